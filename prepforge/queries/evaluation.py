"""Metrics, ROC, confusion matrix and the numbers behind diagnostic charts."""

from __future__ import annotations

from pyspark.sql import functions as F

from prepforge.operators.diagnostics import (
    class_set, confusion_matrix, confusion_shares, residual_histogram, residuals, value_range)
from prepforge.operators.metrics import (
    classification_metrics, confusion_cells, regression_metrics, split_metrics)
from prepforge.operators.ordering import background_sample
from prepforge.operators.roc import roc_auc_frame, roc_curve
from prepforge.operators.split import with_split
from prepforge.queries.base import KEY, KEYS, query, rounded, table

# a fixed formula stands in for a model: the tables hold no predictions
_Y, _P = "l_extendedprice", "l_quantity * 2100 * (1 - l_discount)"


def _priced(spark, d, *more):
    return table(spark, d, "lineitem").select(
        *more, F.col(_Y).alias("y"), F.expr(_P).alias("p"))


_PRICED = f"SELECT {KEYS}, l_returnflag, l_linestatus, {_Y} AS y, {_P} AS p FROM lineitem"
_REGRESSION = """count(*) AS n, round(avg(abs(y - p)), 4) + 0.0 AS mae,
    round(avg(pow(y - p, 2)), 1) + 0.0 AS mse, round(sqrt(avg(pow(y - p, 2))), 4) + 0.0 AS rmse,
    round(1 - sum(pow(y - p, 2)) / (var_pop(y) * count(y)), 8) + 0.0 AS r2"""


def _shown(frame, *by):
    return frame.select(*by, "n", rounded("mae", 4), rounded("mse", 1), rounded("rmse", 4),
                        rounded("r2", 8))


@query("metrics_regression", f"SELECT {_REGRESSION} FROM ({_PRICED})")
def metrics_regression(spark, d):
    return _shown(regression_metrics(_priced(spark, d), "y", "p"))


@query("metrics_regression_by_group",
       f"SELECT l_returnflag, {_REGRESSION} FROM ({_PRICED}) GROUP BY l_returnflag")
def metrics_regression_by_group(spark, d):
    by = ["l_returnflag"]
    return _shown(regression_metrics(_priced(spark, d, *by), "y", "p", by), *by)


@query("metrics_constant_truth", f"""
    SELECT count(*) AS n, round(avg(abs(3 - p)), 4) + 0.0 AS mae, 0.0::DOUBLE AS r2 FROM ({_PRICED})""")
def metrics_constant_truth(spark, d):
    frame = _priced(spark, d).withColumn("y", F.lit(3.0))
    return regression_metrics(frame, "y", "p").select("n", rounded("mae", 4), "r2")


_GUESS = "CASE WHEN l_quantity < 15 THEN 'A' WHEN l_quantity < 35 THEN 'N' ELSE 'R' END"
_GUESSED = f"SELECT l_returnflag AS y, {_GUESS} AS p, {KEYS} FROM lineitem"


def _guessed(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_returnflag").alias("y"), F.expr(_GUESS).alias("p"))


_PER_CLASS = f"""
    WITH t AS ({_GUESSED}), c AS (SELECT DISTINCT unnest([y, p]) AS label FROM t),
    k AS (SELECT label, (SELECT count(*) FROM t WHERE y = label AND p = label) AS tp,
                 (SELECT count(*) FROM t WHERE p = label) AS predicted,
                 (SELECT count(*) FROM t WHERE y = label) AS support FROM c),
    r AS (SELECT *, CASE WHEN predicted > 0 THEN tp / predicted ELSE 0 END AS prec,
                 CASE WHEN support > 0 THEN tp / support ELSE 0 END AS rec FROM k),
    a AS (SELECT CAST(sum(support) AS BIGINT) AS n, sum(tp) / sum(support) AS accuracy,
                 {{prec}} AS precision, {{rec}} AS recall FROM r)
    SELECT n, round(accuracy, 10) + 0.0 AS accuracy, round(precision, 10) + 0.0 AS precision,
           round(recall, 10) + 0.0 AS recall,
           round(CASE WHEN precision + recall = 0 THEN 0
                 ELSE 2 * precision * recall / (precision + recall) END, 10) + 0.0 AS f1 FROM a"""


def _averaged(spark, d, average, pos_label=1):
    out = classification_metrics(_guessed(spark, d), "y", "p", average, pos_label)
    return out.select("n", *[rounded(c, 10) for c in ("accuracy", "precision", "recall", "f1")])


@query("metrics_binary", _PER_CLASS.format(
    prec="max(CASE WHEN label = 'R' THEN prec END)", rec="max(CASE WHEN label = 'R' THEN rec END)"))
def metrics_binary(spark, d):
    return _averaged(spark, d, "binary", "R")


@query("metrics_macro", _PER_CLASS.format(prec="avg(prec)", rec="avg(rec)"))
def metrics_macro(spark, d):
    return _averaged(spark, d, "macro")


@query("metrics_weighted", _PER_CLASS.format(
    prec="sum(prec * support) / sum(support)", rec="sum(rec * support) / sum(support)"))
def metrics_weighted(spark, d):
    return _averaged(spark, d, "weighted")


@query("metrics_micro", _PER_CLASS.format(
    prec="sum(tp) / sum(predicted)", rec="sum(tp) / sum(support)"))
def metrics_micro(spark, d):
    return _averaged(spark, d, "micro")


_SPLIT = """CASE WHEN substr(md5(concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_linenumber, '42')),
    1, 8) < '33333333' THEN 'val' ELSE 'train' END"""


@query("metrics_per_split", f"""
    WITH m AS (SELECT {_SPLIT} AS split, avg(abs(y - p)) AS mae, avg(pow(y - p, 2)) AS mse,
                      1 - sum(pow(y - p, 2)) / (var_pop(y) * count(y)) AS r2 FROM ({_PRICED}) GROUP BY 1)
    SELECT split || '_mae' AS metric, round(mae, 4) + 0.0 AS value FROM m
    UNION ALL SELECT split || '_mse', round(mse, 4) + 0.0 FROM m
    UNION ALL SELECT split || '_r2', round(r2, 4) + 0.0 FROM m""")
def metrics_per_split(spark, d):
    frame = with_split(_priced(spark, d, *KEY), KEY)
    return split_metrics(frame, "y", "p", False).select("metric", rounded("value", 4))


# ROC -------------------------------------------------------------------------

def _judged(spark, d):
    return table(spark, d, "documents").select("doc_id", "n_chars").join(
        table(spark, d, "labels"), "doc_id").select("quality", "n_chars")


def _auc_sql(source: str) -> str:
    """Rank sum with average ranks for ties."""
    return f"""
    WITH t AS ({source}), r AS (
        SELECT hit, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2 AS k FROM t),
    s AS (SELECT CAST(sum(hit) AS BIGINT) AS n_pos, CAST(sum(1 - hit) AS BIGINT) AS n_neg,
                 sum(CASE WHEN hit = 1 THEN k END) AS ranks FROM r)
    SELECT n_pos, n_neg, round(CASE WHEN n_pos = 0 OR n_neg = 0 THEN 0.5 ELSE
        (ranks - n_pos * (n_pos + 1) / 2) / (CAST(n_pos AS DOUBLE) * n_neg) END, 8) + 0.0 AS auc FROM s"""


_DOCS = "SELECT quality AS hit, n_chars AS score FROM documents JOIN labels USING (doc_id)"
_LINES = "SELECT CAST(l_returnflag = 'R' AS INT) AS hit, l_quantity AS score FROM lineitem"


@query("roc_auc", _auc_sql(_DOCS))
def roc_auc(spark, d):
    return roc_auc_frame(_judged(spark, d), "quality", "n_chars").withColumn("auc", rounded("auc", 8))


@query("roc_auc_ties", _auc_sql(_LINES))
def roc_auc_ties(spark, d):
    """Fifty distinct scores over all lines: almost every pair is tied."""
    out = roc_auc_frame(table(spark, d, "lineitem"), "l_returnflag", "l_quantity", "R")
    return out.withColumn("auc", rounded("auc", 8))


@query("roc_auc_one_class", _auc_sql(_LINES.replace("= 'R'", "<> ''")))
def roc_auc_one_class(spark, d):
    frame = table(spark, d, "lineitem").select(F.lit(1).alias("y"), "l_quantity")
    return roc_auc_frame(frame, "y", "l_quantity")


@query("roc_curve", f"""
    WITH t AS ({_DOCS}), g AS (SELECT CAST(score AS DOUBLE) AS score, sum(hit) AS p, sum(1 - hit) AS n
                               FROM t GROUP BY 1),
    c AS (SELECT score, sum(p) OVER w AS tp, sum(n) OVER w AS fp FROM g WINDOW w AS (ORDER BY score DESC))
    SELECT score, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp,
           round(tp / (SELECT sum(p) FROM g), 10) + 0.0 AS tpr,
           round(fp / (SELECT sum(n) FROM g), 10) + 0.0 AS fpr FROM c""")
def roc_points(spark, d):
    return roc_curve(_judged(spark, d), "quality", "n_chars").withColumns(
        {c: rounded(c, 10) for c in ("tpr", "fpr")})


# confusion -------------------------------------------------------------------

_GRID = f"""
    WITH t AS ({_GUESSED}), c AS (SELECT DISTINCT unnest([y, p]) AS label FROM t),
    n AS (SELECT a.label AS y, b.label AS p,
                 (SELECT count(*) FROM t WHERE t.y = a.label AND t.p = b.label) AS n FROM c a, c b)"""


@query("confusion_matrix", _GRID + "SELECT y, p, n FROM n")
def confusion(spark, d):
    return confusion_matrix(_guessed(spark, d), "y", "p")


@query("confusion_normalized", _GRID + """
    SELECT y, p, round(coalesce(n / nullif(sum(n) OVER (PARTITION BY y), 0), 0), 10) + 0.0 AS share FROM n""")
def confusion_normalized(spark, d):
    return confusion_matrix(_guessed(spark, d), "y", "p", normalize=True).withColumn(
        "share", rounded("share", 10))


@query("confusion_cells", f"SELECT y, p, count(*) AS n FROM ({_GUESSED}) GROUP BY y, p")
def cells(spark, d):
    return confusion_cells(_guessed(spark, d), "y", "p")


@query("class_set", f"SELECT y AS label FROM ({_GUESSED}) UNION SELECT p FROM ({_GUESSED})")
def classes(spark, d):
    return class_set(_guessed(spark, d), "y", "p")


@query("confusion_many_classes", """
    WITH c AS (SELECT l_partkey AS y, (l_partkey + l_linenumber) % 5000 AS p, count(*) AS n FROM lineitem GROUP BY 1, 2)
    SELECT y, p, n, round(n / sum(n) OVER (PARTITION BY y), 8) + 0.0 AS share FROM c""")
def confusion_many_classes(spark, d):
    """Occurring class pairs and shares for as many classes as there are parts."""
    lines = table(spark, d, "lineitem").select(
        F.col("l_partkey").alias("y"), ((F.col("l_partkey") + F.col("l_linenumber")) % 5000).alias("p"))
    return confusion_shares(lines, "y", "p").withColumn("share", rounded("share", 8))


@query("metrics_binary_absent_label", f"""
    SELECT count(*) AS n, round(avg((y = p)::INT), 8) + 0.0 AS accuracy,
           0.0::DOUBLE AS "precision", 0.0::DOUBLE AS recall, 0.0::DOUBLE AS f1 FROM ({_GUESSED})""")
def metrics_binary_absent_label(spark, d):
    """Text labels and the default positive label 1, which none of them is."""
    out = classification_metrics(_guessed(spark, d), "y", "p")
    return out.withColumn("accuracy", rounded("accuracy", 8))


# charts ----------------------------------------------------------------------

@query("residual_points", f"""
    SELECT {KEYS}, y AS actual, round(p, 6) + 0.0 AS predicted, round(y - p, 6) + 0.0 AS residual
    FROM ({_PRICED})""")
def residual_points(spark, d):
    return residuals(_priced(spark, d, *KEY), "y", "p", KEY).withColumns(
        {c: rounded(c, 6) for c in ("predicted", "residual")})


@query("residual_histogram", f"""
    WITH r AS (SELECT y - p AS r FROM ({_PRICED})),
    e AS (SELECT min(r) AS a, (max(r) - min(r)) / 30 AS w FROM r),
    h AS (SELECT CAST(least(floor((r - a) / w), 29) AS BIGINT) AS bin, count(*) AS n FROM r, e GROUP BY 1)
    SELECT b.range AS bin, round(a + b.range * w, 4) + 0.0 AS low,
           round(a + (b.range + 1) * w, 4) + 0.0 AS high, coalesce(n, 0) AS n
    FROM range(30) b CROSS JOIN e LEFT JOIN h ON h.bin = b.range""")
def histogram_of_residuals(spark, d):
    return residual_histogram(_priced(spark, d), "y", "p").withColumns(
        {c: rounded(c, 4) for c in ("low", "high")})


@query("pred_actual_range", f"""
    SELECT round(least(min(y), min(p)), 6) + 0.0 AS low, round(greatest(max(y), max(p)), 6) + 0.0 AS high
    FROM ({_PRICED})""")
def pred_actual_range(spark, d):
    return value_range(_priced(spark, d), "y", "p").select(rounded("low", 6), rounded("high", 6))


@query("background_sample")
def background(spark, d):
    """At most 100 rows picked by value hash; the same ones in every run."""
    return background_sample(table(spark, d, "lineitem"), ["l_quantity", "l_discount", "l_tax"])
