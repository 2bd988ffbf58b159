"""Training, scoring and attribution."""

from __future__ import annotations

from pyspark.sql import functions as F

from prepforge.functions.columns import split_threshold
from prepforge.models import sgd
from prepforge.models.forest import fit_forest, fit_forest_classifier
from prepforge.models.linear import LinearModel, fit_least_squares
from prepforge.models.mlp import fit_mlp
from prepforge.models.sgd import fit_sgd
from prepforge.operators.metrics import regression_metrics, split_metrics
from prepforge.operators.ordering import top_features
from prepforge.operators.scale import StandardScaler
from prepforge.operators.split import with_split
from prepforge.plans.attribution import (
    contributions, lime, mean_absolute, shap_importance, standard_deviations)
from prepforge.plans.preparation import apply_preprocessing_pipeline
from prepforge.plans.scoring import Predictor
from prepforge.plans.training import Trainer
from prepforge.queries.base import GAPPY_PRICE, KEY, KEYS, query, rounded, table
from prepforge.session import scratch_path, small_frame

_VAL = (f"substr(md5(concat_ws('-', {KEYS}, '42')), 1, 8) < '{split_threshold(0.2)}'")
_TARGET = "l_extendedprice * (1 - l_discount)"

# least squares on one imputed feature -----------------------------------------

_FITTED = f"""
    WITH t AS (SELECT {KEYS}, {GAPPY_PRICE} AS price, {_TARGET} AS y,
                      CASE WHEN {_VAL} THEN 'val' ELSE 'train' END AS split FROM lineitem),
    x AS (SELECT * EXCLUDE (price), coalesce(price, (SELECT avg(price) FROM t)) AS x FROM t),
    m AS (SELECT regr_slope(y, x) AS a, regr_intercept(y, x) AS b FROM x WHERE split = 'train'),
    s AS (SELECT x.*, b + a * x AS p FROM x, m)"""


def _prepared(spark, d):
    lines = table(spark, d, "lineitem").select(
        *KEY, F.expr(GAPPY_PRICE).alias("price"), F.expr(_TARGET).alias("y"))
    prepared, _ = apply_preprocessing_pipeline(
        with_split(lines, KEY), {"scale": True}, carried=[*KEY, "y", "split"])
    return prepared


def least_squares_metrics(spark, d):
    """Impute, scale, split, fit on the training part, score all, one row per split."""
    prepared = _prepared(spark, d)
    model = fit_least_squares(prepared.where("split = 'train'"), ["price"], "y")
    return regression_metrics(model.predict(prepared), "y", "prediction", ["split"])


@query("train_ols_metrics", _FITTED + """
    SELECT split, count(*) AS n, round(avg(abs(y - p)), 4) + 0.0 AS mae,
           round(avg(pow(y - p, 2)), 2) + 0.0 AS mse, round(sqrt(avg(pow(y - p, 2))), 4) + 0.0 AS rmse,
           round(1 - sum(pow(y - p, 2)) / (var_pop(y) * count(y)), 8) + 0.0 AS r2 FROM s GROUP BY split""")
def train_ols_metrics(spark, d):
    return least_squares_metrics(spark, d).select(
        "split", "n", rounded("mae", 4), rounded("mse", 2), rounded("rmse", 4), rounded("r2", 8))


@query("score_ols", _FITTED + f"SELECT {KEYS}, split, round(p, 2) + 0.0 AS prediction FROM s")
def score_ols(spark, d):
    prepared = _prepared(spark, d)
    model = fit_least_squares(prepared.where("split = 'train'"), ["price"], "y")
    return model.predict(prepared).select(*KEY, "split", rounded("prediction", 2))


def _weights(spark, model: LinearModel):
    rows = [{"term": t, "weight": w} for t, w in
            [*zip(model.features, model.weights), ("intercept", model.intercept)]]
    return small_frame(spark, rows, "term string, weight double")


_TWO = f"""
    WITH t AS (SELECT {KEYS}, l_quantity AS x1, l_discount AS x2, {_TARGET} AS y FROM lineitem),
    c AS (SELECT var_pop(x1) AS v1, var_pop(x2) AS v2, covar_pop(x1, x2) AS c12,
                 covar_pop(x1, y) AS c1, covar_pop(x2, y) AS c2,
                 avg(x1) AS m1, avg(x2) AS m2, avg(y) AS my FROM t),
    w AS (SELECT (c1 * v2 - c2 * c12) / (v1 * v2 - c12 * c12) AS w1,
                 (c2 * v1 - c1 * c12) / (v1 * v2 - c12 * c12) AS w2, m1, m2, my FROM c)"""


def _two(spark, d):
    return table(spark, d, "lineitem").select(
        *KEY, F.col("l_quantity").alias("x1"), F.col("l_discount").alias("x2"),
        F.expr(_TARGET).alias("y"))


@query("train_ols_two_features", _TWO + """
    SELECT 'x1' AS term, round(w1, 4) + 0.0 AS weight FROM w
    UNION ALL SELECT 'x2', round(w2, 4) + 0.0 FROM w
    UNION ALL SELECT 'intercept', round(my - w1 * m1 - w2 * m2, 4) + 0.0 FROM w""")
def train_ols_two_features(spark, d):
    model = fit_least_squares(_two(spark, d), ["x1", "x2"], "y")
    return _weights(spark, model).select("term", rounded("weight", 4))


@query("train_ols_collinear", _TWO + """
    SELECT 'x1' AS term, round(w1 / 2, 4) + 0.0 AS weight FROM w
    UNION ALL SELECT 'again', round(w1 / 2, 4) + 0.0 FROM w
    UNION ALL SELECT 'x2', round(w2, 4) + 0.0 FROM w
    UNION ALL SELECT 'intercept', round(my - w1 * m1 - w2 * m2, 4) + 0.0 FROM w""")
def train_ols_collinear(spark, d):
    """A feature given twice: of all best weights those of least length."""
    model = fit_least_squares(_two(spark, d).withColumn("again", F.col("x1")), ["x1", "again", "x2"], "y")
    return _weights(spark, model).select("term", rounded("weight", 4))


@query("linear_shap", _TWO + """
    SELECT 'x1' AS feature, round(avg(abs(w1 * (x1 - m1))), 4) + 0.0 AS importance FROM t, w
    UNION ALL SELECT 'x2', round(avg(abs(w2 * (x2 - m2))), 4) + 0.0 FROM t, w""")
def linear_shap(spark, d):
    lines = _two(spark, d)
    model = fit_least_squares(lines, ["x1", "x2"], "y")
    return shap_importance(lines, model).select("feature", rounded("importance", 4))


@query("linear_shap_rows", _TWO + f"""
    SELECT {KEYS}, round(w1 * (x1 - m1), 2) + 0.0 AS phi_x1, round(w2 * (x2 - m2), 2) + 0.0 AS phi_x2
    FROM t, w""")
def linear_shap_rows(spark, d):
    lines = _two(spark, d)
    model = fit_least_squares(lines, ["x1", "x2"], "y")
    return contributions(lines, model, KEY).select(*KEY, rounded("phi_x1", 2), rounded("phi_x2", 2))


@query("lime_rows", """
    WITH c AS (SELECT var_pop(p_size) AS v1, stddev_pop(p_partkey) AS s2, stddev_pop(p_size) AS s1,
                 var_pop(p_partkey) AS v2, covar_pop(p_size, p_partkey) AS c12,
                 covar_pop(p_size, p_retailprice) AS c1, covar_pop(p_partkey, p_retailprice) AS c2 FROM part),
    w AS (SELECT (c1 * v2 - c2 * c12) / (v1 * v2 - c12 * c12) * s1 AS w1,
                 (c2 * v1 - c1 * c12) / (v1 * v2 - c12 * c12) * s2 AS w2 FROM c)
    SELECT p_partkey, 'size' AS feature, round(w1, 4) + 0.0 AS weight FROM part, w
    UNION ALL SELECT p_partkey, 'key', round(w2, 4) + 0.0 FROM part, w""")
def lime_rows(spark, d):
    """Every part explained; around a linear model the answer is the model itself."""
    parts = table(spark, d, "part").select(
        "p_partkey", F.col("p_size").cast("double").alias("size"),
        F.col("p_partkey").cast("double").alias("key"), "p_retailprice")
    model = fit_least_squares(parts, ["size", "key"], "p_retailprice")
    out = lime(parts, model, "p_partkey", standard_deviations(parts, model.features),
               samples=64, ridge=0.0)
    return out.select("p_partkey", "feature", rounded("weight", 4))


# a full configured run ---------------------------------------------------------

_RUN = f"""
    WITH t AS (SELECT {KEYS}, {GAPPY_PRICE} AS price, {_TARGET} AS y,
                      CASE WHEN {_VAL} THEN 'val' ELSE 'train' END AS split FROM lineitem),
    x AS (SELECT * EXCLUDE (price), coalesce(price, (SELECT avg(price) FROM t)) AS x FROM t),
    m AS (SELECT regr_slope(y, x) AS a, regr_intercept(y, x) AS b FROM x WHERE split = 'train')"""


def _run_config(**more):
    return {"dataset_names": ["lines"], "model_type": "linear_regression", "target_column": "y",
            "feature_columns": ["price"], "split_key": KEY, **more}


def _register_lines(spark, d, trainer):
    lines = table(spark, d, "lineitem").select(
        *KEY, F.expr(GAPPY_PRICE).alias("price"), F.expr(_TARGET).alias("y"))
    trainer.catalog.register(lines, "lines")


@query("training_run", _RUN + """, s AS (SELECT x.*, b + a * x AS p FROM x, m),
    g AS (SELECT split, avg(abs(y - p)) AS mae, avg(pow(y - p, 2)) AS mse,
          1 - sum(pow(y - p, 2)) / (var_pop(y) * count(y)) AS r2 FROM s GROUP BY split)
    SELECT '1.0.0' AS version, metric, value FROM (
        SELECT split || '_mae' AS metric, round(mae, 4) + 0.0 AS value FROM g
        UNION ALL SELECT split || '_mse', round(mse, 2) + 0.0 FROM g
        UNION ALL SELECT split || '_r2', round(r2, 6) + 0.0 FROM g)""")
def training_run(spark, d):
    """Register a table, train from a configuration, read the registered metrics."""
    trainer = Trainer(spark, scratch_path(spark, "run"))
    _register_lines(spark, d, trainer)
    version, _ = trainer.train(_run_config())
    stored = trainer.registry.models().where(F.col("version") == version)
    digits = F.when(F.col("metric").endswith("_mse"), 2).when(F.col("metric").endswith("_r2"), 6).otherwise(4)
    return stored.select("version", F.explode("metrics").alias("metric", "value")).select(
        "version", "metric", F.when(digits == 2, F.round("value", 2)).when(
            digits == 6, F.round("value", 6)).otherwise(F.round("value", 4)).alias("value"))


@query("training_lineage", """
    SELECT * FROM (VALUES ('1.1.0', 0::BIGINT, 'fine_tune'), ('1.0.0', 1::BIGINT, 'new'))
        AS v(version, depth, training_mode), (SELECT count(*) AS row_count FROM lineitem)""")
def training_lineage(spark, d):
    """Train, fine-tune on the same data (allowed), and follow the lineage back."""
    from prepforge.operators.lineage import lineage

    trainer = Trainer(spark, scratch_path(spark, "run"))
    _register_lines(spark, d, trainer)
    first, _ = trainer.train(_run_config())
    second, _ = trainer.train(_run_config(
        training_mode="fine_tune", base_model_version=first, allow_duplicates=True))
    models = trainer.registry.models()
    chain = lineage(models, models.where(F.col("version") == second).select("version"))
    return chain.join(models.select("version", "training_mode"), "version").join(
        trainer.registry.history_log.current().select("version", "row_count"), "version"
    ).select("version", "depth", "training_mode", "row_count")


@query("inference_log", _RUN + f"""
    SELECT '1.0.0' AS model_version, count(*) AS n, round(avg(b + a * l_extendedprice), 2) + 0.0 AS mean_prediction
    FROM lineitem, m""")
def inference_log(spark, d):
    """Score a whole table with a registered model; the log holds every row."""
    root = scratch_path(spark, "run")
    trainer = Trainer(spark, root)
    _register_lines(spark, d, trainer)
    version, _ = trainer.train(_run_config())
    predictor = Predictor(spark, root)
    rows = table(spark, d, "lineitem").select(*KEY, F.col("l_extendedprice").alias("price"))
    predictor.predict(version, rows)["frame"].unpersist()
    return predictor.log_rows().groupBy("model_version").agg(
        F.count(F.lit(1)).alias("n"), rounded(F.avg(F.col("prediction").cast("double")), 2, "mean_prediction"))


@query("score_file", _RUN + """
    SELECT count(*) AS n, round(avg(b + a * p_retailprice), 4) + 0.0 AS mean_prediction FROM part, m""")
def score_file(spark, d):
    """Score a CSV file with a registered model."""
    root = scratch_path(spark, "run")
    trainer = Trainer(spark, root)
    _register_lines(spark, d, trainer)
    version, _ = trainer.train(_run_config())
    path = f"{root}/parts.csv"
    table(spark, d, "part").select("p_name", F.col("p_retailprice").alias("price")).write.option(
        "header", True).csv(path)
    scored = Predictor(spark, root).predict_file(version, path)["frame"]
    return scored.agg(F.count(F.lit(1)).alias("n"), rounded(F.avg("prediction"), 4, "mean_prediction"))


# iterative and tree models -------------------------------------------------------

_INPUTS = ["l_quantity", "l_discount", "l_tax"]


def _scaled_lines(spark, d):
    lines = table(spark, d, "lineitem").select(
        *KEY, *_INPUTS, F.expr("(l_quantity * 10 + 300 * l_discount - 100 * l_tax) / 100").alias("y"))
    return StandardScaler().fit_transform(lines, _INPUTS)


_LINEAR_SQL = """
    SELECT 'l_quantity' AS term, round(0.1 * stddev_pop(l_quantity), 2) + 0.0 AS weight FROM lineitem
    UNION ALL SELECT 'l_discount', round(3.0 * stddev_pop(l_discount), 2) + 0.0 FROM lineitem
    UNION ALL SELECT 'l_tax', round(-1.0 * stddev_pop(l_tax), 2) + 0.0 FROM lineitem
    UNION ALL SELECT 'intercept',
        round(0.1 * avg(l_quantity) + 3.0 * avg(l_discount) - avg(l_tax), 2) + 0.0 FROM lineitem"""


@query("train_sgd", _LINEAR_SQL)
def train_sgd(spark, d):
    """Gradient descent on an exactly linear target; checked to two digits."""
    model, _ = fit_sgd(_scaled_lines(spark, d), _INPUTS, "y")
    return _weights(spark, model).select("term", rounded("weight", 2))


@query("fine_tune_sgd", _LINEAR_SQL)
def fine_tune_sgd(spark, d):
    """A model from the first year goes on with all lines for one epoch."""
    lines = _scaled_lines(spark, d)
    early = lines.join(
        table(spark, d, "orders").where("year(o_orderdate) = 1995").select(
            F.col("o_orderkey").alias("l_orderkey")), "l_orderkey", "left_semi")
    base, _ = fit_sgd(early, _INPUTS, "y")
    model, _ = fit_sgd(lines, _INPUTS, "y", start=base, max_iter=1)
    return _weights(spark, model).select("term", rounded("weight", 2))


@query("fine_tune_rows", """
    SELECT round(regr_slope(y, x), 1) + 0.0 AS slope, round(regr_intercept(y, x), 1) + 0.0 AS intercept, count(*) AS rows
    FROM (SELECT (l_quantity - avg(l_quantity) OVER ()) / stddev_pop(l_quantity) OVER () AS x,
                 l_quantity / 10 AS y FROM lineitem)""")
def fine_tune_rows(spark, d):
    """A model of an older relation goes once over the rows of a new one and ends there; steps count its rows."""
    lines = StandardScaler().fit_transform(table(spark, d, "lineitem").select(
        F.col("l_quantity").alias("x"), (F.col("l_quantity") / 10).alias("y")), ["x"])
    old, _ = fit_sgd(lines.withColumn("y", -F.col("y")).limit(2000), ["x"], "y", max_iter=1)
    model, history = fit_sgd(lines, ["x"], "y", start=old, max_iter=1)
    parts = max(1, -(-lines.count() // sgd.PART_ROWS))
    rows = round((model.extra["steps"] - old.extra["steps"]) * parts) if len(history) == 1 else 0
    return small_frame(spark, [{"slope": round(model.weights[0], 1), "intercept": round(model.intercept, 1), "rows": rows}],
                       "slope double, intercept double, rows bigint")


@query("train_forest")
def train_forest(spark, d):
    lines = with_split(_scaled_lines(spark, d), KEY)
    model = fit_forest(lines.where("split = 'train'"), _INPUTS, "y")
    return split_metrics(model.predict(lines), "y", "prediction", False)


def _level_sql(level: int, parents: str) -> str:
    """The best cut of every group of ``parents`` (g, x0, x1, y): lowest feature, then lowest value, of equal gains."""
    return f"""
    cells{level} AS (
      SELECT g, f, x, count(*) AS w, sum(y) AS s
      FROM (SELECT g, 0 AS f, x0 AS x, y FROM {parents} UNION ALL SELECT g, 1, x1, y FROM {parents}) GROUP BY ALL),
    run{level} AS (
      SELECT g, f, x, lead(x) OVER o AS nx, sum(w) OVER o AS wl, sum(s) OVER o AS sl,
        sum(w) OVER (PARTITION BY g, f) AS wt, sum(s) OVER (PARTITION BY g, f) AS st
      FROM cells{level} WINDOW o AS (PARTITION BY g, f ORDER BY x)),
    best{level} AS (
      SELECT g, f, (x + nx) / 2 AS cut, wt, st FROM run{level} WHERE nx IS NOT NULL
      QUALIFY row_number() OVER (PARTITION BY g ORDER BY
        pow(sl - wl * st / wt, 2) * (1 / wl + 1 / (wt - wl)) DESC, f, x) = 1)"""


@query("tree_nodes", f"""
    WITH t0 AS (SELECT 0 AS g, l_quantity AS x0, l_discount AS x1, l_extendedprice AS y FROM lineitem),
    {_level_sql(0, "t0")},
    t1 AS (SELECT 2 * g + CASE WHEN CASE WHEN f = 0 THEN x0 ELSE x1 END <= cut THEN 1 ELSE 2 END AS g, x0, x1, y
           FROM t0 JOIN best0 USING (g)),
    {_level_sql(1, "t1")},
    t2 AS (SELECT 2 * g + CASE WHEN CASE WHEN f = 0 THEN x0 ELSE x1 END <= cut THEN 1 ELSE 2 END AS g, y
           FROM t1 JOIN best1 USING (g))
    SELECT g AS node, CASE f WHEN 0 THEN 'l_quantity' ELSE 'l_discount' END AS feature, round(cut, 6) + 0.0 AS threshold,
           CAST(wt AS DOUBLE) AS weight, round(st / wt, 4) + 0.0 AS value
    FROM (SELECT * FROM best0 UNION ALL SELECT * FROM best1)
    UNION ALL SELECT g, NULL, NULL, CAST(count(*) AS DOUBLE), round(avg(y), 4) + 0.0 FROM t2 GROUP BY g""")
def tree_nodes(spark, d):
    """One tree of two levels on all rows: its cuts are those that SQL finds."""
    lines = table(spark, d, "lineitem").select("l_quantity", "l_discount", "l_extendedprice")
    model = fit_forest(lines, ["l_quantity", "l_discount"], "l_extendedprice", n_estimators=1, max_depth=2, bootstrap=False)
    return model.nodes(spark).select("node", "feature", F.when(
        F.col("feature").isNotNull(), F.round("threshold", 6)).alias("threshold"), "weight", rounded("value", 4))


def _documents(spark, d):
    docs = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    words = F.size(F.split(F.trim("text"), r"\s+")).cast("double")
    return docs.select(
        "doc_id", F.col("n_chars").cast("double").alias("n_chars"), words.alias("n_words"),
        (F.length(F.regexp_replace("text", "[^0-9]", "")) / F.greatest(F.length("text"), F.lit(1))).alias("digits"),
        "quality")


@query("train_forest_classifier")
def train_forest_classifier(spark, d):
    docs = with_split(_documents(spark, d), ["doc_id"])
    model = fit_forest_classifier(
        docs.where("split = 'train'"), ["n_chars", "n_words", "digits"], "quality")
    return split_metrics(model.predict(docs), "quality", "prediction", True)


@query("feature_importance_top_n")
def feature_importance_top_n(spark, d):
    model = fit_forest(_scaled_lines(spark, d), _INPUTS, "y")
    return top_features(model.importances(spark), 2)


@query("tree_shap")
def tree_shap(spark, d):
    lines = _scaled_lines(spark, d)
    model = fit_forest(lines, _INPUTS, "y", n_estimators=5, max_depth=5)
    return shap_importance(lines, model)


@query("tree_shap_adds_up", "SELECT count(*) AS n, count(*) AS exact FROM lineitem")
def tree_shap_adds_up(spark, d):
    """Contributions of every row against its prediction less the mean output."""
    lines = _scaled_lines(spark, d)
    model = fit_forest(lines, _INPUTS, "y", n_estimators=5, max_depth=5)
    expected = model.expected(spark)
    phi = contributions(model.predict(lines), model, [*KEY, "prediction"])
    total = sum(F.col(f"phi_{f}") for f in _INPUTS)
    return phi.agg(F.count(F.lit(1)).alias("n"), F.count_if(
        F.abs(total + F.lit(expected) - F.col("prediction")) < 1e-6).alias("exact"))


@query("train_mlp")
def train_mlp(spark, d):
    lines = with_split(_scaled_lines(spark, d), KEY).cache()
    model, _ = fit_mlp(lines.where("split = 'train'"), _INPUTS, "y", epochs=3)
    return split_metrics(model.predict(lines), "y", "prediction", False)


@query("mlp_learning_curve")
def mlp_learning_curve(spark, d):
    from prepforge.operators.diagnostics import learning_curve

    lines = with_split(_scaled_lines(spark, d), KEY).cache()
    _, scores = fit_mlp(lines.where("split = 'train'"), _INPUTS, "y", epochs=3,
                        validation=lines.where("split = 'val'"))
    return learning_curve(spark, [t for t, _ in scores], [v for _, v in scores])


@query("mlp_shap")
def mlp_shap(spark, d):
    lines = _scaled_lines(spark, d).cache()
    model, _ = fit_mlp(lines, _INPUTS, "y", epochs=1)
    return mean_absolute(contributions(lines, model), _INPUTS)
