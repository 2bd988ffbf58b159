"""Registry, guard and log as a user meets them, and the numbers behind charts, checked on whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from prepforge.errors import DuplicateDataError
from prepforge.models.forest import fit_forest
from prepforge.models.linear import fit_least_squares
from prepforge.models.mlp import fit_mlp
from prepforge.operators.diagnostics import confusion_matrix, learning_curve
from prepforge.operators.encode import OneHotEncoder
from prepforge.operators.ordering import background_sample, top_features
from prepforge.operators.scale import StandardScaler
from prepforge.plans.attribution import BACKGROUND_ROWS, contributions, mean_absolute
from prepforge.plans.catalog import DatasetCatalog
from prepforge.plans.training import Trainer
from prepforge.queries.base import KEY, query, rounded, table
from prepforge.session import scratch_path, small_frame


def _trainer(spark, d):
    trainer = Trainer(spark, scratch_path(spark, "run"))
    trainer.catalog.register(table(spark, d, "lineitem").select(
        "l_quantity", "l_discount", "l_tax", F.expr("l_extendedprice * (1 - l_discount)").alias("y")), "lines")
    return trainer


def _config(**more):
    return {"dataset_names": ["lines"], "model_type": "linear_regression", "target_column": "y", **more}


@query("default_features", """
    SELECT v.*, row_count FROM (VALUES ('l_quantity', 0::BIGINT), ('l_discount', 1::BIGINT), ('l_tax', 2::BIGINT))
        AS v(feature, place), (SELECT count(*) AS row_count FROM lineitem)""")
def default_features(spark, d):
    """Without a list, all columns but the target are features, in the order of the table."""
    trainer = _trainer(spark, d)
    version, _ = trainer.train(_config())
    model, _ = trainer.registry.load(version)
    names = small_frame(spark, [{"feature": f, "place": i} for i, f in enumerate(model.features)],
                        "feature string, place bigint")
    return names.crossJoin(trainer.registry.history_log.current().select("row_count"))


@query("reuse_guard", """
    SELECT v.*, n AS rows FROM (VALUES ('new', 'completed', '1.0.0', false), ('fine_tune', 'failed', NULL, true))
        AS v(training_mode, status, result_version, told), (SELECT count(*) AS n FROM lineitem)""")
def reuse_guard(spark, d):
    """Fine-tuning on data that the lineage has seen fails; every run has one outcome in the log."""
    trainer = _trainer(spark, d)
    first, _ = trainer.train(_config())
    try:
        trainer.train(_config(training_mode="fine_tune", base_model_version=first))
    except DuplicateDataError:
        pass
    rows = trainer.catalog.entry("lines")["row_count"]
    return trainer.recent_runs().select(
        "training_mode", "status", "result_version",
        F.coalesce(F.col("error_message").contains("overfitting") & F.col("error_message").contains("lines"),
                   F.lit(False)).alias("told"), F.lit(rows).cast("bigint").alias("rows"))


@query("drop_model", """
    SELECT '1.1.0' AS version, NULL AS parent, count(*) AS row_count FROM lineitem""")
def drop_model(spark, d):
    """A dropped model's child loses its parent, its own history rows go."""
    trainer = _trainer(spark, d)
    first, _ = trainer.train(_config())
    trainer.train(_config(training_mode="fine_tune", base_model_version=first, allow_duplicates=True))
    trainer.registry.delete(first)
    return trainer.registry.models().select("version", "parent").join(
        trainer.registry.history_log.current().select("version", "row_count"), "version", "full")


@query("preview_rows", "SELECT 25::BIGINT AS n, 25::BIGINT AS known, 3 AS columns FROM orders LIMIT 1")
def preview_rows(spark, d):
    """A preview has so many rows, all of the registered table."""
    catalog = DatasetCatalog(spark, scratch_path(spark, "catalog"))
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    catalog.register(orders, "orders-24")
    shown = catalog.preview("orders-24", 25)
    known = shown.join(orders, orders.columns, "left_semi").count()
    return shown.agg(F.count(F.lit(1)).alias("n")).select(
        "n", F.lit(known).cast("bigint").alias("known"), F.lit(len(shown.columns)).alias("columns"))


@query("onehot_names", """
    SELECT 'flag_' || l_returnflag AS name FROM lineitem GROUP BY l_returnflag
    UNION ALL SELECT 'status_' || l_linestatus FROM lineitem GROUP BY l_linestatus""")
def onehot_names(spark, d):
    encoder = OneHotEncoder().fit(table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"])
    names = encoder.get_feature_names(["flag", "status"])
    return small_frame(spark, [{"name": n} for n in names], "name string")


@query("background_rows", f"SELECT {BACKGROUND_ROWS}::BIGINT AS n, {BACKGROUND_ROWS}::BIGINT AS known FROM lineitem LIMIT 1")
def background_rows(spark, d):
    """The reference rows of explanations: so many, all of the table, the same however it is stored."""
    lines = table(spark, d, "lineitem").select(*KEY, "l_extendedprice")
    one, other = (background_sample(x, lines.columns, BACKGROUND_ROWS) for x in (lines, lines.repartition(7)))
    both = one.intersectAll(other)
    return both.agg(F.count(F.lit(1)).alias("n")).crossJoin(
        both.join(lines, lines.columns, "left_semi").agg(F.count(F.lit(1)).alias("known")))


_GRID = """
    WITH c AS (SELECT l_returnflag AS y, CASE WHEN l_quantity > 45 THEN 'Z' ELSE 'A' END AS p, count(*) AS n
               FROM lineitem GROUP BY ALL),
    labels AS (SELECT y AS v FROM c UNION SELECT p FROM c),
    grid AS (SELECT a.v AS y, b.v AS p FROM labels a CROSS JOIN labels b)
    SELECT y, p, coalesce(CAST(n AS DOUBLE) / nullif(sum(n) OVER (PARTITION BY y), 0), 0) AS share
    FROM grid LEFT JOIN c USING (y, p)"""


@query("confusion_never_true", _GRID)
def confusion_never_true(spark, d):
    """A class that is predicted but never true has a row of zeros, not of NaN."""
    lines = table(spark, d, "lineitem").select(
        F.col("l_returnflag").alias("y"), F.when(F.col("l_quantity") > 45, "Z").otherwise("A").alias("p"))
    return confusion_matrix(lines, "y", "p", normalize=True)


@query("learning_curve_years", """
    WITH y AS (SELECT year(l_shipdate) AS year, round(avg(l_quantity), 6) + 0.0 AS q, round(avg(l_tax), 6) + 0.0 AS t
               FROM lineitem GROUP BY 1),
    e AS (SELECT CAST(row_number() OVER (ORDER BY year) AS INTEGER) AS epoch, q, t FROM y)
    SELECT epoch, 'train' AS split, q AS score FROM e UNION ALL SELECT epoch, 'val', t FROM e""")
def learning_curve_years(spark, d):
    """Two series of yearly means, as the chart takes them."""
    years = table(spark, d, "lineitem").groupBy(F.year("l_shipdate").alias("year")).agg(
        rounded(F.avg("l_quantity"), 6, "q"), rounded(F.avg("l_tax"), 6, "t")).orderBy("year").collect()
    return learning_curve(spark, [r["q"] for r in years], [r["t"] for r in years])


_INPUTS = ["l_quantity", "l_discount", "l_tax"]


def _scaled(spark, d):
    return StandardScaler().fit_transform(table(spark, d, "lineitem").select(
        *KEY, *_INPUTS, F.expr("(l_quantity * 10 + 300 * l_discount - 100 * l_tax) / 100").alias("y")), _INPUTS)


@query("top_attribution", """
    SELECT 'l_quantity' AS feature, round(0.1 * avg(abs(l_quantity - m)), 4) + 0.0 AS importance
    FROM lineitem, (SELECT avg(l_quantity) AS m FROM lineitem)""")
def top_attribution(spark, d):
    """The feature with the largest mean contribution to an exactly linear target."""
    lines = _scaled(spark, d)
    model = fit_least_squares(lines, _INPUTS, "y")
    return top_features(mean_absolute(contributions(lines, model), _INPUTS), 1).select(
        "feature", rounded("importance", 4))


@query("forest_importances", """
    SELECT 'l_quantity' AS feature, true AS first, CAST(1 AS DOUBLE) AS total FROM lineitem LIMIT 1""")
def forest_importances(spark, d):
    """Importances add up to 1; the feature that moves the target most comes first."""
    model = fit_forest(_scaled(spark, d), _INPUTS, "y", n_estimators=5, max_depth=6)
    found = model.importances(spark)
    best = top_features(found, 1).select("feature", (F.col("importance") > 0.5).alias("first"))
    return best.crossJoin(found.agg(F.round(F.sum("importance"), 6).alias("total")))


@query("mlp_shap_adds_up", "SELECT count(*) AS n, count(*) AS exact, true AS better FROM lineitem")
def mlp_shap_adds_up(spark, d):
    """A network beats the mean after one epoch; contributions of every row add up to its answer less the reference's."""
    lines = _scaled(spark, d).cache()
    model, history = fit_mlp(lines, _INPUTS, "y", epochs=1, validation=lines)
    spread = lines.agg(F.var_pop("y")).first()[0]
    base = model.predict(background_sample(lines, _INPUTS, BACKGROUND_ROWS), "p").agg(F.avg("p")).first()[0]
    phi = contributions(model.predict(lines), model, ["prediction"])
    gap = sum(F.col(f"phi_{f}") for f in _INPUTS) + F.lit(base) - F.col("prediction")
    return phi.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.abs(gap) < 1e-6).alias("exact")).withColumn(
        "better", F.lit(history[-1][1] < spread))
