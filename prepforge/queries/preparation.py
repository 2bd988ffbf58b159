"""Loading, profiling, imputation, scaling, encoding, features, splitting."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from prepforge.functions.columns import view_name, without_nan
from prepforge.operators.concat import concat, selection_summary
from prepforge.operators.encode import LabelEncoder, OneHotEncoder
from prepforge.operators.features import create_polynomial_features
from prepforge.operators.impute import handle_missing_values
from prepforge.operators.ordering import newest_first
from prepforge.operators.profile import profile
from prepforge.operators.scale import MinMaxScaler, RobustScaler, StandardScaler
from prepforge.operators.split import train_test_split, with_split
from prepforge.plans.preparation import PreprocessingPipeline, apply_preprocessing_pipeline
from prepforge.queries.base import GAPPY_PRICE, KEY, KEYS, gappy, query, rounded, table
from prepforge.session import scratch_path
from prepforge.sources.files import read_csv
from prepforge.sources.typing import retype_strings

# profiles ------------------------------------------------------------------

_PROFILED = {
    "lineitem": [
        ("l_orderkey", "bigint", True), ("l_partkey", "bigint", True), ("l_suppkey", "bigint", True),
        ("l_linenumber", "int", True), ("l_quantity", "double", True),
        ("l_extendedprice", "double", True), ("l_discount", "double", True),
        ("l_tax", "double", True), ("l_returnflag", "string", False),
        ("l_linestatus", "string", False), ("l_shipdate", "timestamp_ntz", False)],
    "events": [
        ("event_id", "bigint", True), ("ts", "timestamp_ntz", False), ("user_id", "bigint", True),
        ("event_type", "string", False), ("value", "double", True), ("props", "string", False)],
    "documents": [
        ("doc_id", "bigint", True), ("text", "string", False), ("lang", "string", False),
        ("source", "string", False), ("n_chars", "bigint", True)],
}


def _profile_sql(columns, source: str) -> str:
    parts = []
    for name, dtype, numeric in columns:
        if numeric:
            x = f"CAST({name} AS DOUBLE)"
            stats = (f"round(avg({x}), 4) + 0.0 AS mean, round(stddev_samp({x}), 4) + 0.0 AS std, "
                     f"min({x}) AS min, max({x}) AS max, "
                     f"round(median({x}), 4) + 0.0 AS median")
        else:
            stats = ", ".join(f"CAST(NULL AS DOUBLE) AS {s}"
                              for s in ("mean", "std", "min", "max", "median"))
        parts.append(
            f"SELECT '{name}' AS \"column\", '{dtype}' AS dtype, "
            f"count(*) - count({name}) AS null_count, count(DISTINCT {name}) AS unique_count, "
            f"{stats} FROM {source}")
    return " UNION ALL ".join(parts)


def _shown(prof):
    return prof.select("column", "dtype", "null_count", "unique_count", rounded("mean", 4),
                       rounded("std", 4), "min", "max", rounded("median", 4))


@query("profile_lineitem", _profile_sql(_PROFILED["lineitem"], "lineitem"))
def profile_lineitem(spark, d):
    return _shown(profile(table(spark, d, "lineitem")))


@query("profile_events", _profile_sql(_PROFILED["events"], "events"))
def profile_events(spark, d):
    return _shown(profile(table(spark, d, "events")))


@query("profile_documents", _profile_sql(_PROFILED["documents"], "documents"))
def profile_documents(spark, d):
    return _shown(profile(table(spark, d, "documents")))


@query("profile_with_nulls", _profile_sql(
    [("price", "double", True), ("flag", "string", False), ("nothing", "double", True)],
    f"""(SELECT {GAPPY_PRICE} AS price,
         CASE WHEN l_linenumber < 3 THEN l_returnflag END AS flag,
         CAST(NULL AS DOUBLE) AS nothing FROM lineitem)"""))
def profile_with_nulls(spark, d):
    return _shown(profile(table(spark, d, "lineitem").select(
        F.expr(GAPPY_PRICE).alias("price"),
        F.expr("CASE WHEN l_linenumber < 3 THEN l_returnflag END").alias("flag"),
        F.lit(None).cast("double").alias("nothing"))))


# loading -------------------------------------------------------------------

@query("load_columns_limit", """
    SELECT o_orderkey, o_totalprice, o_orderpriority FROM orders
    ORDER BY o_orderdate DESC, o_orderkey LIMIT 100""")
def load_columns_limit(spark, d):
    orders = table(spark, d, "orders").select(
        "o_orderkey", "o_totalprice", "o_orderpriority", "o_orderdate")
    return newest_first(orders, "o_orderdate", "o_orderkey", 100).drop("o_orderdate")


@query("csv_round_trip", """
    SELECT o_orderkey, o_custkey, o_orderstatus,
           CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS o_totalprice,
           strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate, o_orderpriority FROM orders""")
def csv_round_trip(spark, d):
    """Orders written as CSV text with 'NA' for missing prices, read back typed."""
    path = scratch_path(spark, "orders_csv")
    price = F.when(F.col("o_orderstatus") == "P", "NA").otherwise(F.col("o_totalprice").cast("string"))
    table(spark, d, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", price.alias("o_totalprice"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("o_orderdate"), "o_orderpriority",
    ).write.option("header", True).csv(path)
    return read_csv(spark, path)


@query("retype_strings", """
    SELECT event_id, user_id, event_type, value, CAST(ts AS VARCHAR) AS ts,
           CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events""")
def retype_all_text(spark, d):
    """Every column as text first; types come back from the values."""
    events = table(spark, d, "events")
    text = events.select(*[F.col(c).cast("string") for c in ("event_id", "user_id", "event_type", "value", "ts")],
                         F.get_json_object("props", "$.k").alias("k"))
    return retype_strings(text)


@query("prep_roundtrip_types", f"""
    SELECT {KEYS}, dense_rank() OVER (ORDER BY l_quantity) - 1 AS quantity,
           dense_rank() OVER (ORDER BY CAST(l_shipdate AS DATE)) - 1 AS day FROM lineitem""")
def prep_roundtrip_types(spark, d):
    """Dictionaries of decimals and dates, applied after a trip through JSON."""
    out = table(spark, d, "lineitem").select(
        *KEY, F.col("l_quantity").cast("decimal(10,2)").alias("quantity"), F.to_date("l_shipdate").alias("day"))
    for c in ("quantity", "day"):
        saved = json.dumps(LabelEncoder().fit(out, c).to_dict())
        out = LabelEncoder.from_dict(json.loads(saved)).transform(out)
    return out


@query("nan_counts_as_missing", f"""
    SELECT l_returnflag, count(price) AS present, round(avg(price), 4) + 0.0 AS mean
    FROM (SELECT l_returnflag, {GAPPY_PRICE} AS price FROM lineitem) GROUP BY l_returnflag""")
def nan_counts_as_missing(spark, d):
    noisy = table(spark, d, "lineitem").select("l_returnflag", F.expr(
        "CASE WHEN l_linenumber = 3 THEN double('NaN') ELSE l_extendedprice END").alias("price"))
    return without_nan(noisy).groupBy("l_returnflag").agg(
        F.count("price").alias("present"), rounded(F.avg("price"), 4, "mean"))


@query("dataset_view_names", """
    SELECT p_partkey, CASE WHEN regexp_matches(n, '^[0-9]') THEN '_' || n ELSE n END AS view_name
    FROM (SELECT p_partkey, regexp_replace(lower(p_size || '-' || p_name || '.' || p_brand),
                                           '[^a-z0-9_]', '_', 'g') AS n FROM part)""")
def dataset_view_names(spark, d):
    name = F.concat(F.col("p_size").cast("string"), F.lit("-"), "p_name", F.lit("."), "p_brand")
    return table(spark, d, "part").select("p_partkey", view_name(name).alias("view_name"))


# missing values --------------------------------------------------------------

_T = f"WITH t AS (SELECT {KEYS}, {GAPPY_PRICE} AS price FROM lineitem)"


def _filled(frame):
    return frame.select(*KEY, rounded("price", 4))


@query("impute_mean", f"""{_T} SELECT {KEYS},
    round(coalesce(price, (SELECT avg(price) FROM t)), 4) + 0.0 AS price FROM t""")
def impute_mean(spark, d):
    return _filled(handle_missing_values(gappy(spark, d), "mean", columns=["price"]))


@query("impute_median", f"""{_T} SELECT {KEYS},
    round(coalesce(price, (SELECT median(price) FROM t)), 4) + 0.0 AS price FROM t""")
def impute_median(spark, d):
    return _filled(handle_missing_values(gappy(spark, d), "median", columns=["price"]))


@query("impute_constant", f"""{_T} SELECT {KEYS}, coalesce(price, -1.0) AS price FROM t""")
def impute_constant(spark, d):
    return handle_missing_values(gappy(spark, d), "constant", -1.0, ["price"])


@query("impute_drop", f"""{_T} SELECT {KEYS}, price FROM t WHERE price IS NOT NULL""")
def impute_drop(spark, d):
    return handle_missing_values(gappy(spark, d), "drop", columns=["price"])


_GAPPY_MODE = """CASE WHEN l_linenumber = 2 THEN NULL ELSE l_returnflag END AS flag,
    CASE WHEN l_linenumber = 3 THEN NULL ELSE l_quantity END AS quantity"""


@query("impute_mode", f"""
    WITH t AS (SELECT {KEYS}, {_GAPPY_MODE} FROM lineitem),
    f AS (SELECT flag FROM t WHERE flag IS NOT NULL GROUP BY flag ORDER BY count(*) DESC, flag LIMIT 1),
    q AS (SELECT quantity FROM t WHERE quantity IS NOT NULL GROUP BY quantity
          ORDER BY count(*) DESC, quantity LIMIT 1)
    SELECT {KEYS}, coalesce(flag, (SELECT flag FROM f)) AS flag,
           coalesce(quantity, (SELECT quantity FROM q)) AS quantity FROM t""")
def impute_mode(spark, d):
    frame = table(spark, d, "lineitem").selectExpr(*KEY, *[p for p in (
        "CASE WHEN l_linenumber = 2 THEN NULL ELSE l_returnflag END AS flag",
        "CASE WHEN l_linenumber = 3 THEN NULL ELSE l_quantity END AS quantity")])
    return handle_missing_values(frame, "mode", columns=["flag", "quantity"])


# scaling ---------------------------------------------------------------------

_SCALED = ["l_quantity", "l_extendedprice", "l_discount"]


def _lines(spark, d, *more):
    return table(spark, d, "lineitem").select(*KEY, *_SCALED, *more)


def _scaled(frame):
    return frame.select(*KEY, *[rounded(c, 6) for c in _SCALED])


def _scale_sql(center, spread, digits=6):
    cols = ", ".join(
        f"round(({c} - (SELECT {center.format(c=c)} FROM lineitem)) / "
        f"(SELECT {spread.format(c=c)} FROM lineitem), {digits}) + 0.0 AS {c}" for c in _SCALED)
    return f"SELECT {KEYS}, {cols} FROM lineitem"


@query("scale_standard", _scale_sql("avg({c})", "stddev_pop({c})"))
def scale_standard(spark, d):
    return _scaled(StandardScaler().fit_transform(_lines(spark, d), _SCALED))


@query("scale_minmax", _scale_sql("min({c})", "max({c}) - min({c})"))
def scale_minmax(spark, d):
    return _scaled(MinMaxScaler().fit_transform(_lines(spark, d), _SCALED))


@query("scale_minmax_range", "SELECT " + KEYS + ", " + ", ".join(
    f"round(({c} - (SELECT min({c}) FROM lineitem)) * 2.0 / "
    f"(SELECT max({c}) - min({c}) FROM lineitem) - 1.0, 6) + 0.0 AS {c}" for c in _SCALED)
    + " FROM lineitem")
def scale_minmax_range(spark, d):
    return _scaled(MinMaxScaler((-1.0, 1.0)).fit_transform(_lines(spark, d), _SCALED))


@query("scale_robust", _scale_sql(
    "median({c})", "quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)"))
def scale_robust(spark, d):
    return _scaled(RobustScaler().fit_transform(_lines(spark, d), _SCALED))


@query("scale_inverse", f"""
    SELECT {KEYS}, l_extendedprice AS standard, l_extendedprice AS minmax, l_extendedprice AS robust
    FROM lineitem""")
def scale_inverse(spark, d):
    """There and back with each scaler."""
    price = F.col("l_extendedprice")
    out = table(spark, d, "lineitem").select(
        *KEY, price.alias("standard"), price.alias("minmax"), price.alias("robust"))
    for name, scaler in (("standard", StandardScaler()), ("minmax", MinMaxScaler()),
                         ("robust", RobustScaler())):
        scaler.fit(out, [name])
        out = scaler.inverse_transform(scaler.transform(out))
    return out.select(*KEY, *[rounded(c, 6) for c in ("standard", "minmax", "robust")])


@query("scale_constant_column", f"""
    SELECT {KEYS}, 0.0::DOUBLE AS standard, -1.0::DOUBLE AS minmax, 0.0::DOUBLE AS robust
    FROM lineitem""")
def scale_constant_column(spark, d):
    fixed = (F.col("l_linenumber") * 0 + 5.0)
    frame = table(spark, d, "lineitem").select(
        *KEY, fixed.alias("standard"), fixed.alias("minmax"), fixed.alias("robust"))
    for name, scaler in (("standard", StandardScaler()), ("minmax", MinMaxScaler((-1.0, 1.0))),
                         ("robust", RobustScaler())):
        frame = scaler.fit_transform(frame, [name])
    return frame


# encoding --------------------------------------------------------------------

@query("encode_label", f"""
    SELECT {KEYS}, dense_rank() OVER (ORDER BY l_returnflag) - 1 AS l_returnflag FROM lineitem""")
def encode_label(spark, d):
    frame = table(spark, d, "lineitem").select(*KEY, "l_returnflag")
    return LabelEncoder().fit_transform(frame, "l_returnflag")


@query("encode_label_medium", """
    SELECT o_orderkey, dense_rank() OVER (ORDER BY o_custkey) - 1 AS o_custkey FROM orders""")
def encode_label_medium(spark, d):
    """More values than fit the plan as literals: a broadcast dictionary."""
    frame = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    return LabelEncoder().fit(frame, "o_custkey").transform(frame)


@query("encode_label_large", f"""
    SELECT {KEYS}, l_extendedprice, dense_rank() OVER (ORDER BY l_extendedprice) - 1 AS code
    FROM lineitem""")
def encode_label_large(spark, d):
    """A dictionary too large for the driver: distributed codes and a join."""
    frame = table(spark, d, "lineitem").select(
        *KEY, "l_extendedprice", F.col("l_extendedprice").alias("code"))
    return LabelEncoder().fit(frame, "code").transform(frame)


@query("encode_label_inverse", """
    SELECT p_partkey, p_brand, p_type FROM part""")
def encode_label_inverse(spark, d):
    frame = table(spark, d, "part").select("p_partkey", "p_brand", "p_type")
    for name in ("p_brand", "p_type"):
        encoder = LabelEncoder().fit(frame, name)
        frame = encoder.inverse_transform(encoder.transform(frame))
    return frame


_TYPES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]


def _onehot_sql(types):
    flags = ", ".join(f"CASE WHEN p_type = '{t}' THEN 1.0 ELSE 0.0 END::DOUBLE AS \"p_type_{t}\""
                      for t in types)
    return f"SELECT p_partkey, {flags} FROM part"


@query("encode_onehot", _onehot_sql(_TYPES))
def encode_onehot(spark, d):
    return OneHotEncoder().fit_transform(table(spark, d, "part").select("p_partkey", "p_type"), "p_type")


@query("encode_onehot_ignore", _onehot_sql(_TYPES[:-1]))
def encode_onehot_ignore(spark, d):
    """Fitted without one type; its rows become all zeros."""
    parts = table(spark, d, "part").select("p_partkey", "p_type")
    known = parts.where(F.col("p_type") != "STANDARD")
    return OneHotEncoder(handle_unknown="ignore").fit(known, "p_type").transform(parts)


@query("encode_onehot_vector", """
    SELECT p_partkey, dense_rank() OVER (ORDER BY p_name) - 1 AS hot,
           (SELECT count(DISTINCT p_name) FROM part) AS width FROM part""")
def encode_onehot_vector(spark, d):
    from pyspark.ml.functions import vector_to_array

    parts = table(spark, d, "part").select("p_partkey", "p_name")
    out = OneHotEncoder().fit(parts, "p_name").transform_vector(parts, "p_name", "v")
    flags = vector_to_array("v")
    return out.select("p_partkey", (F.array_position(flags, F.lit(1.0)) - 1).alias("hot"),
                      F.size(flags).cast("bigint").alias("width"))


# features, preparation chains ------------------------------------------------

@query("poly_degree3_bias", f"""
    SELECT {KEYS}, 1.0::DOUBLE AS bias, l_discount, l_tax,
           round(pow(l_discount, 2), 10) + 0.0 AS l_discount_pow2, round(pow(l_tax, 2), 10) + 0.0 AS l_tax_pow2,
           round(pow(l_discount, 3), 10) + 0.0 AS l_discount_pow3, round(pow(l_tax, 3), 10) + 0.0 AS l_tax_pow3
    FROM lineitem""")
def poly_degree3_bias(spark, d):
    out = create_polynomial_features(
        table(spark, d, "lineitem"), ["l_discount", "l_tax"], 3, True, keep=KEY)
    powers = [c for c in out.columns if "_pow" in c]
    return out.select(*[c for c in out.columns if c not in powers], *[rounded(c, 10) for c in powers])


_PREPARED_SQL = f"""
    {_T[:-1].replace('AS price', 'AS price, l_quantity, l_returnflag')}),
    u AS (SELECT {KEYS}, coalesce(price, (SELECT avg(price) FROM t)) AS price,
                 l_quantity, l_returnflag FROM t)
    SELECT {KEYS},
           round((price - (SELECT avg(price) FROM u)) / (SELECT stddev_pop(price) FROM u), 6) + 0.0 AS price,
           round((l_quantity - (SELECT avg(l_quantity) FROM u)) /
                 (SELECT stddev_pop(l_quantity) FROM u), 6) + 0.0 AS l_quantity,
           CASE WHEN l_returnflag = 'A' THEN 1.0 ELSE 0.0 END::DOUBLE AS "l_returnflag_A",
           CASE WHEN l_returnflag = 'N' THEN 1.0 ELSE 0.0 END::DOUBLE AS "l_returnflag_N",
           CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END::DOUBLE AS "l_returnflag_R"
    FROM u"""


def _raw(spark, d):
    return table(spark, d, "lineitem").select(
        *KEY, F.expr(GAPPY_PRICE).alias("price"), "l_quantity", "l_returnflag")


def _prepared(frame):
    return frame.withColumns({c: rounded(c, 6) for c in ("price", "l_quantity")})


@query("prep_fit_transform", _PREPARED_SQL)
def prep_fit_transform(spark, d):
    out, _ = apply_preprocessing_pipeline(
        _raw(spark, d), {"categorical_columns": ["l_returnflag"], "encoder_type": "onehot"}, carried=KEY)
    return _prepared(out)


@query("prep_roundtrip", _PREPARED_SQL)
def prep_roundtrip(spark, d):
    """Fitted, written as plain state, read back, applied to the raw rows."""
    raw = _raw(spark, d)
    _, made = apply_preprocessing_pipeline(
        raw, {"categorical_columns": ["l_returnflag"], "encoder_type": "onehot",
              "store_imputation": True}, carried=KEY)
    again = PreprocessingPipeline.from_dict(made.to_dict())
    return _prepared(apply_preprocessing_pipeline(raw, {}, again)[0])


@query("prep_label_minmax", f"""
    SELECT {KEYS}, round((l_quantity - (SELECT min(l_quantity) FROM lineitem)) /
           (SELECT max(l_quantity) - min(l_quantity) FROM lineitem), 6) + 0.0 AS l_quantity,
           round((l_tax - (SELECT median(l_tax) FROM lineitem)) /
           (SELECT quantile_cont(l_tax, 0.75) - quantile_cont(l_tax, 0.25) FROM lineitem), 6) + 0.0 AS l_tax,
           dense_rank() OVER (ORDER BY l_returnflag) - 1 AS l_returnflag,
           dense_rank() OVER (ORDER BY l_linestatus) - 1 AS l_linestatus FROM lineitem""")
def prep_label_minmax(spark, d):
    """Several steps fitted together and applied in order."""
    frame = table(spark, d, "lineitem").select(*KEY, "l_quantity", "l_tax", "l_returnflag", "l_linestatus")
    made = (PreprocessingPipeline().add_scaler("minmax", ["l_quantity"])
            .add_scaler("robust", ["l_tax"]).add_encoder("label", ["l_returnflag", "l_linestatus"]))
    out = made.fit_transform(frame)
    return out.withColumns({c: rounded(c, 6) for c in ("l_quantity", "l_tax")})


# splitting -------------------------------------------------------------------

_IN_VAL = "substr(md5(CAST(o_orderkey AS VARCHAR) || '-42'), 1, 8) < '33333333'"


@query("split_counts", f"""
    SELECT CASE WHEN {_IN_VAL} THEN 'val' ELSE 'train' END AS split, count(*) AS n,
           round(avg(o_totalprice), 4) + 0.0 AS mean_price FROM orders GROUP BY 1""")
def split_counts(spark, d):
    return with_split(table(spark, d, "orders"), ["o_orderkey"]).groupBy("split").agg(
        F.count(F.lit(1)).alias("n"), rounded(F.avg("o_totalprice"), 4, "mean_price"))


@query("split_rows", f"SELECT o_orderkey, o_totalprice FROM orders WHERE {_IN_VAL}")
def split_rows(spark, d):
    _, val = train_test_split(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), ["o_orderkey"])
    return val


# stacking datasets -----------------------------------------------------------

def _parties(spark, d):
    customers = table(spark, d, "customer").toDF("key", "name", "nation", "balance", "segment")
    suppliers = table(spark, d, "supplier").toDF("key", "name", "nation", "balance")
    return customers, suppliers


@query("concat_common_columns", """
    SELECT c_custkey AS key, c_name AS name, c_nationkey AS nation, c_acctbal AS balance FROM customer
    UNION ALL SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier""")
def concat_common_columns(spark, d):
    return concat(list(_parties(spark, d)))


@query("concat_type_clash", """
    SELECT CAST(c_custkey AS VARCHAR) AS key, CAST(c_nationkey AS DOUBLE) AS amount FROM customer
    UNION ALL SELECT s_name, s_acctbal FROM supplier""")
def concat_type_clash(spark, d):
    """bigint meets text: text; int meets double: double."""
    return concat([
        table(spark, d, "customer").selectExpr("c_custkey AS key", "c_nationkey AS amount"),
        table(spark, d, "supplier").selectExpr("s_name AS key", "s_acctbal AS amount")])


@query("common_columns", """
    SELECT unnest(['balance', 'key', 'name', 'nation']) AS "column",
           (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) AS total_rows""")
def common_columns(spark, d):
    """Columns shared by a selection of datasets, with the rows they hold together."""
    entries = None
    for name, frame in zip(("customers", "suppliers"), _parties(spark, d)):
        one = frame.agg(F.count(F.lit(1)).alias("row_count")).select(
            F.lit(name).alias("name"), F.array(*[F.lit(c) for c in frame.columns]).alias("column_names"),
            "row_count")
        entries = one if entries is None else entries.unionByName(one)
    return selection_summary(entries)
