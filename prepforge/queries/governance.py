"""Fingerprints, catalog, versions, lineage and training history."""

from __future__ import annotations

from pyspark.sql import functions as F

from prepforge.functions.columns import bump_version
from prepforge.operators.fingerprint import fingerprint_frame
from prepforge.operators.lineage import (
    children, duplicate_datasets, hash_counts, job_history, lineage, used_hashes, with_row_counts)
from prepforge.operators.ordering import latest_per_key
from prepforge.plans.catalog import DatasetCatalog
from prepforge.plans.registry import list_versions
from prepforge.queries.base import query, rounded, table
from prepforge.session import scratch_path, small_frame
from prepforge.sources.digest import file_digests

# fingerprints --------------------------------------------------------------------


@query("dataset_fingerprint")
def dataset_fingerprint(spark, d):
    return fingerprint_frame(table(spark, d, "orders"))


def _marks(spark, d):
    """The orders table reordered, changed in one row per customer, and with a pair added."""
    orders = table(spark, d, "orders")
    null_key = F.lit(None).cast("bigint")
    return {
        "reordered": orders.repartition(7, "o_custkey").sortWithinPartitions(F.col("o_totalprice").desc()),
        "one_cell_edited": orders.withColumn("o_totalprice", F.when(
            F.col("o_orderkey") == 1, F.col("o_totalprice") + 0.01).otherwise(F.col("o_totalprice"))),
        "one_second_later": orders.withColumn("o_orderdate", F.when(
            F.col("o_orderkey") == 1, F.col("o_orderdate") + F.expr("INTERVAL 1 SECOND"))
            .otherwise(F.col("o_orderdate"))),
        "pair_added": orders.unionByName(orders.where("o_orderkey = 2")).unionByName(
            orders.where("o_orderkey = 2")),
        "null_moved": orders.withColumns({
            "o_orderkey": F.when(F.col("o_orderkey") == 3, null_key).otherwise(F.col("o_orderkey"))}),
    }


@query("fingerprint_equality", """
    WITH o AS (SELECT * FROM orders),
    e AS (SELECT * REPLACE (CASE WHEN o_orderkey = 1 THEN o_totalprice + 0.01
          ELSE o_totalprice END AS o_totalprice) FROM o),
    t AS (SELECT * REPLACE (CASE WHEN o_orderkey = 1 THEN o_orderdate + INTERVAL 1 SECOND
          ELSE o_orderdate END AS o_orderdate) FROM o),
    p AS (SELECT * FROM o UNION ALL SELECT * FROM o WHERE o_orderkey = 2
          UNION ALL SELECT * FROM o WHERE o_orderkey = 2),
    m AS (SELECT * REPLACE (CASE WHEN o_orderkey <> 3 THEN o_orderkey END AS o_orderkey) FROM o),
    r AS (SELECT * FROM o ORDER BY o_totalprice DESC)
    SELECT 'reordered' AS variant, (SELECT count(*) FROM (FROM o EXCEPT ALL FROM r)) +
        (SELECT count(*) FROM (FROM r EXCEPT ALL FROM o)) = 0 AS same
    UNION ALL SELECT 'one_cell_edited', (SELECT count(*) FROM (FROM o EXCEPT ALL FROM e)) +
        (SELECT count(*) FROM (FROM e EXCEPT ALL FROM o)) = 0
    UNION ALL SELECT 'one_second_later', (SELECT count(*) FROM (FROM o EXCEPT ALL FROM t)) +
        (SELECT count(*) FROM (FROM t EXCEPT ALL FROM o)) = 0
    UNION ALL SELECT 'pair_added', (SELECT count(*) FROM (FROM o EXCEPT ALL FROM p)) +
        (SELECT count(*) FROM (FROM p EXCEPT ALL FROM o)) = 0
    UNION ALL SELECT 'null_moved', (SELECT count(*) FROM (FROM o EXCEPT ALL FROM m)) +
        (SELECT count(*) FROM (FROM m EXCEPT ALL FROM o)) = 0""")
def fingerprint_equality(spark, d):
    """Equal fingerprints exactly where the tables hold the same rows."""
    whole = fingerprint_frame(table(spark, d, "orders")).first()["fingerprint"]
    out = None
    for name, frame in _marks(spark, d).items():
        one = fingerprint_frame(frame).select(
            F.lit(name).alias("variant"), (F.col("fingerprint") == F.lit(whole)).alias("same"))
        out = one if out is None else out.unionByName(one)
    return out


@query("text_sha256", "SELECT doc_id, sha256(text) AS digest FROM documents")
def text_sha256(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))


@query("rows_as_json", """
    SELECT c_custkey, to_json({'c_name': c_name, 'c_nationkey': c_nationkey,
                               'c_mktsegment': c_mktsegment})::VARCHAR AS record FROM customer""")
def rows_as_json(spark, d):
    return table(spark, d, "customer").select("c_custkey", F.to_json(
        F.struct("c_name", "c_nationkey", "c_mktsegment")).alias("record"))


# catalog -------------------------------------------------------------------------

def _catalog(spark, d):
    catalog = DatasetCatalog(spark, scratch_path(spark, "catalog"))
    for name, source in (("2024-customers", "customer"), ("my suppliers", "supplier"), ("nations", "nation")):
        catalog.register(table(spark, d, source), name)
    return catalog


@query("catalog_listing", """
    SELECT '2024-customers' AS name, 'parquet' AS file_type, (SELECT count(*) FROM customer) AS row_count,
           'c_custkey,c_name,c_nationkey,c_acctbal,c_mktsegment' AS column_names
    UNION ALL SELECT 'my suppliers', 'parquet', (SELECT count(*) FROM supplier),
           's_suppkey,s_name,s_nationkey,s_acctbal'""")
def catalog_listing(spark, d):
    """Three datasets registered, one dropped again."""
    catalog = _catalog(spark, d)
    catalog.delete("nations")
    return catalog.list_datasets().select("name", "file_type", "row_count",
                                          F.array_join("column_names", ",").alias("column_names"))


@query("catalog_statistics", """
    SELECT 'c_acctbal' AS "column", count(DISTINCT c_acctbal) AS unique_count,
           round(avg(c_acctbal), 4) + 0.0 AS mean, round(median(c_acctbal), 4) + 0.0 AS median FROM customer
    UNION ALL SELECT 'c_mktsegment', count(DISTINCT c_mktsegment), NULL, NULL FROM customer""")
def catalog_statistics(spark, d):
    """The stored profile, replaced when a name is registered again."""
    catalog = DatasetCatalog(spark, scratch_path(spark, "catalog"))
    catalog.register(table(spark, d, "supplier"), "parties")
    catalog.register(table(spark, d, "customer").select("c_acctbal", "c_mktsegment"), "parties")
    return catalog.log.current().select(F.explode("statistics").alias("column", "s")).select(
        "column", "s.unique_count", rounded(F.col("s.mean"), 4, "mean"),
        rounded(F.col("s.median"), 4, "median"))


@query("catalog_sql", """
    SELECT n_name, count(*) AS customers, round(sum(c_acctbal), 2) + 0.0 AS balance
    FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 0 GROUP BY n_name""")
def catalog_sql(spark, d):
    return _catalog(spark, d).query("""
        SELECT n_name, count(*) AS customers, round(sum(c_acctbal), 2) AS balance
        FROM _2024_customers JOIN nations ON c_nationkey = n_nationkey WHERE c_acctbal > 0 GROUP BY n_name""")


@query("catalog_two_roots", """
    SELECT 'first' AS root, count(*) AS n, round(sum(c_acctbal), 2) + 0.0 AS balance FROM customer
    UNION ALL SELECT 'second', count(*), round(sum(s_acctbal), 2) + 0.0 FROM supplier""")
def catalog_two_roots(spark, d):
    """The same name in two catalogs of one session: each answers from its own data."""
    one, two = (DatasetCatalog(spark, scratch_path(spark, "catalog")) for _ in range(2))
    one.register(table(spark, d, "customer").selectExpr("c_acctbal AS balance"), "parties")
    two.register(table(spark, d, "supplier").selectExpr("s_acctbal AS balance"), "parties")
    ask = "SELECT '{}' AS root, count(*) AS n, round(sum(balance), 2) AS balance FROM parties"
    return one.query(ask.format("first")).unionByName(two.query(ask.format("second")))


@query("catalog_load", "SELECT o_orderkey, o_orderdate, o_totalprice FROM orders")
def catalog_load(spark, d):
    """Some columns of a registered dataset."""
    catalog = DatasetCatalog(spark, scratch_path(spark, "catalog"))
    catalog.register(table(spark, d, "orders"), "orders")
    return catalog.load("orders", ["o_orderkey", "o_orderdate", "o_totalprice"])


@query("catalog_info", """
    SELECT '2024-customers' AS name, 'parquet' AS file_type, count(*) AS row_count, 5 AS columns,
           round(avg(c_acctbal), 4) + 0.0 AS mean, min(c_acctbal) AS low, max(c_acctbal) AS high FROM customer""")
def catalog_info(spark, d):
    found = _catalog(spark, d).info("2024-customers")
    stats = found["statistics"]["c_acctbal"]
    row = {"name": found["name"], "file_type": found["file_type"], "row_count": found["row_count"],
           "columns": len(found["column_names"]), "mean": round(stats["mean"], 4),
           "low": float(stats["min"]), "high": float(stats["max"])}
    return small_frame(spark, [row], "name string, file_type string, row_count bigint, columns int, "
                                     "mean double, low double, high double")


@query("catalog_load_multiple", """
    SELECT count(*) AS n, round(sum(balance), 2) + 0.0 AS balance FROM (
        SELECT c_acctbal AS balance FROM customer UNION ALL SELECT s_acctbal FROM supplier)""")
def catalog_load_multiple(spark, d):
    catalog = DatasetCatalog(spark, scratch_path(spark, "catalog"))
    catalog.register(table(spark, d, "customer").selectExpr("c_name AS name", "c_acctbal AS balance"), "a")
    catalog.register(table(spark, d, "supplier").selectExpr("s_acctbal AS balance", "s_suppkey AS id"), "b")
    union, _ = catalog.load_multiple(["a", "b"])
    return union.agg(F.count(F.lit(1)).alias("n"), rounded(F.sum("balance"), 2, "balance"))


@query("latest_catalog_rows", """
    SELECT user_id, event_id, event_type, created_at FROM (
        SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k,
               CAST(epoch_us(min(ts) OVER (PARTITION BY user_id)) AS BIGINT) AS created_at FROM events) WHERE k = 1""")
def latest_catalog_rows(spark, d):
    """The event log as an upsert log: newest row and first time per key."""
    events = table(spark, d, "events").select(
        "user_id", "event_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("ts"))
    return latest_per_key(events, ["user_id"], ["ts", "event_id"],
                          {"created_at": "ts"}).drop("ts")


@query("file_digest", """
    WITH t AS (SELECT string_agg(CAST(o_orderkey AS VARCHAR) || ',' || o_orderpriority || chr(10), ''
                                 ORDER BY o_orderkey) AS c FROM orders),
    leaves AS (SELECT i, sha256(substr(c, i * 4096 + 1, 4096)) AS h
               FROM t, (SELECT unnest(range((SELECT (length(c) + 4095) // 4096 FROM t))) AS i))
    SELECT length(c) AS length, (SELECT sha256(string_agg(h, '' ORDER BY i)) FROM leaves) AS sha256 FROM t""")
def file_digest(spark, d):
    """A file of all orders, hashed in ranges of 4,096 bytes."""
    path = scratch_path(spark, "digest")
    table(spark, d, "orders").orderBy("o_orderkey").select(
        F.concat_ws(",", F.col("o_orderkey").cast("string"), "o_orderpriority").alias("line")
    ).coalesce(1).write.text(path)
    return file_digests(spark, path, 4096).select("length", "sha256")


# versions and lineage ------------------------------------------------------------
# Orders serve as models: half the number is the parent. Their lines are the
# training history, the part number standing for the dataset.


def _models(spark, d):
    return table(spark, d, "orders").select(
        F.col("o_orderkey").alias("version"),
        F.expr("CASE WHEN o_orderkey > 0 THEN o_orderkey DIV 2 END").alias("parent"),
        F.col("o_orderpriority").alias("model_type"), F.col("o_orderstatus").alias("training_mode"),
        F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("created_at"))


def _history(spark, d):
    return table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("version"),
        F.sha2(F.col("l_partkey").cast("string"), 256).alias("dataset_hash"))


_CHAIN = """
    WITH RECURSIVE chain AS (
        SELECT o_orderkey AS start, o_orderkey AS version, 0::BIGINT AS depth FROM orders
        UNION ALL SELECT start, version // 2, depth + 1 FROM chain WHERE version > 0)"""


@query("lineage_chain", _CHAIN + "SELECT start, version, depth FROM chain")
def lineage_chain(spark, d):
    """All ancestors of every model."""
    return lineage(_models(spark, d))


@query("children", "SELECT o_orderkey // 2 AS version, o_orderkey AS child FROM orders WHERE o_orderkey > 0")
def all_children(spark, d):
    return children(_models(spark, d))


@query("lineage_hashes", _CHAIN + """
    SELECT start, count(DISTINCT sha256(CAST(l_partkey AS VARCHAR))) AS hashes
    FROM chain JOIN lineitem ON version = l_orderkey GROUP BY start""")
def lineage_hashes(spark, d):
    """How many different datasets went into each model and its ancestors."""
    used = used_hashes(lineage(_models(spark, d)), _history(spark, d))
    return hash_counts(used)


@query("duplicate_datasets", _CHAIN + """,
    used AS (SELECT DISTINCT start, l_partkey FROM chain JOIN lineitem ON version = l_orderkey)
    SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem
    WHERE l_orderkey > 0 AND EXISTS (SELECT 1 FROM used WHERE start = lineitem.l_orderkey // 2
                                     AND used.l_partkey = lineitem.l_partkey)""")
def duplicates(spark, d):
    """Lines of an order whose part the order's parent lineage has already used."""
    candidates = table(spark, d, "lineitem").where("l_orderkey > 0").select(
        F.expr("l_orderkey DIV 2").alias("start"),
        F.sha2(F.col("l_partkey").cast("string"), 256).alias("dataset_hash"),
        "l_orderkey", "l_linenumber", "l_partkey")
    used = used_hashes(lineage(_models(spark, d)), _history(spark, d))
    return duplicate_datasets(candidates, used).select("l_orderkey", "l_linenumber", "l_partkey")


def _bumped_sql(part: str) -> str:
    exprs = {"major": "(a + 1) || '.0.0'", "minor": "a || '.' || (b + 1) || '.0'",
             "patch": "a || '.' || b || '.' || (c + 1)"}
    return exprs[part]


@query("next_version", f"""
    SELECT l_orderkey, l_linenumber, a || '.' || b || '.' || c AS version, {_bumped_sql('major')} AS major,
           {_bumped_sql('minor')} AS minor, {_bumped_sql('patch')} AS patch
    FROM (SELECT l_orderkey, l_linenumber, l_suppkey AS a, l_linenumber AS b,
                 CAST(l_quantity AS BIGINT) AS c FROM lineitem)""")
def next_version(spark, d):
    version = F.concat_ws(".", F.col("l_suppkey").cast("string"), F.col("l_linenumber").cast("string"),
                          F.col("l_quantity").cast("bigint").cast("string"))
    frame = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", version.alias("version"))
    return frame.select("*", *[bump_version(F.col("version"), p).alias(p) for p in ("major", "minor", "patch")])


@query("list_versions", """
    SELECT o_orderkey AS version, o_orderpriority AS model_type, o_orderstatus AS training_mode FROM orders
    WHERE o_orderpriority = '2-HIGH' AND o_orderstatus = 'F' ORDER BY o_orderdate DESC, o_orderkey LIMIT 100""")
def versions(spark, d):
    return list_versions(_models(spark, d), "2-HIGH", "F").select("version", "model_type", "training_mode")


@query("latest_version", """
    SELECT o_orderpriority AS model_type, first(o_orderkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS version
    FROM orders GROUP BY 1""")
def latest_version(spark, d):
    """Newest by time, not by number."""
    return _models(spark, d).groupBy("model_type").agg(
        F.max_by("version", F.struct("created_at", "version")).alias("version"))


@query("job_history", """
    SELECT o_custkey AS job, o_orderkey AS result_version, sha256(CAST(l_partkey AS VARCHAR)) AS dataset_hash
    FROM orders JOIN lineitem ON o_orderkey = l_orderkey""")
def jobs_with_history(spark, d):
    jobs = table(spark, d, "orders").select(F.col("o_custkey").alias("job"),
                                            F.col("o_orderkey").alias("result_version"))
    return job_history(jobs, _history(spark, d))


@query("dataset_row_counts", """
    SELECT c_custkey, c_name AS dataset_name, coalesce(n, 0) AS row_count FROM customer
    LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON c_custkey = o_custkey""")
def dataset_row_counts(spark, d):
    """Row counts looked up by dataset name, 0 for the unknown."""
    customers = table(spark, d, "customer").select("c_custkey", F.col("c_name").alias("dataset_name"))
    counted = table(spark, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("row_count")).join(
        customers, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("dataset_name").alias("name"), "row_count")
    return with_row_counts(customers, counted)
