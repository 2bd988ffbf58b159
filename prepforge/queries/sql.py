"""SQL over the registered tables, one query per class of statement."""

from __future__ import annotations

from pyspark.sql import functions as F

from prepforge.operators.asof import asof_join
from prepforge.operators.bands import band_join, band_totals
from prepforge.operators.quantiles import grouped_quantiles
from prepforge.queries.base import query, rounded, table, views


def same(name: str, tables: list[str], text: str) -> None:
    """A statement that reads alike in both dialects."""
    dialect(name, tables, text, text)


def dialect(name: str, tables: list[str], text: str, oracle: str) -> None:
    @query(name, oracle)
    def run(spark, d):
        views(spark, d, *tables)
        return spark.sql(text)


# projection, filter, expressions ------------------------------------------------

same("sql_filter_case", ["lineitem"], """
    SELECT l_orderkey, l_linenumber, l_partkey,
           CASE WHEN l_quantity < 10 THEN 'small' WHEN l_quantity < 30 THEN 'medium' ELSE 'large' END AS size,
           l_extendedprice * (1 - l_discount) * (1 + l_tax) AS charge
    FROM lineitem WHERE l_returnflag = 'R' AND l_discount BETWEEN 0.03 AND 0.07""")

same("sql_in_like_null", ["part"], """
    SELECT p_partkey, p_name, coalesce(nullif(p_type, 'PROMO'), 'none') AS kind FROM part
    WHERE p_brand IN ('Brand#1', 'Brand#12') OR p_name LIKE 'blue%' OR p_size IS NULL""")

# joins ----------------------------------------------------------------------------

same("sql_join_inner", ["customer", "orders", "nation", "region"], """
    SELECT r_name, n_name, count(*) AS orders, round(sum(o_totalprice), 2) + 0.0 AS total
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
    JOIN region ON n_regionkey = r_regionkey GROUP BY r_name, n_name""")

same("sql_join_left", ["customer", "orders"], """
    SELECT c_custkey, count(o_orderkey) AS orders, round(coalesce(sum(o_totalprice), 0), 2) + 0.0 AS total
    FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey""")

same("sql_join_right", ["documents", "labels"], """
    SELECT d.doc_id, lang, quality FROM labels l RIGHT JOIN documents d ON l.doc_id = d.doc_id""")

same("sql_join_full", ["customer", "supplier"], """
    SELECT coalesce(c_nationkey, s_nationkey) AS nation, customers, suppliers FROM
        (SELECT c_nationkey, count(*) AS customers FROM customer WHERE c_acctbal > 5000 GROUP BY c_nationkey)
        FULL JOIN (SELECT s_nationkey, count(*) AS suppliers FROM supplier WHERE s_acctbal > 5000
                   GROUP BY s_nationkey) ON c_nationkey = s_nationkey""")

dialect("sql_join_semi", ["customer", "orders"], """
    SELECT c_custkey, c_name FROM customer LEFT SEMI JOIN orders
    ON c_custkey = o_custkey AND o_totalprice > 200000""", """
    SELECT c_custkey, c_name FROM customer SEMI JOIN (SELECT * FROM orders WHERE o_totalprice > 200000)
    ON c_custkey = o_custkey""")

dialect("sql_join_anti", ["customer", "orders"], """
    SELECT c_custkey, c_name FROM customer LEFT ANTI JOIN orders
    ON c_custkey = o_custkey AND o_orderstatus = 'P'""", """
    SELECT c_custkey, c_name FROM customer ANTI JOIN (SELECT * FROM orders WHERE o_orderstatus = 'P')
    ON c_custkey = o_custkey""")

# the bands are the only other side, six literal rows
same("sql_join_range", ["part"], """
    SELECT band, count(*) AS parts, round(avg(p_retailprice), 4) + 0.0 AS price
    FROM part JOIN (VALUES ('a', 1, 5), ('b', 6, 10), ('c', 11, 20), ('d', 21, 30), ('e', 31, 40),
                           ('f', 41, 100)) AS b(band, low, high)
    ON p_size >= low AND p_size <= high GROUP BY band""")

same("sql_join_self", ["nation"], """
    SELECT a.n_name AS nation, count(b.n_name) AS neighbours FROM nation a
    JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey <> b.n_nationkey GROUP BY a.n_name""")


@query("sql_asof", """
    SELECT p.event_id, p.user_id, epoch_us(p.ts) AS ts, v.value AS asof_value, epoch_us(v.ts) AS asof_seen
    FROM (SELECT * FROM events WHERE event_type = 'purchase') p
    ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') v
    ON p.user_id = v.user_id AND p.ts >= v.ts""")
def sql_asof(spark, d):
    """For every purchase the user's latest view before it."""
    events = table(spark, d, "events")
    bought = events.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    seen = events.where("event_type = 'view'").select("user_id", F.col("ts").alias("seen"), "value")
    out = asof_join(bought, seen, ["user_id"], "ts", "seen", ["value"])
    micros = {c: F.unix_micros(F.col(c).cast("timestamp")) for c in ("ts", "asof_seen")}
    return out.withColumns(micros)


@query("band_join_events", """
    SELECT h.event_id AS home, count(*) AS n, count(DISTINCT e.user_id) AS users,
           round(sum(e.value), 2) + 0.0 AS value
    FROM (SELECT event_id, ts, value FROM events WHERE event_type = 'purchase') h
    JOIN events e ON e.ts >= h.ts AND e.ts <= h.ts + to_seconds(CAST(floor(h.value) AS BIGINT) * 60 + 600)
    GROUP BY h.event_id""")
def band_join_events(spark, d):
    """What happens during a while after every purchase: intervals of one table against the times of another."""
    events = table(spark, d, "events")
    length = F.make_interval(secs=F.floor("value") * 60 + 600)
    spans = events.where("event_type = 'purchase'").select(
        F.col("event_id").alias("home"), F.col("ts").alias("low"), (F.col("ts") + length).alias("high"))
    pairs = band_join(events.select("ts", "user_id", "value"), spans, "ts", "low", "high")
    return band_totals(pairs, "home", "user_id", "value").select(
        "home", "n", F.col("n_distinct").alias("users"), rounded("total", 2, "value"))


# aggregation ------------------------------------------------------------------------

same("sql_group_having", ["lineitem"], """
    SELECT l_suppkey, count(*) AS n, count(DISTINCT l_partkey) AS parts, round(sum(l_quantity), 2) + 0.0 AS quantity
    FROM lineitem GROUP BY l_suppkey HAVING sum(l_quantity) > 1000""")

same("sql_group_by_all", ["orders"], """
    SELECT o_orderstatus, o_orderpriority, count(*) AS n, max(o_totalprice) AS top FROM orders GROUP BY ALL""")

same("sql_rollup", ["lineitem"], """
    SELECT l_returnflag, l_linestatus, grouping(l_returnflag) + grouping(l_linestatus) AS level,
           count(*) AS n, round(sum(l_extendedprice), 1) + 0.0 AS price
    FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)""".replace(
    "grouping(l_returnflag) + grouping(l_linestatus)",
    "CAST(grouping(l_returnflag) + grouping(l_linestatus) AS BIGINT)"))

same("sql_cube", ["part"], """
    SELECT p_type, p_brand, count(*) AS n, round(avg(p_retailprice), 4) + 0.0 AS price
    FROM part GROUP BY CUBE (p_type, p_brand)""")

same("sql_grouping_sets", ["orders"], """
    SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders
    GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())""")

@query("sql_statistics", """
    SELECT l_returnflag, round(stddev_samp(l_quantity), 6) AS sd, round(corr(l_quantity, l_extendedprice), 8) AS r,
           round(skewness(l_discount) * (count(*) - 2) / sqrt(count(*) * (count(*) - 1.0)), 3) + 0.0 AS skew,
           CAST(count_if(l_tax > 0.04) AS BIGINT) AS taxed,
           quantile_cont(CAST(l_linenumber AS DOUBLE), 0.9) AS p90,
           arg_max(l_orderkey, {'p': l_extendedprice, 'k': l_orderkey}) AS dearest
    FROM lineitem GROUP BY l_returnflag""")
def sql_statistics(spark, d):
    """Moments by SQL; the quantile of each group without holding a group's values."""
    views(spark, d, "lineitem")
    moments = spark.sql("""
        SELECT l_returnflag, round(stddev_samp(l_quantity), 6) AS sd, round(corr(l_quantity, l_extendedprice), 8) AS r,
               round(skewness(l_discount), 3) AS skew, count_if(l_tax > 0.04) AS taxed,
               max_by(l_orderkey, struct(l_extendedprice, l_orderkey)) AS dearest
        FROM lineitem GROUP BY l_returnflag""")
    tops = grouped_quantiles(table(spark, d, "lineitem"), ["l_returnflag"], "l_linenumber", [0.9], ["p90"])
    return moments.join(tops, "l_returnflag")


@query("grouped_quantiles", """
    SELECT l_returnflag, l_linestatus, round(quantile_cont(l_extendedprice, 0.1), 6) + 0.0 AS low,
           round(median(l_extendedprice), 6) + 0.0 AS middle,
           round(quantile_cont(l_extendedprice, 0.99), 6) + 0.0 AS high FROM lineitem GROUP BY ALL""")
def quantiles_by_group(spark, d):
    return grouped_quantiles(table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], "l_extendedprice",
                             [0.1, 0.5, 0.99], ["low", "middle", "high"]).select(
        "l_returnflag", "l_linestatus", *[rounded(c, 6) for c in ("low", "middle", "high")])


# windows ------------------------------------------------------------------------------
# Ranks keep only the first rows of each group and running frames go over days,
# so that no window gathers an unbounded group.

same("sql_top_per_group", ["orders"], """
    SELECT o_custkey, o_orderkey, o_totalprice, place FROM (
        SELECT o_custkey, o_orderkey, o_totalprice,
               CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS BIGINT) AS place
        FROM orders) WHERE place <= 3""")

same("sql_window_rank", ["lineitem"], """
    SELECT l_returnflag, l_linestatus, l_quantity, n,
           CAST(rank() OVER (PARTITION BY l_returnflag, l_linestatus ORDER BY n DESC) AS BIGINT) AS rk,
           CAST(dense_rank() OVER (PARTITION BY l_returnflag, l_linestatus ORDER BY n DESC) AS BIGINT) AS dense,
           CAST(ntile(4) OVER (PARTITION BY l_returnflag, l_linestatus ORDER BY n DESC, l_quantity) AS BIGINT) AS quarter,
           round(percent_rank() OVER (PARTITION BY l_returnflag, l_linestatus ORDER BY n DESC), 8) + 0.0 AS pct
    FROM (SELECT l_returnflag, l_linestatus, l_quantity, count(*) AS n FROM lineitem
          GROUP BY l_returnflag, l_linestatus, l_quantity)""")

dialect("sql_window_frames", ["orders"], """
    SELECT o_orderstatus, month, round(total, 2) AS total,
           round(sum(total) OVER w, 2) AS running,
           round(avg(total) OVER (PARTITION BY o_orderstatus ORDER BY month
                                  ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS smooth,
           round(lag(total) OVER w, 2) AS before, round(lead(total, 2) OVER w, 2) AS later,
           round(first_value(total) OVER w, 2) AS first, round(last_value(total) OVER w, 2) AS last
    FROM (SELECT o_orderstatus, date_format(o_orderdate, 'yyyy-MM') AS month, sum(o_totalprice) AS total
          FROM orders GROUP BY 1, 2) WINDOW w AS (PARTITION BY o_orderstatus ORDER BY month)""", """
    SELECT o_orderstatus, month, round(total, 2) + 0.0 AS total,
           round(sum(total) OVER w, 2) + 0.0 AS running,
           round(avg(total) OVER (PARTITION BY o_orderstatus ORDER BY month
                                  ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) + 0.0 AS smooth,
           round(lag(total) OVER w, 2) + 0.0 AS before, round(lead(total, 2) OVER w, 2) + 0.0 AS later,
           round(first_value(total) OVER w, 2) + 0.0 AS first, round(last_value(total) OVER w, 2) + 0.0 AS last
    FROM (SELECT o_orderstatus, strftime(o_orderdate, '%Y-%m') AS month, sum(o_totalprice) AS total
          FROM orders GROUP BY 1, 2) WINDOW w AS (PARTITION BY o_orderstatus ORDER BY month)""")

dialect("sql_window_range", ["events"], """
    SELECT event_type, day, n, sum(n) OVER (PARTITION BY event_type ORDER BY day
                                            RANGE BETWEEN 6 PRECEDING AND CURRENT ROW) AS week
    FROM (SELECT event_type, datediff(CAST(ts AS DATE), DATE '2024-01-01') AS day, count(*) AS n
          FROM events GROUP BY 1, 2)""", """
    SELECT event_type, day, n, CAST(sum(n) OVER (PARTITION BY event_type ORDER BY day
                                            RANGE BETWEEN 6 PRECEDING AND CURRENT ROW) AS BIGINT) AS week
    FROM (SELECT event_type, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS INT) AS day, count(*) AS n
          FROM events GROUP BY 1, 2)""")

dialect("sql_qualify", ["part"], """
    SELECT p_brand, p_partkey, p_retailprice FROM (
        SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS k FROM part)
    WHERE k = 1""", """
    SELECT p_brand, p_partkey, p_retailprice FROM part
    QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) = 1""")

# order, limit, set operations -----------------------------------------------------------

same("sql_topk", ["lineitem"], """
    SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice FROM lineitem
    ORDER BY l_extendedprice DESC NULLS LAST, l_orderkey, l_linenumber, l_partkey LIMIT 25""")

same("sql_limit_offset", ["customer"], """
    SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal ASC NULLS FIRST, c_custkey LIMIT 50 OFFSET 100""")

same("sql_union", ["customer", "supplier"], """
    SELECT c_nationkey AS nation FROM customer UNION SELECT s_nationkey FROM supplier""")

same("sql_union_all", ["customer", "supplier"], """
    SELECT c_nationkey AS nation, c_acctbal AS balance FROM customer
    UNION ALL SELECT s_nationkey, s_acctbal FROM supplier""")

same("sql_intersect", ["orders", "customer"], """
    SELECT o_custkey AS k FROM orders INTERSECT SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'""")

same("sql_except", ["customer", "orders"], """
    SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT'""")

same("sql_intersect_all", ["lineitem", "part"], """
    SELECT CAST(l_quantity AS INT) AS v FROM lineitem INTERSECT ALL SELECT p_size FROM part""")

same("sql_except_all", ["lineitem", "part"], """
    SELECT p_size AS v FROM part EXCEPT ALL SELECT CAST(l_linenumber AS INT) FROM lineitem""")

# subqueries, common table expressions -------------------------------------------------------

same("sql_cte", ["orders", "customer"], """
    WITH spent AS (SELECT o_custkey, sum(o_totalprice) AS total FROM orders GROUP BY o_custkey),
         top AS (SELECT o_custkey, total FROM spent WHERE total > 1000000)
    SELECT c_mktsegment, count(*) AS n, round(avg(total), 2) + 0.0 AS mean
    FROM top JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment""")

same("sql_recursive", ["orders"], """
    WITH RECURSIVE line(k, depth) AS (
        SELECT max(o_orderkey), CAST(0 AS BIGINT) FROM orders
        UNION ALL SELECT CAST(floor(k / 2) AS BIGINT), depth + 1 FROM line WHERE k > 0)
    SELECT k, depth, o_totalprice FROM line JOIN orders ON k = o_orderkey""")

same("sql_subquery_scalar", ["part"], """
    SELECT p_partkey, p_retailprice FROM part WHERE p_retailprice > (SELECT avg(p_retailprice) FROM part)""")

same("sql_subquery_correlated", ["part"], """
    SELECT p_partkey, p_type, p_retailprice FROM part p
    WHERE p_retailprice >= (SELECT max(p_retailprice) - 1 FROM part q WHERE q.p_type = p.p_type)""")

same("sql_subquery_exists", ["customer", "orders"], """
    SELECT c_custkey FROM customer WHERE EXISTS
        (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)
    AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')""")

# pivot, unpivot -----------------------------------------------------------------------------

dialect("sql_pivot", ["lineitem"], """
    SELECT * FROM (SELECT l_returnflag, l_linestatus, l_quantity FROM lineitem)
    PIVOT (CAST(sum(l_quantity) AS BIGINT) FOR l_linestatus IN ('F' AS filled, 'O' AS open))""".replace(
    "CAST(sum(l_quantity) AS BIGINT)", "sum(l_quantity)"), """
    SELECT l_returnflag, sum(l_quantity) FILTER (l_linestatus = 'F') AS filled,
           sum(l_quantity) FILTER (l_linestatus = 'O') AS open FROM lineitem GROUP BY l_returnflag""")

dialect("sql_unpivot", ["lineitem"], """
    SELECT l_orderkey, l_linenumber, l_partkey, measure, value FROM
        (SELECT l_orderkey, l_linenumber, l_partkey, l_discount, l_tax FROM lineitem)
    UNPIVOT (value FOR measure IN (l_discount, l_tax))""", """
    SELECT l_orderkey, l_linenumber, l_partkey, measure, value FROM
        (SELECT l_orderkey, l_linenumber, l_partkey, l_discount, l_tax FROM lineitem)
    UNPIVOT (value FOR measure IN (l_discount, l_tax))""")

# scalar functions ------------------------------------------------------------------------------

dialect("sql_strings", ["part"], """
    SELECT p_partkey, upper(p_name) AS up, length(p_name) AS len, substring(p_name, 1, 3) AS head,
           replace(p_brand, '#', '-') AS brand, split(p_name, ' ')[0] AS colour, lpad(p_type, 10, '*') AS padded,
           regexp_extract(p_brand, '([0-9]+)', 1) AS number, concat_ws('/', p_type, p_brand) AS joined,
           reverse(p_type) AS mirrored, initcap(p_name) AS titled FROM part""", """
    SELECT p_partkey, upper(p_name) AS up, CAST(length(p_name) AS INT) AS len, substring(p_name, 1, 3) AS head,
           replace(p_brand, '#', '-') AS brand, string_split(p_name, ' ')[1] AS colour, lpad(p_type, 10, '*') AS padded,
           regexp_extract(p_brand, '([0-9]+)', 1) AS number, concat_ws('/', p_type, p_brand) AS joined,
           reverse(p_type) AS mirrored,
           array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS titled
    FROM part""")

dialect("sql_dates", ["orders"], """
    SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, dayofmonth(o_orderdate) AS d,
           quarter(o_orderdate) AS q, date_format(o_orderdate, 'yyyy-MM-dd') AS day,
           date_format(date_trunc('MONTH', o_orderdate), 'yyyy-MM-dd') AS month_start,
           datediff(CAST(o_orderdate AS DATE), DATE '1990-01-01') AS days,
           date_format(o_orderdate + INTERVAL 30 DAYS, 'yyyy-MM-dd') AS due,
           unix_timestamp(CAST(o_orderdate AS TIMESTAMP)) AS epoch FROM orders""", """
    SELECT o_orderkey, CAST(year(o_orderdate) AS INT) AS y, CAST(month(o_orderdate) AS INT) AS m,
           CAST(day(o_orderdate) AS INT) AS d, CAST(quarter(o_orderdate) AS INT) AS q,
           strftime(o_orderdate, '%Y-%m-%d') AS day,
           strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS month_start,
           CAST(date_diff('day', DATE '1990-01-01', CAST(o_orderdate AS DATE)) AS INT) AS days,
           strftime(o_orderdate + INTERVAL 30 DAYS, '%Y-%m-%d') AS due,
           CAST(epoch(o_orderdate) AS BIGINT) AS epoch FROM orders""")

dialect("sql_math", ["lineitem"], """
    SELECT l_orderkey, l_linenumber, l_partkey, abs(l_discount - 0.05) < 0.01 AS near, round(sqrt(l_quantity), 8) AS root,
           round(ln(l_extendedprice), 8) AS logged, CAST(floor(l_extendedprice) AS BIGINT) AS low,
           CAST(ceil(l_extendedprice) AS BIGINT) AS high, l_partkey % 7 AS rest, l_linenumber / 2 AS half,
           round(pow(l_tax, 2), 8) AS squared, greatest(l_discount, l_tax) AS bigger, least(l_discount, l_tax) AS smaller,
           CAST(sign(l_discount - l_tax) AS DOUBLE) AS direction FROM lineitem""", """
    SELECT l_orderkey, l_linenumber, l_partkey, abs(l_discount - 0.05) < 0.01 AS near, round(sqrt(l_quantity), 8) AS root,
           round(ln(l_extendedprice), 8) AS logged, CAST(floor(l_extendedprice) AS BIGINT) AS low,
           CAST(ceil(l_extendedprice) AS BIGINT) AS high, l_partkey % 7 AS rest, l_linenumber / 2 AS half,
           round(pow(l_tax, 2), 8) AS squared, greatest(l_discount, l_tax) AS bigger, least(l_discount, l_tax) AS smaller,
           CAST(sign(l_discount - l_tax) AS DOUBLE) AS direction FROM lineitem""")

dialect("sql_arrays", ["embeddings"], """
    SELECT vec_id, size(embedding) AS width, round(CAST(embedding[0] AS DOUBLE), 5) AS first,
           size(filter(embedding, x -> x > 0)) AS positive,
           round(aggregate(transform(embedding, x -> CAST(x AS DOUBLE) * x), 0.0D, (a, x) -> a + x), 5) AS norm,
           round(CAST(array_max(embedding) AS DOUBLE), 5) AS top, size(slice(embedding, 1, 5)) AS head
    FROM embeddings""", """
    SELECT vec_id, CAST(len(embedding) AS INT) AS width, round(CAST(embedding[1] AS DOUBLE), 5) + 0.0 AS first,
           CAST(len(list_filter(embedding, lambda x: x > 0)) AS INT) AS positive,
           round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x)), 5) + 0.0 AS norm,
           round(CAST(list_max(embedding) AS DOUBLE), 5) + 0.0 AS top, CAST(len(embedding[1:5]) AS INT) AS head
    FROM embeddings""")

dialect("sql_explode", ["conversations"], """
    SELECT conv_id, turn, word, count(*) AS n FROM (
        SELECT conv_id, turn, explode(split(lower(text), ' ')) AS word FROM conversations) GROUP BY conv_id, turn, word""", """
    SELECT conv_id, turn, word, count(*) AS n FROM (
        SELECT conv_id, turn, unnest(string_split(lower(text), ' ')) AS word FROM conversations) GROUP BY ALL""")

dialect("sql_json", ["events"], """
    SELECT event_type, CAST(sum(CAST(get_json_object(props, '$.k') AS BIGINT)) AS BIGINT) AS total,
           max(from_json(props, 'k INT').k) AS top,
           CAST(sum(map_from_arrays(array('k'), array(from_json(props, 'k INT').k))['k']) AS BIGINT) AS mapped
    FROM events GROUP BY event_type""", """
    SELECT event_type, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS total,
           max(CAST(json_extract(props, '$.k') AS INT)) AS top,
           CAST(sum(map([ 'k' ], [CAST(json_extract(props, '$.k') AS INT)])['k']) AS BIGINT) AS mapped
    FROM events GROUP BY event_type""")

dialect("sql_structs", ["nation", "region"], """
    SELECT r_name, size(nations) AS n, nations[0].name AS first, nations[0].key AS first_key FROM (
        SELECT r_name, array_sort(collect_list(named_struct('name', n_name, 'key', n_nationkey))) AS nations
        FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name)""", """
    SELECT r_name, CAST(len(nations) AS INT) AS n, nations[1].name AS first, nations[1].key AS first_key FROM (
        SELECT r_name, list_sort(list({'name': n_name, 'key': n_nationkey})) AS nations
        FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name)""")

dialect("sql_exclude_columns", ["customer"],
        "SELECT * EXCEPT (c_name, c_acctbal) FROM customer",
        "SELECT * EXCLUDE (c_name, c_acctbal) FROM customer")


@query("sql_sample")
def sql_sample(spark, d):
    """A tenth of the lines; the sampling operator itself."""
    views(spark, d, "lineitem")
    return spark.sql("SELECT l_returnflag, count(*) AS n FROM lineitem TABLESAMPLE (10 PERCENT) REPEATABLE (7) "
                     "GROUP BY l_returnflag")


@query("sql_describe_values", """
    SELECT lang, count(*) AS n, round(avg(n_chars), 4) + 0.0 AS mean, median(n_chars) AS middle,
           CAST(sum(length(text)) AS BIGINT) AS letters FROM documents GROUP BY lang""")
def sql_describe_values(spark, d):
    docs = table(spark, d, "documents")
    middle = grouped_quantiles(docs, ["lang"], "n_chars", [0.5], ["middle"])
    return docs.groupBy("lang").agg(
        F.count(F.lit(1)).alias("n"), rounded(F.avg("n_chars"), 4, "mean"),
        F.sum(F.length("text")).alias("letters")).join(middle, "lang")
