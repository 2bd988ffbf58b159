import datetime
import random

import pytest
from pyspark.sql import functions as F

from prepforge.errors import DataError
from prepforge.operators import bands as bands_module
from prepforge.operators import lineage as lineage_module
from prepforge.operators import ordering as ordering_module
from prepforge.operators.asof import asof_join
from prepforge.operators.bands import band_join, band_totals
from prepforge.operators.lineage import duplicate_datasets, hash_counts, lineage, used_hashes, with_row_counts
from prepforge.operators.ordering import highest_so_far, last_so_far, latest_per_key, newest_first, ordered_totals


def test_long_chain(spark):
    models = spark.range(300).select("id", F.expr("CASE WHEN id > 0 THEN id - 1 END").alias("parent"))
    start = spark.createDataFrame([(299,)], "version bigint")
    chain = lineage(models, start, "id").orderBy("depth").collect()
    assert [r["version"] for r in chain] == list(range(299, -1, -1))
    assert [r["depth"] for r in chain] == list(range(300))


def test_forest_against_walking(spark):
    parent = {i: (i * 7) // 11 if i % 5 else None for i in range(60)}
    models = spark.createDataFrame(list(parent.items()), "version bigint, parent bigint")
    got = {(r["start"], r["version"], r["depth"]) for r in lineage(models).collect()}
    want = set()
    for start in parent:
        at, depth = start, 0
        while at is not None:
            want.add((start, at, depth))
            at, depth = parent[at], depth + 1
    assert got == want


def test_circle_is_refused(spark):
    models = spark.createDataFrame([(1, 2), (2, 1)], "version bigint, parent bigint")
    with pytest.raises(DataError):
        lineage(models)


def test_missing_parent_ends_the_chain(spark):
    models = spark.createDataFrame([("b", "gone")], "version string, parent string")
    assert lineage(models).count() == 1


def test_used_and_duplicate(spark):
    models = spark.createDataFrame([("1.0.0", None), ("1.1.0", "1.0.0")], "version string, parent string")
    history = spark.createDataFrame([("1.0.0", "h1"), ("1.1.0", "h2"), ("1.1.0", "h1")],
                                    "version string, dataset_hash string")
    used = used_hashes(lineage(models), history)
    assert {tuple(r) for r in used.collect()} == {("1.0.0", "h1"), ("1.1.0", "h1"), ("1.1.0", "h2")}
    asked = spark.createDataFrame([("1.0.0", "h2"), ("1.1.0", "h2"), ("1.1.0", "h2"), ("1.1.0", "h9")],
                                  "start string, dataset_hash string")
    assert duplicate_datasets(asked, used).count() == 2


def test_row_counts_default_to_zero(spark):
    names = spark.createDataFrame([("a",), ("x",)], "dataset_name string")
    known = spark.createDataFrame([("a", 7)], "name string, row_count bigint")
    got = {r["dataset_name"]: r["row_count"] for r in with_row_counts(names, known).collect()}
    assert got == {"a": 7, "x": 0}


def test_ordered_totals(spark):
    df = spark.range(1000).select((F.col("id") * 37 % 1000).alias("k"), (F.col("id") * 37 % 1000 + 1).alias("n"))
    got = {r["k"]: r["n_before"] for r in ordered_totals(df, [F.col("k")], ["n"]).collect()}
    assert got == {k: k * (k + 1) // 2 for k in range(1000)}


def test_latest_and_newest(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 3, "y"), ("b", 2, "z")], "k string, t int, v string")
    got = {r["k"]: (r["v"], r["t0"]) for r in latest_per_key(df, ["k"], ["t"], {"t0": "t"}).collect()}
    assert got == {"a": ("y", 1), "b": ("z", 2)}
    assert [r["t"] for r in newest_first(df, "t", "k", 2).collect()] == [3, 2]


def test_asof_against_brute_force(spark):
    start = datetime.datetime(2024, 1, 1)
    at = lambda h: start + datetime.timedelta(hours=h)
    left = [(i, "a" if i % 3 else "b", at(i * 5 % 97)) for i in range(60)] + [(99, None, at(4)), (98, "a", None)]
    right = [("a" if j % 2 else "b", at(j * 11 % 97), float(j)) for j in range(25)] + [(None, at(1), 5.0)]
    got = {r["id"]: r["asof_v"] for r in asof_join(
        spark.createDataFrame(left, "id int, k string, t timestamp"),
        spark.createDataFrame(right, "k string, s timestamp, v double"), ["k"], "t", "s", ["v"]).collect()}
    for i, k, t in left:
        before = [(s, v) for kk, s, v in right if k is not None and kk == k and t is not None and s <= t]
        assert got[i] == (max(before)[1] if before else None)
    assert len(got) == len(left)


def test_asof_on_one_key_spreads(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        left = spark.range(4000).select("id", F.lit("k").alias("k"), (F.col("id") * 37 % 4001).alias("t"))
        right = spark.range(40).select(F.lit("k").alias("k"), (F.col("id") * 101 % 4001).alias("s"), F.col("id").alias("v"))
        got = {r["id"]: (r["asof_s"], r["asof_v"]) for r in asof_join(left, right, ["k"], "t", "s", ["v"]).collect()}
        known = sorted((r["s"], r["v"]) for r in right.collect())
        for r in left.collect():
            assert got[r["id"]] == max([x for x in known if x[0] <= r["t"]], default=(None, None))
        both = left.select("k", F.col("t").alias("at"), F.lit(None).cast("bigint").alias("v")).unionByName(
            right.select("k", F.col("s").alias("at"), "v"))
        parts = last_so_far(both, ["k"], ["at"], ["at", "v"], "v", "found").groupBy(F.spark_partition_id()).count().collect()
        assert len(parts) > 3 and max(r["count"] for r in parts) < 2000
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_popular_ancestor(spark):
    models = spark.range(500).select("id", F.when(F.col("id") >= 2, F.col("id") % 2).when(
        F.col("id") == 1, F.lit(0)).cast("bigint").alias("parent"))
    got = lineage(models, version="id").groupBy("depth").count().collect()
    assert {r["depth"]: r["count"] for r in got} == {0: 500, 1: 499, 2: 249}


def test_band_join_against_brute_force(spark):
    r = random.Random(1)
    points = [(i, r.choice("ab"), r.choice([None, r.randrange(-50, 300), r.randrange(-50, 300)])) for i in range(300)]
    bands = [(j, r.choice(["a", "b", None]), (low := r.randrange(-60, 320)), low + r.choice([-1, 0, 0, 1, 3, 17, 200]))
             for j in range(60)] + [(99, "a", None, 4), (98, "b", -2 ** 40, 2 ** 40)]
    p = spark.createDataFrame(points, "i int, k string, v bigint")
    q = spark.createDataFrame(bands, "j int, k string, lo bigint, hi bigint")
    for by in (["k"], []):
        joined = band_join(p, q if by else q.drop("k"), "v", "lo", "hi", by)
        got = sorted((x["i"], x["j"]) for x in joined.collect())
        assert got == sorted((i, j) for i, k, v in points for j, kk, low, high in bands if None not in (v, low)
                             and low <= v <= high and (not by or k == kk)) and len(got) > 200
        assert "NestedLoop" not in joined._jdf.queryExecution().toString() and "Cartesian" not in str(joined)
    assert band_join(p, q.limit(0).drop("k"), "v", "lo", "hi").count() == 0


def test_hash_counts_and_reuse_without_pairs(spark):
    r = random.Random(3)
    parent = {i: r.choice([None, i - 1, i // 2, r.randrange(i), 10 ** 6]) if i else None for i in range(400)}
    models = spark.createDataFrame(list(parent.items()) + [(None, 5)], "version bigint, parent bigint")
    used_by = [(r.randrange(420), r.choice(["", "ab", "AB", "abc", "x", None, "0f", f"{r.randrange(60):064x}"])) for _ in range(900)]
    history = spark.createDataFrame(used_by, "version bigint, dataset_hash string")
    asked = [(r.randrange(420), r.choice(used_by)[1], i) for i in range(800)] + [(7, "new", 800), (None, "x", 801)]
    per = {}
    for v, h in used_by:
        per.setdefault(v, set()).add(h)
    want = {}
    for start in parent:
        at, seen = start, set()
        while at is not None and at in parent:
            seen |= per.get(at, set())
            at = parent[at]
        want[start] = seen
    used = used_hashes(lineage(models), history)
    plans = []
    for frame, got in ((hash_counts(used), {s: len(h) for s, h in want.items() if h}),
                       (duplicate_datasets(spark.createDataFrame(asked, "start bigint, dataset_hash string, i int"), used),
                        {i for s, h, i in asked if h is not None and h in want.get(s, ())})):
        rows = frame.collect()
        assert len(rows) == len(got)
        assert ({x["start"]: x["hashes"] for x in rows} if isinstance(got, dict) else {
            x["i"] for x in rows if (x["start"], x["dataset_hash"], x["i"]) in asked}) == got
        plans.append(frame._jdf.queryExecution().toString())
    assert {(s, h) for s, hs in want.items() for h in hs} == {tuple(x) for x in used.collect()}
    assert not any("posexplode" in p or "Generate" in p for p in plans)      # no row per version and ancestor


def test_lineage_of_all_versions_in_a_deep_forest(spark):
    parent = {i: i - 1 if i % 150 else None for i in range(300)} | {1000 + i: 140 for i in range(200)}
    chain = lineage(spark.createDataFrame(list(parent.items()), "version bigint, parent bigint"))
    want = set()
    for start in parent:
        at, depth = start, 0
        while at is not None:
            want.add((start, at, depth))
            at, depth = parent[at], depth + 1
    got = [tuple(x) for x in chain.collect()]
    assert len(got) == len(want) and set(got) == want


def test_repeated_versions_multiply_their_chains(spark):
    twice = spark.createDataFrame([(1, None), (2, 1), (2, 1), (3, 2), (4, 1), (4, 3)], "version bigint, parent bigint")
    counts = {(x["start"], x["version"], x["depth"]): x["count"]
              for x in lineage(twice).groupBy("start", "version", "depth").count().collect()}
    assert counts[(3, 2, 1)] == 1 and counts[(3, 1, 2)] == 2 and counts[(2, 1, 1)] == 4 and counts[(4, 1, 1)] == 2
    history = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "version bigint, dataset_hash string")
    used = used_hashes(lineage(twice), history)
    assert {(x["start"], x["hashes"]) for x in hash_counts(used).collect()} == {(1, 1), (2, 2), (3, 2), (4, 2)}


def test_running_highest_of_one_key_spreads(spark):
    rows = [("k" if i % 9 else "j", i * 37 % 500 // 2, i * 101 % 997 if i % 4 else None) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, at bigint, v bigint").repartition(3)
    for reach in (0, -1):
        got = highest_so_far(df, ["k"], "at", "v", "top", reach).collect()
        assert len(got) == len(rows)
        for x in got:
            assert x["top"] == max([v for k, at, v in rows if k == x["k"] and at <= x["at"] + reach and v is not None], default=None)


def test_totals_of_a_band_join_without_its_pairs(spark):
    r = random.Random(5)
    points = [(r.choice([None, *range(9)]), r.choice("ab"), r.choice([None, *range(-40, 200)]), r.choice([None, 1.5, 2.25])) for _ in range(400)]
    bands = [(j if j % 7 else None, r.choice(["a", "b", None]), (low := r.randrange(-60, 220)), low + r.choice([-1, 0, 1, 3, 17, 90]))
             for j in range(60)]
    bands += bands[:20] + [(3, "a", 0, 50), (3, "b", 20, 90), (99, "a", None, 4), (98, "b", -2 ** 40, 2 ** 40)]
    p = spark.createDataFrame(points, "u int, k string, v bigint, x double")
    q = spark.createDataFrame(bands, "j int, k string, lo bigint, hi bigint")
    for by in (["k"], []):
        joined = band_join(p, q if by else q.drop("k"), "v", "lo", "hi", by)
        want = {}
        for j, kk, low, high in bands:
            for u, k, v, x in points:
                if None not in (v, low) and low <= v <= high and (not by or k == kk):
                    want.setdefault(j, []).append((u, x))
        got = band_totals(joined, "j", "u", "x").collect()
        assert {g["j"]: (g["n"], g["n_distinct"], g["total"]) for g in got} == {
            j: (len(m), len({u for u, _ in m} - {None}), sum(t) if (t := [x for _, x in m if x is not None]) else None)
            for j, m in want.items()} and len(got) == len(want) > 15


@pytest.mark.parametrize("block, blocks, kind", [(7, 1000, "double"), (1, 5, "int"), (7, 512, "decimal(12,2)")])
def test_totals_of_bands_over_many_blocks(spark, monkeypatch, block, blocks, kind):
    monkeypatch.setattr(bands_module, "BLOCK", block)
    monkeypatch.setattr(bands_module, "BLOCKS", blocks)
    r = random.Random(block)
    points = [(r.choice([None, *range(12)]), r.randrange(0, 10 ** 12), r.choice([None, 2, 7])) for _ in range(150)]
    points += [(1, 10 ** 12 + 1, 10 ** 9 if kind != "double" else 10 ** 18), (2, 5 * 10 ** 11, 3), (2, 5 * 10 ** 11, 4)]
    bands = [(j, (low := r.randrange(0, 10 ** 12)), low + r.randrange(10 ** r.randrange(1, 13))) for j in range(80)]
    bands += [(80, -2 ** 60, 2 ** 60), (81, 5 * 10 ** 11, 5 * 10 ** 11), (82, 5, 4)]
    p = spark.createDataFrame(points, "u int, v bigint, x bigint").withColumn("x", F.col("x").cast(kind))
    joined = band_join(p, spark.createDataFrame(bands, "j int, lo bigint, hi bigint"), "v", "lo", "hi")
    want = {j: [(u, x) for u, v, x in points if low <= v <= high] for j, low, high in bands}
    found = band_totals(joined, "j", "u", "x")
    assert found.schema["total"].dataType == joined.select(F.sum("x")).schema[0].dataType
    assert {g["j"]: (g["n"], g["n_distinct"], g["total"]) for g in found.collect()} == {
        j: (len(m), len({u for u, _ in m} - {None}), pytest.approx(sum(t), rel=1e-15) if (t := [x for _, x in m if x is not None]) else None)
        for j, m in want.items() if m}


def test_totals_of_bands_move_a_row_a_fixed_number_of_times(spark, monkeypatch):
    """However long the bands are, and from how fine a scale; before, a point was written once for each power of two."""
    written = []
    for module in (bands_module, ordering_module):
        def counted(df, label="stage", kept=module.settle):
            out = kept(df, label)
            written.append(out.count())
            return out
        monkeypatch.setattr(module, "settle", counted)
    p = spark.range(2000).selectExpr("id % 50 AS u", "id * 1000003 % 900000000007 AS v", "CAST(id AS DOUBLE) AS x")
    q = spark.range(300).selectExpr("id AS j", "id * 7919 AS lo", "id * 7919 + id * id * 1000000 AS hi")
    rows = band_totals(band_join(p, q, "v", "lo", "hi"), "j", "u", "x").collect()
    assert len(rows) == 300 - sum(1 for j in range(300) if not any(
        j * 7919 <= i * 1000003 % 900000000007 <= j * 7919 + j * j * 1000000 for i in range(2000)))
    assert sum(written) < 12 * (2000 + 2 * 300)


def test_reuse_of_a_hash_that_fills_many_ranges(spark, monkeypatch):
    """One hash over all ranges of the order, and no more written than places and 128 bits; before, whole rows were."""
    written = []
    def counted(df, label="stage", kept=lineage_module.settle):
        written.append((label, df.columns))
        return kept(df, label)
    monkeypatch.setattr(lineage_module, "settle", counted)
    r = random.Random(11)
    parent = {i: r.choice([None, i - 1, i // 2]) if i else None for i in range(300)}
    models = spark.createDataFrame(list(parent.items()), "version bigint, parent bigint")
    uses = [(i, "hot") for i in r.sample(range(300), 12)] + [(r.randrange(300), f"h{r.randrange(9)}") for _ in range(60)]
    asked = [(r.randrange(300), r.choice(["hot", "hot", "h1", "h2", "other"]), "x" * 50, i) for i in range(900)]
    used = used_hashes(lineage(models), spark.createDataFrame(uses, "version bigint, dataset_hash string"))
    candidates = spark.createDataFrame(asked, "start bigint, dataset_hash string, note string, i int")
    def above(v):
        while v is not None:
            yield v
            v = parent[v]
    want = {i for s, h, _, i in asked if any((v, h) in set(uses) for v in above(s))}
    for parts in ("4", "23"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        try:
            got = duplicate_datasets(candidates, used).collect()
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")
            spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        assert {g["i"] for g in got} == want and len(got) == len(want) > 30
    assert not any("note" in columns or "row" in columns or "mark" in columns for _, columns in written)
