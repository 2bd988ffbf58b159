"""Model lineage: parent chains, the data used along them, and reuse checks."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prepforge.errors import DataError
from prepforge.functions.columns import quoted
from prepforge.operators.ordering import highest_so_far, ordered_totals
from prepforge.session import drop, settle


LEVELS = 5              # rounds of doubling that gather ancestors in arrays: 32 of them at most


def lineage(models: DataFrame, starts: DataFrame | None = None,
            version: str = "version", parent: str = "parent") -> DataFrame:
    """Ancestors of the start versions: start, version, depth (0 = the model itself).

    ``models`` has one row per version; ``starts`` is a one-column frame (all
    versions when absent). Pointer doubling: after k rounds the chains reach
    2^k levels up, so even very long chains take few joins. Of all versions,
    each gathers its nearest 2^LEVELS ancestors in an array, one row per version
    and round; only longer chains are continued by rows, one for each array.
    Ancestors shared by very many chains are split by the engine at run time.
    """
    edges = models.select(quoted(version).alias("version"), quoted(parent).alias("up")).where("version IS NOT NULL")
    if starts is None:
        edges = settle(edges, "models")
        if edges.groupBy("version").count().where("count > 1").isEmpty():
            edges = settle(_known(edges), "models")
            chain = _gathered(edges)
            chain.forest = edges
            return chain
    jump = settle(edges.where("up IS NOT NULL").join(
        edges.select(F.col("version").alias("up")), "up", "left_semi"), "jump")
    first = starts if starts is not None else edges.select("version")
    return _walked(first.toDF("version").join(edges, "version", "left_semi"), jump, 1)


def _known(edges: DataFrame) -> DataFrame:
    """Parents that have no row of their own become null."""
    names = edges.select(F.col("version").alias("up"))
    inner = edges.where("up IS NOT NULL")
    return edges.where("up IS NULL").unionByName(inner.join(names, "up", "left_semi")).unionByName(
        inner.join(names, "up", "left_anti").withColumn("up", F.lit(None).cast(edges.schema["up"].dataType)))


def _walked(first: DataFrame, jump: DataFrame, stride: int) -> DataFrame:
    """Rows start, version, depth of every ``stride``-th ancestor; ``jump`` leads from version to up, as far away.

    Each round writes only what it adds.
    """
    parts = [first.select(F.col("version").alias("start"), "version",
                          F.lit(0).cast("bigint").alias("depth"))]
    step, longest = 1, jump.count()
    while True:
        reached = reduce(DataFrame.union, parts)
        more = reached.join(jump, "version").select(
            "start", F.col("up").alias("version"), (F.col("depth") + step * stride).alias("depth"))
        more = settle(more, "chain")
        added = more.count()
        if not added:
            return reached
        if step > longest:
            raise DataError("the parent links form a circle")
        parts.append(more)
        upper = jump.select(F.col("version").alias("up"), F.col("up").alias("top"))
        # many versions may jump to one, which is unique on the other side: the engine splits such a key
        jump = settle(jump.join(upper, "up").select("version", F.col("top").alias("up")), "jump")
        step *= 2


def _climbed(state: DataFrame, value: str, combine, rounds: int | None = None) -> DataFrame:
    """Pointer doubling on rows ``version, up, value, ...``: what lies above is combined into ``value``.

    Every round looks up only those rows that someone points to. Rows whose
    ``up`` is null are done and stay as written; with ``rounds`` given, the ``up``
    of the others leads 2^rounds levels up.
    """
    done, active = [state.where("up IS NULL")], state.where("up IS NOT NULL")
    turn = 0
    while turn != rounds:
        turn += 1
        wanted = settle(active.select(F.col("up").alias("version")).distinct(), "wanted")
        if wanted.isEmpty():
            break
        above = settle(reduce(DataFrame.unionByName, [*done, active]).join(wanted, "version", "left_semi").select(
            F.col("version").alias("up"), F.col("up").alias("top"), F.col(value).alias("__above")), "above")
        moved = settle(active.join(above, "up").withColumn(value, combine(F.col(value), F.col("__above"))).withColumn(
            "up", F.col("top")).select(*state.columns), "climbed")
        drop(wanted)
        drop(above)
        done.append(moved.where("up IS NULL"))
        active = moved.where("up IS NOT NULL")
    return reduce(DataFrame.unionByName, [*done, active])


def _gathered(edges: DataFrame) -> DataFrame:
    """The chains of all versions, of which each has one row."""
    arrays = _climbed(edges.withColumn("path", F.array("version")), "path", F.concat, LEVELS)
    jump = arrays.where("up IS NOT NULL").select("version", "up")
    if jump.isEmpty():
        heads = arrays.select(F.col("version").alias("start"), F.lit(0).cast("bigint").alias("base"), "path")
    else:
        heads = _walked(edges.select("version"), settle(jump, "jump"), 2 ** LEVELS).withColumnRenamed("depth", "base").join(
            arrays.select("version", "path"), "version")
    return heads.select("start", "base", F.posexplode("path").alias("place", "version")).select(
        "start", "version", (F.col("base") + F.col("place")).alias("depth"))


def _intervals(edges: DataFrame) -> DataFrame:
    """``version, low, high``: a version's descendants and itself are those whose ``low`` lies in [low, high).

    ``edges`` is a forest, one row per version. Sizes of subtrees come by
    doubling; siblings are placed one behind the other, below their parent.
    """
    state, settled = edges.withColumn("size", F.lit(1).cast("bigint")), False
    while True:
        below = settle(state.where("up IS NOT NULL").groupBy(F.col("up").alias("version")).agg(
            F.sum("size").alias("more")), "below")
        if below.isEmpty():
            break
        above = settle(state.join(below, "version", "left_semi").select(
            F.col("version").alias("up"), F.col("up").alias("top")), "above")
        grown = state.join(below, "version", "left").select(
            "version", "up", (F.col("size") + F.coalesce("more", F.lit(0))).alias("size"))
        before, state = state, settle(grown.where("up IS NULL").unionByName(
            grown.where("up IS NOT NULL").join(above, "up").select("version", F.col("top").alias("up"), "size")), "sizes")
        for frame in [below, above, *([before] if settled else [])]:
            drop(frame)
        settled = True
    sized = edges.join(state.select("version", "size"), "version")
    placed = settle(ordered_totals(sized, [F.col("up"), F.col("version")], ["size"]), "placed")
    if settled:
        drop(state)
    roots, inner = placed.where("up IS NULL"), placed.where("up IS NOT NULL")
    firsts = inner.groupBy("up").agg(F.min("size_before").alias("first"))
    offsets = roots.select("version", "up", "size", F.col("size_before").alias("low")).unionByName(
        inner.join(firsts, "up").select("version", "up", "size", (F.col("size_before") - F.col("first") + 1).alias("low")))
    offsets = settle(offsets, "offsets")
    drop(placed)
    found = _climbed(offsets, "low", lambda own, above: own + above)
    return settle(found.select("version", "low", (F.col("low") + F.col("size")).alias("high")), "intervals")


def children(models: DataFrame, version: str = "version", parent: str = "parent") -> DataFrame:
    """Pairs (version, child) for every model that has children."""
    return models.where(quoted(parent).isNotNull()).select(
        quoted(parent).alias("version"), quoted(version).alias("child"))


def children_of(models: DataFrame, of: str, version: str = "version",
                parent: str = "parent") -> DataFrame:
    return models.where(quoted(parent) == F.lit(of))


def used_hashes(chain: DataFrame, history: DataFrame) -> DataFrame:
    """Distinct (start, dataset_hash) used by a model or any of its ancestors.

    ``chain`` comes from ``lineage``; ``history`` has version, dataset_hash.
    ``hash_counts`` and ``duplicate_datasets`` need no such pairs if the chain
    is that of all versions.
    """
    per_model = history.select("version", "dataset_hash")
    used = chain.join(per_model, "version").select("start", "dataset_hash").distinct()
    if (forest := vars(chain).get("forest")) is not None:
        used.lineage = (forest, per_model)
    return used


def _short(mark):
    """A hash as bytes, half as long if it is written in hexadecimal digits."""
    packed = F.unhex(mark)
    return F.when(F.lower(F.hex(packed)) == mark, F.concat(F.unhex(F.lit("01")), packed)).when(
        mark.isNotNull(), F.concat(F.unhex(F.lit("00")), F.encode(mark, "UTF-8")))


def _hash_intervals(forest: DataFrame, per_model: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The intervals of all versions, and ``mark, low, high`` where a version itself uses a hash; none is an empty mark."""
    intervals = _intervals(forest)
    own = per_model.select("version", F.coalesce(_short(F.col("dataset_hash").cast("string")), F.unhex(F.lit(""))).alias("mark"))
    return intervals, own.join(intervals, "version").select("mark", "low", "high")


def hash_counts(used: DataFrame) -> DataFrame:
    """start, hashes: how many rows of ``used_hashes`` a start has.

    A hash counts where it first appears on the way from the root: in the
    version that uses it with no ancestor doing so. A start's count is the sum
    of those along its chain, a running total over the ends of intervals.
    """
    if (source := vars(used).get("lineage")) is None:
        return used.groupBy("start").agg(F.count(F.lit(1)).alias("hashes"))
    intervals, own = _hash_intervals(*source)
    seen = highest_so_far(own, ["mark"], "low", "high", "reach", -1)
    fresh = settle(seen.where("reach IS NULL OR reach <= low").groupBy("low", "high").agg(
        F.countDistinct("mark").alias("n")), "fresh")
    events = fresh.select(F.col("low").alias("at"), "n").unionByName(fresh.select(F.col("high").alias("at"), -F.col("n")).toDF("at", "n"))
    starts = intervals.select(F.col("low").alias("at"), F.lit(0).cast("bigint").alias("n"), F.col("version").alias("start"))
    totals = ordered_totals(events.withColumn("start", F.lit(None).cast(starts.schema["start"].dataType)).unionByName(starts)
                            .groupBy("at").agg(F.sum("n").alias("n"), F.max("start").alias("start")), [F.col("at")], ["n"])
    return totals.where("start IS NOT NULL").select("start", (F.col("n_before") + F.col("n")).alias("hashes")).where("hashes > 0")


def _keyed(mark):
    """128 bits that stand for a hash."""
    text = mark.cast("string")
    return {"k1": F.xxhash64(text), "k2": F.xxhash64(F.lit(1), text)}


def _swept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of one range of rows in the order of (k1, k2, low), those with an end first, which rows without one (-1) lie
    before the farthest end so far (kind 0); which do not, but have the range's first key, so ranges before may tell
    (kind 1); and the farthest ends of the first key and of the last one (kind 2)."""
    part, key, best, first = TaskContext.get().partitionId(), None, -1, None
    names = ["part", "kind", "k1", "k2", "low", "high"]

    def rows(kind, *columns):
        n = len(columns[0])
        return pa.RecordBatch.from_arrays([pa.array(np.full(n, part, np.int64)), pa.array(np.full(n, kind, np.int64)),
                                           *[pa.array(np.asarray(c, dtype=np.int64)) for c in columns]], names)

    for batch in batches:
        k1, k2, low, high = (batch.column(c).to_numpy(zero_copy_only=False) for c in names[2:])
        if not len(k1):
            continue
        new = np.empty(len(k1), dtype=bool)
        new[0] = key != (k1[0], k2[0])
        new[1:] = (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])
        if first is None:
            first, new[0] = (k1[0], k2[0]), False
        seg = np.cumsum(new)
        ends = high.copy()
        if seg[0] == 0:
            ends[0] = max(ends[0], best)
        span = int(ends.max()) + 2
        reach = np.maximum.accumulate(seg * span + ends + 1) - seg * span - 1
        hit = (high < 0) & (reach > low)
        open_ = (high < 0) & ~hit & (k1 == first[0]) & (k2 == first[1])
        if key in (None, first) and new.any():      # the first key ends
            at = int(np.flatnonzero(new)[0]) - 1
            yield rows(2, [first[0]], [first[1]], [0], [reach[at] if at >= 0 else best])
        for kind, some in ((0, hit), (1, open_)):
            if some.any():
                yield rows(kind, k1[some], k2[some], low[some], high[some])
        key, best = (k1[-1], k2[-1]), int(reach[-1])
    if key is not None:
        yield rows(2, [key[0]], [key[1]], [0], [best])


def duplicate_datasets(candidates: DataFrame, used: DataFrame) -> DataFrame:
    """Candidate rows (start, dataset_hash, …) whose data the lineage has seen.

    Of the intervals of versions that use a hash, those that hold a start's place
    begin before it and end behind it: the farthest end so far decides. Only
    places and 128 bits of a hash are put in order, by ranges; a range answers for
    itself, and what its first key needs to know of the ranges before is a row of
    each.
    """
    if (source := vars(used).get("lineage")) is None:
        return candidates.join(used, ["start", "dataset_hash"], "left_semi")
    forest, per_model = source
    intervals = _intervals(forest)
    own = settle(per_model.where("dataset_hash IS NOT NULL").select("version", *[
        c.alias(k) for k, c in _keyed(F.col("dataset_hash")).items()]).join(intervals, "version").select("k1", "k2", "low", "high"), "used")
    places = intervals.select(F.col("version").alias("start"), "low")
    asked = settle(candidates.where("dataset_hash IS NOT NULL").select("start", *[
        c.alias(k) for k, c in _keyed(F.col("dataset_hash")).items()]).join(places, "start").select(
            "k1", "k2", "low", F.lit(-1).cast("bigint").alias("high")), "asked")
    swept = settle(own.unionByName(asked).repartitionByRange("k1", "k2", "low").sortWithinPartitions(
        "k1", "k2", "low", F.desc("high")).mapInArrow(
        _swept, "part bigint, kind bigint, k1 bigint, k2 bigint, low bigint, high bigint"), "swept")
    drop(own)
    drop(asked)
    ends = swept.where("kind = 2").select("k1", "k2", F.col("part").alias("of"), F.col("high").alias("end"))
    late = swept.where("kind = 1").join(F.broadcast(ends), ["k1", "k2"]).where("of < part AND end > low")
    hits = swept.where("kind = 0").select("k1", "k2", "low").unionByName(late.select("k1", "k2", "low")).distinct()
    pairs = settle(hits.join(places, "low").select("start", F.col("k1").alias("__k1"), F.col("k2").alias("__k2")), "reused")
    keys = {f"__{k}": c for k, c in _keyed(F.col("dataset_hash")).items()}
    return candidates.withColumns(keys).join(pairs, ["start", *keys], "left_semi").select(*[quoted(c) for c in candidates.columns])


def with_row_counts(names: DataFrame, datasets: DataFrame, key: str = "dataset_name") -> DataFrame:
    """Adds row_count from the catalog, 0 for an unknown dataset."""
    counts = datasets.select(F.col("name").alias(key), F.col("row_count").alias("__rows"))
    return names.join(counts, key, "left").withColumn(
        "row_count", F.coalesce("__rows", F.lit(0)).cast("bigint")).drop("__rows")


def job_history(jobs: DataFrame, history: DataFrame) -> DataFrame:
    """What each job's resulting model was trained on."""
    return jobs.join(history, jobs["result_version"] == history["version"], "inner").drop("version")
