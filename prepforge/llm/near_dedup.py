"""Near-duplicate groups: SuperMinHash signatures, banding, verification on full sets, union-find."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prepforge.llm.collocations import bitmap, marked
from prepforge.llm.components import components
from prepforge.llm.tables import Scratch, only
from prepforge.llm.textblocks import Block, blocks, mixed, sets, sums, windows

SIZE = 128              # positions of a signature
ROWS = 4                # positions per band: a pair at 0.75 shares none of 32 bands once in 190,000 pairs
PERCENT = 75            # similarity from which documents are linked
CROWD = 64              # texts from which a shingle is frequent
MARKS = 1 << 22         # frequent shingles that are marked at most; with more, only the more frequent ones

_DRAW = np.uint64(0x9E3779B97F4A7C15)
_LOW = np.uint64(0xFFFFFFFF)
_HALF = np.uint64(32)


def superminhash(found: np.ndarray, bounds: np.ndarray, size: int = SIZE) -> np.ndarray:
    """SuperMinHash signatures of sets of 64-bit values, one row of ``size`` values per set.

    Every element owns a random permutation of the positions and offers its
    j-th position the rank ``j + random``; a position keeps its smallest rank.
    All elements of all sets take step j together. A set leaves as soon as all
    its positions hold ranks of steps already taken, which no later step can
    lower; large sets leave after the first step. Rank: step in the high 32
    bits, fraction in the low. Empty sets keep the largest value everywhere.
    """
    n = len(bounds) - 1
    out = np.full((n, size), np.iinfo(np.uint64).max, dtype=np.uint64)
    flat = out.reshape(-1)
    owner = np.repeat(np.arange(n), np.diff(bounds))
    element = found
    swaps: list[np.ndarray] = []
    for step in range(size):
        if not len(element):
            break
        draw = mixed(element + np.uint64(int(_DRAW) * (step + 1) % (1 << 64)))
        swap = ((draw & _LOW) * np.uint64(size - step) >> _HALF).astype(np.int16) + np.int16(step)
        place = swap
        for i in range(step - 1, -1, -1):       # undo the swaps: which position has come to stand there
            place = np.where(swaps[i] == place, np.int16(i), place)
        np.minimum.at(flat, owner * size + place, (np.uint64(step) << _HALF) | (draw >> _HALF))
        open_ = (out.max(axis=1) >= np.uint64((step + 1) << 32))[owner]
        swaps.append(swap)
        if not open_.all():
            element, owner = element[open_], owner[open_]
            swaps = [s[open_] for s in swaps]
    return out


def band_keys(signatures: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """One 64-bit key per band; the band's number is part of it."""
    n, size = signatures.shape
    bands = signatures.reshape(n, size // rows, rows)
    keys = np.tile(np.arange(1, size // rows + 1, dtype=np.uint64), (n, 1))
    for r in range(rows):
        keys = mixed(keys * _DRAW + bands[:, :, r])
    return keys


def shingle_sets(block: Block) -> tuple[np.ndarray, np.ndarray]:
    low = block.lowered()
    starts, ends, first = low.words()
    return sets(*windows(low.hashes(starts, ends), first), low.rows)


def _lists(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values.view(np.int64)))


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block in blocks(batch.column("text")):
            found, bounds = shingle_sets(block)
            size = np.diff(bounds)
            keys = band_keys(superminhash(found, bounds))
            per = keys.shape[1]
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id").slice(block.first, block.rows),
                pa.array(size),
                pa.array(sums(mixed(found), bounds).view(np.int64)),
                pa.array(sums(mixed(found ^ _DRAW), bounds).view(np.int64)),
                _lists(keys.reshape(-1), np.arange(block.rows + 1) * per),
            ], ["doc_id", "n_shingles", "key_a", "key_b", "bands"])


def _full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sets of the texts that belong to their node's class; an id may stand on other texts too."""
    for batch in batches:
        for block in blocks(batch.column("text")):
            found, bounds = shingle_sets(block)
            own = [batch.column(k).slice(block.first, block.rows) for k in ("node", "key_a", "key_b")]
            rows = pa.array(np.flatnonzero(
                (sums(mixed(found), bounds).view(np.int64) == own[1].to_numpy(zero_copy_only=False))
                & (sums(mixed(found ^ _DRAW), bounds).view(np.int64) == own[2].to_numpy(zero_copy_only=False))))
            yield pa.RecordBatch.from_arrays([own[0].take(rows), _lists(found, bounds).take(rows)], ["node", "shingles"])


def _flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    bounds = lists.offsets.to_numpy().astype(np.int64)
    values = lists.values.to_numpy(zero_copy_only=False).view(np.uint64)
    return values[bounds[0]:bounds[-1]], bounds - bounds[0]


def _frequent(sets_: DataFrame) -> Broadcast:
    """A bitmap of the shingles that CROWD sets hold or more, by their own counts.

    Counts are summed before they are exchanged. With more than MARKS of them the
    limit rises fourfold until the bitmap tells them apart from others.
    """
    counted = Scratch(sets_.sparkSession, "near").write(
        sets_.select(F.explode("shingles").alias("token")).groupBy("token").agg(F.count("*").alias("n"))
        .where(f"n >= {CROWD}"))
    least = CROWD
    while counted.where(f"n >= {least}").count() > MARKS:
        least *= 4
    return bitmap(counted.where(f"n >= {least}"), ["token"])


def _confirmed(pairs: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """The pairs ``a, b`` whose full sets are similar enough."""
    of_a = full.select(F.col("node").alias("a"), F.col("shingles").alias("set_a"))
    of_b = full.select(F.col("node").alias("b"), F.col("shingles").alias("set_b"))
    shared = F.size(F.array_intersect("set_a", "set_b"))
    total = F.size("set_a") + F.size("set_b") - F.col("shared")
    return (pairs.join(of_b, "b").join(of_a, "a")
            .where(F.least(F.size("set_a"), F.size("set_b")) * 100
                   >= F.greatest(F.size("set_a"), F.size("set_b")) * percent)
            .withColumn("shared", shared)
            .where(F.col("shared") * 100 >= total * percent).select("a", "b"))


def _sharing_a_rare_shingle(sets_: DataFrame, percent: int) -> DataFrame:
    """All pairs ``a < b`` of nodes with different labels that can reach ``percent``; exact, for any sets.

    In any common order of shingles, two sets that are similar enough share one
    of the first ``n - ceil(n * percent / 100) + 1``, and what stands after the
    first shared one must suffice in both. Frequent shingles come last, so a
    passage that very many texts hold pairs none that differ enough elsewhere.
    For each shingle, nodes of its most frequent label are only compared with
    the others, so a large group is not compared within itself.
    """
    kind = sets_.schema["node"].dataType.simpleString()
    known = _frequent(sets_)

    def first_shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, bounds = _flat(batch.column("shingles"))
            taken = []
            for i in range(batch.num_rows):
                own = values[bounds[i]:bounds[i + 1]]
                own = own[np.argsort(marked(known.value, own), kind="stable")]
                taken.append(own[:len(own) - -(-len(own) * percent // 100) + 1])
            size = np.array([len(t) for t in taken], dtype=np.int64)
            row = pa.array(np.repeat(np.arange(batch.num_rows), size))
            token = np.concatenate(taken) if taken else np.empty(0, dtype=np.uint64)
            at = np.arange(len(token)) - np.repeat(np.cumsum(size) - size, size)
            yield pa.RecordBatch.from_arrays(
                [batch.column("node").take(row), batch.column("label").take(row),
                 pa.array(np.diff(bounds)).take(row), pa.array(at), pa.array(token.view(np.int64))],
                ["node", "label", "n", "at", "token"])

    rows = sets_.mapInArrow(first_shingles, f"node {kind}, label {kind}, n bigint, at bigint, token bigint")
    per = rows.groupBy("token", "label").agg(F.count("*").alias("members"))
    main = (per.groupBy("token").agg(F.max(F.struct("members", "label")).alias("main"), F.count("*").alias("labels"))
            .where("labels > 1").select("token", F.col("main.label").alias("main")))
    minor = rows.join(main, "token").where("label <> main").drop("main")
    x, y = minor.alias("x"), rows.alias("y")
    n_x, n_y = F.col("x.n"), F.col("y.n")
    reachable = F.least(n_x - F.col("x.at"), n_y - F.col("y.at")) * (100 + percent) >= (n_x + n_y) * percent
    fits = F.least(n_x, n_y) * 100 >= F.greatest(n_x, n_y) * percent
    differ = F.col("x.label") != F.col("y.label")
    return (x.join(y, (F.col("x.token") == F.col("y.token")) & differ & fits & reachable)
            .select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct())


def _same_id(filled: DataFrame, classes: DataFrame, keys: list[str]) -> DataFrame:
    """Links ``a, b`` of the classes of ids that stand on several texts."""
    key = F.struct(*keys)
    several = (filled.groupBy("doc_id").agg(F.min(key).alias("low"), F.max(key).alias("high"))
               .where("low < high").select("doc_id"))
    own = (filled.select("doc_id", *keys).join(several, "doc_id").distinct()
           .join(classes.select("node", *keys), keys).select("doc_id", "node"))
    heads = own.groupBy("doc_id").agg(F.min("node").alias("a"))
    return own.join(heads, "doc_id").where("a < node").select("a", F.col("node").alias("b"))


def near_duplicates(docs: DataFrame, percent: int = PERCENT, id_col: str = "doc_id",
                    text_col: str = "text", exact: bool = False) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept``: one row per row of ``docs``.

    A document's set holds its distinct windows of five words (A-Z lower-cased);
    with one to four words the whole sequence is the one element; without words
    it is empty and linked with nothing. Documents are linked when
    ``100 * shared >= percent * union`` on the full sets (of 64-bit hashes);
    ``component_id`` is the smallest id reachable, ``kept`` marks it.

    Documents with equal sets are one class and travel as one from there on.
    Classes that share a band form a bucket. Each bucket first compares its
    members with two of them, which joins a large group of copies by as many
    pairs as it has members, twice. Members of buckets that this leaves in several
    components are then compared across components by an exact join on their
    rarest shingles. So no pair that shares a band is left undecided, a group
    of n copies costs 2n pairs, not n squared, and texts that merely hold the
    same passage are not paired at all. A pair that is just similar enough
    shares no band once in 190,000; with ``exact`` all classes, not only those
    of such buckets, go through the exact join, which loses none and moves a
    quarter of all shingles.

    A null text is empty. Rows that repeat an id are one document: the classes
    of their texts are linked (an empty one stays by itself). A row with a null
    id is kept by itself, with a null component, and does not link others. No
    rows give no rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "near")
    texts = only(docs, doc_id=id_col, text=text_col)
    kind = texts.schema["doc_id"].dataType.simpleString()
    sketch = scratch.write(texts.mapInArrow(
        _sketch, f"doc_id {kind}, n_shingles bigint, key_a bigint, key_b bigint, bands array<bigint>"))
    filled = sketch.where("n_shingles > 0 AND doc_id IS NOT NULL")
    keys = ["key_a", "key_b", "n_shingles"]
    classes = scratch.write(filled.groupBy(*keys).agg(F.min("doc_id").alias("doc_id"), F.first("bands").alias("bands"))
                            .withColumn("node", F.monotonically_increasing_id()))
    entries = scratch.write(classes.select("node", F.explode("bands").alias("bucket")))
    heads = (entries.groupBy("bucket").agg(F.min("node").alias("head"), F.max("node").alias("last"))
             .where("head < last"))
    shared = scratch.write(entries.join(heads, "bucket"))
    scratch.drop(entries)
    spokes = scratch.write(
        shared.where("node <> head").select(F.col("head").alias("a"), F.col("node").alias("b"))
        .union(shared.where("node <> last").select(F.col("node").alias("a"), F.col("last").alias("b"))).distinct())
    wanted = (classes.select("node") if exact
              else spokes.select("a").union(spokes.select("b")).distinct().withColumnRenamed("a", "node"))
    named = classes.select("node", "doc_id", "key_a", "key_b").join(wanted, "node")
    # a sort-merge join at every size: what is exchanged grows with the table, not in a step
    full = scratch.write(texts.join(named.hint("merge"), "doc_id").select("node", "key_a", "key_b", "text")
                         .mapInArrow(_full_sets, "node bigint, shingles array<bigint>").dropDuplicates(["node"]))
    links = scratch.write(_confirmed(spokes, full, percent).union(_same_id(filled, classes, keys)))
    joined = scratch.write(components(links))
    placed = (shared.join(joined, "node", "left")
              .select("bucket", "node", F.coalesce("label", "node").alias("label")))
    mixed_up = (placed.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high"))
                .where("low < high").select("bucket"))
    if exact:
        open_ = classes.select("node").join(joined, "node", "left").select("node", F.coalesce("label", "node").alias("label"))
    else:
        open_ = placed.join(mixed_up, "bucket").select("node", "label").distinct()
    undecided = scratch.write(full.join(open_, "node"))
    rest = scratch.write(_sharing_a_rare_shingle(undecided, percent).join(spokes, ["a", "b"], "left_anti"))
    more = scratch.write(_confirmed(rest, full, percent))
    label = joined if more.isEmpty() else components(links.union(more))
    scratch.drop(shared, undecided, rest, full, spokes)
    first = label.join(classes.select("node", "doc_id"), "node").groupBy("label").agg(F.min("doc_id").alias("component"))
    place = classes.select("node", "doc_id", *keys).join(label.join(first, "label"), "node", "left").select(
        *keys, F.coalesce("component", "doc_id").alias("component"))
    rows = sketch.select("doc_id", *keys)
    on = reduce(lambda x, y: x & y, [rows[c] == place[c] for c in keys])
    found = rows.join(place, on & rows["doc_id"].isNotNull(), "left").select(
        rows["doc_id"], rows["n_shingles"], F.coalesce("component", rows["doc_id"]).alias("component_id"))
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
