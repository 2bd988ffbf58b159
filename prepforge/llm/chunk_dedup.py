"""Exact duplicates by content-defined chunk recipes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prepforge.llm.tables import Scratch, only
from prepforge.llm.textblocks import SPACE, Block, blocks

ROLLING = 48            # bytes that decide whether a chunk ends after them
LEAST, MOST = 256, 8192  # bytes of a chunk (the last of a text may be shorter)
AVERAGE_BITS = 10       # a chunk ends after one of 2**10 byte positions


def normalised(block: Block) -> Block:
    """Every run of white space becomes one space."""
    gap = SPACE[block.data]
    repeated = np.zeros(len(gap), dtype=bool)
    repeated[1:] = gap[1:] & gap[:-1]
    cuts = block.bounds[block.bounds < len(gap)]
    repeated[cuts] = False
    kept = ~repeated
    before = np.zeros(len(gap) + 1, dtype=np.int64)
    np.cumsum(kept, out=before[1:])
    return Block(block.first, np.where(gap, np.uint8(32), block.data)[kept], before[block.bounds])


def cut_points(block: Block) -> np.ndarray:
    """Positions after which the rolling hash asks for a cut; depends on the last ROLLING bytes alone."""
    n = len(block.data)
    if n < ROLLING:
        return np.empty(0, dtype=np.int64)
    total, back = block.running()
    rolled = (total[ROLLING:] - total[:-ROLLING]) * back[:n - ROLLING + 1]
    return np.flatnonzero(rolled >> np.uint64(64 - AVERAGE_BITS) == 0) + ROLLING


def chunk_ends(asked: np.ndarray, start: int, end: int) -> list[int]:
    """Ends of one text's chunks. ``asked`` holds the cut points of its block, ascending."""
    out, last = [], start
    lo = np.searchsorted(asked, start + LEAST)
    for cut in asked[lo:np.searchsorted(asked, end)].tolist():
        if cut - ROLLING < start:
            continue
        while cut - last > MOST:
            last += MOST
            out.append(last)
        if cut - last >= LEAST:
            out.append(cut)
            last = cut
    while end - last > MOST:
        last += MOST
        out.append(last)
    if end > last:
        out.append(end)
    return out


def _recipes(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for raw in blocks(batch.column("text")):
            block = normalised(raw)
            asked = cut_points(block)
            content = memoryview(np.ascontiguousarray(block.data))
            whole, ends, bounds = [], [], [0]
            for i in range(block.rows):
                start, end = int(block.bounds[i]), int(block.bounds[i + 1])
                whole.append(hashlib.sha256(content[start:end]).hexdigest())
                ends += chunk_ends(asked, start, end)
                bounds.append(len(ends))
            stops = np.array(ends, dtype=np.int64)
            starts = np.concatenate(([0], stops[:-1])) if len(stops) else stops
            offsets = pa.array(np.array(bounds, dtype=np.int32))
            prints = (block.hashes(starts, stops) >> np.uint64(64 - bits)).view(np.int64)
            proofs = [hashlib.sha256(content[s:e]).digest()[:16] for s, e in zip(starts.tolist(), ends, strict=True)]
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id").slice(raw.first, raw.rows), pa.array(whole, pa.string()),
                pa.ListArray.from_arrays(offsets, pa.array(prints)),
                pa.ListArray.from_arrays(offsets, pa.array(proofs, pa.binary())),
            ], ["doc_id", "text_sha256", "prints", "proofs"])


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = 64) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256``: one row per row of ``docs``.

    Texts are equal when they are identical after each run of white space has
    become one space. Each text is cut where its content says so; a chunk is
    known by a fingerprint of ``bits``, and chunks that share one are told apart by
    their SHA-256, which verifies the identifier (fingerprint, ordinal). Texts
    are then compared as ordered lists of identifiers: the long texts themselves
    never leave the task that read them. Last, each group is checked against the
    SHA-256 of its whole texts.

    A null text counts as empty; all empty texts are one group. ``keep_id`` is
    the smallest id of the group (null if it has null ids alone); rows that
    repeat the kept id are all marked kept. No rows give no rows.
    """
    scratch = Scratch(docs.sparkSession, "chunks")
    texts = only(docs, doc_id=id_col, text=text_col)
    kind = texts.schema["doc_id"].dataType.simpleString()
    recipes = scratch.write(texts.mapInArrow(
        lambda batches: _recipes(batches, bits), f"doc_id {kind}, text_sha256 string, prints array<bigint>, proofs array<binary>"))
    chunks = recipes.select("text_sha256", F.posexplode(F.arrays_zip("prints", "proofs")).alias("place", "chunk"))
    known = chunks.select("chunk.*").distinct()
    clashing = scratch.write(known.groupBy("prints").agg(F.count("*").alias("n")).where("n > 1").select("prints"))
    ordinals = (known.join(clashing, "prints", "left_semi").groupBy("prints")
                .agg(F.sort_array(F.collect_list("proofs")).alias("all"))
                .select("prints", F.posexplode("all").alias("ordinal", "proofs")))
    settled = (chunks.select("text_sha256", "place", "chunk.*").distinct().join(ordinals, ["prints", "proofs"])
               .groupBy("text_sha256")
               .agg(F.sort_array(F.collect_list(F.struct("place", "ordinal"))).alias("told_apart")))
    lists = recipes.select("doc_id", "text_sha256", "prints")
    if clashing.isEmpty():
        lists = lists.withColumn("told_apart", F.array().cast("array<struct<place:int,ordinal:int>>"))
    else:
        settled = scratch.write(settled)
        lists = (lists.join(settled, "text_sha256", "left")
                 .withColumn("told_apart", F.coalesce("told_apart", F.array())))
    check = F.xxhash64("text_sha256")
    groups = lists.groupBy("prints", "told_apart").agg(
        F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"),
        F.min(check).alias("low"), F.max(check).alias("high"))
    sure = F.when(F.col("low") == F.col("high"), F.col("group_size")).otherwise(
        F.raise_error(F.lit("equal chunk lists of different texts")))
    return (lists.join(groups.withColumn("group_size", sure).drop("low", "high"), ["prints", "told_apart"])
            .select("doc_id", "keep_id", "group_size",
                    F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"))
