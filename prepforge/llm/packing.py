"""Packing documents into sequences: tokenize, cut, and fill bins by completion with branch and bound."""

from __future__ import annotations

import json
import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prepforge.llm.tables import Scratch, only
from prepforge.llm.textblocks import blocks

LENGTH = 2048           # tokens of a sequence
SHARD = 4096            # pieces that are packed together; loses less than one sequence per shard
EFFORT = 1_000          # fillings taken back or refused per shard after which the best packing found stands
FILLINGS = 6            # fillings tried per bin, least waste first
LOOKS = 400             # fillings looked at for them, dominated ones included

# fixed values: how a byte-level tokenizer splits text, and the order of bytes in its printable alphabet
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    """The byte-level vocabulary of a tokenizers file, for tiktoken, and the file's added tokens.

    Such a file numbers its tokens in the order of their merges, which is all
    that tiktoken needs; anything else is refused.
    """
    import tiktoken

    with open(path, encoding="utf-8") as f:
        held = json.load(f)
    shown = {chr(b): b for b in PRINTABLE}
    shown |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in PRINTABLE)}
    added = {t["content"]: t["id"] for t in held["added_tokens"]}
    model, split = held["model"], held["pre_tokenizer"]
    merged = [model["vocab"]["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
    if (split.get("type"), split.get("add_prefix_space")) != ("ByteLevel", False) or merged != sorted(merged) \
            or held.get("normalizer"):
        raise ValueError(f"{path} is not a plain byte-level tokenizer")
    ranks = {bytes(shown[c] for c in token): n for token, n in model["vocab"].items() if token not in added}
    return tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), added


def token_ids(text: str, path: str) -> bytes:
    """The ids that the tokenizer file gives a text, as little-endian unsigned 32-bit values.

    Equal to ``tokenizers`` with ``add_special_tokens=False`` (strings of added
    tokens inside a text are those tokens), at a fifth of its time.
    """
    encoding, added = _tokenizer(path)
    parts = re.split("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")", text) if added else [text]
    return b"".join(np.array([added[p]], "<u4").tobytes() if p in added
                    else np.array(encoding.encode_ordinary(p), dtype="<u4").tobytes() for p in parts if p)


def token_pieces(docs: DataFrame, path: str, length: int = LENGTH, with_ids: bool = False,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` and on request ``ids``: pieces of at most ``length`` tokens.

    A document is its ids and then id 0, so an empty or null text has one token.
    Only longer documents are cut; the first piece takes the remainder, so that
    all others are full. ``ids`` are little-endian unsigned 32-bit values.
    """
    texts = only(docs, doc_id=id_col, text=text_col)
    kind = texts.schema["doc_id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column("text")):
                rows: list[tuple[int, int, int, int, int, bytes]] = []
                own = batch.column("text").slice(block.first, block.rows).to_pylist()
                for i, text in enumerate(own):
                    ids = token_ids(text or "", path) + b"\0\0\0\0"
                    total, start, number = len(ids) // 4, 0, 0
                    size = total if total <= length else total % length or length
                    while start < total:
                        part = ids[4 * start:4 * (start + size)]
                        rows.append((i, number, start, size, zlib.crc32(part), part))
                        start, number, size = start + size, number + 1, length
                doc, number, start, size, crc, part = zip(*rows, strict=True)
                columns = [batch.column("doc_id").slice(block.first, block.rows).take(pa.array(doc)),
                           pa.array(number, pa.int32()), pa.array(start, pa.int64()),
                           pa.array(size, pa.int64()), pa.array(crc, pa.int64())]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    columns, names = [*columns, pa.array(part, pa.binary())], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(columns, names)

    return texts.mapInArrow(cut, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint"
                                 + ", ids binary" * with_ids)


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Best-fit decreasing: every length, longest first, into the fullest bin that still holds it."""
    bins: list[list[int]] = []
    by_room: dict[int, list[int]] = {}
    rooms = 0                                   # bit r: some open bin has r tokens of room
    for size in sorted(lengths, reverse=True):
        fitting = rooms >> size << size
        if fitting:
            room = (fitting & -fitting).bit_length() - 1
            place = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
        else:
            room, place = capacity, len(bins)
            bins.append([])
        bins[place].append(size)
        by_room.setdefault(room - size, []).append(place)
        rooms |= 1 << (room - size)
    return bins


def fewest_bins(lengths: list[int], capacity: int) -> int:
    """A lower bound: total length, sharpened by lengths over half a bin and what cannot join them."""
    ordered = np.sort(np.array(lengths, dtype=np.int64))
    upto = np.concatenate([[0], np.cumsum(ordered)])                        # total of the first k lengths
    large = len(ordered) - np.searchsorted(2 * ordered, capacity, "right")
    least = np.unique(ordered[2 * ordered <= capacity])
    full = np.searchsorted(ordered, capacity - least, "right")              # from here on alone in their bins
    rest = upto[full] - upto[np.searchsorted(ordered, least, "left")]
    alone = len(ordered) - full
    bounds = alone + np.maximum(large - alone, -(-rest // capacity))
    return int(max([-(-upto[-1] // capacity), large, *bounds]))


def fillings(counts: dict[int, int], sizes: list[int], room: int, limit: int = FILLINGS,
             looks: int = LOOKS, most: int | None = None) -> list[tuple[int, ...]]:
    """Undominated ways to fill ``room``, least waste first.

    A filling is dominated when a remaining length still fits beside it, or in
    place of one of its own lengths with less waste. The sums that lengths can
    reach are known before any filling is looked at, so that the least waste is
    always found, whatever its partners are. Fillings of equal waste come one
    per largest partner, then the second of each, and so on. The list ends after
    ``limit`` fillings, ``looks`` of any kind, or at a waste over ``most``.
    """
    fits = [s for s in sizes if s <= room and counts[s]]
    rising = fits[::-1]

    def reached(end: int) -> list[int]:
        """Bit t of number i: some of ``fits[i:end]`` are t tokens together."""
        below, whole = [1], (2 << room) - 1
        for s in reversed(fits[:end]):
            sums, n, step = below[-1], counts[s], 1
            if sums == whole:
                break
            while n > 1 and step * s <= room:
                many = min(n - 1, step)
                sums |= sums << many * s
                n, step = n - many, 2 * step
            below.append((sums | sums << s) & whole)
        return below[::-1] if len(below) > end else [whole] * (end + 1 - len(below)) + below[::-1]

    def exact(at: int, left: int, upto: int) -> Iterator[tuple[int, ...]]:
        """Those of ``fits[at:end]`` whose largest length is one of ``fits[at:upto]``."""
        if not left:
            yield ()
            return
        for k in range(max(at, len(fits) - bisect_right(rising, left)), upto):
            if not below[k] >> left & 1:
                return
            s = fits[k]
            for n in range(min(counts[s], left // s) if counts[s] > 1 else 1, 0, -1):
                if below[k + 1] >> (left - n * s) & 1:
                    for rest in exact(k + 1, left - n * s, end):
                        yield (s,) * n + rest

    def replaceable(taken: tuple[int, ...], waste: int) -> bool:
        return any(counts[s] > taken.count(s) for x in set(taken)
                   for s in rising[bisect_right(rising, x):bisect_right(rising, x + waste)])

    found: list[tuple[int, ...]] = []
    end, below, beside = len(fits), reached(len(fits)), ()
    for waste in range(min(room, room if most is None else most) + 1):
        if end and fits[end - 1] <= waste:                  # lengths that would fit beside it are all in it
            end = len(fits) - bisect_right(rising, waste)
            below, beside = reached(end), tuple(s for s in fits[end:] for _ in range(counts[s]))
        left = room - waste - sum(beside)
        if left < 0:
            break
        if not below[0] >> left & 1:
            continue
        ways = (exact(at, left, at + 1) for at in range(len(fits) - bisect_right(rising, left), end)) \
            if left else [exact(end, 0, end)]
        while ways:
            open_ = []
            for way in ways:
                taken = next(way, None)
                if taken is None:
                    continue
                open_.append(way)
                looks -= 1
                if not waste or not replaceable(taken + beside, waste):
                    found.append(taken + beside)
                if len(found) == limit or not looks:
                    return found
            ways = open_
    return found


def bin_completion(lengths: list[int], capacity: int = LENGTH, effort: int = EFFORT) -> list[list[int]]:
    """Bins of at most ``capacity``, as few as the search finds.

    Best-fit decreasing is the first incumbent. If it uses more bins than the
    lower bound, bins are completed one by one around the largest remaining
    length, by the undominated fillings in order of waste. A branch ends when
    its waste so far leaves no room for fewer bins than the incumbent. Only
    fillings that are taken back or refused count as ``effort``: however many
    bins there are, the first descent goes on until it has placed every length
    or wasted too much to be better.
    """
    incumbent = best_fit(lengths, capacity)
    bound = fewest_bins(lengths, capacity)
    if len(incumbent) <= bound or not lengths:
        return incumbent
    total = sum(lengths)
    counts: dict[int, int] = {}
    for x in lengths:
        counts[x] = counts.get(x, 0) + 1
    sizes = sorted(counts, reverse=True)
    path: list[list[int]] = []
    wasted, left = 0, len(lengths)
    choices: list[list[list[int]]] = []

    def open_bin() -> None:
        first = next(s for s in sizes if counts[s])
        counts[first] -= 1
        rest = [s for s in sizes if counts[s]]
        spare = (len(incumbent) - 1) * capacity - total - wasted
        ways = [[first, *w] for w in fillings(counts, rest, capacity - first, most=spare)]
        counts[first] += 1
        choices.append(ways[::-1])

    open_bin()
    while choices and effort > 0 and len(incumbent) > bound:
        if len(path) == len(choices):                       # come back from below: undo this level's bin
            effort -= 1
            undone = path.pop()
            wasted -= capacity - sum(undone)
            left += len(undone)
            for x in undone:
                counts[x] += 1
        if not choices[-1]:
            choices.pop()
            continue
        filling = choices[-1].pop()
        if wasted + capacity - sum(filling) > (len(incumbent) - 1) * capacity - total:
            effort -= 1
            continue
        for x in filling:
            counts[x] -= 1
        path.append(filling)
        wasted += capacity - sum(filling)
        left -= len(filling)
        if not left:
            incumbent = [list(b) for b in path]
            continue
        open_bin()
    return incumbent


def pack(pieces: DataFrame, capacity: int = LENGTH, shard: int = SHARD) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``: every sequence is gapless from 0 and holds at most ``capacity``.

    ``pieces`` needs ``length``; its other columns pass through. Full pieces are
    sequences of their own. The others are dealt by a hash of their row numbers
    into shards of about ``shard`` pieces, which are packed on their own, so a
    task's work does not grow with the table. A length that is null, not
    positive or over the capacity raises. No rows give no rows.
    """
    scratch = Scratch(pieces.sparkSession, "pieces")
    for name in ("sequence_id", "offset", "_row", "_shard"):
        if name in pieces.columns:
            raise ValueError(f"the table already has a column {name!r}")
    sound = F.when(F.col("length").between(1, capacity), F.col("length")).otherwise(
        F.raise_error(F.lit("a piece has no length that fits a sequence")).cast("bigint"))
    rows = scratch.write(pieces.withColumn("length", sound)
                         .withColumn("_row", F.monotonically_increasing_id()))
    full = rows.where(F.col("length") == capacity)
    part = rows.where(F.col("length") < capacity)
    shards = max(1, -(-part.count() // shard))
    fields = rows.drop("_row").schema.simpleString()[len("struct<"):-1]

    def packed(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["length", "_row"], ascending=[False, True], kind="stable")
        lengths = frame["length"].tolist()
        waiting: dict[int, list[int]] = {}
        for i in range(len(lengths) - 1, -1, -1):
            waiting.setdefault(lengths[i], []).append(i)
        sequence, offset = [0] * len(lengths), [0] * len(lengths)
        for number, bin_ in enumerate(bin_completion(lengths, capacity)):
            at = 0
            for size in bin_:
                row = waiting[size].pop()
                sequence[row], offset[row] = number, at
                at += size
        first = int(frame["_shard"].iloc[0]) * (1 << 24)
        return (frame.drop(columns=["_row", "_shard"])
                .assign(sequence_id=np.array(sequence, dtype=np.int64) + first, offset=np.array(offset, np.int64)))

    short = (part.withColumn("_shard", F.pmod(F.xxhash64("_row"), F.lit(shards)))
             .groupBy("_shard").applyInPandas(packed, f"{fields}, sequence_id bigint, offset bigint"))
    alone = full.select(*[F.col(f"`{c}`") for c in pieces.columns], (-F.col("_row") - 1).alias("sequence_id"),
                        F.lit(0).cast("bigint").alias("offset"))
    return short.unionByName(alone)


def sequences(packed: DataFrame) -> DataFrame:
    """``sequence_id, ids``: the token ids of every sequence, from pieces that carry their ``ids``."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(
        F.aggregate(parts, F.unhex(F.lit("")), lambda sofar, p: F.concat(sofar, p["ids"])).alias("ids"))
