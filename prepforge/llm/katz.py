"""Katz backoff language model: Good-Turing discounted counts, normalised backoff weights, partitioned tables.

Order two. The probability of a token after its history is evaluated from the
bigram down: a bigram seen in training has its discounted count over the count
of the history; an unseen one backs off to the unigram times the weight of the
history; a token never seen in training gets the unigram mass that discounting
left, as one unknown type. Histories never seen back off with weight one. So the
probabilities after any history add up to one over the training tokens and the
unknown type.

The corpus is exchanged once. Every task turns its texts into batches of
bigrams, sorted by token, and sends each range of token hashes to its bucket as
one compressed block. A bucket then has all bigrams that end in its tokens: it
counts them, and scores every text that contains them. What a score needs from
elsewhere travels as sums: discounts are applied to the numbers of tokens in
each count class once the counts of counts are known; the histories' shares of
backed-off tokens are exchanged by history, for those tokens alone.

Frequent tokens and bigrams are counted per batch before they travel, and the
texts that hold them are stored as small gaps, so a bigram that fills a third of
the corpus is a small block.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from prepforge.llm.tables import Scratch, fold, only
from prepforge.llm.textblocks import blocks

CLASSES = 5             # counts up to this are discounted by Good-Turing
TAIL = 0.05             # what larger counts give up, so that every history keeps mass for unseen tokens
TOKENS = 1 << 20        # tokens of a batch
FINER = 2               # buckets per shuffle partition: the memory of a task shrinks with their number
END, START = np.uint64(1), np.uint64(2)

# numbers kept per text: unseen tokens by unigram count 0..5 and above, seen ones by bigram count 1..5, known, all
UNSEEN, ABOVE, SEEN, KNOWN, ALL, COLUMNS = 0, 6, 7, 12, 13, 14


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed block, byte planes apart."""
    sizes = np.array([len(a) for a in arrays], dtype="<i8").tobytes()
    planes = [np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.dtype.itemsize).T.tobytes() for a in arrays]
    return zstandard.ZstdCompressor(level=1).compress(sizes + b"".join(planes))


def unpacked(block: bytes, *kinds: str) -> list[np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(block)
    sizes, at, out = np.frombuffer(data, "<i8", len(kinds)), 8 * len(kinds), []
    for n, kind in zip(sizes.tolist(), kinds, strict=True):
        width = np.dtype(kind).itemsize
        planes = np.frombuffer(data, np.uint8, n * width, at).reshape(width, n)
        out.append(np.ascontiguousarray(planes.T).reshape(-1).view(kind))
        at += n * width
    return out


def stretches(*keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin in sorted arrays."""
    fresh = np.zeros(len(keys[0]), dtype=bool)
    fresh[:1] = True
    for k in keys:
        fresh[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(fresh)


def bucket_of(token: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of each hash; ascending with the hash."""
    return ((token >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def cuts(sorted_tokens: np.ndarray, buckets: int) -> Iterator[tuple[int, int, int]]:
    """Bucket, start and end of each bucket's stretch."""
    own = bucket_of(sorted_tokens, buckets)
    at = stretches(own)
    for i, start in enumerate(at):
        yield int(own[start]), int(start), int(at[i + 1]) if i + 1 < len(at) else len(own)


# one schema for everything that is exchanged or stored: kind, bucket, batch, block, ids, stats
FIELDS = "kind string, bucket int, batch string, block binary, ids array<{}>, stats array<bigint>"


def _rows(rows: list[tuple], ids: pa.DataType) -> pa.Table:
    kinds = [pa.string(), pa.int32(), pa.string(), pa.binary(), pa.list_(ids), pa.list_(pa.int64())]
    names = ["kind", "bucket", "batch", "block", "ids", "stats"]
    return pa.table([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)


def _batches(buckets: int):
    """The first exchange: per batch its ids, per bucket of a batch its bigrams and the texts that hold them."""
    def block(token, before, text, learned) -> bytes:
        types = stretches(token, before)
        words = stretches(token[types])
        histories, place = np.unique(before[types], return_inverse=True)
        gaps = np.diff(text, prepend=text.dtype.type(0))
        gaps[types] = text[types]
        return packed(token[types][words], np.diff(np.append(words, len(types))).astype("<u4"), histories,
                      place.astype("<u4"), np.diff(np.append(types, len(token))).astype("<u4"),
                      gaps.astype("<u4"), np.packbits(learned))

    def exchange(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        tokens, befores, texts, ids, learned, n, number = [], [], [], [], [], 0, 0

        def flush() -> Iterator[pa.RecordBatch]:
            name = f"{task}-{number}"
            token, before, text = map(np.concatenate, (tokens, befores, texts))
            order = np.lexsort((before, token))         # stable: the texts of a bigram stay ascending
            token, before, text = token[order], before[order], text[order]
            flags = np.concatenate(learned)
            out = [("ids", zlib.crc32(name.encode()) % buckets, name, None, pa.concat_arrays(ids).to_pylist(), None)]
            out += [("bigrams", b, name, block(token[s:e], before[s:e], text[s:e], flags), None, None)
                    for b, s, e in cuts(token, buckets)]
            yield from _rows(out, ids[0].type).to_batches()

        rows = 0
        for batch in batches:
            for part in blocks(batch.column("text")):
                low = part.lowered()
                starts, ends, first = low.words()
                found = low.hashes(starts, ends)
                at = first[1:] + np.arange(part.rows)               # where each text's end stands
                token = np.empty(len(found) + part.rows, dtype=np.uint64)
                inner = np.ones(len(token), dtype=bool)
                inner[at] = False
                token[at], token[inner] = END, found
                before = np.empty_like(token)
                before[1:] = token[:-1]
                before[np.concatenate(([0], at[:-1] + 1))] = START
                tokens.append(token)
                befores.append(before)
                texts.append(np.repeat(np.arange(rows, rows + part.rows, dtype=np.int32), np.diff(first) + 1))
                ids.append(batch.column("doc_id").slice(part.first, part.rows))
                learned.append(np.asarray(batch.column("learn").slice(part.first, part.rows).to_pylist(), dtype=bool))
                rows, n = rows + part.rows, n + len(token)
                if n >= TOKENS:
                    yield from flush()
                    tokens, befores, texts, ids, learned, n, rows, number = [], [], [], [], [], 0, 0, number + 1
        if n:
            yield from flush()
    return exchange


BIGRAMS = ("<u8", "<u4", "<u8", "<u4", "<u4", "<u4", "u1")
TYPES = ("<u8", "<u4", "<u8", "<u8", "<i8")
DOCS = ("<u4", "<f8", "<f8", "<u4")
OPEN = ("<u8", "<u4", "<u4")
HISTORIES = ("<u8", "<f8", "<f8", "<i8")


def _log10(x: np.ndarray) -> np.ndarray:
    """log10 of counts: as they are up to CLASSES, less TAIL above; 0 for 0."""
    return np.log10(np.where(x > CLASSES, x - TAIL, np.maximum(x, 1)))


def _count(buckets: int, ids: pa.DataType):
    """One bucket: counts of its bigrams and tokens, and for every text the sums that scores are made of."""
    def decoded(data: bytes):
        words, per_word, histories, place, refs, gaps, flags = unpacked(data, *BIGRAMS)
        text = np.cumsum(gaps.astype(np.int64))
        starts = np.cumsum(refs.astype(np.int64)) - refs
        before = np.where(starts > 0, text[np.maximum(starts - 1, 0)], 0)   # gaps restart with every bigram
        text -= np.repeat(before, refs)
        return np.repeat(words, per_word), histories[place], refs, text, np.unpackbits(flags).astype(bool)

    def count(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        kinds, names, ids_ = (table.column(c).to_pylist() for c in ("kind", "batch", "ids"))
        out = [("ids", bucket, n, None, i, None) for k, n, i in zip(kinds, names, ids_, strict=True) if k == "ids"]
        held_blocks = table.column("block")
        data = [(n, held_blocks[at].as_buffer()) for at, (k, n) in enumerate(zip(kinds, names, strict=True))
                if k == "bigrams"]
        del ids_
        if not data:
            return _rows(out, ids)
        words, befores, counts = [], [], []
        for _, block in data:
            word, before, refs, text, learned = decoded(block)
            starts = np.cumsum(refs.astype(np.int64)) - refs
            words.append(word)
            befores.append(before)
            counts.append(np.add.reduceat(learned[text].astype(np.int64), starts))
        sizes = [len(w) for w in words]
        word, before, count_ = map(np.concatenate, (words, befores, counts))
        del words, befores, counts
        order = np.lexsort((before, word))
        word, before = word[order], before[order]
        types = stretches(word, before)
        inverse = np.empty(len(order), dtype=np.int32)
        inverse[order] = np.repeat(np.arange(len(types), dtype=np.int32), np.diff(np.append(types, len(order))))
        both = np.add.reduceat(count_[order], types)                # training count of each bigram
        del order, count_
        word, before = word[types], before[types]
        firsts = stretches(word)
        one = np.add.reduceat(both, firsts)                         # and of each token
        per = np.diff(np.append(firsts, len(word)))
        single = np.repeat(one, per)
        kept = both > 0
        left = np.add.reduceat(kept.astype(np.int64), firsts)
        histories, place = np.unique(before[kept], return_inverse=True)
        out.append(("types", bucket, None, packed(
            word[firsts][left > 0], left[left > 0].astype("<u4"), one[left > 0].astype("<u8"),
            histories[place], both[kept]), None, None))
        of_counts = lambda c: np.bincount(np.minimum(c[c > 0], CLASSES + 2), minlength=CLASSES + 3)[1:]
        stats = [*of_counts(both), *of_counts(one), both.sum(), (one > 0).sum(),
                 one[word[firsts] == END].sum()]
        out.append(("counts", bucket, None, None, None, [int(x) for x in stats]))
        # per bigram: its share of a text's sums
        seen = both > 0
        history = np.where((single > 0) & (word != END), -np.log10(np.maximum(single, 1)), 0.0)
        score = history + np.where(seen, _log10(both), _log10(single))
        base = np.log10(single + 0.1)
        column = np.where(seen, np.where(both <= CLASSES, SEEN - 1 + both, -1),
                          np.where(single > CLASSES, ABOVE, UNSEEN + single))
        at, names, open_ = 0, [], []
        for i, ((name, block), size) in enumerate(zip(data, sizes, strict=True)):
            _, _, refs, text, _ = decoded(block)
            kind = np.repeat(inverse[at:at + size], refs)
            at += size
            held, row = np.unique(text, return_inverse=True)
            n = len(held)
            sums = [np.bincount(row, weights=v[kind], minlength=n) for v in (score, base)]
            table_ = np.zeros((n, COLUMNS), dtype=np.int64)
            table_[:, KNOWN] = np.bincount(row, weights=single[kind] > 0, minlength=n)
            table_[:, ALL] = np.bincount(row, minlength=n)
            cell = column[kind]
            inside = cell >= 0
            table_ += np.bincount(row[inside] * COLUMNS + cell[inside], minlength=n * COLUMNS).reshape(n, COLUMNS)
            out.append(("docs", bucket, name, packed(
                held.astype("<u4"), *sums, table_.T.reshape(-1).astype("<u4")), None, None))
            names.append(name)
            missing = ~seen[kind]
            open_.append((before[kind[missing]], np.full(int(missing.sum()), i), text[missing]))
        before, batch, text = map(np.concatenate, zip(*open_, strict=True))
        order = np.argsort(before, kind="stable")
        before, batch, text = before[order], batch[order], text[order]
        for b, s, e in cuts(before, buckets):
            out.append(("open", b, "|".join(names), packed(
                before[s:e], batch[s:e].astype("<u4"), text[s:e].astype("<u4")), None, None))
        return _rows(out, ids)
    return count


def discounts(n: list[int]) -> list[float]:
    """Good-Turing factors for counts 1..CLASSES from the counts of counts 1..CLASSES+1.

    Where the formula leaves (0, 1), as for small or odd corpora, all counts
    give up the same absolute amount instead.
    """
    if all(n[:CLASSES + 1]):
        common = (CLASSES + 1) * n[CLASSES] / n[0]
        if common < 1:
            out = [((r + 1) * n[r] / (r * n[r - 1]) - common) / (1 - common) for r in range(1, CLASSES + 1)]
            if all(0.01 < d < 0.999 for d in out):
                return out
    amount = min(0.9, max(0.1, n[0] / (n[0] + 2 * n[1]))) if n[0] else 0.5
    return [1 - amount / r for r in range(1, CLASSES + 1)]


@dataclass(frozen=True)
class Totals:
    """What the whole corpus says: training tokens, types and texts, discounts, mass of the unknown type."""

    tokens: int
    types: int
    texts: int
    bigram: tuple[float, ...]
    unigram: tuple[float, ...]
    unknown: float

    @staticmethod
    def of(stats: list[int]) -> "Totals":
        k = CLASSES + 2
        pairs, ones, (tokens, types, texts) = stats[:k], stats[k:2 * k], stats[2 * k:]
        first, second = discounts(ones), discounts(pairs)
        lost = sum(r * n * (1 - d) for r, n, d in zip(range(1, CLASSES + 1), ones, first)) + TAIL * sum(ones[CLASSES:])
        return Totals(tokens, types, texts, tuple(second), tuple(first), lost / tokens if tokens else 1.0)

    @staticmethod
    def discounted(count: np.ndarray, factors: tuple[float, ...]) -> np.ndarray:
        table = np.array([0.0, *factors])
        return np.where(count > CLASSES, count - TAIL, count * table[np.minimum(count, CLASSES)])


def _histories(totals: Totals, buckets: int, ids: pa.DataType):
    """From a bucket's bigrams, per history: discounted counts, unigram probabilities and counts of its followers."""
    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in batch.column("block").to_pylist():
                _, per, one, before, both = unpacked(block, *TYPES)
                if not len(before):
                    continue
                single = totals.discounted(one.astype(np.int64), totals.unigram) / max(totals.tokens, 1)
                order = np.argsort(before, kind="stable")
                single, both, before = np.repeat(single, per)[order], both[order], before[order]
                at = stretches(before)
                sums = [np.add.reduceat(v, at) for v in (totals.discounted(both, totals.bigram), single, both)]
                before = before[at]
                yield from _rows([("histories", b, None, packed(before[s:e], *[v[s:e] for v in sums]), None, None)
                                  for b, s, e in cuts(before, buckets)], ids).to_batches()
    return spread


def _back_off(ids: pa.DataType):
    """One bucket of histories: their backoff weights, and what they add to the texts that back off."""
    def weigh(table: pa.Table) -> pa.Table:
        rows = table.select(["kind", "bucket", "batch", "block"]).to_pylist()
        parts = [unpacked(r["block"], *HISTORIES) for r in rows if r["kind"] == "histories"]
        out = []
        if parts:
            before, seen, single, count = (np.concatenate(p) for p in zip(*parts, strict=True))
            order = np.argsort(before, kind="stable")
            before, seen, single, count = before[order], seen[order], single[order], count[order]
            at = stretches(before)
            before = before[at]
            seen, single, count = (np.add.reduceat(v, at) for v in (seen, single, count))
            weight = (1 - seen / count) / np.maximum(1 - single, 1e-300)
            out.append(("weights", rows[0]["bucket"], None, packed(before, weight, count), None, None))
        else:
            before, weight, count = np.empty(0, "<u8"), np.empty(0), np.empty(0, "<i8")
        number: dict[str, int] = {}
        batches, texts, adds = [], [], []
        for r in rows:
            if r["kind"] != "open":
                continue
            wanted, batch, text = unpacked(r["block"], *OPEN)
            place = np.minimum(np.searchsorted(before, wanted), max(len(before) - 1, 0))
            known = before[place] == wanted if len(before) else np.zeros(len(wanted), dtype=bool)
            add = np.zeros(len(wanted))
            add[known] = np.log10(weight[place[known]] * count[place[known]])
            own = np.array([number.setdefault(n, len(number)) for n in r["batch"].split("|")], dtype=np.int64)
            batches.append(own[batch])
            texts.append(text)
            adds.append(add)
        if batches:                                     # one row per batch, whatever buckets its tokens came from
            batch, text, add = map(np.concatenate, (batches, texts, adds))
            order = np.lexsort((text, batch))
            batch, text, add = batch[order], text[order], add[order]
            at = stretches(batch, text)
            batch, text, add = batch[at], text[at], np.add.reduceat(add, at) if len(at) else add
            names, firsts = list(number), stretches(batch)
            for s, e in zip(firsts, np.append(firsts[1:], len(batch)), strict=True):
                out.append(("backed", rows[0]["bucket"], names[batch[s]], packed(
                    text[s:e].astype("<u4"), add[s:e]), None, None))
        return _rows(out, ids)
    return weigh


def _scores(totals: Totals, ids: pa.DataType):
    """One batch: all its sums put together."""
    def score(table: pa.Table) -> pa.Table:
        rows = table.select(["kind", "block", "ids"]).to_pylist()
        own = next(r["ids"] for r in rows if r["kind"] == "ids")
        n = len(own)
        total, base, numbers = np.zeros(n), np.zeros(n), np.zeros((n, COLUMNS), dtype=np.int64)
        for r in rows:
            if r["kind"] == "docs":
                held, a, b, table_ = unpacked(r["block"], *DOCS)
                total[held] += a
                base[held] += b
                numbers[held] += table_.reshape(COLUMNS, -1).T
            elif r["kind"] == "backed":
                held, a = unpacked(r["block"], "<u4", "<f8")
                total[held] += a
        size = max(totals.tokens, 1)
        backed = numbers[:, UNSEEN + 1:ABOVE + 1].sum(axis=1)
        total += (numbers[:, UNSEEN] * math.log10(max(totals.unknown, 1e-300)) - backed * math.log10(size)
                  + numbers[:, UNSEEN + 1:ABOVE] @ np.log10(totals.unigram)
                  + numbers[:, SEEN:SEEN + CLASSES] @ np.log10(totals.bigram)
                  - (math.log10(totals.texts) if totals.texts else 0.0))
        base -= numbers[:, ALL] * math.log10(totals.tokens + 0.1 * (totals.types + 1))
        return pa.table([pa.array(own, ids), pa.array(numbers[:, ALL]), pa.array(numbers[:, KNOWN]),
                         pa.array(np.full(n, totals.tokens)), pa.array(base), pa.array(total)],
                        ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"])
    return score


def katz_scores(docs: DataFrame, learn=None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, n_known, train_tokens, base_score, score``: one row per row of ``docs``.

    Tokens are words (A-Z lower-cased) and one end per text; null counts as
    empty, which is an end alone. ``learn`` is a condition over ``doc_id``: the
    rows that teach; by default crc32 of the id modulo 10 is not 0. ``score`` is
    the base-10 log-probability of all tokens of the text; ``base_score`` that of
    unigrams with 0.1 added to every count. Rows that repeat an id are scored and
    learned from each. Without rows that teach, all tokens are unknown.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "katz")
    texts = only(docs, doc_id=id_col, text=text_col).withColumn(
        "learn", F.coalesce(fold("doc_id", 10) != 0 if learn is None else learn, F.lit(False)))
    kind = texts.schema["doc_id"].dataType
    ids = to_arrow_type(kind)
    fields = FIELDS.format(kind.simpleString())
    buckets = FINER * max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    found = scratch.write(
        texts.mapInArrow(_batches(buckets), fields).groupBy("bucket").applyInArrow(_count(buckets, ids), fields),
        partition_by="kind")
    stats = found.where("kind = 'counts'").select(F.posexplode("stats").alias("at", "n")).groupBy("at").agg(
        F.sum("n").alias("n")).collect()
    numbers = [0] * (2 * (CLASSES + 2) + 3)
    for row in stats:
        numbers[row["at"]] = row["n"]
    totals = Totals.of(numbers)
    model = scratch.write(
        found.where("kind = 'types'").mapInArrow(_histories(totals, buckets, ids), fields)
        .unionByName(found.where("kind = 'open'"))
        .groupBy("bucket").applyInArrow(_back_off(ids), fields), partition_by="kind")
    return (found.where("kind IN ('ids', 'docs')").unionByName(model.where("kind = 'backed'"))
            .groupBy("batch").applyInArrow(
                _scores(totals, ids), f"doc_id {kind.simpleString()}, n_tokens bigint, n_known bigint, "
                                      "train_tokens bigint, base_score double, score double"))
