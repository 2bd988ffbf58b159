"""Cross-tokenizer alignment: where the tokens of two tokenizers end together, and how often two tokens meet."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain, count, islice

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prepforge.llm.packing import _tokenizer
from prepforge.llm.tables import Scratch, only
from prepforge.llm.textblocks import sums

BATCH = 1 << 20         # characters of the documents that travel as one row
KEPT = 150_000          # different stretches of text that a task remembers before it starts anew
KEPT_TEXT = 16 << 20    # and their characters
AT_ONCE = 4096          # stretches aligned at once: their index dictionaries stay in the cache
PAIRS = 1 << 22         # different pairs of ids whose counts are broadcast (17 bytes each); more are joined
OUTPUT = 2 << 20        # characters of alignments per emitted batch
#: Rows of about a megabyte: Parquet looks at sizes every 100 rows by itself, and a task's whole output became one page.
LARGE_ROWS = {"compression": "none", "parquet.block.size": 8 << 20, "parquet.block.size.row.check.min": 1,
              "parquet.page.size.row.check.min": 1, "parquet.enable.dictionary": "false"}

WORD_START = re.compile(r"(?<=\S)(?=[ \n])")
ODD_SPACE = re.compile(r"\s[ \n]|\0")
#: Texts on which a tokenizer that crosses the cuts, or changes the text, is found out.
PROBES = [" a  b", "  a", " a \n b", " a\t c ", " 12 345  6\n", " don't 's", " é ü\u3000x", " \x00 a\n\n b\n\tc",
          " f(x) = [1, 2];\n\n  y"]


def common_ends(ends_a: list[int], ends_b: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The byte ends that both token lists have, ascending, and the number of tokens of either list up to each."""
    index_a = dict(zip(ends_a, range(1, len(ends_a) + 1), strict=True))
    index_b = dict(zip(ends_b, range(1, len(ends_b) + 1), strict=True))
    common = sorted(index_a.keys() & index_b.keys())
    n = len(common)
    return (np.array(common, dtype=np.int64), np.fromiter(map(index_a.__getitem__, common), np.int64, n),
            np.fromiter(map(index_b.__getitem__, common), np.int64, n))


class Aligner:
    """Aligns a byte-level tokenizer file (A, given a leading space) with a piece model (B, which adds one).

    Neither kind joins bytes across a space or line break that follows a
    character of a word, so space and text are cut before each of those and
    every different stretch is aligned once. Models for which this does not hold
    get whole texts.
    """

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece

        self.a, _ = _tokenizer(path_a)
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_a = {i: self.a.decode_single_token_bytes(i) for i in self.a._mergeable_ranks.values()}
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("\u2581", " ").encode()
                        for i, p in enumerate(pieces)]
        self.length_a = np.zeros(max(self.bytes_a) + 1, dtype=np.int64)
        self.length_a[list(self.bytes_a)] = [len(x) for x in self.bytes_a.values()]
        self.length_b = np.array([len(x) for x in self.bytes_b])
        # the written form of every id inside a group, at the end of its part of it; B's ids after A's
        self.written = [f"{i}{end}" for i in range(len(self.length_a)) for end in ",|"]
        self.written += [f"{i}{end}" for i in range(len(pieces)) for end in ",;"]
        self.forget()
        self.cuts = not any(re.search("[^\u2581]\u2581|\n", p) for p in pieces) and all(
            self.b.encode(p[1:]) == [i for ids in self._ids_b(self.stretches(p, True)) for i in ids] for p in PROBES)

    def stretches(self, text: str, cuts: bool | None = None) -> list[str]:
        """A text that begins with a space, cut where both tokenizers end a token."""
        if not (self.cuts if cuts is None else cuts):
            return [text]
        if ODD_SPACE.search(text):
            return WORD_START.split(text)
        found = text.replace(" ", "\0 ").replace("\n", "\0\n").split("\0")
        return found[1:]

    def _ids_b(self, stretches: list[str]) -> list[list[int]]:
        """Ids of stretches as they are inside a text: a space is the one that B adds, else B's is taken off."""
        spaced = [s[0] == " " and len(s) > 1 for s in stretches]
        found = self.b.encode([s[1:] if x else "\n" + s for s, x in zip(stretches, spaced, strict=True)], num_threads=1)
        return [ids if x else ids[2:] for ids, x in zip(found, spaced, strict=True)]

    def forget(self) -> None:
        self.number: dict[str, int] = defaultdict(count().__next__)
        self.size = 0                                       # characters of all stretches with a number
        self.text: list[str] = []                           # groups as a1,a2|b1;a3|b2
        self.sizes = np.empty((4, 0), dtype=np.int64)       # tokens of A and B, groups, links; all 0 if not spelled
        self.links = np.empty(0, dtype=np.int64)            # a << 32 | b
        self.first = np.zeros(1, dtype=np.int64)            # where the links of each begin

    def numbers(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The stretches of all texts by number, and how many each text has; aligns those without a number."""
        if len(self.number) >= KEPT or self.size >= KEPT_TEXT:
            self.forget()
        known = len(self.number)
        found = [np.fromiter(map(self.number.__getitem__, self.stretches(" " + t)), np.int32)
                 if t else np.empty(0, dtype=np.int32) for t in texts]
        if fresh := list(islice(self.number, known, None)):
            aligned = [self.align(fresh[i:i + AT_ONCE]) for i in range(0, len(fresh), AT_ONCE)]
            self.size += sum(map(len, fresh))
            self.text += chain.from_iterable(x[0] for x in aligned)
            self.sizes = np.concatenate([self.sizes, *[x[1] for x in aligned]], axis=1)
            self.links = np.concatenate([self.links, *[x[2] for x in aligned]])
            self.first = np.concatenate([[0], np.cumsum(self.sizes[3])])
        return np.concatenate(found), np.array([len(x) for x in found], dtype=np.int64)

    def align(self, stretches: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Written groups, the four sizes and all links of the stretches; sizes of 0 where tokens do not spell one."""
        encode = self.a._core_bpe.encode_ordinary
        by_a, by_b = [encode(s) for s in stretches], self._ids_b(stretches)
        a, b = (np.fromiter(chain.from_iterable(x), np.int64) for x in (by_a, by_b))
        spelled = [s.encode() for s in stretches]
        whole = b"".join(spelled)
        if not (b"".join(map(self.bytes_a.__getitem__, a.tolist())) == whole
                == b"".join(map(self.bytes_b.__getitem__, b.tolist()))):
            good = [b"".join(map(self.bytes_a.__getitem__, x)) == s == b"".join(map(self.bytes_b.__getitem__, y))
                    for x, y, s in zip(by_a, by_b, spelled, strict=True)]
            if not all(good):
                text, sizes = [""] * len(stretches), np.zeros((4, len(stretches)), dtype=np.int64)
                kept = np.flatnonzero(good)
                if not len(kept):
                    return text, sizes, np.empty(0, dtype=np.int64)
                found, sizes[:, kept], links = self.align([stretches[i] for i in kept])
                for i, x in zip(kept, found, strict=True):
                    text[i] = x
                return text, sizes, links
        ends_a, ends_b = np.cumsum(self.length_a[a]), np.cumsum(self.length_b[b])
        stop = np.cumsum([len(s) for s in spelled])
        common, to_a, to_b = common_ends(ends_a.tolist(), ends_b.tolist())
        sizes_a, sizes_b = np.diff(to_a, prepend=0), np.diff(to_b, prepend=0)
        last_a, last_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        last_a[to_a - 1], last_b[to_b - 1] = 1, 1
        code = np.empty(len(a) + len(b), np.int64)          # the ids in the order in which they are written
        code[np.arange(len(a)) + np.repeat(to_b - sizes_b, sizes_a)] = 2 * a + last_a
        code[np.arange(len(b)) + np.repeat(to_a, sizes_b)] = 2 * (len(self.length_a) + b) + last_b
        written = list(map(self.written.__getitem__, code.tolist()))
        # within a slice, every stretch between two neighbouring ends is the overlap of one pair of tokens
        ends = np.union1d(ends_a, ends_b)
        links = a[np.searchsorted(ends_a, ends)] << 32 | b[np.searchsorted(ends_b, ends)]
        upto = np.array([np.searchsorted(x, stop, "right") for x in (ends_a, ends_b, common, ends)])
        to = (upto[0] + upto[1]).tolist()
        text = ["".join(written[i:x])[:-1] for i, x in zip([0, *to], to, strict=False)]
        return text, np.diff(upto, axis=1, prepend=0), links


@lru_cache(maxsize=1)
def aligner(path_a: str, path_b: str) -> Aligner:
    return Aligner(path_a, path_b)


@dataclass(frozen=True)
class Alignment:
    """``documents``: one row per document; ``pairs``: ``a, b, count, best`` of every linked pair of ids."""

    documents: DataFrame
    pairs: DataFrame


def _lists(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values, kind))


def _packed(batch_id: int, ids: list[pa.Array], texts: list[str | None], own: Aligner) -> pa.RecordBatch:
    """All documents of a batch as one row.

    What only Python reads again, the documents' stretches by number and the
    different stretches' alignments, is one compressed value; the different
    pairs of ids and their numbers stand beside it.
    """
    word, sizes = own.numbers(texts)
    unusable = own.sizes[0] == 0
    if unusable[word].any():
        doc = np.repeat(np.arange(len(texts)), sizes)
        lost = np.zeros(len(texts), dtype=bool)
        lost[doc[unusable[word]]] = True
        word, sizes = word[~lost[doc]], np.where(lost, 0, sizes)
    total = np.bincount(word, minlength=len(own.text))
    used = np.flatnonzero(total)
    place = np.zeros(len(own.text), dtype=np.int32)
    place[used] = np.arange(len(used))
    n_a, n_b, n_groups, n_links = own.sizes[:, used]
    inside = np.repeat(own.first[used] - np.cumsum(n_links) + n_links, n_links) + np.arange(n_links.sum())
    pairs, link = np.unique(own.links[inside], return_inverse=True)
    n = np.bincount(link, weights=np.repeat(total[used], n_links), minlength=len(pairs)).astype(np.int64)
    key = pa.concat_arrays(ids)
    inner = {
        "doc_id": pa.ListArray.from_arrays(pa.array([0, len(key)], pa.int32()), key),
        "sizes": _lists(sizes, pa.int32()), "words": _lists(place[word], pa.int32()),
        "n_a": _lists(n_a, pa.int32()), "n_b": _lists(n_b, pa.int32()), "n_groups": _lists(n_groups, pa.int32()),
        "texts": pa.ListArray.from_arrays(pa.array([0, len(used)], pa.int32()),
                                          pa.array([own.text[i] for i in used.tolist()], pa.string())),
        "n_links": _lists(n_links, pa.int32()), "links": _lists(link, pa.int32()), "pairs": _lists(pairs, pa.int64()),
    }
    content = pa.RecordBatch.from_arrays(list(inner.values()), list(inner))
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, content.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
        stream.write_batch(content)
    return pa.RecordBatch.from_arrays(
        [pa.array([batch_id], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary()), inner["pairs"],
         _lists(n, pa.int64())], ["batch", "content", "pairs", "times"])


def _flat(column: pa.Array) -> np.ndarray:
    return column[0].values.to_numpy(zero_copy_only=False)


def _documents(batches: Iterator[pa.RecordBatch],
               known: Broadcast | None = None) -> Iterator[pa.RecordBatch]:
    """The documents of every batch row, with the counts of their links: broadcast, or in the row as ``found``."""
    names = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
    for batch in batches:
        for r in range(batch.num_rows):
            inner = pa.ipc.open_stream(batch.column("content")[r].as_buffer()).read_next_batch()
            at = {name: inner.column(name) for name in inner.schema.names}
            sizes, words = _flat(at["sizes"]).astype(np.int64), _flat(at["words"])
            n_links, links = _flat(at["n_links"]).astype(np.int64), _flat(at["links"])
            pairs = _flat(at["pairs"])
            counts, best = np.zeros(len(pairs), np.int64), np.zeros(len(pairs), np.int64)
            if known is not None:
                pair, count, highest = known.value
                if len(pair):
                    place = np.minimum(np.searchsorted(pair, pairs), len(pair) - 1)
                    hit = pair[place] == pairs
                    counts, best = np.where(hit, count[place], 0), np.where(hit, highest[place], 0).astype(np.int64)
            elif batch.column("found")[r].is_valid:
                found = batch.column("found")[r].values
                place = found.field("pos").to_numpy(zero_copy_only=False)
                counts[place] = found.field("count").to_numpy(zero_copy_only=False)
                best[place] = found.field("best").to_numpy(zero_copy_only=False)
            bounds = np.concatenate([[0], np.cumsum(n_links)])
            per_word = {name: _flat(at[name]).astype(np.int64) for name in names[:4]}
            per_word |= {"n_best": sums(best[links], bounds), "count_sum": sums(counts[links], bounds)}
            ends = np.concatenate([[0], np.cumsum(sizes)])
            per_doc = [pa.array(sums(per_word[name][words], ends)) for name in names]
            texts, ids = at["texts"][0].values.to_pylist(), at["doc_id"][0].values
            first, held, size = 0, [], 0
            for i in range(len(sizes)):
                held.append(";".join(map(texts.__getitem__, words[ends[i]:ends[i + 1]].tolist())))
                size += len(held[-1])
                if size >= OUTPUT or i + 1 == len(sizes):
                    yield pa.RecordBatch.from_arrays(
                        [ids.slice(first, len(held)), *[x.slice(first, len(held)) for x in per_doc],
                         pa.array(held, pa.string())], ["doc_id", *names, "groups"])
                    first, held, size = i + 1, [], 0


def align_tokens(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id",
                 text_col: str = "text") -> Alignment:
    """Aligns the tokens of ``path_a`` (space and text) and ``path_b`` (text, which adds the space).

    ``documents``: ``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum,
    groups``, one row per row of ``docs``. Bytes at which a token of either
    tokenizer ends cut a text into groups; ``groups`` has their ids as
    ``a1,a2|b1;a3|b2``. Every pair of overlapping tokens is a link; the count of
    its id pair is the number of links of that pair in all documents.
    ``count_sum`` adds the counts of a document's links, ``n_best`` counts those
    whose count is the highest that their B id has, ties included.

    A batch of documents travels as one row that holds each different stretch
    once; only its different pairs are exchanged, so a frequent pair costs one
    row per batch. Up to PAIRS different pairs, their counts are broadcast;
    beyond, they come back by a join, as one list per batch.

    Texts that are null or empty, or that the tokens of either tokenizer do not
    spell, have zeros and the empty text. Repeated ids and null ids are rows of
    their own. No rows give no rows. A text has to fit a task.
    """
    scratch = Scratch(docs.sparkSession, "alignment")
    texts = only(docs, doc_id=id_col, text=text_col)
    kind = texts.schema["doc_id"].dataType.simpleString()

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, task, made = aligner(path_a, path_b), TaskContext.get().partitionId() << 32, 0
        ids: list[pa.Array] = []
        held: list[str | None] = []
        size = 0
        for batch in batches:
            first, column = 0, batch.column("text")
            for i in range(batch.num_rows):
                held.append(column[i].as_py())
                size += len(held[-1] or "")
                if size >= BATCH:
                    ids.append(batch.column("doc_id").slice(first, i + 1 - first))
                    yield _packed(task + made, ids, held, own)
                    made, first, ids, held, size = made + 1, i + 1, [], [], 0
            if first < batch.num_rows:
                ids.append(batch.column("doc_id").slice(first))
        if held:
            yield _packed(task + made, ids, held, own)
        own.forget()            # the worker's memory is another task's now

    rows = scratch.write(texts.mapInArrow(
        packed, "batch bigint, content binary, pairs array<bigint>, times array<bigint>"), **LARGE_ROWS)
    met = rows.select("batch", F.posexplode(F.arrays_zip("pairs", "times")).alias("pos", "met")).select(
        "batch", "pos", F.col("met.pairs").alias("pair"), F.col("met.times").alias("times"))
    low = F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF).cast("bigint"))
    counts = met.groupBy("pair").agg(F.sum("times").alias("count")).where("count > 0").withColumn("b", low)
    highest = counts.groupBy("b").agg(F.max("count").alias("highest"))     # at most as many rows as B has ids
    pairs = scratch.write(counts.join(F.broadcast(highest), "b").select(
        "pair", "count", (F.col("count") == F.col("highest")).cast("int").alias("best")))
    out = (f"doc_id {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, "
           "groups string")
    if pairs.count() <= PAIRS:
        table = pairs.toPandas().sort_values("pair")
        known = docs.sparkSession.sparkContext.broadcast(
            (table["pair"].to_numpy(), table["count"].to_numpy(), table["best"].to_numpy(dtype=np.int8)))
        documents = rows.select("content").mapInArrow(lambda batches: _documents(batches, known), out)
    else:
        found = (met.drop("times").join(pairs, "pair").groupBy("batch")
                 .agg(F.collect_list(F.struct("pos", "count", "best")).alias("found")))
        documents = rows.select("batch", "content").join(found.hint("merge"), "batch", "left").mapInArrow(_documents, out)
    return Alignment(documents, pairs.select(F.shiftright("pair", 32).alias("a"), low.alias("b"), "count",
                                             (F.col("best") == 1).alias("best")))
