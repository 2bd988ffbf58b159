"""Phrase collocations: candidates level by level, counted over whole texts by double-array tries in shards."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from hashlib import blake2b
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from prepforge.llm.tables import Scratch, only
from prepforge.llm.textblocks import Block, blocks, mixed

LEAST = 10              # occurrences of a phrase from which it is a candidate
LONGEST = 3             # words of the longest phrase
PERCENT = 50            # share of its occurrences inside a longer candidate from which a phrase is dropped
TOP = 2000              # phrases reported per language
UNKNOWN = "und"
BITS = 26               # size of the bitmap that tells which parts are frequent: 8 MB
SHARD = 6 << 20         # bytes of the phrases of one trie, at most about
SPREAD = 1 << 16        # and of a trie of few phrases, so that all tasks have one
PACKED = 512            # phrases that travel in one row
MERGED = 1 << 21        # words or windows that a task merges before it passes them on

_JOIN = np.uint64(0xD1B54A32D192ED03)
_WORD, _SPACE, _BREAK = 0, 1, 2
_KIND = np.zeros(256, dtype=np.uint8)
_KIND[[0x20, 0x09]] = _SPACE
_KIND[list(b".,;:!?\n\x0b\x0c\r")] = _BREAK


class Words(NamedTuple):
    """All words of a block (lower-cased): where they are, whose, and whether the next one is in the same piece."""

    block: Block
    starts: np.ndarray
    ends: np.ndarray
    text: np.ndarray
    joined: np.ndarray


def words_of(block: Block) -> Words:
    low = block.lowered()
    kind = _KIND[low.data]
    n = len(kind)
    inside = np.zeros(n + 1, dtype=bool)
    np.equal(kind, _WORD, out=inside[:n])
    opens, closes = inside.copy(), np.zeros(n + 1, dtype=bool)
    opens[1:] &= ~inside[:-1]
    closes[1:] = inside[:-1] & ~inside[1:]
    cuts = low.bounds[(low.bounds > 0) & (low.bounds < n)]
    opens[cuts] = inside[cuts]
    closes[cuts] = inside[cuts - 1]
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes)
    first = np.searchsorted(starts, low.bounds)
    new = np.ones(len(starts) + 1, dtype=bool)
    new[:-1] = False
    new[np.searchsorted(starts, np.flatnonzero(kind == _BREAK))] = True
    new[first] = True
    return Words(low, starts, ends, np.repeat(np.arange(low.rows), np.diff(first)), ~new[1:])


def spans(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The bytes of all spans, one after another."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return data[np.arange(total) + np.repeat(starts - ends + sizes, sizes)]


def combined(hashes: list[np.ndarray]) -> np.ndarray:
    """One hash for the hashes of consecutive words."""
    return reduce(lambda x, y: mixed(x * _JOIN + y), hashes)


def _langs(column: pa.Array, block: Block) -> tuple[list[str], np.ndarray]:
    """The languages of a block's texts, and the place of each text's."""
    own = column.slice(block.first, block.rows).dictionary_encode()
    return own.dictionary.to_pylist(), own.indices.to_numpy(zero_copy_only=False)


def _hashes(words: Words, langs: list[str], place: np.ndarray) -> np.ndarray:
    """A hash of every word and its language."""
    salt = np.array([int.from_bytes(blake2b(x.encode(), digest_size=8).digest(), "little") for x in langs],
                    dtype=np.uint64)
    return mixed(words.block.hashes(words.starts, words.ends) + salt[place[words.text]])


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Words, list[str], np.ndarray]]:
    for batch in batches:
        for block in blocks(batch.column("text")):
            langs, place = _langs(batch.column("lang"), block)
            yield words_of(block), langs, place


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of the different words of a stretch of texts; a null word counts all words of a language."""
    held: list[tuple[np.ndarray, np.ndarray, pa.Array, pa.Array]] = []
    size = 0

    def merged() -> pa.RecordBatch:
        h, n = np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held])
        lang, word = pa.concat_arrays([x[2] for x in held]), pa.concat_arrays([x[3] for x in held])
        _, at, same = np.unique(h, return_index=True, return_inverse=True)
        total = np.bincount(same, weights=n).astype(np.int64)
        return pa.RecordBatch.from_arrays(
            [lang.take(pa.array(at)), word.take(pa.array(at)), pa.array(h[at].view(np.int64)), pa.array(total)],
            ["lang", "phrase", "h1", "n"])

    for words, langs, place in _each(batches):
        h = _hashes(words, langs, place)
        found, at, n = np.unique(h, return_index=True, return_counts=True)
        sizes = words.ends[at] - words.starts[at]
        text = spans(words.block.data, words.starts[at], sizes)
        offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        spelled = pa.StringArray.from_buffers(len(at), pa.py_buffer(offsets), pa.py_buffer(text))
        whose = place[words.text[at]]
        all_words = np.bincount(place[words.text], minlength=len(langs))
        names = pa.array(langs, pa.string())
        used = np.flatnonzero(all_words)
        yield pa.RecordBatch.from_arrays(
            [names.take(pa.array(used)), pa.nulls(len(used), pa.string()), pa.array(np.zeros(len(used), np.int64)),
             pa.array(all_words[used])], ["lang", "phrase", "h1", "n"])
        held.append((found, n, names.take(pa.array(whose)), spelled))
        size += len(found)
        if size >= MERGED // 4:
            yield merged()
            held, size = [], 0
    if held:
        yield merged()


def bitmap(frame: DataFrame, columns: list[str]) -> Broadcast:
    """Marks the combined hashes of ``columns`` among 2^BITS places, whatever the number of rows; never too few."""
    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = combined([c.to_numpy(zero_copy_only=False).view(np.uint64) for c in batch.columns])
            yield pa.RecordBatch.from_arrays(
                [pa.array((keys & np.uint64((1 << BITS) - 1)).view(np.int64) + 1)], ["place"])

    marked = (frame.select(*columns).mapInArrow(places, "place bigint")
              .groupBy(F.bitmap_bucket_number("place").alias("part"))
              .agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bits")).collect())
    bits = np.zeros((1 << BITS) // 8, dtype=np.uint8)
    for row in marked:
        first = (row["part"] - 1) * 4096
        part = np.frombuffer(row["bits"], dtype=np.uint8)[:len(bits) - first]
        bits[first:first + len(part)] = part
    return frame.sparkSession.sparkContext.broadcast(bits)


def marked(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    place = keys & np.uint64(8 * len(bits) - 1)
    return (bits[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _count_windows(width: int, known: Broadcast) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Word windows whose two parts of one word less are marked, by their words' hashes, with counts."""
    names = [f"h{i + 1}" for i in range(width)]

    def merged(held: list[list[np.ndarray]]) -> pa.RecordBatch:
        columns = [np.concatenate(x) for x in zip(*held, strict=True)]
        key = combined(columns)
        order = np.argsort(key)
        key = key[order]
        new = np.ones(len(key), dtype=bool)
        new[1:] = key[1:] != key[:-1]
        for c in columns:           # different windows with one hash stand apart, perhaps more than once
            near = c[order]
            new[1:] |= near[1:] != near[:-1]
        first = np.flatnonzero(new)
        at, n = order[first], np.diff(first, append=len(order))
        return pa.RecordBatch.from_arrays([*[pa.array(c[at].view(np.int64)) for c in columns], pa.array(n)],
                                          [*names, "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        size = 0
        for words, langs, place in _each(batches):
            h = _hashes(words, langs, place)
            n = len(h) - width + 1
            if n <= 0:
                continue
            parts = [h[i:len(h) - width + 2 + i] for i in range(width - 1)]
            good = marked(known.value, combined(parts))
            together = good[:-1] & good[1:]
            for i in range(width - 1):
                together &= words.joined[i:n + i]
            at = np.flatnonzero(together)
            held.append([h[at + i] for i in range(width)])
            size += len(at)
            if size >= MERGED:
                yield merged(held)
                held, size = [], 0
        if size:
            yield merged(held)

    return count


class Trie(NamedTuple):
    """A double array over bytes: the child of state s by byte c is base[s] + c if its check is s."""

    base: np.ndarray
    check: np.ndarray
    accept: np.ndarray      # the id of the phrase that ends in a state, or -1

    def walk(self, key: bytes) -> int:
        """The state after ``key``, or -1."""
        state = 0
        for c in key:
            to = int(self.base[state]) + c
            if self.check[to] != state:
                return -1
            state = to
        return state


def build_trie(keys: list[bytes]) -> Trie:
    """The trie of ascending different keys; a key's id is its place.

    All keys take one byte at a time. States with several children try places at
    random, all at once, in cells added for the level (those without luck get
    256 cells of their own); states with one child then fill the cells that are left.
    """
    r = np.random.default_rng(0)
    sizes = np.array([len(k) for k in keys], dtype=np.int64)
    starts = np.cumsum(sizes) - sizes
    data = np.frombuffer(b"".join(keys), dtype=np.uint8)
    base, check = np.zeros(512, dtype=np.int32), np.full(512, -1, dtype=np.int32)
    check[0] = -2
    state, free = np.zeros(len(keys), dtype=np.int64), 256          # cells from ``free`` on may be used
    owner = np.zeros(len(keys), dtype=np.int64)
    alive = np.flatnonzero(sizes > 0)
    depth = 0

    def grow(cells: int) -> None:
        nonlocal base, check
        if cells + 512 > len(check):
            more = max(cells + 512 - len(check), len(check) // 2)
            base = np.concatenate([base, np.zeros(more, dtype=np.int32)])
            check = np.concatenate([check, np.full(more, -1, dtype=np.int32)])

    top = 256                                                       # no cell from here on is taken
    while len(alive):
        symbol, of = data[starts[alive] + depth].astype(np.int64), state[alive]
        new = np.ones(len(alive), dtype=bool)
        new[1:] = (of[1:] != of[:-1]) | (symbol[1:] != symbol[:-1])
        child = np.cumsum(new) - 1
        c_symbol, c_of = symbol[new], of[new]
        first = np.ones(len(c_of), dtype=bool)
        first[1:] = c_of[1:] != c_of[:-1]
        begin = np.flatnonzero(first)
        kids = np.diff(begin, append=len(c_of))
        parent = np.cumsum(first) - 1
        cell = np.full(len(c_of), -1, dtype=np.int64)
        many = kids > 1
        low = top
        if many.any():
            room = 2 * int(kids[many].sum()) + 256
            grow(low + room + 256)
            for _ in range(24):
                open_ = np.flatnonzero((cell[begin] < 0) & many)
                if not len(open_):
                    break
                mine = np.flatnonzero(np.isin(parent, open_))
                where = np.zeros(len(kids), dtype=np.int64)
                where[open_] = r.integers(low, low + room, len(open_))
                tried = where[parent[mine]] + c_symbol[mine]
                ok = check[tried] == -1
                claim = np.full(len(kids), True)
                np.logical_and.at(claim, parent[mine][~ok], False)
                mine, tried = mine[claim[parent[mine]]], tried[claim[parent[mine]]]
                check[tried] = parent[mine]                        # the last one to write keeps a cell
                lost = check[tried] != parent[mine]
                good = np.full(len(kids), True)
                good[parent[mine][lost]] = False
                check[tried] = -1
                won = good[parent[mine]]
                cell[mine[won]] = tried[won]
                check[tried[won]] = c_of[mine[won]]
            for p in np.flatnonzero((cell[begin] < 0) & many):
                top = max(top, low + room + 256)
                grow(top + 512)
                own = np.arange(begin[p], begin[p] + kids[p])
                cell[own] = top + c_symbol[own]
                check[cell[own]] = c_of[own]
                top += 256
            top = max(top, int(cell.max()) + 1)
        ones = np.flatnonzero(cell < 0)
        if len(ones):
            holes = free + np.flatnonzero(check[free:top] == -1)[:len(ones)]
            more = np.arange(top, top + len(ones) - len(holes))
            grow(top + len(more))
            cell[ones] = np.concatenate([holes, more])
            check[cell[ones]] = c_of[ones]
            top += len(more)
            free = int(holes[-1]) + 1 if len(holes) == len(ones) else top
        base[c_of] = cell - c_symbol
        state[alive] = cell[child]
        owner[alive] = cell[child]
        depth += 1
        alive = alive[sizes[alive] > depth]
    accept = np.full(len(check), -1, dtype=np.int32)
    accept[owner] = np.arange(len(keys), dtype=np.int32)
    return Trie(base[:top + 257], check[:top + 257], accept[:top + 257])


def _key(lang: str, phrase: str) -> bytes:
    """What a trie holds of a phrase: no language, and no word, has a line break in it."""
    return f"{lang.encode().hex().upper()}\n{phrase}".encode()


def _spelled(lang: pa.Array, phrase: pa.Array, n: np.ndarray, into: np.ndarray, trie: Trie,
             roots: dict[str, int]) -> None:
    """Adds the counts ``n`` of phrases to the ids that the trie finds: all phrases take one byte at a time."""
    coded = lang.dictionary_encode()
    names = coded.dictionary.to_pylist()
    for x in names:
        if x not in roots:
            roots[x] = trie.walk(_key(x, ""))
    state = np.array([roots[x] for x in names], dtype=np.int64)[coded.indices.to_numpy(zero_copy_only=False)]
    offsets = np.frombuffer(phrase.buffers()[1], dtype=np.int32)[phrase.offset:phrase.offset + len(phrase) + 1].astype(np.int64)
    data = np.frombuffer(phrase.buffers()[2], dtype=np.uint8)
    base, check, accept = trie
    rows = np.flatnonzero(state >= 0)
    at, end, state = offsets[rows], offsets[rows + 1], state[rows]
    while len(rows):
        done = at == end
        if done.any():
            found, count = accept[state[done]], n[rows[done]]
            np.add.at(into, found[found >= 0], count[found >= 0])
            rows, at, end, state = rows[~done], at[~done], end[~done], state[~done]
        to = base[state] + data[at]
        on = check[to] == state
        rows, at, end, state = rows[on], at[on] + 1, end[on], to[on].astype(np.int64)


def _count_in_tries(columns: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows come by shard, candidates (kind 0) before occurrences (kind 1): a shard's trie is built, then counts."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held, trie, total, roots = None, [], None, np.empty(0, np.int64), {}

        def counted() -> Iterator[pa.RecordBatch]:
            if trie is not None:
                used = np.flatnonzero(total)
                out = held[0].take(pa.array(used)).set_column(columns.index("n"), "n", pa.array(total[used]))
                yield from out.to_batches(MERGED // 8)

        for batch in batches:
            own, kind = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("shard", "kind"))
            cuts = np.flatnonzero((np.diff(own) != 0) | (np.diff(kind) != 0)) + 1
            for low, high in zip([0, *cuts], [*cuts, len(own)], strict=True):
                if low == high:
                    continue
                if own[low] != shard:
                    yield from counted()
                    shard, held, trie, roots = own[low], [], None, {}
                part = batch.slice(low, high - low)
                if kind[low] == 0:
                    held.append(part.select(columns))
                    continue
                if not held:
                    continue            # windows let through by the bitmap, in a shard without candidates
                if trie is None:
                    rows = pa.Table.from_batches(held)
                    keys = list(map(_key, rows.column("lang").to_pylist(), rows.column("phrase").to_pylist()))
                    order = sorted(range(len(keys)), key=keys.__getitem__)
                    held = [rows.take(pa.array(order))]
                    trie, total = build_trie([keys[i] for i in order]), np.zeros(len(keys), dtype=np.int64)
                sizes = pc.list_value_length(part.column("phrases")).to_numpy(zero_copy_only=False)
                _spelled(part.column("lang").take(pa.array(np.repeat(np.arange(len(sizes)), sizes))), part.column("phrases").flatten().cast(pa.string()),
                         part.column("counts").flatten().to_numpy(), total, trie, roots)
        yield from counted()

    return count


def _occurrences(width: int, known: Broadcast, shards: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Word windows that are marked, spelled, with the shard that may have their phrase; equal ones of a task are merged."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []
        size, names = 0, {}

        def merged() -> pa.RecordBatch:
            coded = pa.concat_arrays([x[0] for x in held]).dictionary_encode()
            whose, shard = np.concatenate([x[1] for x in held]), np.concatenate([x[2] for x in held])
            place = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            _, at, n = np.unique(place * len(names) + whose, return_index=True, return_counts=True)
            order = np.lexsort((whose[at], shard[at]))
            at, n = at[order], n[order]
            shard, whose = shard[at].astype(np.int64), whose[at]
            new = np.flatnonzero((np.diff(shard) != 0) | (np.diff(whose) != 0)) + 1
            starts = np.concatenate([[0], new])
            run = np.arange(len(at)) - np.repeat(starts, np.diff(starts, append=len(at)))
            cuts = np.append(np.flatnonzero(run % PACKED == 0), len(at)).astype(np.int32)
            return pa.RecordBatch.from_arrays(
                [pa.array(shard[cuts[:-1]].astype(np.int32)), pa.array(list(names), pa.string()).take(pa.array(whose[cuts[:-1]])),
                 pa.ListArray.from_arrays(pa.array(cuts), coded.dictionary.take(pa.array(place[at]))),
                 pa.ListArray.from_arrays(pa.array(cuts), pa.array(n))], ["shard", "lang", "phrases", "counts"])

        for words, langs, place in _each(batches):
            h = _hashes(words, langs, place)
            n = len(h) - width + 1
            if n <= 0:
                continue
            parts = [h[i:n + i] for i in range(width)]
            together = marked(known.value, combined(parts))
            for i in range(width - 1):
                together &= words.joined[i:n + i]
            at = np.flatnonzero(together)
            if not len(at):
                continue
            # every word and one byte after it, within a piece a space
            sizes = words.ends - words.starts + 1
            ends = np.cumsum(sizes)
            content = spans(np.append(words.block.data, np.uint8(0)), words.starts, sizes)
            content[ends - 1] = 0x20
            own = np.array([names.setdefault(x, len(names)) for x in langs], dtype=np.int64)
            for some in np.split(at, range(MERGED, len(at), MERGED)):
                low, high = (ends - sizes)[some], ends[some + width - 1] - 1
                offsets = np.concatenate([[0], np.cumsum(high - low)]).astype(np.int32)
                spelled = pa.StringArray.from_buffers(
                    len(some), pa.py_buffer(offsets), pa.py_buffer(spans(content, low, high - low)))
                held.append((spelled, own[place[words.text[some]]], _shard_of([x[some] for x in parts], shards)))
                size += len(some)
                if size >= MERGED:
                    yield merged()
                    held, size = [], 0
        if held:
            yield merged()

    return count


def _shard_of(hashes: list[np.ndarray], shards: int) -> np.ndarray:
    mixed_up = reduce(np.bitwise_xor, [h >> np.uint64(7 * i) for i, h in enumerate(hashes)])
    return (mixed_up & np.uint64(2 ** 62 - 1)) % np.uint64(shards)


def _shard_column(names: list[str], shards: int) -> Column:
    """The same as ``_shard_of``."""
    mixed_up = reduce(Column.bitwiseXOR, [F.shiftrightunsigned(name, 7 * i) for i, name in enumerate(names)])
    return F.pmod(mixed_up.bitwiseAND(F.lit(2 ** 62 - 1)), F.lit(shards).cast("bigint")).cast("int")


def counted_phrases(texts: DataFrame, candidates: DataFrame, width: int, scratch: Scratch) -> DataFrame:
    """``candidates`` (``lang, phrase``, the hashes ``h1 ...`` of their words and more) with ``n``, the exact number of
    their occurrences.

    Candidates are cut by their hashes into shards of at most about SHARD bytes.
    One scan of all texts, however many shards there are, spells the windows
    whose hashes are those of a candidate (a bitmap of fixed size lets a few
    others through) and sends them to the shard, once per task. There a task
    builds the shard's trie and walks it with every phrase that arrives, so only
    the spelling decides. Nothing but the bitmap is collected or broadcast.
    """
    key = F.concat(F.hex(F.encode("lang", "UTF-8")), F.lit("\n"), "phrase")
    names = [f"h{i + 1}" for i in range(width)]
    held = scratch.write(candidates)
    total = int(held.agg(F.coalesce(F.sum(F.octet_length(key)), F.lit(0))).first()[0])
    if not total:
        return held.withColumn("n", F.lit(0).cast("bigint"))
    spread = 4 * int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shards = max(-(-total // SHARD), min(spread, -(-total // SPREAD)))
    marks = bitmap(held, names)
    found = texts.mapInArrow(_occurrences(width, marks, shards), "shard int, lang string, phrases array<string>, counts array<bigint>")
    columns = [*held.columns, "n"]
    both = held.withColumns({"shard": _shard_column(names, shards), "kind": F.lit(0), "n": F.lit(0).cast("bigint")}).unionByName(
        found.withColumn("kind", F.lit(1)), allowMissingColumns=True)
    schema = ", ".join(f"`{c}` {kind}" for c, kind in both.select(*columns).dtypes)
    return both.repartition("shard").sortWithinPartitions("shard", "kind").mapInArrow(_count_in_tries(columns), schema)


def _score(a: Column, l: Column, r: Column) -> Column:  # noqa: E741
    """floor(1000000 * a * a / (l * r)), exact."""
    wide = lambda c: c.cast("decimal(15,0)")
    part = (wide(a) * wide(a) * F.lit(1_000_000).cast("decimal(7,0)")).cast("decimal(38,0)")
    return F.call_function("div", part, (wide(l) * wide(r)).cast("decimal(38,0)")).cast("bigint")


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, percent: int = PERCENT, top: int = TOP,
                 text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the ``top`` phrases of every language.

    Texts (A-Z lower-cased) are cut at ``.,;:!?`` and line ends into pieces, and
    pieces at spaces and tabs into words; ``n`` counts a language's words.
    Phrases of 2 to ``longest`` words that occur ``a >= least`` times within
    pieces, overlaps included, are candidates. Cut after its first words, a
    phrase has ``l`` and ``r`` occurrences of the parts and the score
    floor(1000000 a a / (l r)); its worst cut counts, the earliest of equal
    ones. A candidate that lies inside a longer one with at least ``percent`` %
    of its occurrences is dropped. Rank is by score and ``a``, highest first,
    then by the phrase's bytes, so there are no ties.

    A phrase can only be frequent if both parts of one word less are. These are
    marked in a bitmap of fixed size; windows with both parts marked are counted
    by their words' hashes, and those that reach ``least`` are candidates (a few
    too many, never too few). Tries then count the candidates exactly.

    Null languages are ``und``, null and empty texts have no words, copies of a
    row count as often as they are there, ids play no part. No rows give no
    rows. A text has to fit a task.
    """
    scratch = Scratch(docs.sparkSession, "collocations")
    texts = only(docs, text=text_col, lang=F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit(UNKNOWN)))
    words = scratch.write(
        texts.mapInArrow(_count_words, "lang string, phrase string, h1 bigint, n bigint")
        .groupBy("lang", "phrase", "h1").agg(F.sum("n").alias("n")).where((F.col("n") >= least) | F.col("phrase").isNull()))
    totals = words.where("phrase IS NULL").select("lang", F.col("n").alias("n"))
    frequent = words.where("phrase IS NOT NULL")
    single = frequent.select("lang", F.col("phrase").alias("w1"), "h1")
    levels = {1: frequent.select("lang", "phrase", "n")}
    known = frequent
    for width in range(2, longest + 1):
        names = [f"h{i + 1}" for i in range(width)]
        marks = bitmap(known, names[:-1])
        windows = texts.mapInArrow(_count_windows(width, marks), ", ".join(f"{x} bigint" for x in [*names, "n"]))
        near = scratch.write(windows.groupBy(*names).agg(F.sum("n").alias("n")).where(F.col("n") >= least).select(*names))
        marks.destroy()
        spelled = near
        for i in range(width):
            word = single.select(F.col("lang").alias("of"), F.col("w1").alias(f"w{i + 1}"), F.col("h1").alias(f"h{i + 1}"))
            spelled = spelled.join(word, f"h{i + 1}")
            spelled = (spelled.withColumnRenamed("of", "lang") if not i
                       else spelled.where(F.col("of") == F.col("lang")).drop("of"))
        spelled = spelled.select("lang", *names, *[f"w{i + 1}" for i in range(width)],
                                 F.concat_ws(" ", *[f"w{i + 1}" for i in range(width)]).alias("phrase"))
        known = scratch.write(counted_phrases(texts, spelled, width, scratch).where(F.col("n") >= least))
        levels[width] = known
    found: DataFrame | None = None
    for width in range(2, longest + 1):
        own = levels[width].withColumnRenamed("n", "a")
        word = [f"w{i + 1}" for i in range(width)]
        cuts = []
        for k in range(1, width):
            for side, part in (("l", word[:k]), ("r", word[k:])):
                counts = levels[len(part)].select("lang", F.col("phrase").alias(f"part_{side}{k}"),
                                                  F.col("n").alias(f"{side}{k}"))
                own = (own.withColumn(f"part_{side}{k}", F.concat_ws(" ", *part))
                       .join(counts, ["lang", f"part_{side}{k}"]))
            cuts.append(F.struct(_score(F.col("a"), F.col(f"l{k}"), F.col(f"r{k}")).alias("score"), F.lit(k).alias("k"),
                                 F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r")))
        own = own.withColumn("cut", F.least(*cuts) if len(cuts) > 1 else cuts[0])
        for more in range(width + 1, longest + 1):
            inside = [F.concat_ws(" ", *[f"w{i + 1}" for i in range(j, j + width)]) for j in range(more - width + 1)]
            longer = (levels[more].select("lang", F.explode(F.array(*inside)).alias("phrase"), F.col("n").alias("of"))
                      .groupBy("lang", "phrase").agg(F.max("of").alias(f"in{more}")))
            own = own.join(longer, ["lang", "phrase"], "left")
            own = own.where(F.coalesce(F.col(f"in{more}"), F.lit(0)) * 100 < F.col("a") * percent)
        own = own.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
        found = own if found is None else found.unionByName(own)
    first = W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return (found.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= top)
            .join(totals, "lang").select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score"))
