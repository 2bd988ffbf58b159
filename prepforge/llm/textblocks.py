"""Whole texts as byte arrays: words, hashes of words and of word windows, one array operation per block.

A block holds complete texts of about ``BLOCK`` bytes; a longer text is a block
of its own. Words are runs of bytes other than space and \\x09-\\x0D, so UTF-8
never has to be decoded. Nothing here depends on Spark or on the process.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

BLOCK = 1 << 20
WINDOW = 5

SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_STEP = np.uint64(0x9E3779B97F4A7C15)       # odd, so that its powers have inverses modulo 2^64
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_JOIN = np.uint64(0xD1B54A32D192ED03)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mixed(np.arange(1, 257, dtype=np.uint64) * _STEP)


@lru_cache(maxsize=1)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    def run(base: np.uint64) -> np.ndarray:
        out = np.full(size, base, dtype=np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)
    return run(_STEP), run(_BACK)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = BLOCK + 1
    while size < n:
        size *= 2
    return _powers(size)


class Block:
    """Consecutive texts of one Arrow batch: ``data`` and the ``bounds`` of each text in it."""

    def __init__(self, first: int, data: np.ndarray, bounds: np.ndarray):
        self.first, self.data, self.bounds = first, data, bounds

    @property
    def rows(self) -> int:
        return len(self.bounds) - 1

    def text(self, i: int) -> bytes:
        return self.data[self.bounds[i]:self.bounds[i + 1]].tobytes()

    def lowered(self) -> "Block":
        return Block(self.first, LOWER[self.data], self.bounds)

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of all words, and for each text the number of words before it."""
        n = len(self.data)
        inside = np.empty(n + 1, dtype=bool)
        np.logical_not(SPACE[self.data], out=inside[:n])
        inside[n] = False
        opens = inside.copy()
        opens[1:] &= ~inside[:-1]
        closes = np.zeros(n + 1, dtype=bool)
        closes[1:] = inside[:-1] & ~inside[1:]
        cuts = self.bounds[(self.bounds > 0) & (self.bounds < n)]
        opens[cuts] = inside[cuts]
        closes[cuts] = inside[cuts - 1]
        starts, ends = np.flatnonzero(opens), np.flatnonzero(closes)
        return starts, ends, np.searchsorted(starts, self.bounds)

    def running(self) -> tuple[np.ndarray, np.ndarray]:
        """Running polynomial total of the bytes, and what takes the place out of a difference of two."""
        forth, back = powers(len(self.data) + 1)
        total = np.zeros(len(self.data) + 1, dtype=np.uint64)
        np.cumsum(_BYTE[self.data] * forth[:len(self.data)], out=total[1:])
        return total, back

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """One 64-bit hash per span, equal for equal bytes wherever they stand."""
        total, back = self.running()
        return mixed((total[ends] - total[starts]) * back[starts])


def blocks(column: pa.Array, limit: int = BLOCK) -> Iterator[Block]:
    """The texts of a string or binary column in blocks; null counts as empty."""
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    n = len(column)
    if not n:
        return
    bounds = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)
    bounds = bounds[column.offset:column.offset + n + 1].astype(np.int64)
    content = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, dtype=np.uint8)
    at = 0
    while at < n:
        to = int(np.searchsorted(bounds, bounds[at] + limit, side="right")) - 1
        to = min(n, max(to, at + 1))
        yield Block(at, content[bounds[at]:bounds[to]], bounds[at:to + 1] - bounds[at])
        at = to


def windows(hashes: np.ndarray, first: np.ndarray, width: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all word windows and the text of each; a shorter text with words is one window."""
    counts = np.diff(first)
    parts, owner = [], []
    if len(hashes) >= width:
        size = len(hashes) - width + 1
        run = hashes[:size].copy()
        for k in range(1, width):
            run *= _JOIN
            run += hashes[k:size + k]
        text = np.repeat(np.arange(len(counts)), counts)
        whole = text[:size] == text[width - 1:]
        parts.append(run[whole])
        owner.append(text[:size][whole])
    for k in range(1, width):
        short = np.flatnonzero(counts == k)
        if len(short):
            run = np.zeros(len(short), dtype=np.uint64)
            for i in range(k):
                run = run * _JOIN + hashes[first[short] + i]
            parts.append(run + np.uint64(k))
            owner.append(short)
    if not parts:
        return np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64)
    found, text = mixed(np.concatenate(parts)), np.concatenate(owner)
    if len(parts) == 1:
        return found, text
    order = np.argsort(text, kind="stable")
    return found[order], text[order]


def sets(found: np.ndarray, text: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of each text, ascending, and the bounds of each text's set."""
    found = found.copy()
    ends = np.searchsorted(text, np.arange(rows + 1))
    for i in range(rows):
        found[ends[i]:ends[i + 1]].sort()
    fresh = np.ones(len(found), dtype=bool)
    fresh[1:] = (found[1:] != found[:-1]) | (text[1:] != text[:-1])
    found, text = found[fresh], text[fresh]
    return found, np.searchsorted(text, np.arange(rows + 1))


def sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of each stretch, zero for empty ones (wrapping for 64-bit integers)."""
    total = np.zeros(len(values) + 1, dtype=values.dtype)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]
