"""Band join: values of one table within the intervals of another."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prepforge.functions.columns import quoted
from prepforge.operators.ordering import highest_so_far, ordered_totals
from prepforge.session import settle

BLOCK = 1 << 17         # points that one task ranks by two orders, or more where there were more than BLOCKS blocks
BLOCKS = 512

def _number(df: DataFrame, name: str):
    kind = df.schema[name].dataType.typeName()
    if kind == "date":
        return F.unix_date(quoted(name)).cast("bigint")
    if kind.startswith("timestamp"):
        return F.unix_micros(quoted(name).cast("timestamp"))
    return quoted(name).cast("bigint")


def _shift(c, level):
    return F.call_function("shiftright", c, level)


def _cut(bands: DataFrame, columns: list[str]) -> tuple[DataFrame, list[int]]:
    """``columns`` of the bands, which have ``__low`` and ``__high`` (exclusive), once for each stretch: ``__level, __cell``.

    And the levels that occur, 63 at most.
    """
    span = F.when(quoted("__low") <= quoted("__high"), F.sequence(F.lit(0), F.lit(62)))

    def ends(level):
        """Of one length, the stretch at the left end and that at the right end, where the bounds are odd."""
        first = _shift(F.col("__low") + F.call_function("shiftleft", F.lit(1).cast("bigint"), level) - 1, level)
        last = _shift(F.col("__high"), level)
        odd = lambda c: (first < last) & (F.pmod(c, F.lit(2)) == 1)
        return F.filter(F.array(F.when(odd(first), first), F.when(odd(last), last - 1)), lambda c: c.isNotNull())

    pieces = F.flatten(F.transform(span, lambda k: F.transform(
        ends(k.cast("int")), lambda c: F.struct(k.cast("int").alias("level"), c.alias("cell")))))
    cells = bands.withColumn("__piece", F.explode(pieces)).select(
        *[quoted(c) for c in columns], F.col("__piece.level").alias("__level"), F.col("__piece.cell").alias("__cell"))
    return cells, cells.agg(F.sort_array(F.collect_set("__level")).alias("levels")).first()["levels"]


def _placed(points: DataFrame, at, used: list[int]) -> DataFrame:
    """The points, once for each of the ``used`` levels: ``__level, __cell``."""
    placed = points.withColumn("__p", F.explode(F.array(*[
        F.struct(F.lit(k).alias("level"), _shift(at, F.lit(k)).alias("cell")) for k in used]) if used else F.array().cast(
            "array<struct<level:int,cell:bigint>>")))
    return placed.select(*[quoted(c) for c in points.columns], F.col("__p.level").alias("__level"),
                         F.col("__p.cell").alias("__cell"))


def band_join(points: DataFrame, bands: DataFrame, value: str, low: str, high: str, by: list[str] = ()) -> DataFrame:
    """All pairs of a point and a band with ``low <= value <= high`` (and equal ``by``).

    Every band is cut into aligned stretches whose lengths are powers of two, at
    most two of each length; a point lies in one stretch of each length that
    occurs. So both sides meet in an equality join, whatever the lengths of the
    bands, and no pair is met twice. Values are whole numbers, dates or
    timestamps (by microseconds). A point, band or key with a null joins nothing.
    The columns of both sides must differ but for ``by``.
    """
    cells = bands.withColumn("__low", _number(bands, low)).withColumn("__high", _number(bands, high) + 1)
    cells, used = _cut(cells, bands.columns)
    joined = _placed(points, _number(points, value), used).join(cells, [*by, "__level", "__cell"]).drop("__level", "__cell")
    joined.sides = (points, bands, value, low, high, list(by))
    return joined


class _Places:
    """Points of a block by ``x``: how many lie below both bounds of a question, and sums of ``t`` over ranges of ``x``."""

    def __init__(self, x: np.ndarray, y: np.ndarray, t: np.ndarray) -> None:
        order = np.argsort(x, kind="stable")
        self.x, t = x[order], t[order]
        by_y = np.argsort(y[order], kind="stable")
        self.y = y[order][by_y]
        rank = np.empty(len(x), dtype=np.int64)
        rank[by_y] = np.arange(len(x))
        self.bits: list[tuple[np.ndarray, int]] = []        # a wavelet matrix of the ranks by y
        for bit in reversed(range(len(x).bit_length())):
            zero = (rank >> bit) & 1 == 0
            self.bits.append((np.concatenate([[0], np.cumsum(zero)]), bit))
            rank = np.concatenate([rank[zero], rank[~zero]])
        self.leaves = 1 << max(0, len(x) - 1).bit_length()
        self.sums = np.zeros(2 * self.leaves)
        self.sums[self.leaves:self.leaves + len(t)] = t
        size = self.leaves
        while size > 1:
            self.sums[size // 2:size] = self.sums[size:2 * size:2] + self.sums[size + 1:2 * size:2]
            size //= 2

    def below(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        first, last = np.zeros(len(x), dtype=np.int64), np.searchsorted(self.x, x)
        bound, found = np.searchsorted(self.y, y), np.zeros(len(x), dtype=np.int64)
        for zeros, bit in self.bits:
            a, b = zeros[first], zeros[last]
            one = (bound >> bit) & 1 == 1
            found += np.where(one, b - a, 0)
            first, last = np.where(one, first - a + zeros[-1], a), np.where(one, last - b + zeros[-1], b)
        return found

    def total(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Only added up, never a difference: what lies outside a range does not touch its sum."""
        a, b = np.searchsorted(self.x, low) + self.leaves, np.searchsorted(self.x, high) + self.leaves
        found = np.zeros(len(a))
        while (a < b).any():
            odd = np.flatnonzero((a < b) & (a & 1 == 1))
            found[odd] += self.sums[a[odd]]
            a[odd] += 1
            odd = np.flatnonzero((a < b) & (b & 1 == 1))
            b[odd] -= 1
            found[odd] += self.sums[b[odd]]
            a, b = np.where(a < b, a >> 1, 0), np.where(a < b, b >> 1, 0)
        return found


def _answers(size: int, blocks: int, known) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows come by block, points (kind 0) before questions, which are answered a batch at a time.

    A question's ``x`` and ``y`` bound the points to count. One of kind 1 sums
    from ``z`` or the block's begin up to ``x`` and adds what the blocks before
    hold; kind 2 sums from ``z`` on, kind 3 only counts.
    """
    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, totals = known.value
        whole = _Places(np.arange(blocks), np.zeros(blocks), totals)
        now, held, places = None, [], None
        for batch in batches:
            block, kind, x, y, z, mark = (batch.column(c).to_numpy(zero_copy_only=False)
                                          for c in ("block", "kind", "x", "y", "z", "id"))
            t = batch.column("t").to_numpy(zero_copy_only=False)
            for rows in np.split(np.arange(len(block)), np.flatnonzero(np.diff(block)) + 1) if len(block) else []:
                if block[rows[0]] != now:
                    now, held, places = block[rows[0]], [], None
                point = rows[kind[rows] == 0]
                if len(point):
                    held.append((x[point], y[point], t[point]))
                rows = rows[len(point):]
                if not len(rows):
                    continue
                if places is None:
                    places = _Places(*(np.concatenate([h[i] for h in held]) for i in range(3))) if held else _Places(
                        np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
                    held = []
                for k in (1, 2, 3):
                    own = rows[kind[rows] == k]
                    if not len(own):
                        continue
                    n, total = np.zeros(len(own), dtype=np.int64), np.zeros(len(own))
                    if k != 2:
                        n = places.below(x[own], y[own])
                    if k == 1:
                        to = x[own] // size
                        n += counts[to, y[own] // size] - z[own]
                        total = places.total(np.maximum(z[own], to * size), x[own]) + whole.total(z[own] // size + 1, to)
                    if k == 2:
                        total = places.total(z[own], np.full(len(own), np.iinfo(np.int64).max))
                    yield pa.RecordBatch.from_arrays([pa.array(mark[own]), pa.array(n), pa.array(total)], ["__id", "d", "t"])

    return answer


def band_totals(joined: DataFrame, band: str, distinct: str, total: str) -> DataFrame:
    """Of a band join, per value of the bands' column ``band``: its pairs ``n``, their different values
    ``n_distinct`` of the points' column ``distinct``, and the sum ``total`` of another one.

    The same as grouping the pairs, of which there may be very many, but no pair
    is made. A band is a range of places in the order of the points, so ``n`` is a
    difference of running counts. In it, a value counts at its first point, the
    one whose predecessor of that value lies before the band: those are the
    points before the band's end whose predecessor lies before its begin, less
    all points before its begin. Both orders are cut into blocks of BLOCK points
    or more, at most BLOCKS. Counts of pairs of blocks answer for whole blocks; a
    task per block answers for the rest. Sums of floating numbers are added up
    from parts of blocks and whole blocks. A row is moved a fixed number of times.
    Only a ``band`` that has several different intervals goes by its pairs.
    """
    points, bands, value, low, high, by = vars(joined)["sides"]
    grouped = lambda pairs: pairs.groupBy(band).agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct(quoted(distinct)).alias("n_distinct"), F.sum(quoted(total)).alias("total"))
    place = F.struct(*[quoted(c) for c in by], F.col("__low"), F.col("__high"))
    spans = bands.withColumn("__low", _number(bands, low)).withColumn("__high", _number(bands, high) + 1).where(
        "__low < __high").groupBy(band).agg(F.min(place).alias("__span"), F.max(place).alias("__other"),
                                            F.count(F.lit(1)).alias("__times"))
    spans = settle(spans.withColumn("__id", F.monotonically_increasing_id()), "bands")
    several = spans.where("__span <> __other").select(F.col(band).alias("__band"))
    single = spans.where("__span = __other").select("__id", band, "__times", "__span.*").dropna(subset=by or ["__id"])

    kind = points.select(F.sum(quoted(total)).alias("t")).schema["t"].dataType
    floating = kind.typeName() == "double"
    wide = "double" if floating else f"decimal(38,{getattr(kind, 'scale', 0)})"
    number = points.withColumn("__at", _number(points, value)).select(
        *by, "__at", quoted(distinct).alias("__v"), quoted(total).alias("__t"))
    number = number.where(F.col("__at").isNotNull()).dropna(subset=by or ["__at"]).groupBy(*by, "__v", "__at").agg(
        F.count(F.lit(1)).alias("__n"), F.count("__t").alias("__m"), F.coalesce(F.sum("__t").cast(wide), F.lit(0).cast(wide)).alias("__t"))
    once = highest_so_far(number.where("__v IS NOT NULL"), [*by, "__v"], "__at", "__at", "__last", -1)
    # a point without a value never is a first one
    number = once.unionByName(number.where("__v IS NULL").withColumn("__last", F.col("__at")))
    marks = number.select(*by, "__at", F.lit(1).alias("__kind"), F.xxhash64("__v").alias("__tie"), F.lit(1).cast("bigint").alias("__c"),
                          "__n", "__m", "__t", "__last", F.lit(None).cast("bigint").alias("__id"), F.lit(None).cast("boolean").alias("__end"))
    zero = F.lit(0).cast("bigint")
    asked = single.withColumn("__side", F.explode(F.array(
        F.struct(F.col("__low").alias("at"), F.lit(False).alias("end")), F.struct(F.col("__high").alias("at"), F.lit(True).alias("end"))))).select(
        *by, F.col("__side.at").alias("__at"), F.lit(0).alias("__kind"), F.xxhash64("__id").alias("__tie"), zero.alias("__c"), zero.alias("__n"),
        zero.alias("__m"), F.lit(0).cast(wide).alias("__t"), F.lit(None).cast("bigint").alias("__last"), "__id", F.col("__side.end").alias("__end"))
    exact = ["__n", "__m"] if floating else ["__n", "__m", "__t"]
    ranks = settle(ordered_totals(marks.unionByName(asked), [*[F.col(c) for c in by], F.col("__at"), F.col("__kind"), F.col("__tie")],
                                  ["__c", *exact]).drop("__c", "__tie", "__n", "__m"), "ranks")
    at_end, at_begin = (lambda c, e=e: F.max(F.when(F.col("__end") == e, F.col(f"{c}_before"))) for e in (True, False))
    inside = ranks.where("__kind = 0").groupBy("__id").agg(
        at_begin("__c").alias("__first"), at_end("__c").alias("__past"), *[(at_end(c) - at_begin(c)).alias(f"{c}_inside") for c in exact])
    found = settle(single.join(inside.where("__n_inside > 0"), "__id"), "asked")

    seconds = [*by, "__last", "__kind", "__tie"]
    places = settle(ordered_totals(
        ranks.where("__kind = 1").select(*by, "__last", "__kind", F.col("__c_before").alias("__tie"), F.lit(1).cast("bigint").alias("__c"), "__t",
                                         F.lit(None).cast("bigint").alias("__past"), F.lit(None).cast("bigint").alias("__id")).unionByName(
            found.select(*by, F.col("__low").alias("__last"), F.lit(0).alias("__kind"), F.col("__first").alias("__tie"), zero.alias("__c"),
                         F.lit(0).cast(wide).alias("__t"), "__past", "__id")),
        [F.col(c) for c in seconds], ["__c"]).select(
            "__kind", F.col("__tie").alias("r"), F.col("__c_before").alias("s"), F.col("__t").cast("double").alias("t"), F.col("__past").alias("past"), "__id"), "places")
    n = places.where("__kind = 1").count()
    size = max(BLOCK, -(-n // BLOCKS))
    blocks = -(-n // size)
    block = lambda c: F.expr(f"{c} DIV {size}")
    cells = places.where("__kind = 1").groupBy(block("r").alias("b"), block("s").alias("c")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("t").alias("t")).toArrow()
    b, c = (cells.column(x).to_numpy() for x in "bc")
    counts, totals = np.zeros((blocks + 1, blocks + 1), dtype=np.int64), np.zeros(blocks)
    counts[b + 1, c + 1] = cells.column("n").to_numpy()
    np.add.at(totals, b, cells.column("t").to_numpy())
    counts = np.pad(counts.cumsum(axis=0).cumsum(axis=1), ((0, 1), (0, 1)), mode="edge")
    row = lambda k, at, x, y, z: F.struct(*[v.cast("bigint").alias(name) for name, v in (
        ("kind", F.lit(k)), ("block", at), ("x", x), ("y", y), ("z", z))])
    r, s, end = F.col("r"), F.col("s"), F.col("past")
    second = lambda at: at + blocks + 1
    rows = F.when(F.col("__kind") == 1, F.array(row(0, block("r"), r, s, zero), row(0, second(block("s")), s, r, zero))).otherwise(
        F.filter(F.array(row(1, block("past"), end, s, r), F.when(block("r") < block("past"), row(2, block("r"), end, s, r)),
                         row(3, second(block("s")), s, block("past") * size, zero)), lambda v: v.isNotNull()))
    dealt = places.select(F.explode(rows).alias("v"), "t", F.coalesce("__id", F.lit(-1)).alias("id")).select("v.*", "t", "id")
    known = points.sparkSession.sparkContext.broadcast((counts, totals))
    answers = dealt.repartition("block").sortWithinPartitions("block", "kind").mapInArrow(
        _answers(size, blocks, known), "__id bigint, d bigint, t double").groupBy("__id").agg(
        F.sum("d").alias("__d"), F.sum("t").alias("__t"))
    of_band = F.col("__t") if floating else F.col("__t_inside")
    parts = [found.join(answers, "__id").select(
        quoted(band), (F.col("__n_inside") * F.col("__times")).alias("n"), F.col("__d").alias("n_distinct"),
        F.when(F.col("__m_inside") > 0, of_band * F.col("__times")).cast(kind).alias("total"))]
    if not several.isEmpty():
        rest = bands.join(several, quoted(band).eqNullSafe(F.col("__band")), "left_semi")
        parts.append(grouped(band_join(points, rest, value, low, high, by)))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
