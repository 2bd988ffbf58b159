"""Exact interpolated quantiles without sorting or shuffling the data.

The built-in exact percentile keeps every distinct value in one task. Here a
mergeable sketch first gives, for each column and probability, a narrow
bracket that must hold the wanted order statistics; a second pass counts what
lies below the bracket and collects the few distinct values inside it. Only
when a bracket could still hold too many values are further narrowing passes
run. Every pass is an aggregate with bounded state.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prepforge.errors import DataError
from prepforge.functions.columns import as_number, quoted
from prepforge.operators.longform import ITEM, MAX_STACKED, stacked
from prepforge.operators.ordering import ordered_totals

ACCURACY = 10_000          # rank error of the sketch is at most 1 / ACCURACY
MAX_BRACKET_VALUES = 50_000


@dataclass
class _Bracket:
    column: str
    prob: float
    total: int
    low: float
    high: float
    rows: int          # upper estimate of the rows inside, ties of the ends aside
    below: int = 0

    @property
    def position(self) -> float:
        return self.prob * (self.total - 1)

    @property
    def first_rank(self) -> int:
        return math.floor(self.position)

    @property
    def last_rank(self) -> int:
        return math.ceil(self.position)

    def covers(self, below: int, inside: int) -> bool:
        return below <= self.first_rank and self.last_rank < below + inside

    def share(self, rank: int, shift: float) -> float:
        """Relative position of a rank inside the bracket, moved by ``shift``."""
        at = (rank - self.below) / max(self.rows - 1, 1)
        return min(max(at + shift, 0.0), 1.0)


def _grid(probs: list[float], accuracy: int) -> list[float]:
    """The probabilities moved down and up by twice the error of the sketch."""
    margin = 2.0 / accuracy
    return [min(max(p + s, 0.0), 1.0) for p in probs for s in (-margin, margin)]


def sketch_aggregates(df: DataFrame, columns: list[str], probs: list[float],
                      accuracy: int = ACCURACY) -> list[Column]:
    """The first pass, for use beside other aggregates over the same frame."""
    grid = _grid(probs, accuracy)
    return [
        expr for i, c in enumerate(columns) for expr in (
            F.count(as_number(df, c)).alias(f"sk_n{i}"),
            F.min(as_number(df, c)).alias(f"sk_min{i}"),
            F.max(as_number(df, c)).alias(f"sk_max{i}"),
            F.percentile_approx(as_number(df, c), grid, accuracy).alias(f"sk_q{i}"),
        )
    ]


def exact_quantiles(df: DataFrame, columns: list[str], probs: list[float],
                    max_values: int = MAX_BRACKET_VALUES, accuracy: int = ACCURACY,
                    sketched: dict | None = None) -> dict[str, list[float | None]]:
    """Linear-interpolated quantiles per column, NULL and NaN ignored.

    ``sketched`` holds the results of ``sketch_aggregates`` for the same
    arguments when another pass has already computed them.
    """
    if not columns:
        return {}
    if len(columns) > MAX_STACKED and sketched is None:
        return {**exact_quantiles(df, columns[:MAX_STACKED], probs, max_values, accuracy),
                **exact_quantiles(df, columns[MAX_STACKED:], probs, max_values, accuracy)}
    margin, grid = 2.0 / accuracy, _grid(probs, accuracy)
    numbers = {c: as_number(df, c) for c in columns}
    first = sketched or df.agg(*sketch_aggregates(df, columns, probs, accuracy)).first().asDict()

    brackets: list[_Bracket] = []
    extremes: dict[str, tuple[float, float]] = {}
    for i, c in enumerate(columns):
        n = first[f"sk_n{i}"]
        if not n:
            continue
        extremes[c] = (first[f"sk_min{i}"], first[f"sk_max{i}"])
        for j, p in enumerate(probs):
            low, high = first[f"sk_q{i}"][2 * j], first[f"sk_q{i}"][2 * j + 1]
            brackets.append(_Bracket(
                c, p, n,
                low=extremes[c][0] if grid[2 * j] == 0.0 else low,
                high=extremes[c][1] if grid[2 * j + 1] == 1.0 else high,
                rows=math.ceil(n * 3 * margin)))

    found: dict[tuple[str, float], float] = {}
    pending = brackets
    while pending:
        while wide := [b for b in pending if b.low < b.high and b.rows > max_values]:
            _narrow(df, numbers, wide, extremes, margin, accuracy)
        missed = []
        for b, (below, values) in zip(pending, _inside(df, numbers, pending)):
            if not b.covers(below, sum(n for _, n in values)):
                b.low, b.high = extremes[b.column]      # the sketch missed: start over
                b.rows = max(b.total, max_values + 1)
                missed.append(b)
                continue
            low = _at(values, b.first_rank - below)
            high = _at(values, b.last_rank - below)
            found[b.column, b.prob] = low + (high - low) * (b.position - b.first_rank)
        pending = missed
    return {c: [found.get((c, p)) for p in probs] for c in columns}


def _narrow(df, numbers, brackets, extremes, margin, accuracy) -> None:
    """Shrink every bracket to a few sketch errors around its ranks."""
    counted = df.agg(*[
        expr for i, b in enumerate(brackets) for expr in (
            F.count_if(numbers[b.column] < b.low).alias(f"below{i}"),
            F.count_if(numbers[b.column].between(b.low, b.high)).alias(f"inside{i}"),
        )
    ]).first()
    for i, b in enumerate(brackets):
        b.below, b.rows = counted[f"below{i}"], counted[f"inside{i}"]
        if not b.covers(b.below, b.rows):
            b.low, b.high = extremes[b.column]
            b.below, b.rows = 0, b.total
    refined = df.agg(*[
        F.percentile_approx(
            F.when(numbers[b.column].between(b.low, b.high), numbers[b.column]),
            [b.share(b.first_rank, -margin), b.share(b.last_rank, margin)],
            accuracy).alias(f"q{i}")
        for i, b in enumerate(brackets)
    ]).first()
    for i, b in enumerate(brackets):
        b.low, b.high = max(b.low, refined[f"q{i}"][0]), min(b.high, refined[f"q{i}"][1])
        b.rows = math.ceil(b.rows * 3 * margin)


def _inside(df, numbers, brackets):
    """Per bracket: rows below it and the sorted (value, rows) pairs inside it."""
    rows = [
        [F.when(numbers[b.column] >= b.low, numbers[b.column]),
         numbers[b.column] <= F.lit(b.high)]
        for b in brackets
    ]
    counted = (
        stacked(df, rows, ["value", "kept"]).where("kept")
        .groupBy(ITEM, "value").count().collect()
    )
    below = [0] * len(brackets)
    values: list[list[tuple[float, int]]] = [[] for _ in brackets]
    for row in counted:
        if row["value"] is None:
            below[row[ITEM]] = row["count"]
        else:
            values[row[ITEM]].append((row["value"], row["count"]))
    return [(b, sorted(v)) for b, v in zip(below, values)]


def _at(values: list[tuple[float, int]], rank: int) -> float:
    for value, n in values:
        if rank < n:
            return value
        rank -= n
    raise DataError("rank outside the collected bracket")


def grouped_quantiles(df: DataFrame, by: list[str], column: str, probs: list[float], names: list[str]) -> DataFrame:
    """``by`` and one column per probability: exact interpolated quantiles of every group.

    Equal values are counted first; the counts are added up along ranges of
    (group, value), so a group of any size is spread over the tasks, and the
    values at the two ranks around each quantile are picked by an aggregate.
    NULL and NaN are ignored, a group without values has NULLs, and NULL is a
    group of its own.
    """
    keys = [f"__k{i}" for i in range(len(by))]
    rows = df.select(*[quoted(b).alias(k) for b, k in zip(by, keys)], as_number(df, column).alias("__v"))
    cells = rows.groupBy(*keys, "__v").agg(F.count(F.lit(1)).alias("__n"))
    groups = cells.select(*keys).distinct()
    run = ordered_totals(cells.where("__v IS NOT NULL"), [F.col(c) for c in [*keys, "__v"]], ["__n"])
    sizes = run.groupBy(*keys).agg(F.min("__n_before").alias("__start"), F.sum("__n").alias("__total"))

    def same(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
        other = right.select(*[F.col(k).alias(f"{k}_") for k in keys], *[c for c in right.columns if c not in keys])
        on = reduce(and_, [F.col(k).eqNullSafe(F.col(f"{k}_")) for k in keys], F.lit(True))
        return left.join(other, on, how).drop(*[f"{k}_" for k in keys])

    below = F.col("__n_before") - F.col("__start")
    place = [F.lit(float(p)) * (F.col("__total") - 1) for p in probs]
    holds = lambda rank: F.max(F.when((below <= rank) & (rank < below + F.col("__n")), F.col("__v")))
    picked = same(run, sizes, "inner").groupBy(*keys, "__total").agg(*[
        expr for i, at in enumerate(place) for expr in (
            holds(F.floor(at)).alias(f"__a{i}"), holds(F.ceil(at)).alias(f"__b{i}"))])
    values = [(F.col(f"__a{i}") + (F.col(f"__b{i}") - F.col(f"__a{i}")) * (at - F.floor(at))).alias(f"__q{i}")
              for i, at in enumerate(place)]
    found = same(groups, picked.select(*keys, *values), "left")
    return found.select(*[F.col(k).alias(b) for k, b in zip(keys, by)],
                        *[F.col(f"__q{i}").alias(n) for i, n in enumerate(names)])
