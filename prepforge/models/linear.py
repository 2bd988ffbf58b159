"""Linear models: scoring is a column expression."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import add, and_
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prepforge.errors import TrainingError
from prepforge.functions.columns import as_number, clean, quoted
from prepforge.session import settle

_MERGED = 16           # triangular factors that one task reduces to one
_MAX_TERMS = 100       # longer sums are written as one array expression


class LinearModel:
    """intercept + sum of weight * feature."""

    def __init__(self, kind: str, features: list[str], weights: list[float], intercept: float,
                 extra: dict[str, Any] | None = None) -> None:
        self.kind, self.features = kind, list(features)
        self.weights = [float(w) for w in weights]
        self.intercept = float(intercept)
        self.extra = extra or {}

    def expression(self, columns: dict[str, Column] | None = None) -> Column:
        cols = [(columns or {}).get(f, quoted(f)).cast("double") for f in self.features]
        base = F.lit(self.intercept)
        if len(cols) <= _MAX_TERMS:
            return reduce(add, [F.lit(w) * c for w, c in zip(self.weights, cols)], base)
        products = F.zip_with(F.array(*cols), F.array(*[F.lit(w) for w in self.weights]),
                              lambda x, w: x * w)
        return F.aggregate(products, base, lambda a, x: a + x)

    def predict(self, df: DataFrame, output: str = "prediction") -> DataFrame:
        return df.withColumn(output, self.expression())

    def to_dict(self) -> dict[str, Any]:
        return {"kind": self.kind, "features": self.features, "weights": self.weights,
                "intercept": self.intercept, "extra": self.extra}

    @staticmethod
    def from_dict(data: dict[str, Any]) -> "LinearModel":
        return LinearModel(data["kind"], data["features"], data["weights"], data["intercept"],
                           data.get("extra"))


def require_complete(df: DataFrame, columns: list[str]) -> None:
    """Raises with the number of rows that lack one of the columns; the same rule for every model."""
    present_ = [clean(df, c).isNotNull() for c in columns]
    missing = df.agg(F.count_if(~reduce(and_, present_))).first()[0]
    if missing:
        raise TrainingError(f"{missing} rows lack a feature or the target; impute or drop them first")


def numbers_of(column: pa.Array, width: int) -> np.ndarray:
    """A column of arrays as a matrix; what is missing is NaN."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, width)


def _reduced(block: np.ndarray, known: np.ndarray | None) -> np.ndarray:
    """The triangular factor of ``known`` and further rows."""
    return np.linalg.qr(block if known is None else np.vstack([known, block]), mode="r")


def _solved(factor: np.ndarray, intercept: bool, rows: int) -> np.ndarray:
    """Intercept and weights of least length among the best, from the factor of (1,) features, target.

    Directions weaker than the rounding of that many rows do not count.
    """
    small = np.finfo(float).eps * max(rows, factor.shape[1])
    if not intercept:
        features, target = factor[:, :-1], factor[:, -1]
        return np.concatenate([[0.0], np.linalg.lstsq(features, target, rcond=small)[0]])
    # what is left of the columns beside the ones is what they are without their means
    means = factor[0, 1:] / factor[0, 0]
    weights = np.linalg.lstsq(factor[1:, 1:-1], factor[1:, -1], rcond=small)[0] if len(factor) > 1 else np.zeros(
        factor.shape[1] - 2)
    return np.concatenate([[means[-1] - means[:-1] @ weights], weights])


def fit_least_squares(df: DataFrame, features: list[str], target: str,
                      fit_intercept: bool = True) -> LinearModel:
    """Unregularised least squares in one pass, for any number of features, collinear ones too.

    Every task reduces its rows to a triangular factor, and a tree of tasks
    reduces the factors to one, whose singular values give the solution of least
    length (an intercept does not count). Only the weights reach the driver. A
    task holds ``features`` squared numbers. A row that lacks a feature or the
    target raises, with the number of such rows.
    """
    width = len(features) + 1 + fit_intercept

    def reduce_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factor, rows, gaps = None, 0, 0
        for batch in batches:
            block = numbers_of(batch.column("row"), len(features) + 1)
            if fit_intercept:
                block = np.column_stack([np.ones(len(block)), block])
            whole = ~np.isnan(block).any(axis=1)
            gaps, rows = gaps + int((~whole).sum()), rows + batch.num_rows
            if whole.any():
                factor = _reduced(block[whole], factor)
        if rows:
            yield packed(factor, rows, gaps)

    def packed(factor, rows, gaps) -> pa.RecordBatch:
        content = b"" if factor is None else factor.astype("<f8").tobytes()
        return pa.RecordBatch.from_pydict({"rows": [rows], "gaps": [gaps], "factor": [content]})

    def merged(batches):
        factor, rows, gaps = None, 0, 0
        for batch in batches:
            for r in batch.to_pylist():
                rows, gaps = rows + r["rows"], gaps + r["gaps"]
                if r["factor"]:
                    factor = _reduced(np.frombuffer(r["factor"], dtype="<f8").reshape(-1, width), factor)
        return factor, rows, gaps

    def reduce_factors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factor, rows, gaps = merged(batches)
        if rows:
            yield packed(factor, rows, gaps)

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factor, rows, gaps = merged(batches)
        found = None if factor is None or gaps else _solved(factor, fit_intercept, rows)
        yield pa.RecordBatch.from_arrays([pa.array([rows], pa.int64()), pa.array([gaps], pa.int64()),
                                          pa.array([found], pa.list_(pa.float64()))], ["rows", "gaps", "weights"])

    shape = "rows bigint, gaps bigint, factor binary"
    data = df.select(F.array(*[as_number(df, c) for c in [*features, target]]).alias("row"))
    parts = data.rdd.getNumPartitions()
    partial = data.mapInArrow(reduce_rows, shape)
    while parts > _MERGED:
        parts = -(-parts // _MERGED)
        partial = settle(partial, "factors").repartition(parts).mapInArrow(reduce_factors, shape)
    result = partial.repartition(1).mapInArrow(solve, "rows bigint, gaps bigint, weights array<double>").first()
    if result is None or not result["rows"]:
        raise TrainingError("no rows to train on")
    if result["gaps"]:
        raise TrainingError(f"{result['gaps']} rows lack a feature or the target; impute or drop them first")
    return LinearModel("linear_regression", features, result["weights"][1:], result["weights"][0])
