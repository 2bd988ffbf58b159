"""Stacking datasets on top of each other."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prepforge.errors import DataError
from prepforge.functions.columns import quoted

_RANK = {T.ByteType: 0, T.ShortType: 1, T.IntegerType: 2, T.LongType: 3,
         T.FloatType: 4, T.DoubleType: 5}


def common_columns(frames: list[DataFrame]) -> list[str]:
    """Columns present in every frame, in the order of the first."""
    shared = set.intersection(*[set(f.columns) for f in frames])
    return [c for c in frames[0].columns if c in shared]


def shared_type(types: list[T.DataType]) -> T.DataType:
    """Widest numeric type, or text when the types have nothing in common."""
    if all(t == types[0] for t in types):
        return types[0]
    if all(isinstance(t, T.NumericType) for t in types):
        ranks = [_RANK.get(type(t)) for t in types]
        if None in ranks:
            return T.DoubleType()
        widest = types[ranks.index(max(ranks))]
        if isinstance(widest, T.FloatType) and any(isinstance(t, (T.IntegerType, T.LongType)) for t in types):
            return T.DoubleType()
        return widest
    return T.StringType()


def concat(frames: list[DataFrame], columns: list[str] | None = None) -> DataFrame:
    """UNION ALL over the given or the common columns; duplicates stay."""
    if not frames:
        raise DataError("no datasets given")
    names = list(columns) if columns else common_columns(frames)
    if not names:
        raise DataError("the datasets have no column in common")
    for f in frames:
        missing = [c for c in names if c not in f.columns]
        if missing:
            raise DataError(f"column '{missing[0]}' is not in every dataset")
    target = {c: shared_type([f.schema[c].dataType for f in frames]) for c in names}
    aligned = [f.select(*[quoted(c).cast(target[c]).alias(c) for c in names]) for f in frames]
    return reduce(DataFrame.unionByName, aligned)


def selection_summary(datasets: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Per column of a dataset selection: in how many datasets, and in all of them?

    ``datasets`` has the catalog columns name, column_names, row_count.
    """
    chosen = datasets.where(F.col("name").isin(list(names))) if names else datasets
    total = chosen.agg(F.count(F.lit(1)).alias("n"), F.sum("row_count").alias("rows")).first()
    per_column = (
        chosen.select("name", F.explode("column_names").alias("column"))
        .groupBy("column").agg(F.countDistinct("name").alias("datasets"))
    )
    return per_column.where(F.col("datasets") == total["n"]).select(
        "column", F.lit(total["rows"]).cast("bigint").alias("total_rows")).orderBy("column")
