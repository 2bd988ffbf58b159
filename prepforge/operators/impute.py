"""Filling or dropping missing values (NULL and NaN alike)."""

from __future__ import annotations

from functools import reduce
from operator import or_
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prepforge.errors import DataError
from prepforge.functions.columns import (
    INTEGRAL, as_number, clean, is_floating, is_stat_numeric, quoted)
from prepforge.operators.longform import ITEM, MAX_STACKED, typed_values
from prepforge.operators.quantiles import exact_quantiles

STRATEGIES = ("mean", "median", "mode", "constant", "drop")


def modes(df: DataFrame, columns: list[str]) -> dict[str, Any]:
    """Most frequent value per column, the smallest among equals, nulls ignored.

    Values are counted per (column, value) with map-side reduction, so neither
    a hot value nor a wide value range gathers in one task.
    """
    if not columns:
        return {}
    if len(columns) > MAX_STACKED:
        return {**modes(df, columns[:MAX_STACKED]), **modes(df, columns[MAX_STACKED:])}
    long, slot_of = typed_values(df, columns)
    slots = sorted(set(slot_of.values()))
    filled = reduce(or_, [F.col(s).isNotNull() for s in slots])
    best = (
        long.where(filled)
        .groupBy(ITEM, *slots).agg(F.count(F.lit(1)).alias("n"))
        .groupBy(ITEM).agg(F.min(F.struct((-F.col("n")).alias("rank"), *slots)).alias("top"))
    )
    found = {r[ITEM]: r["top"] for r in best.collect()}
    return {c: found[i][slot_of[c]] for i, c in enumerate(columns) if i in found}


def fit_fills(df: DataFrame, strategy: str = "mean", fill_value: Any = None,
              columns: list[str] | None = None) -> dict[str, Any]:
    """The fill value of every column the strategy applies to."""
    if strategy not in STRATEGIES or strategy == "drop":
        raise DataError(f"no fill values for strategy: {strategy}")
    names = [c for c in (columns if columns is not None else df.columns) if c in df.columns]
    if strategy == "constant":
        if fill_value is None:
            raise DataError("strategy 'constant' needs a fill value")
        return dict.fromkeys(names, fill_value)
    if strategy == "mode":
        return modes(df, names)
    numeric = [c for c in names if is_stat_numeric(df.schema[c].dataType)]
    if strategy == "median":
        return {c: q[0] for c, q in exact_quantiles(df, numeric, [0.5]).items()}
    if not numeric:
        return {}
    row = df.agg(*[F.avg(as_number(df, c)).alias(f"m{i}") for i, c in enumerate(numeric)]).first()
    return {c: row[f"m{i}"] for i, c in enumerate(numeric)}


def apply_fills(df: DataFrame, fills: dict[str, Any]) -> DataFrame:
    """Replace missing values by the given ones; one projection."""
    out = []
    for f in df.schema.fields:
        if f.name not in fills:
            out.append(quoted(f.name))
            continue
        value, target = fills[f.name], f.dataType
        if isinstance(f.dataType, INTEGRAL) and isinstance(value, float):
            target = T.DoubleType()       # an integer column cannot hold the fill
        elif isinstance(f.dataType, T.StringType) and value is not None:
            value = str(value)
        try:
            fill = F.lit(value).cast(target)
        except Exception as e:
            raise DataError(f"cannot fill column '{f.name}' with {value!r}") from e
        out.append(F.coalesce(clean(df, f.name).cast(target), fill).alias(f.name))
    return df.select(*out)


def handle_missing_values(df: DataFrame, strategy: str = "mean", fill_value: Any = None,
                          columns: list[str] | None = None) -> DataFrame:
    """Impute or drop rows; unknown columns are skipped, unknown strategies raise."""
    if strategy not in STRATEGIES:
        raise DataError(f"unknown strategy for missing values: {strategy}")
    if strategy == "drop":
        names = [c for c in (columns if columns is not None else df.columns) if c in df.columns]
        keep = F.lit(True)
        for c in names:
            keep = keep & quoted(c).isNotNull()
            if is_floating(df.schema[c].dataType):
                keep = keep & ~F.isnan(quoted(c))
        return df.where(keep)
    return apply_fills(df, fit_fills(df, strategy, fill_value, columns))
