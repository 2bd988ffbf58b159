"""One row per (column, value): lets one job aggregate many columns at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prepforge.functions.columns import clean, quoted

ITEM = "item"
MAX_STACKED = 64       # columns handled by one job; wider tables take several


def stacked(df: DataFrame, rows: list[list[Column]], names: list[str]) -> DataFrame:
    """``stack`` with a running number in front of each row of columns."""
    cells: list[Column] = []
    for i, row in enumerate(rows):
        cells.append(F.lit(i))
        cells.extend(row)
    return df.select(F.stack(F.lit(len(rows)), *cells).alias(ITEM, *names))


def typed_values(df: DataFrame, columns: list[str]) -> tuple[DataFrame, dict[str, str]]:
    """Long form that keeps each value in its own type.

    There is one value column per distinct type among ``columns``; in each row
    only the one of its column's type is filled. Returns the long frame and
    the name of the value column of every input column.
    """
    slots: dict[str, T.DataType] = {}
    slot_of: dict[str, str] = {}
    for name in columns:
        dtype = df.schema[name].dataType
        slot = "v_" + "".join(ch if ch.isalnum() else "_" for ch in dtype.simpleString())
        slots[slot] = dtype
        slot_of[name] = slot
    rows = [
        [clean(df, name) if slot_of[name] == slot else F.lit(None).cast(dtype)
         for slot, dtype in slots.items()]
        for name in columns
    ]
    return stacked(df, rows, list(slots)), slot_of


def value_digest(df: DataFrame, name: str) -> tuple[Column, Column]:
    """128 bits per value for exact distinct counts, NULL for a missing value.

    For fixed-width values each half is a bijection, so no two values meet;
    text and nested values rely on the 128 bits. Whole values are hashed.
    """
    dtype = df.schema[name].dataType
    value = hashable(clean(df, name), dtype)
    gone = value.isNull()
    first = F.when(~gone, F.xxhash64(value))
    second = F.when(~gone, F.xxhash64(F.lit(1), value))
    return first, second


def hashable(col: Column, dtype: T.DataType) -> Column:
    """Maps have no order, so they are hashed as sorted entries."""
    if isinstance(dtype, T.MapType):
        return F.array_sort(F.map_entries(col))
    return col


def named(df: DataFrame, columns: list[str] | None) -> list[str]:
    return list(columns) if columns else list(df.columns)


def pick(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*[quoted(c) for c in columns])
