"""Naming, null handling and type rules shared by all operators."""

from __future__ import annotations

import decimal
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

FLOATING = (T.FloatType, T.DoubleType)
INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def quoted(name: str) -> Column:
    """A column by its literal name; dots and spaces in the name are not paths."""
    return F.col("`" + name.replace("`", "``") + "`")


def is_floating(dtype: T.DataType) -> bool:
    return isinstance(dtype, FLOATING)


def is_stat_numeric(dtype: T.DataType) -> bool:
    """Types that get a numeric profile and mean / median imputation."""
    return isinstance(dtype, (T.IntegerType, T.LongType, T.FloatType, T.DoubleType))


def is_scalable(dtype: T.DataType) -> bool:
    """Types that default scaling picks up: every numeric type."""
    return isinstance(dtype, T.NumericType)


def present(col: Column, dtype: T.DataType) -> Column:
    """``col`` with NaN turned into NULL, so that missing has one meaning."""
    if is_floating(dtype):
        return F.when(~F.isnan(col), col)
    return col


def field_types(df: DataFrame) -> dict[str, T.DataType]:
    return {f.name: f.dataType for f in df.schema.fields}


def clean(df: DataFrame, name: str) -> Column:
    """The named column of ``df`` with NaN as NULL."""
    return present(quoted(name), df.schema[name].dataType)


def as_number(df: DataFrame, name: str) -> Column:
    """The named column as a double with NaN as NULL."""
    dtype = df.schema[name].dataType
    return present(quoted(name), dtype).cast("double")


def equals_literal(col: Column, dtype: T.DataType, value: Any) -> Column:
    """``col = value`` where a value of another kind equals nothing; NULL stays NULL."""
    numeric = isinstance(dtype, T.NumericType)
    kinds = (str,) if isinstance(dtype, T.StringType) else (bool,) if isinstance(dtype, T.BooleanType) else ()
    given = isinstance(value, (int, float, decimal.Decimal)) and not isinstance(value, bool)
    if numeric and given or isinstance(value, kinds) or not (numeric or kinds):
        return col == F.lit(value)
    return F.when(col.isNotNull(), F.lit(False))


def without_nan(df: DataFrame) -> DataFrame:
    """All float columns with NaN as NULL; untouched when there is none."""
    if not any(is_floating(f.dataType) for f in df.schema.fields):
        return df
    return df.select(*[
        clean(df, f.name).alias(f.name) if is_floating(f.dataType) else quoted(f.name)
        for f in df.schema.fields
    ])


def bump_version(version: Column, increment: str) -> Column:
    """``major.minor.patch`` raised in the given part; lower parts restart at 0."""
    part = F.split(version, r"\.")
    major, minor, patch = (part.getItem(i).cast("bigint") for i in range(3))
    zero = F.lit(0).cast("bigint")
    pieces = {
        "major": (major + 1, zero, zero),
        "minor": (major, minor + 1, zero),
        "patch": (major, minor, patch + 1),
    }
    if increment not in pieces:
        raise ValueError(f"unknown version part: {increment}")
    return F.concat_ws(".", *[p.cast("string") for p in pieces[increment]])


def view_name(name: Column) -> Column:
    """Dataset name as a SQL identifier: lower case, ``_`` for anything else."""
    low = F.regexp_replace(F.lower(name), r"[^a-z0-9_]", "_")
    return F.when(low.rlike(r"^[0-9]"), F.concat(F.lit("_"), low)).otherwise(low)


def split_bucket(key: list[Column], seed: int) -> Column:
    """Eight hex digits that depend on the key values and the seed only."""
    joined = F.concat_ws("-", *[k.cast("string") for k in key], F.lit(str(seed)))
    return F.substring(F.md5(joined), 1, 8)


def split_threshold(share: float) -> str:
    """Hex bound below which a row falls into a part of the given share."""
    if not 0.0 < share < 1.0:
        raise ValueError("the share must lie between 0 and 1")
    return format(int(share * 2 ** 32), "08x")
