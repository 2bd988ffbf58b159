"""Content fingerprint of a table: order-free, one pass, no shuffle.

Every row is hashed twice; the fingerprint covers the schema, the row count
and the exact sums and xors of both hashes. Sums see repeated rows that an
xor alone would cancel. Each value is hashed with its null flag because the
row hash skips NULLs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prepforge.functions.columns import clean
from prepforge.operators.longform import hashable

_PIECE_BITS = 16     # sums of 16-bit pieces fit a bigint up to 10^14 rows
_PIECES = 64 // _PIECE_BITS


def row_hashes(df: DataFrame) -> list[Column]:
    parts: list[Column] = []
    for f in df.schema.fields:
        value = hashable(clean(df, f.name), f.dataType)
        parts += [value.isNull(), value]
    return [F.xxhash64(F.lit(seed), *parts) for seed in (0, 1)]


def fingerprint_aggregates(df: DataFrame) -> list[Column]:
    """Aggregates to be evaluated over ``df``, alone or beside other ones."""
    out = [F.count(F.lit(1)).alias("fp_rows")]
    for k, h in enumerate(row_hashes(df)):
        out.append(F.bit_xor(h).alias(f"fp_xor{k}"))
        for p in range(_PIECES):
            piece = F.shiftrightunsigned(h, p * _PIECE_BITS).bitwiseAND(2 ** _PIECE_BITS - 1)
            out.append(F.sum(piece).alias(f"fp_sum{k}_{p}"))
    return out


def fingerprint_from_aggregates(df: DataFrame) -> Column:
    """The 64 hex digits, from the columns made by ``fingerprint_aggregates``."""
    schema = ",".join(f"{f.name}:{f.dataType.simpleString()}" for f in df.schema.fields)
    parts = [F.lit(schema), F.col("fp_rows").cast("string")]
    for k in range(2):
        parts.append(F.coalesce(F.col(f"fp_xor{k}"), F.lit(0)).cast("string"))
        parts += [F.coalesce(F.col(f"fp_sum{k}_{p}"), F.lit(0)).cast("string")
                  for p in range(_PIECES)]
    return F.sha2(F.concat_ws("~", *parts), 256)


def fingerprint_frame(df: DataFrame) -> DataFrame:
    """One row: row_count, fingerprint."""
    return df.agg(*fingerprint_aggregates(df)).select(
        F.col("fp_rows").alias("row_count"),
        fingerprint_from_aggregates(df).alias("fingerprint"))


def fingerprint(df: DataFrame) -> str:
    return fingerprint_frame(df).first()["fingerprint"]
