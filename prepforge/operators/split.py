"""Reproducible train / validation split by the values of a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prepforge.functions.columns import quoted, split_bucket, split_threshold


def in_validation(key: list[str], test_size: float = 0.2, seed: int = 42) -> Column:
    """True for the validation part. Depends on values only, never on partitions."""
    return split_bucket([quoted(k) for k in key], seed) < F.lit(split_threshold(test_size))


def with_split(df: DataFrame, key: list[str] | None = None, test_size: float = 0.2,
               seed: int = 42, name: str = "split") -> DataFrame:
    """Adds 'train' / 'val'. Without a key all columns count, so equal rows stay together."""
    flag = in_validation(key or df.columns, test_size, seed)
    return df.withColumn(name, F.when(flag, "val").otherwise("train"))


def train_test_split(df: DataFrame, key: list[str] | None = None, test_size: float = 0.2,
                     seed: int = 42) -> tuple[DataFrame, DataFrame]:
    flag = in_validation(key or df.columns, test_size, seed)
    return df.where(~flag), df.where(flag)
