"""CSV and Parquet input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from prepforge.errors import DataError
from prepforge.functions.columns import without_nan
from prepforge.sources.typing import retype_strings


def detect_format(path: str) -> str:
    """'parquet' for a .parquet name in any case, 'csv' for everything else."""
    return "parquet" if path.rstrip("/").lower().endswith(".parquet") else "csv"


def read_csv(spark: SparkSession, path: str, infer_types: bool = True,
             multiline: bool = False) -> DataFrame:
    """Header row, quotes doubled inside quotes, types from the whole column.

    A row with more or fewer cells than the header fails the read, whichever
    columns are asked for. ``multiline`` allows line breaks inside quotes; such
    a file cannot be split between tasks, so it is off by default, and a break
    inside quotes then counts as a malformed row.
    """
    raw = (spark.read.option("header", True).option("escape", '"').option("mode", "FAILFAST")
           .option("columnPruning", False).option("multiLine", multiline).csv(path))
    return retype_strings(raw) if infer_types else raw


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return without_nan(spark.read.parquet(path))


def read_file(spark: SparkSession, path: str, file_type: str | None = None,
              multiline: bool = False) -> DataFrame:
    kind = file_type or detect_format(path)
    if kind == "parquet":
        return read_parquet(spark, path)
    if kind == "csv":
        return read_csv(spark, path, multiline=multiline)
    raise DataError(f"unknown file type: {kind}")
