"""Registration of queries and the pieces several of them share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

KEY = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
KEYS = ", ".join(KEY)
# the tables hold no NULL, so both sides inject them by the same rule
GAPPY_PRICE = "CASE WHEN l_linenumber = 3 THEN NULL ELSE l_extendedprice END"


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def views(spark: SparkSession, sf_dir: str, *names: str) -> None:
    for name in names:
        table(spark, sf_dir, name).createOrReplaceTempView(name)


def rounded(col: str | Column, digits: int, name: str | None = None) -> Column:
    out = F.round(F.col(col) if isinstance(col, str) else col, digits)
    return out.alias(name or col)


def gappy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem keys with a price that is missing on every third line."""
    return table(spark, sf_dir, "lineitem").select(
        *KEY, F.expr(GAPPY_PRICE).alias("price"))
