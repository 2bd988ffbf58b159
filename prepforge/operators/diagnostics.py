"""The numbers behind evaluation charts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prepforge.errors import DataError
from prepforge.functions.columns import as_number, clean
from prepforge.operators.metrics import confusion_cells
from prepforge.session import settle, small_frame

MAX_GRID_CLASSES = 1_000


def class_set(df: DataFrame, y_true: str, y_pred: str) -> DataFrame:
    """Distinct classes of truth and prediction together, sorted."""
    cells = confusion_cells(df, y_true, y_pred)
    both = cells.select(F.explode(F.array("y", "p")).alias("label"))
    return both.distinct().orderBy("label")


def confusion_shares(df: DataFrame, y_true: str, y_pred: str) -> DataFrame:
    """Occurring class pairs with counts and shares of the truth row: y, p, n, share. For any number of classes."""
    cells = settle(confusion_cells(df, y_true, y_pred), "cells")
    totals = cells.groupBy("y").agg(F.sum("n").alias("total"))
    return cells.join(totals, "y").select("y", "p", "n", (F.col("n") / F.col("total")).alias("share"))


def confusion_matrix(df: DataFrame, y_true: str, y_pred: str, normalize: bool = False) -> DataFrame:
    """A display of all class pairs with zeros: y, p, and n or the share of the truth row.

    The table is read once into its occurring cells; the full grid has one
    cell per pair of classes, so the number of classes is checked first.
    """
    spark = df.sparkSession
    cells = settle(confusion_cells(df, y_true, y_pred), "cells")
    dtype = cells.schema["y"].dataType
    seen = cells.select(F.explode(F.array("y", "p")).alias("label")).distinct()
    labels = [r["label"] for r in seen.limit(MAX_GRID_CLASSES + 1).collect()]
    if len(labels) > MAX_GRID_CLASSES:
        raise DataError("too many classes for a zero-filled display; use confusion_shares()")
    every = F.array(*[F.lit(v).cast(dtype) for v in sorted(labels)])
    grid = spark.range(1).select(F.explode(every).alias("y")).withColumn("p", F.explode(every))
    full = grid.join(cells, ["y", "p"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    if not normalize:
        return full
    row_total = F.sum("n").over(Window.partitionBy("y"))
    return full.select(
        "y", "p", F.when(row_total > 0, F.col("n") / row_total).otherwise(0.0).alias("share"))


def residuals(df: DataFrame, y_true: str, y_pred: str, keep: list[str] = ()) -> DataFrame:
    """Points of the residual and the predicted-against-actual charts."""
    y, p = as_number(df, y_true), as_number(df, y_pred)
    return df.select(*keep, y.alias("actual"), p.alias("predicted"), (y - p).alias("residual"))


def value_range(df: DataFrame, y_true: str, y_pred: str) -> DataFrame:
    """Ends of the identity line: smallest and largest of truth and prediction."""
    y, p = as_number(df, y_true), as_number(df, y_pred)
    return df.agg(F.least(F.min(y), F.min(p)).alias("low"),
                  F.greatest(F.max(y), F.max(p)).alias("high"))


def histogram(df: DataFrame, column: str, bins: int = 30) -> DataFrame:
    """Equal-width bins over min..max: bin, low, high, n. The last bin is closed."""
    x = as_number(df, column)
    ends = df.agg(F.min(x).alias("a"), F.max(x).alias("b")).first()
    low, high = ends["a"], ends["b"]
    if low is None:
        raise DataError(f"column '{column}' has no value")
    if low == high:
        low, high = low - 0.5, high + 0.5
    width = (high - low) / bins
    place = F.least(F.floor((x - F.lit(low)) / F.lit(width)), F.lit(bins - 1)).cast("bigint")
    counted = (df.select(place.alias("bin")).where("bin IS NOT NULL")
               .groupBy("bin").agg(F.count(F.lit(1)).alias("n")))
    every = df.sparkSession.range(bins).withColumnRenamed("id", "bin")
    return every.join(F.broadcast(counted), "bin", "left").select(
        "bin", (F.lit(low) + F.col("bin") * width).alias("low"),
        (F.lit(low) + (F.col("bin") + 1) * width).alias("high"),
        F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def residual_histogram(df: DataFrame, y_true: str, y_pred: str, bins: int = 30) -> DataFrame:
    return histogram(residuals(df, y_true, y_pred), "residual", bins)


def learning_curve(spark, train_scores: list[float], val_scores: list[float]) -> DataFrame:
    """Series epoch, split, score as written by iterative training."""
    rows = [{"epoch": i + 1, "split": split, "score": float(s)}
            for split, scores in (("train", train_scores), ("val", val_scores))
            for i, s in enumerate(scores)]
    return small_frame(spark, rows, "epoch int, split string, score double")
