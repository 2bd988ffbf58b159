"""Regression and classification metrics as aggregates.

Rows whose truth or prediction is missing do not count. Every function with a
plain metric name returns a float; the ``*_metrics`` functions return frames
and can work per group.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prepforge.functions.columns import as_number, clean, equals_literal

AVERAGES = ("binary", "macro", "weighted", "micro")


# regression ----------------------------------------------------------------

def regression_aggregates(y: Column, p: Column) -> dict[str, Column]:
    """n, mae, mse, rmse, r2 in one pass; both columns must be non-null doubles."""
    squared = F.pow(y - p, 2)
    total = F.var_pop(y) * F.count(y)
    return {
        "n": F.count(y),
        "mae": F.avg(F.abs(y - p)),
        "mse": F.avg(squared),
        "rmse": F.sqrt(F.avg(squared)),
        "r2": F.when(total == 0, 0.0).otherwise(1 - F.sum(squared) / F.nullif(total, F.lit(0.0))),
    }


def regression_metrics(df: DataFrame, y_true: str, y_pred: str, by: list[str] = ()) -> DataFrame:
    pairs = df.select(*by, as_number(df, y_true).alias("__y"), as_number(df, y_pred).alias("__p"))
    pairs = pairs.where("__y IS NOT NULL AND __p IS NOT NULL")
    exprs = regression_aggregates(F.col("__y"), F.col("__p"))
    return pairs.groupBy(*by).agg(*[e.alias(name) for name, e in exprs.items()])


def _regression(df: DataFrame, y_true: str, y_pred: str, name: str) -> float:
    return regression_metrics(df, y_true, y_pred).first()[name]


def mae(df: DataFrame, y_true: str, y_pred: str) -> float:
    return _regression(df, y_true, y_pred, "mae")


def mse(df: DataFrame, y_true: str, y_pred: str) -> float:
    return _regression(df, y_true, y_pred, "mse")


def rmse(df: DataFrame, y_true: str, y_pred: str) -> float:
    return _regression(df, y_true, y_pred, "rmse")


def r2_score(df: DataFrame, y_true: str, y_pred: str) -> float:
    """1 - SSres / SStot; 0 when the truth is constant."""
    return _regression(df, y_true, y_pred, "r2")


# classification ------------------------------------------------------------

def confusion_cells(df: DataFrame, y_true: str, y_pred: str, by: list[str] = ()) -> DataFrame:
    """Occurring (truth, prediction) pairs with their row counts: y, p, n."""
    pairs = df.select(*by, clean(df, y_true).alias("y"), clean(df, y_pred).alias("p"))
    return (pairs.where("y IS NOT NULL AND p IS NOT NULL")
            .groupBy(*by, "y", "p").agg(F.count(F.lit(1)).alias("n")))


def class_counts(cells: DataFrame, by: list[str] = ()) -> DataFrame:
    """Per class of truth or prediction: tp, predicted, support."""
    hit = F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(F.lit(0))
    zero = F.lit(0).cast("bigint")
    sides = cells.select(*by, F.stack(
        F.lit(2),
        F.col("y"), hit, zero, F.col("n"),
        F.col("p"), zero, F.col("n"), zero,
    ).alias("label", "tp", "predicted", "support"))
    return sides.groupBy(*by, "label").agg(
        F.sum("tp").alias("tp"), F.sum("predicted").alias("predicted"),
        F.sum("support").alias("support"))


def _ratio(top: Column, bottom: Column) -> Column:
    return F.when(bottom > 0, top / bottom).otherwise(F.lit(0.0))


def classification_metrics(df: DataFrame, y_true: str, y_pred: str, average: str = "binary",
                           pos_label: Any = 1, by: list[str] = ()) -> DataFrame:
    """accuracy, precision, recall, f1; an unknown average counts as macro.

    F1 is the harmonic mean of the averaged precision and recall, not the mean
    of the per-class values. After the first aggregate only class pairs move.
    """
    per_class = class_counts(confusion_cells(df, y_true, y_pred, by), by)
    tp, predicted, support = F.col("tp"), F.col("predicted"), F.col("support")
    if average == "binary":
        is_pos = equals_literal(F.col("label"), per_class.schema["label"].dataType, pos_label)
        picked = [F.coalesce(F.sum(F.when(is_pos, c)), F.lit(0)) for c in (tp, predicted, support)]
        prec, rec = _ratio(picked[0], picked[1]), _ratio(picked[0], picked[2])
    elif average == "micro":
        prec = _ratio(F.sum(tp), F.sum(predicted))
        rec = _ratio(F.sum(tp), F.sum(support))
    elif average == "weighted":
        prec = F.sum(_ratio(tp, predicted) * support) / F.sum(support)
        rec = F.sum(_ratio(tp, support) * support) / F.sum(support)
    else:
        prec, rec = F.avg(_ratio(tp, predicted)), F.avg(_ratio(tp, support))
    out = per_class.groupBy(*by).agg(
        F.sum(support).alias("n"), (F.sum(tp) / F.sum(support)).alias("accuracy"),
        prec.alias("precision"), rec.alias("recall"))
    both = F.col("precision") + F.col("recall")
    return out.withColumn(
        "f1", F.when(both == 0, 0.0).otherwise(
            2 * F.col("precision") * F.col("recall") / F.nullif(both, F.lit(0.0))))


def accuracy(df: DataFrame, y_true: str, y_pred: str) -> float:
    y, p = clean(df, y_true), clean(df, y_pred)
    return df.agg(F.avg((y == p).cast("double"))).first()[0]


def _classification(df, y_true, y_pred, average, pos_label, name) -> float:
    return classification_metrics(df, y_true, y_pred, average, pos_label).first()[name]


def precision(df: DataFrame, y_true: str, y_pred: str, average: str = "binary",
              pos_label: Any = 1) -> float:
    return _classification(df, y_true, y_pred, average, pos_label, "precision")


def recall(df: DataFrame, y_true: str, y_pred: str, average: str = "binary",
           pos_label: Any = 1) -> float:
    return _classification(df, y_true, y_pred, average, pos_label, "recall")


def f1_score(df: DataFrame, y_true: str, y_pred: str, average: str = "binary",
             pos_label: Any = 1) -> float:
    return _classification(df, y_true, y_pred, average, pos_label, "f1")


# bundle per split ----------------------------------------------------------

def split_metrics(df: DataFrame, y_true: str, y_pred: str, classifier: bool,
                  split: str = "split") -> DataFrame:
    """Rows (metric, value) such as train_mae, val_r2 or val_f1."""
    if classifier:
        wide = classification_metrics(df, y_true, y_pred, "macro", by=[split])
        names = ["accuracy", "f1"]
    else:
        wide = regression_metrics(df, y_true, y_pred, by=[split])
        names = ["mae", "mse", "r2"]
    long = wide.select(split, F.stack(
        F.lit(len(names)), *[x for m in names for x in (F.lit(m), F.col(m))]
    ).alias("__name", "value"))
    return long.select(F.concat_ws("_", split, "__name").alias("metric"), "value")
