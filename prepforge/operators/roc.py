"""ROC curve and area, exact and tie-aware, over any number of scores."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prepforge.functions.columns import as_number, clean, equals_literal
from prepforge.operators.ordering import ordered_totals


def score_counts(df: DataFrame, y_true: str, y_score: str, pos_label: Any = 1) -> DataFrame:
    """One row per distinct score: score, pos, neg."""
    pairs = df.select(as_number(df, y_score).alias("score"),
                      equals_literal(clean(df, y_true), df.schema[y_true].dataType, pos_label).alias("hit"))
    return (pairs.where("score IS NOT NULL AND hit IS NOT NULL")
            .groupBy("score").agg(F.count_if("hit").alias("pos"),
                                  F.count_if(~F.col("hit")).alias("neg")))


def roc_curve(df: DataFrame, y_true: str, y_score: str, pos_label: Any = 1) -> DataFrame:
    """One row per distinct score taken as threshold: score, tp, fp, tpr, fpr."""
    counted = score_counts(df, y_true, y_score, pos_label)
    running = ordered_totals(counted, [F.col("score").desc()], ["pos", "neg"])
    totals = running.agg(F.sum("pos").alias("p"), F.sum("neg").alias("n")).first()
    tp, fp = F.col("pos_before") + F.col("pos"), F.col("neg_before") + F.col("neg")
    n_pos, n_neg = totals["p"] or 0, totals["n"] or 0
    return running.select(
        "score", tp.alias("tp"), fp.alias("fp"),
        (tp / F.lit(n_pos) if n_pos else F.lit(0.0)).alias("tpr"),
        (fp / F.lit(n_neg) if n_neg else F.lit(0.0)).alias("fpr"))


def roc_auc_frame(df: DataFrame, y_true: str, y_score: str, pos_label: Any = 1) -> DataFrame:
    """One row: n_pos, n_neg, auc. With one class only the area is 0.5."""
    counted = score_counts(df, y_true, y_score, pos_label)
    running = ordered_totals(counted, [F.col("score").desc()], ["pos"])
    # pairs ranked right, a tie counts half; doubles because pairs outgrow a bigint
    won = F.sum(F.col("neg").cast("double") * (F.col("pos_before") + F.col("pos") / 2))
    pairs = F.sum("pos").cast("double") * F.sum("neg")
    return running.agg(
        F.coalesce(F.sum("pos"), F.lit(0)).alias("n_pos"),
        F.coalesce(F.sum("neg"), F.lit(0)).alias("n_neg"),
        F.when(pairs > 0, won / F.nullif(pairs, F.lit(0.0))).otherwise(F.lit(0.5)).alias("auc"))


def roc_auc(df: DataFrame, y_true: str, y_score: str, pos_label: Any = 1) -> float:
    return roc_auc_frame(df, y_true, y_score, pos_label).first()["auc"]
