"""Saving and loading fitted models as plain files."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from prepforge.errors import RegistryError
from prepforge.models.forest import ForestModel
from prepforge.models.linear import LinearModel
from prepforge.models.mlp import MlpModel


def write_json(spark: SparkSession, data: dict, path: str) -> None:
    text = json.dumps(data, default=str)
    spark.range(0, 1, 1, 1).select(F.lit(text).alias("value")).write.text(path)


def read_json(spark: SparkSession, path: str) -> dict:
    return json.loads("\n".join(r["value"] for r in spark.read.text(path, wholetext=True).collect()))


def save_model(spark: SparkSession, model, path: str) -> None:
    write_json(spark, model.to_dict(), f"{path}/state")
    if isinstance(model, ForestModel):
        model.units(spark).write.parquet(f"{path}/native")


def load_model(spark: SparkSession, path: str):
    data = read_json(spark, f"{path}/state")
    if data["kind"] in ("linear_regression", "sgd_regressor"):
        return LinearModel.from_dict(data)
    if data["kind"] == MlpModel.kind:
        return MlpModel.from_dict(data)
    if data["kind"].startswith("random_forest"):
        return ForestModel.from_dict(data, f"{path}/native")
    raise RegistryError(f"unknown model type: {data['kind']}")
