"""Scoring with a registered model, with log and optional explanation."""

from __future__ import annotations

import json
import uuid
from typing import Any

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prepforge.errors import InferenceError
from prepforge.functions.columns import quoted
from prepforge.operators.ordering import newest_first
from prepforge.plans.attribution import lime, shap_importance, standard_deviations
from prepforge.plans.registry import ModelRegistry
from prepforge.session import now
from prepforge.sources.files import read_file

_ROW = "__row"
WHOLE = ("tinyint", "smallint", "int", "bigint")


def records_frame(spark: SparkSession, records: list[dict], types: dict[str, str]) -> DataFrame:
    """Records as a frame with their row numbers; absent keys and None are NULL.

    A column has the type that training stored for it, except that fractions in
    a column of whole numbers make it double. Other columns are typed by all
    their values: whole numbers and fractions together are doubles, values of
    different kinds are text, no value at all is a double.
    """
    def kind(name: str, values: list) -> str:
        found = {bool if isinstance(v, bool) else type(v) for v in values}
        fractions = float in found and any(isinstance(v, float) and not v.is_integer() for v in values)
        if name in types and not (fractions and types[name] in WHOLE):
            return types[name]
        if found <= {int, float}:
            return "bigint" if found == {int} else "double"
        return "boolean" if found == {bool} else "string"

    names = list(dict.fromkeys(k for r in records for k in r))
    kinds = {n: kind(n, [r[n] for r in records if r.get(n) is not None]) for n in names}
    fit = {"double": float, "float": float, "string": str, **{w: int for w in WHOLE}}

    def cell(name: str, value: Any) -> Any:
        if value is None:
            return None
        try:
            return fit.get(kinds[name], lambda v: v)(value)
        except (TypeError, ValueError) as e:
            raise InferenceError(f"{name}: {value!r} is not a {kinds[name]}") from e

    schema = T.StructType([T.StructField(_ROW, T.LongType()), *[
        T.StructField(n, T._parse_datatype_string(kinds[n])) for n in names]])
    return spark.createDataFrame([(i, *[cell(n, r.get(n)) for n in names]) for i, r in enumerate(records)], schema)


class Predictor:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self.registry = ModelRegistry(spark, root)
        self._loaded: dict[str, tuple] = {}

    def _model(self, version: str):
        if version not in self._loaded:
            self._loaded[version] = self.registry.load(version)
        return self._loaded[version]

    def score(self, version: str, df: DataFrame, output: str = "prediction") -> DataFrame:
        """``df`` with a prediction column; nothing runs until the result is used.

        The preparation changes feature values, so it works on a copy of the
        feature columns while the given columns travel along untouched.
        """
        model, preprocessor = self._model(version)
        features = self._features(version, df)
        kept = df.select(F.struct(*[quoted(c) for c in df.columns]).alias("__given"),
                         *[quoted(f) for f in features])
        prepared = preprocessor.transform(kept) if preprocessor is not None else kept
        scored = model.predict(prepared, "__prediction")
        return scored.select("__given.*", F.col("__prediction").alias(output))

    def _features(self, version: str, df: DataFrame) -> list[str]:
        model, _ = self._model(version)
        features = self.registry.get(version)["metadata"].get("feature_columns") or model.features
        for name in features:
            if name not in df.columns:
                raise InferenceError(f"missing feature column: {name}")
        return features

    def prepared(self, version: str, df: DataFrame) -> DataFrame:
        """The model's own input columns for ``df``."""
        model, preprocessor = self._model(version)
        chosen = df.select(*[quoted(f) for f in self._features(version, df)])
        out = preprocessor.transform(chosen) if preprocessor is not None else chosen
        return out.select(*[quoted(c) for c in model.features])

    def predict(self, version: str, data: dict | list[dict] | DataFrame, analyze: bool = False,
                analysis_method: str = "shap", log: bool = True) -> dict[str, Any]:
        """Score one record, a list of records or a frame.

        ``frame`` holds the input with a ``prediction`` column. For records
        given as dicts ``predictions`` is the list of values in their order.
        """
        local = isinstance(data, (dict, list))
        if local:
            records = [data] if isinstance(data, dict) else data
            df = records_frame(self.spark, records, self.registry.get(version)["metadata"].get("feature_types") or {})
        else:
            df = data
        features = [c for c in df.columns if c != _ROW]
        scored = self.score(version, df)
        scored.persist(StorageLevel.MEMORY_AND_DISK)     # the log and the caller both read it
        result: dict[str, Any] = {"version": version, "frame": scored.drop(_ROW)}
        if local:
            result["predictions"] = [r["prediction"] for r in scored.orderBy(_ROW).collect()]
        if analyze:
            result["analysis"] = self.analyze(version, df, analysis_method)
        if log:
            result["call_id"] = self._log(version, scored, features, result.get("analysis", {}))
        return result

    def predict_file(self, version: str, path: str, analyze: bool = False,
                     analysis_method: str = "shap") -> dict[str, Any]:
        return self.predict(version, read_file(self.spark, path), analyze, analysis_method)

    def analyze(self, version: str, df: DataFrame, method: str = "shap") -> dict[str, Any]:
        """Importance per feature; a failure is reported, not raised."""
        try:
            model, _ = self._model(version)
            prepared = self.prepared(version, df)
            if method == "lime":
                first = prepared.select(F.lit(0).alias("__id"), *[quoted(c) for c in model.features])
                first = first.orderBy(*[quoted(c) for c in model.features]).limit(1)
                if _ROW in df.columns:
                    first = self.prepared(version, df.where(F.col(_ROW) == 0)).withColumn(
                        "__id", F.lit(0))
                spreads = standard_deviations(prepared, model.features)
                table = lime(first, model, "__id", spreads).select(
                    "feature", F.col("weight").alias("importance"))
            else:
                table = shap_importance(prepared, model)
            found = {r["feature"]: r["importance"] for r in table.collect()}
            given = self._features(version, df)
            names = (given if len(given) == len(model.features)
                     else [f"feature_{i}" for i in range(len(model.features))])
            return {"method": method, "feature_importance": {
                n: found[f] for n, f in zip(names, model.features)}}
        except Exception as e:
            return {"method": method, "error": str(e)}

    # log -----------------------------------------------------------------------
    def _log(self, version: str, scored: DataFrame, features: list[str], analysis: dict) -> str:
        """One row per scored row, marked with the call it belongs to."""
        call = uuid.uuid4().hex
        scored.select(
            F.lit(call).alias("call_id"),
            F.to_json(F.struct(*[quoted(c) for c in features])).alias("input"),
            F.col("prediction").cast("string").alias("prediction"),
            F.lit(json.dumps(analysis)).alias("analysis"),
            F.lit(now()).alias("logged_at"),
            F.lit(version).alias("model_version"),
        ).write.mode("append").partitionBy("model_version").parquet(f"{self.root}/inference_log")
        return call

    def log_rows(self) -> DataFrame:
        return (self.spark.read.option("basePath", f"{self.root}/inference_log")
                .schema("call_id string, input string, prediction string, analysis string, "
                        "logged_at timestamp, model_version string")
                .parquet(f"{self.root}/inference_log"))

    def recent_calls(self, limit: int = 20) -> DataFrame:
        """Latest calls with their row counts."""
        calls = self.log_rows().groupBy("call_id").agg(
            F.first("model_version").alias("model_version"),
            F.max("logged_at").alias("logged_at"), F.count(F.lit(1)).alias("rows"))
        return newest_first(calls, "logged_at", "call_id", limit)
