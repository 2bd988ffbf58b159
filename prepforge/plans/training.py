"""Training runs from a configuration."""

from __future__ import annotations

import json
import uuid
from typing import Any

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prepforge.errors import DuplicateDataError, TrainingError
from prepforge.functions.columns import clean, quoted
from prepforge.models.forest import ForestModel, fit_forest, fit_forest_classifier
from prepforge.models.linear import fit_least_squares
from prepforge.models.mlp import fit_mlp
from prepforge.models.sgd import fit_sgd
from prepforge.operators.concat import concat
from prepforge.operators.metrics import split_metrics
from prepforge.operators.ordering import newest_first, top_features
from prepforge.operators.split import with_split
from prepforge.plans.catalog import DatasetCatalog
from prepforge.plans.preparation import apply_preprocessing_pipeline
from prepforge.plans.registry import ModelRegistry
from prepforge.session import now
from prepforge.sources.statelog import StateLog

# The model types and the hyperparameters each understands.
MODEL_TYPES = {
    "linear_regression": ["fit_intercept"],
    "random_forest": ["n_estimators", "max_depth", "min_samples_split", "random_state"],
    "sgd_regressor": ["max_iter", "tol", "random_state"],
    "random_forest_classifier": ["n_estimators", "max_depth", "min_samples_split", "random_state"],
    "torch_mlp": ["hidden_dims", "output_dim", "dropout", "batch_size", "learning_rate", "epochs",
                  "random_state"],
}
RUN_SCHEMA = T.StructType([
    T.StructField("job_id", T.StringType()),
    T.StructField("dataset_names", T.ArrayType(T.StringType())),
    T.StructField("model_type", T.StringType()),
    T.StructField("training_mode", T.StringType()),
    T.StructField("hyperparameters", T.StringType()),
    T.StructField("feature_columns", T.ArrayType(T.StringType())),
    T.StructField("target_column", T.StringType()),
    T.StructField("base_model_version", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("error_message", T.StringType()),
    T.StructField("result_version", T.StringType()),
    T.StructField("created_at", T.TimestampType()),
    T.StructField("completed_at", T.TimestampType()),
])
_TARGET, _SPLIT = "__target", "__split"


def known_options(model_type: str, given: dict[str, Any]) -> dict[str, Any]:
    """Hyperparameters of the model type; unknown keys and blanks fall away."""
    if model_type not in MODEL_TYPES:
        raise TrainingError(f"unknown model type: {model_type}")
    return {k: v for k, v in given.items()
            if k in MODEL_TYPES[model_type] and v is not None and v != ""}


def fit_model(model_type: str, train: DataFrame, features: list[str], target: str,
              options: dict[str, Any], base=None):
    """A new model, or ``base`` trained further where the type allows it.

    Gradient descent takes one more epoch from the stored weights, the network
    goes on from its weights; the other types are fitted again on the new data.
    """
    options = known_options(model_type, options)
    if model_type == "linear_regression":
        return fit_least_squares(train, features, target, **options)
    if model_type == "random_forest":
        return fit_forest(train, features, target, **options)
    if model_type == "random_forest_classifier":
        return fit_forest_classifier(train, features, target, **options)
    if model_type == "sgd_regressor":
        if base is not None:
            return fit_sgd(train, features, target, start=base, max_iter=1)[0]
        return fit_sgd(train, features, target, **options)[0]
    return fit_mlp(train, features, target, start=base, **options)[0]


class Trainer:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark = spark
        self.catalog = DatasetCatalog(spark, root)
        self.registry = ModelRegistry(spark, root)
        self.runs = StateLog(spark, f"{root.rstrip('/')}/runs", RUN_SCHEMA, "job_id")

    def recent_runs(self, limit: int = 20) -> DataFrame:
        return newest_first(self.runs.current(), "created_at", "job_id", limit)

    def job_history(self, job_id: str) -> DataFrame:
        """What the model that came out of a run was trained on."""
        run = self.runs.find(job_id)
        if run is None:
            raise TrainingError(f"run {job_id} not found")
        return self.registry.history().where(F.col("version") == F.lit(run["result_version"]))

    def train(self, config: dict[str, Any]) -> tuple[str, dict[str, float]]:
        """Run a configuration; ``(model version, metrics)``.

        Every run leaves exactly one row in the run log, completed or failed.
        """
        names = list(config.get("dataset_names") or [])
        if not names and config.get("dataset_name"):
            names = [config["dataset_name"]]
        if not names:
            raise TrainingError("no datasets specified for training")
        run = {
            "job_id": uuid.uuid4().hex[:8], "dataset_names": names,
            "model_type": config["model_type"],
            "training_mode": config.get("training_mode", "new"),
            "hyperparameters": json.dumps(config.get("hyperparameters") or {}),
            "feature_columns": list(config.get("feature_columns") or []),
            "target_column": config["target_column"],
            "base_model_version": config.get("base_model_version"),
            "created_at": now(),
        }
        outcome: dict[str, Any] = {"status": "failed"}
        try:
            version, metrics = self._train(names, config)
            outcome = {"status": "completed", "result_version": version}
            return version, metrics
        except TrainingError as e:
            outcome["error_message"] = str(e)
            raise
        except Exception as e:
            outcome["error_message"] = str(e)
            raise TrainingError(str(e)) from e
        finally:
            self.runs.append([{**run, **outcome, "completed_at": now()}])

    def _train(self, names: list[str], config: dict[str, Any]) -> tuple[str, dict[str, float]]:
        model_type, target = config["model_type"], config["target_column"]
        options = dict(config.get("hyperparameters") or {})
        known_options(model_type, options)
        mode, base_version = config.get("training_mode", "new"), config.get("base_model_version")
        if mode == "fine_tune" and not base_version:
            raise TrainingError("fine-tuning needs a base model version")

        entries = self.catalog.entries(names)
        hashes = {n: e["fingerprint"] for n, e in entries.items()}
        rows = {n: e["row_count"] for n, e in entries.items()}
        base = None
        if mode == "fine_tune":
            self._guard(base_version, hashes, bool(config.get("allow_duplicates", False)))
            record = self.registry.get(base_version)
            if record["model_type"] != model_type:
                raise TrainingError(f"base model is a {record['model_type']}, not a {model_type}")
            base, _ = self.registry.load(base_version)

        frames = [self.catalog.open(entries[n]) for n in names]
        data = frames[0] if len(frames) == 1 else concat(frames)
        features = list(config.get("feature_columns") or []) or [
            c for c in data.columns if c != target]
        preparation = config.get("preprocess_config", {"scale": True})
        prepared, inputs, preprocessor = self._prepare(data, features, target, preparation, config)
        prepared.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            missing = prepared.agg(F.count_if(quoted(_TARGET).isNull())).first()[0]
            if missing:
                raise TrainingError(f"target column '{target}' has {missing} missing values")
            train = prepared.where(F.col(_SPLIT) == "train")
            model = fit_model(model_type, train, inputs, _TARGET, options, base)
            scored = model.predict(prepared.select(_SPLIT, _TARGET, *[quoted(c) for c in inputs]),
                                   "__prediction")
            table = split_metrics(scored, _TARGET, "__prediction",
                                  "classifier" in model_type, split=_SPLIT)
            metrics = {r["metric"]: r["value"] for r in table.collect()}
        finally:
            prepared.unpersist()

        record = self.registry.save(
            model, model_type, metrics, preprocessor, {
                "dataset_names": names, "dataset_hashes": hashes,
                "total_rows": sum(rows[n] for n in names), "feature_columns": features,
                "feature_types": {f: data.schema[f].dataType.simpleString() for f in features},
                "model_inputs": inputs, "target_column": target,
                "preprocess_config": preparation, "hyperparameters": options,
            }, mode, base_version if mode == "fine_tune" else None)
        self.registry.record_history(record["version"], hashes, rows)
        return record["version"], metrics

    def _prepare(self, data, features, target, preparation, config):
        """Prepared features with the target and the split beside them.

        Target and split key travel through the preparation under names of
        their own, so dropped rows disappear from all of them together.
        """
        key = list(config.get("split_key") or [])
        marked = with_split(data, key or features + [target], config.get("test_size", 0.2),
                            int(config.get("split_seed", 42)), _SPLIT)
        marked = marked.select(*[quoted(f) for f in features],
                               F.struct(clean(data, target).alias("t"), F.col(_SPLIT).alias("s"))
                               .alias("__kept"))
        basis = None
        if config.get("fit_on") == "train":
            basis = marked.where(F.col("__kept.s") == "train")
        prepared, preprocessor = apply_preprocessing_pipeline(
            marked, dict(preparation), fit_on=basis, carried=["__kept"])
        inputs = [c for c in prepared.columns if c != "__kept"]
        out = prepared.select(*[quoted(c) for c in inputs], F.col("__kept.t").alias(_TARGET),
                              F.col("__kept.s").alias(_SPLIT))
        return out, inputs, preprocessor

    def _guard(self, base_version: str, hashes: dict[str, str], allowed: bool) -> list[str]:
        again = self.registry.duplicate_datasets(base_version, hashes)
        if again and not allowed:
            raise DuplicateDataError(
                "already used to train this model's lineage: " + ", ".join(again)
                + ". Training on them again may cause overfitting; "
                  "set allow_duplicates to go on.")
        return again


def train_model(spark: SparkSession, root: str, config: dict[str, Any]):
    return Trainer(spark, root).train(config)


def forest_importances(spark: SparkSession, model: ForestModel, n: int = 20) -> DataFrame:
    return top_features(model.importances(spark), n)
