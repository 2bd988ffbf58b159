"""Model registry: versions, lineage, training history, tamper check."""

from __future__ import annotations

import json
import uuid
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prepforge.errors import RegistryError
from prepforge.models.store import load_model, read_json, save_model, write_json
from prepforge.operators.lineage import children_of, duplicate_datasets, lineage, used_hashes
from prepforge.operators.ordering import newest_first
from prepforge.plans.catalog import remove_path
from prepforge.plans.preparation import PreprocessingPipeline
from prepforge.session import now
from prepforge.sources.digest import folder_digest
from prepforge.sources.statelog import StateLog

REGISTRY_SCHEMA = T.StructType([
    T.StructField("version", T.StringType()),
    T.StructField("parent", T.StringType()),
    T.StructField("path", T.StringType()),
    T.StructField("has_preprocessor", T.BooleanType()),
    T.StructField("metadata", T.StringType()),
    T.StructField("metrics", T.MapType(T.StringType(), T.DoubleType())),
    T.StructField("training_mode", T.StringType()),
    T.StructField("model_type", T.StringType()),
    T.StructField("file_hash", T.StringType()),
    T.StructField("created_at", T.TimestampType()),
])
HISTORY_SCHEMA = T.StructType([
    T.StructField("entry", T.StringType()),
    T.StructField("version", T.StringType()),
    T.StructField("dataset_name", T.StringType()),
    T.StructField("dataset_hash", T.StringType()),
    T.StructField("row_count", T.LongType()),
    T.StructField("trained_at", T.TimestampType()),
])
LISTED = ["version", "model_type", "training_mode", "metrics", "created_at"]


def bumped(version: str, increment: str) -> str:
    """One version raised; ``bump_version`` does the same for a column."""
    numbers = [int(n) for n in version.split(".")]
    place = ("major", "minor", "patch").index(increment)
    return ".".join(str(n) for n in [*numbers[:place], numbers[place] + 1, 0, 0][:3])


class ModelRegistry:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self.log = StateLog(spark, f"{self.root}/registry", REGISTRY_SCHEMA, "version")
        self.history_log = StateLog(spark, f"{self.root}/history", HISTORY_SCHEMA, "entry")

    # versions ----------------------------------------------------------------
    def models(self) -> DataFrame:
        return self.log.current()

    def next_version(self, base: str | None = None, increment: str = "patch") -> str:
        """Raised from ``base``, else from the newest model; the next free number."""
        current = self.models()
        if base is None:
            newest = current.agg(F.max_by("version", F.struct("created_at", "version"))).first()[0]
            if newest is None:
                return "1.0.0"
            base = newest
        wanted = [int(x) for x in bumped(base, increment).split(".")]
        at = ("major", "minor", "patch").index(increment)
        # how many numbers from the wanted one on are taken without a gap
        parts = F.split("version", r"\.")
        numbers = [F.get(parts, F.lit(i)).try_cast("bigint") for i in range(3)]
        alike = F.size(parts) == 3
        for i, number in enumerate(numbers):
            alike = alike & (number >= wanted[i] if i == at else number == wanted[i])
        taken = current.where(alike).select(numbers[at].alias("n")).distinct()
        place = F.row_number().over(Window.orderBy("n")) + F.lit(wanted[at] - 1)
        wanted[at] += taken.select((F.col("n") == place).alias("run")).agg(F.count_if("run")).first()[0]
        return ".".join(map(str, wanted))

    def save(self, model, model_type: str, metrics: dict[str, float],
             preprocessor: PreprocessingPipeline | None = None,
             metadata: dict[str, Any] | None = None, training_mode: str = "new",
             parent_version: str | None = None, version: str | None = None) -> dict[str, Any]:
        if parent_version and self.log.find(parent_version) is None:
            raise RegistryError(f"parent model version {parent_version} not found")
        if version is None:
            tuned = training_mode == "fine_tune" and parent_version
            version = self.next_version(parent_version, "minor") if tuned else self.next_version()
        elif self.log.find(version) is not None:
            raise RegistryError(f"model version {version} exists already")
        path = f"{self.root}/models/{version}/{uuid.uuid4().hex}"
        save_model(self.spark, model, f"{path}/model")
        if preprocessor is not None:
            self._save_preprocessor(preprocessor, path)
        record = {
            "version": version, "parent": parent_version, "path": path,
            "has_preprocessor": preprocessor is not None,
            "metadata": json.dumps(metadata or {}),
            "metrics": {k: None if v is None else float(v) for k, v in metrics.items()},
            "training_mode": training_mode, "model_type": model_type,
            "file_hash": folder_digest(self.spark, f"{path}/model"),
            "created_at": now(),
        }
        self.log.append([record])
        return record

    def _save_preprocessor(self, preprocessor: PreprocessingPipeline, path: str) -> None:
        """Large dictionaries move beside the model, out of the scratch folder."""
        data = preprocessor.to_dict()
        for s, step in enumerate(data["steps"]):
            for p, part in enumerate(step["fitted"]):
                found = part.get("categories") or {}
                for c in [found] if "type_json" in found else list(found.values()):
                    if c["table"]:
                        kept = f"{path}/dictionaries/{s}-{p}-{uuid.uuid4().hex}"
                        self.spark.read.parquet(c["table"]).write.parquet(kept)
                        c["table"] = kept
        write_json(self.spark, data, f"{path}/preprocessor")

    def get(self, version: str) -> dict[str, Any]:
        found = self.log.find(version)
        if found is None:
            raise RegistryError(f"model version {version} not found")
        return {**found, "metadata": json.loads(found["metadata"])}

    def load(self, version: str, verify_hash: bool = True):
        """``(model, preprocessor or None)``; changed model files are refused."""
        found = self.get(version)
        if verify_hash and found["file_hash"]:
            if folder_digest(self.spark, f"{found['path']}/model") != found["file_hash"]:
                raise RegistryError(f"model file hash mismatch for version {version}")
        preprocessor = None
        if found["has_preprocessor"]:
            preprocessor = PreprocessingPipeline.from_dict(
                read_json(self.spark, f"{found['path']}/preprocessor"))
        return load_model(self.spark, f"{found['path']}/model"), preprocessor

    def list_versions(self, model_type: str | None = None, training_mode: str | None = None,
                      limit: int = 100) -> DataFrame:
        return list_versions(self.models(), model_type, training_mode, limit).select(*LISTED)

    def delete(self, version: str, delete_files: bool = True) -> None:
        """Children lose their parent, the version's history rows go with it."""
        found = self.get(version)
        orphans = self.models().where(F.col("parent") == version)
        if not orphans.isEmpty():
            self.log.append_frame(orphans.withColumn("parent", F.lit(None).cast("string")))
        used = self.history_log.current().where(F.col("version") == version)
        if not used.isEmpty():
            self.history_log.append_frame(used, deleted=True)
        # the marker first: a crash in between leaves files without a row, not a row without files
        self.log.delete(F.col("version") == version)
        if delete_files:
            remove_path(self.spark, found["path"])

    # lineage -----------------------------------------------------------------
    def _start(self, version: str) -> DataFrame:
        return self.models().where(F.col("version") == version).select("version")

    def lineage(self, version: str) -> list[str]:
        """The version itself, then its ancestors up to the root."""
        chain = lineage(self.models(), self._start(version))
        return [r["version"] for r in chain.orderBy("depth").collect()]

    def children(self, version: str) -> DataFrame:
        return children_of(self.models(), version).select("version", "created_at")

    # training history ----------------------------------------------------------
    def record_history(self, version: str, hashes: dict[str, str], rows: dict[str, int]) -> None:
        moment = now()
        self.history_log.append([
            {"entry": uuid.uuid4().hex, "version": version, "dataset_name": name,
             "dataset_hash": mark, "row_count": rows.get(name, 0), "trained_at": moment}
            for name, mark in hashes.items()])

    def history(self, version: str | None = None) -> DataFrame:
        rows = self.history_log.current()
        rows = rows.where(F.col("version") == version) if version else rows
        return newest_first(rows, "trained_at", "dataset_name")

    def used_dataset_hashes(self, version: str) -> DataFrame:
        chain = lineage(self.models(), self._start(version))
        return used_hashes(chain, self.history_log.current())

    def duplicate_datasets(self, version: str | None, hashes: dict[str, str]) -> list[str]:
        """Names (in the given order) whose data the version's lineage has seen."""
        if not version or self.log.find(version) is None or not hashes:
            return []
        given = self.spark.createDataFrame(
            [(version, mark, name, i) for i, (name, mark) in enumerate(hashes.items())],
            "start string, dataset_hash string, name string, place int")
        seen = duplicate_datasets(given, self.used_dataset_hashes(version))
        return [r["name"] for r in seen.orderBy("place").collect()]


def list_versions(models: DataFrame, model_type: str | None = None,
                  training_mode: str | None = None, limit: int = 100) -> DataFrame:
    """Newest first; each given value must match."""
    if model_type:
        models = models.where(F.col("model_type") == model_type)
    if training_mode:
        models = models.where(F.col("training_mode") == training_mode)
    return newest_first(models, "created_at", "version", limit)
