"""Dataset catalog: registration, loading, SQL and removal."""

from __future__ import annotations

import re
import uuid
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.errors import PySparkException

from prepforge.errors import DataError
from prepforge.functions.columns import is_floating, quoted, without_nan
from prepforge.operators.concat import concat
from prepforge.operators.ordering import newest_first
from prepforge.operators.profile import STATS_FIELDS, column_statistics
from prepforge.session import now
from prepforge.sources.files import detect_format, read_file
from prepforge.sources.statelog import StateLog

CATALOG_SCHEMA = T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("view", T.StringType()),
    T.StructField("file_path", T.StringType()),
    T.StructField("file_type", T.StringType()),
    T.StructField("owned", T.BooleanType()),
    T.StructField("has_nan", T.BooleanType()),
    T.StructField("row_count", T.LongType()),
    T.StructField("column_names", T.ArrayType(T.StringType())),
    T.StructField("statistics", T.MapType(T.StringType(), T.StructType(STATS_FIELDS))),
    T.StructField("fingerprint", T.StringType()),
    T.StructField("created_at", T.TimestampType()),
    T.StructField("updated_at", T.TimestampType()),
])
LISTED = ["name", "file_type", "row_count", "column_names", "created_at"]


def safe_view_name(name: str) -> str:
    """Lower case, ``_`` for every other sign, ``_`` before a leading digit."""
    low = re.sub(r"[^a-z0-9_]", "_", name.lower())
    return f"_{low}" if low[:1].isdigit() else low


class DatasetCatalog:
    """Datasets live as Parquet below ``root``; the catalog is an append-only log."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self.log = StateLog(spark, f"{self.root}/catalog", CATALOG_SCHEMA, "name")

    # registration ------------------------------------------------------------
    def register(self, source: str | DataFrame, name: str, file_type: str | None = None,
                 materialize: bool = True, approximate: bool = False, multiline: bool = False) -> dict[str, Any]:
        """Profile and store a file or frame under ``name``; replaces an older one.

        A materialised copy goes to a new folder, so readers of the previous
        one are not disturbed. With ``materialize=False`` a Parquet source is
        used where it lies. ``multiline`` is for CSV with line breaks in quotes.
        """
        view = safe_view_name(name)
        near = self.log.current().where((F.col("view") == view) | (F.col("name") == name)).collect()
        before = next((r for r in near if r["name"] == name), None)
        clash = next((r for r in near if r["name"] != name), None)
        if clash:
            raise DataError(f"'{name}' and '{clash['name']}' would share the table {view}")
        if isinstance(source, str):
            kind, path = file_type or detect_format(source), source
        else:
            kind, path = file_type or "parquet", None
        owned = materialize or path is None or kind != "parquet"
        if owned:
            frame = without_nan(source) if path is None else read_file(self.spark, path, kind, multiline)
            path = f"{self.root}/data/{view}/{uuid.uuid4().hex}"
            frame.write.parquet(path)
        # the stored copy holds no NaN, so later filters reach its scan unwrapped
        has_nan = False if owned else _holds_nan(self.spark.read.parquet(path))
        frame = self._frame(path, has_nan)
        stats, rows, mark = column_statistics(frame, approximate=approximate, with_fingerprint=True)
        moment = now()
        record = {
            "name": name, "view": view, "file_path": path, "file_type": kind, "owned": owned,
            "has_nan": has_nan,
            "row_count": rows, "column_names": list(frame.columns), "statistics": stats,
            "fingerprint": mark, "created_at": before["created_at"].astimezone() if before else moment,
            "updated_at": moment,
        }
        self.log.append([record])
        frame.createOrReplaceTempView(view)
        return record

    # lookup ------------------------------------------------------------------
    def entry(self, name: str) -> dict[str, Any]:
        found = self.log.find(name)
        if found is None:
            raise DataError(f"dataset '{name}' not found")
        return found

    def entries(self, names: list[str]) -> dict[str, dict[str, Any]]:
        """Several catalog rows with one lookup, in the order of the names."""
        rows = self.log.current().where(F.col("name").isin(list(names))).collect()
        found = {r["name"]: r.asDict(recursive=True) for r in rows}
        for name in names:
            if name not in found:
                raise DataError(f"dataset '{name}' not found")
        return {n: found[n] for n in names}

    def _frame(self, path: str, has_nan: bool) -> DataFrame:
        frame = self.spark.read.parquet(path)
        return without_nan(frame) if has_nan else frame

    def load(self, name: str, columns: list[str] | None = None,
             limit: int | None = None) -> DataFrame:
        return self.open(self.entry(name), columns, limit)

    def open(self, entry: dict[str, Any], columns: list[str] | None = None,
             limit: int | None = None) -> DataFrame:
        """The data behind a catalog row."""
        frame, name = self._frame(entry["file_path"], entry["has_nan"]), entry["name"]
        if columns:
            missing = [c for c in columns if c not in frame.columns]
            if missing:
                raise DataError(f"dataset '{name}' has no column '{missing[0]}'")
            frame = frame.select(*[quoted(c) for c in columns])
        return frame.limit(limit) if limit else frame

    def preview(self, name: str, max_rows: int = 100) -> DataFrame:
        return self.load(name, limit=max_rows)

    def list_datasets(self) -> DataFrame:
        return newest_first(self.log.current(), "created_at", "name").select(*LISTED)

    def info(self, name: str) -> dict[str, Any]:
        found = self.entry(name)
        keys = ["name", "file_type", "row_count", "column_names", "statistics", "created_at"]
        return {**{k: found[k] for k in keys}, "hash": found["fingerprint"]}

    def fingerprint(self, name: str) -> str:
        """Computed once at registration; the stored data does not change."""
        return self.entry(name)["fingerprint"]

    def load_multiple(self, names: list[str], columns: list[str] | None = None):
        """``(union of the datasets, name -> fingerprint of the whole dataset)``."""
        if not names:
            raise DataError("no dataset names given")
        entries = self.entries(names)
        frames = [self.open(entries[n], columns) for n in names]
        return concat(frames, columns), {n: e["fingerprint"] for n, e in entries.items()}

    # SQL ---------------------------------------------------------------------
    def query(self, sql: str) -> DataFrame:
        """Any Spark SQL over the registered datasets, each a view by its safe name."""
        # views belong to the session, which other catalogs share: bind what this text names anew each time
        named = sql.lower()
        for row in self.log.current().select("view", "file_path", "has_nan").collect():
            if row["view"] in named:
                self._frame(row["file_path"], row["has_nan"]).createOrReplaceTempView(row["view"])
        try:
            return self.spark.sql(sql)
        except PySparkException as e:
            raise DataError(f"query failed: {e}") from e

    def rows(self, sql: str, max_rows: int = 100) -> list:
        """The first rows of a query, run at once; a failure while it runs is a ``DataError`` too."""
        try:
            return self.query(sql).limit(max_rows).collect()
        except PySparkException as e:
            raise DataError(f"query failed: {e}") from e

    # removal -----------------------------------------------------------------
    def delete(self, name: str, delete_files: bool = True) -> None:
        found = self.entry(name)
        self.spark.catalog.dropTempView(found["view"])
        # the marker first: a crash in between leaves files without a row, not a row without files
        self.log.delete(F.col("name") == name)
        if delete_files and found["owned"]:
            remove_path(self.spark, found["file_path"])


def _holds_nan(df: DataFrame) -> bool:
    floats = [f.name for f in df.schema.fields if is_floating(f.dataType)]
    if not floats:
        return False
    return df.agg(F.coalesce(F.max(F.greatest(
        *[F.coalesce(F.isnan(quoted(c)), F.lit(False)) for c in floats], F.lit(False))), F.lit(False))).first()[0]


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a file or folder on whatever file system it lies."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
