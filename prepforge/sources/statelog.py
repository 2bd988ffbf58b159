"""Small state tables as append-only logs; the newest entry of a key is current.

One writer at a time is assumed. Deleting appends a marker instead of
rewriting files, so a reader or a failed task never sees a half-written table.
"""

from __future__ import annotations

import time
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prepforge.errors import DataError
from prepforge.operators.ordering import latest_per_key
from prepforge.session import small_frame

SEQ, GONE = "seq", "deleted"


class StateLog:
    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, key: str) -> None:
        self.spark, self.path, self.key = spark, path, key
        self.fields = schema
        self.schema = T.StructType(
            schema.fields + [T.StructField(SEQ, T.LongType()), T.StructField(GONE, T.BooleanType())])
        self._seq = 0

    def _next_seq(self) -> int:
        self._seq = max(self._seq + 1, time.time_ns())
        return self._seq

    def append(self, records: list[dict[str, Any]]) -> None:
        rows = [{f.name: r.get(f.name) for f in self.fields.fields} for r in records]
        self.append_frame(small_frame(self.spark, rows, self.fields))

    def append_frame(self, rows: DataFrame, deleted: bool = False) -> None:
        marked = rows.select(*[f.name for f in self.fields.fields],
                             F.lit(self._next_seq()).cast("bigint").alias(SEQ),
                             F.lit(deleted).alias(GONE))
        marked.write.mode("append").parquet(self.path)

    def history(self) -> DataFrame:
        try:
            return self.spark.read.schema(self.schema).parquet(self.path)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], self.schema)

    def current(self) -> DataFrame:
        newest = latest_per_key(self.history(), [self.key], [SEQ])
        return newest.where(~F.col(GONE)).select(*[f.name for f in self.fields.fields])

    def find(self, value: Any) -> dict[str, Any] | None:
        row = self.current().where(F.col(self.key) == F.lit(value)).first()
        return row.asDict(recursive=True) if row else None

    def delete(self, where) -> None:
        doomed = self.current().where(where)
        if doomed.isEmpty():
            raise DataError("nothing to delete")
        self.append_frame(doomed, deleted=True)
