"""Shared helpers of the operators: intermediate tables, bounded loops over them, column checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prepforge.session import scratch_path

SPACES = " \t\n\x0b\x0c\r"          # what separates words everywhere in this package


class Scratch:
    """Intermediate tables below ``spark.checkpoint.dir``, dropped when nothing reads them any more.

    ``write`` cuts the lineage: the table survives lost executors and is not
    recomputed. ``drop`` removes tables that no returned frame reads. Options
    are those of the Parquet writer.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.label, self.paths = spark, label, {}

    def write(self, df: DataFrame, partition_by: str | None = None, **options: str | int) -> DataFrame:
        path = scratch_path(self.spark, self.label)
        writer = df.write.options(**options)
        (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = (out, path)
        return out

    def drop(self, *frames: DataFrame) -> None:
        for frame in frames:
            _, path = self.paths.pop(id(frame), (None, None))
            if path:
                place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
                place.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(place, True)


def only(df: DataFrame, **columns: Column | str) -> DataFrame:
    """The named columns alone, so that whatever else a table carries cannot clash."""
    return df.select(*[(F.col(f"`{c}`") if isinstance(c, str) else c).alias(name)
                       for name, c in columns.items()])


def fresh(name: str, taken: list[str]) -> str:
    """A column name that no column of ``taken`` has."""
    lowered = {t.lower() for t in taken}
    while name.lower() in lowered:
        name = f"_{name}"
    return name


def fold(key: str | Column, folds: int) -> Column:
    """crc32 of the key's text, modulo ``folds``; a null key counts as empty text."""
    key = F.col(key) if isinstance(key, str) else key
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % folds


def keep_rows(docs: DataFrame, decisions: DataFrame, id_col: str = "doc_id",
              text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose id has a decision ``kept``, in the columns of ``docs``.

    Rows that repeat a kept id stay once per text, so that no decision leaves
    the same document twice. A null id matches a null id, and its text too where
    decisions carry ``text_sha256``; such rows stay once per text, whose runs of
    white space count as one space.
    """
    key, n, digest = (fresh(name, docs.columns) for name in ("kept_id", "kept_n", "kept_sha256"))
    columns = [f"`{c}`" for c in docs.columns]
    kept = decisions.where("kept").groupBy(F.col("doc_id").alias(key)).agg(F.count("*").alias(n))
    found = docs.join(kept, docs[f"`{id_col}`"].eqNullSafe(kept[key]))
    nameless, more = F.col(key).isNull(), F.col(n) > 1
    if kept.where(nameless | more).isEmpty():
        return found.select(*columns)
    once = found.where(~nameless & more).dropDuplicates([id_col, text_col])
    plain = F.regexp_replace(F.coalesce(F.col(f"`{text_col}`"), F.lit("")), r"[\x20\x09-\x0D]+", " ")
    alone = found.where(nameless).withColumn(digest, F.sha2(plain.cast("binary"), 256))
    if "text_sha256" in decisions.columns:
        known = decisions.where("kept AND doc_id IS NULL").select(F.col("text_sha256").alias(digest)).distinct()
        alone = alone.join(known, digest, "left_semi")
    rows = [found.where(~nameless & ~more), once, alone.dropDuplicates([digest])]
    return rows[0].select(*columns).unionByName(rows[1].select(*columns)).unionByName(rows[2].select(*columns))
