"""SHA-256 over the files of a folder, to notice tampering."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from prepforge.errors import DataError

LEAF = 32 << 20         # bytes of a file that are hashed at once
_MARK = b"\xef\xbb\xbf"    # the source of lines leaves this out where a file begins with it


def file_digests(spark: SparkSession, path: str, leaf: int = LEAF) -> DataFrame:
    """One row per data file below ``path``: name (relative), length, sha256.

    A file of up to ``leaf`` bytes is hashed whole. A longer one is hashed in
    ranges of ``leaf`` bytes, side by side, and then over the ranges' hashes in
    hexadecimal; its size has no limit. The result does not depend on how the
    ranges were read. Empty files are left out.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    root = path.rstrip("/").rsplit("/", 1)[-1]
    names = files.select("path", F.substring_index("path", f"/{root}/", -1).alias("name"), "length").where(
        ~F.col("name").rlike(r"(^|/)[_.][^/]*$"))
    small = files.where(F.col("length") <= leaf).select("path", F.sha2("content", 256).alias("sha256"))
    large = {r["path"]: r["length"] for r in names.where(F.col("length") > leaf).collect()}
    digests = small if not large else small.unionByName(_ranged(spark, large, leaf))
    return names.join(digests, "path").select("name", "length", "sha256")


def _ranged(spark: SparkSession, lengths: dict[str, int], leaf: int) -> DataFrame:
    """``path, sha256`` of long files, read as lines of bytes by as many tasks as they have blocks."""
    def read() -> DataFrame:
        return spark.read.text(list(lengths), lineSep="\n").select(
            F.col("value").cast("binary").alias("line"), F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block"))

    blocks = read().groupBy("file", "block").agg(F.sum(F.octet_length("line") + 1).alias("size"))
    before = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    starts: dict[tuple[str, int], int] = {}
    total: dict[str, int] = {}
    for r in blocks.withColumn("start", F.coalesce(F.sum("size").over(before), F.lit(0))).collect():    # one per block
        starts[r["file"], r["block"]] = r["start"]
        total[r["file"]] = max(total.get(r["file"], 0), r["start"] + r["size"])
    plain = {f: next(p for p in lengths if _bare(p) == _bare(f)) for f in total}
    marked = {}
    for f, size in total.items():
        marked[f] = lengths[plain[f]] - size in (len(_MARK), len(_MARK) - 1)    # a last line may have no end
        if lengths[plain[f]] - size - marked[f] * len(_MARK) not in (0, -1):
            raise DataError(f"{plain[f]} could not be read byte by byte")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Hashes of the ranges that a block holds whole, and the bytes at its ends."""
        at, held, size, now = 0, [], 0, None

        def out(content: bytes, start: int) -> pa.RecordBatch:
            whole = len(content) == min(leaf, lengths[plain[now[0]]] - start // leaf * leaf)
            return pa.RecordBatch.from_pydict({
                "path": [plain[now[0]]], "leaf": [start // leaf], "start": [start],
                "hash": [hashlib.sha256(content).hexdigest() if whole else None],
                "content": [None if whole else content]}, _PIECES)

        def cut(last: bool):
            nonlocal at, held, size
            end = lengths[plain[now[0]]] if now else 0
            while size and (last or at % leaf + size >= leaf):
                joined = b"".join(held)
                if at + len(joined) > end:          # the line end that the last line of a file does not have
                    joined = joined[:end - at]
                take = min(leaf - at % leaf, len(joined))
                if take:
                    yield out(joined[:take], at)
                at, held, size = at + take, [joined[take:]], len(joined) - take

        for batch in batches:
            for line, file, block in zip(*[batch.column(k).to_pylist() for k in ("line", "file", "block")], strict=True):
                if (file, block) != now:
                    yield from cut(True)
                    now, held, size = (file, block), [], 0
                    at = starts[now] + marked[file] * len(_MARK)
                    if starts[now] == 0 and marked[file]:
                        at, held, size = 0, [_MARK], len(_MARK)
                held.append(line + b"\n")
                size += len(line) + 1
                yield from cut(False)
        yield from cut(True)

    found = read().mapInArrow(pieces, "path string, leaf bigint, start bigint, hash string, content binary")
    parts = F.array_sort(F.collect_list(F.struct("start", "content")))
    joined = F.aggregate(parts, F.lit(b""), lambda all_, p: F.concat(all_, F.coalesce(p["content"], F.lit(b""))))
    leaves = found.groupBy("path", "leaf").agg(F.coalesce(F.max("hash"), F.sha2(joined, 256)).alias("hash"))
    hashes = F.transform(F.array_sort(F.collect_list(F.struct("leaf", "hash"))), lambda x: x["hash"])
    return leaves.groupBy("path").agg(F.sha2(F.array_join(hashes, "").cast("binary"), 256).alias("sha256"))


_PIECES = pa.schema([("path", pa.string()), ("leaf", pa.int64()), ("start", pa.int64()), ("hash", pa.string()),
                     ("content", pa.binary())])


def _bare(path: str) -> str:
    """A path without what different readers write before it."""
    from urllib.parse import unquote

    return "/" + unquote(path).split(":", 1)[-1].lstrip("/")


def folder_digest(spark: SparkSession, path: str) -> str:
    """One digest over all file names and contents below ``path``."""
    lines = F.transform(
        F.array_sort(F.collect_list(F.struct("name", "sha256"))),
        lambda f: F.concat_ws(":", f["name"], f["sha256"]))
    return file_digests(spark, path).agg(
        F.sha2(F.array_join(lines, "\n"), 256).alias("digest")).first()["digest"]
