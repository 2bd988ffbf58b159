"""From raw documents to training sequences, one stage after another.

Every stage takes (spark, docs, sf_dir) and works on all rows of ``docs``, what
its predecessor kept. All but the last return the columns of ``docs`` and keep
every clean document. Null texts are empty, rows with null ids are documents of
their own, an empty table passes through every stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prepforge.llm import mixing
from prepforge.llm.chunk_dedup import exact_duplicates
from prepforge.llm.near_dedup import near_duplicates
from prepforge.llm.packing import pack, token_pieces
from prepforge.llm.queries import LEVELS, WEIGHTS
from prepforge.llm.tables import fresh, keep_rows
from prepforge.llm.toxicity import fit_toxicity, score_toxicity
from prepforge.session import scratch_path

TOXIC = 0.7             # score from which a document is rejected
BUDGET = 0.9            # tokens of the mixture, as a share of those that reach it


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves out documents that score TOXIC or more."""
    model = fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    into = fresh("toxicity", docs.columns)
    scored = score_toxicity(docs, model, into=into)
    return scored.where(F.col(into)["score"] < TOXIC).select(*[f"`{c}`" for c in docs.columns])


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, keeps the document with the smallest id."""
    return keep_rows(docs, exact_duplicates(docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates, keeps the document with the smallest id."""
    return keep_rows(docs, near_duplicates(docs))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts the sources down to their weights; no row is used twice.

    Rows that repeat an id within a leaf (null ids too) are kept together or
    dropped together; the same id in another leaf is decided there.
    """
    return mixing.used_rows(docs, mixing.mixture(docs, LEVELS, WEIGHTS, share=BUDGET, epochs=1), LEVELS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where every piece of every document lies: the columns of ``pack``."""
    import public_tokenizers

    return pack(token_pieces(docs, str(public_tokenizers.path("byte_bpe_50k.json"))))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix),
    ("packing", pack_sequences),
]

# models, similarity and packing have no SQL form; tests/llm compares the stages with brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is a table in the shared folder that the next one reads."""
    out = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, out, sf_dir).write.parquet(path)
        out = spark.read.parquet(path)
    return out
