"""Language by compression: the language whose passages help most to compress a text."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from prepforge.llm.tables import fold, fresh, only
from prepforge.llm.textblocks import LOWER

LANGUAGES = 500         # languages to learn, those with most different texts
SAMPLE = 320            # texts to learn a language from, the first in the order of a hash of their content
PASSAGE = 400           # characters taken from each, from a place that the hash decides
TOTAL = 16 << 20        # characters of all passages: with very many languages each gets fewer
CHUNK = 2048            # bytes compressed at once; chunks cover the whole text
LEVEL = 6               # of zstandard; lower ones miss too many matches with the dictionary
MARGIN = 0.005          # a best language that saves a smaller share of the bytes than this is not accepted
UNKNOWN = "und"


@dataclass(frozen=True)
class LanguageModel:
    """``names`` of the learned languages, most frequent first, and the broadcast dictionary of each."""

    names: list[str]
    dictionaries: Broadcast


def fit_languages(docs: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text",
                  lang_col: str = "lang", held_out_fold: int | None = 1, folds: int = 3) -> LanguageModel:
    """Passages of every language, from rows outside the held-out fold that have a language and a letter.

    At most LANGUAGES languages, ``sample`` texts each, PASSAGE characters a
    text and TOTAL characters together are learned from, collected and
    broadcast. The texts are the first in the order of a hash of their content,
    so copies count once however many there are, and rows may come in any order.
    Null texts and languages teach nothing; without labelled rows the model has
    no language.
    """
    rows = only(docs, doc_id=id_col, text=text_col, lang=F.col(f"`{lang_col}`").cast("string"))
    rows = rows.where("lang IS NOT NULL").where(F.col("text").rlike(r"\p{L}"))
    if held_out_fold is not None:
        rows = rows.where(fold("doc_id", folds) != held_out_fold)
    rows = rows.withColumn("key", F.xxhash64(F.lit(12), "text"))
    counted = (rows.groupBy("lang").agg(F.approx_count_distinct("key").alias("n"))
               .orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect())
    names = [r["lang"] for r in counted]
    if not names:
        return LanguageModel([], docs.sparkSession.sparkContext.broadcast([]))
    wanted = max(1, min(sample, TOTAL // (PASSAGE * len(names))))
    # twice the share that holds the wanted texts; the rest of the choice is then made on few rows
    shares = F.create_map(*[F.lit(x) for r in counted for x in (r["lang"], min(1.0, 2 * wanted / max(r["n"], 1)))])
    place = F.pmod("key", F.greatest(F.length("text") - PASSAGE, F.lit(0)) + 1).cast("int") + 1
    near = (rows.where((F.shiftrightunsigned("key", 11) / float(1 << 53)) <= shares[F.col("lang")])
            .select("lang", "key", F.substring("text", place, F.lit(PASSAGE)).alias("passage"))
            .groupBy("lang", "key").agg(F.min("passage").alias("passage")))
    first = W.partitionBy("lang").orderBy("key", "passage")
    chosen = (near.withColumn("at", F.row_number().over(first)).where(F.col("at") <= wanted)
              .select("lang", "at", "passage").toPandas().sort_values(["lang", "at"]))
    texts = {n: LOWER[np.frombuffer("\n".join(p).encode(), dtype=np.uint8)].tobytes()
             for n, p in chosen.groupby("lang")["passage"]}
    names = [n for n in names if n in texts]
    return LanguageModel(names, docs.sparkSession.sparkContext.broadcast([texts[n] for n in names]))


def compressed_sizes(texts: list[bytes], dictionaries: list[bytes]) -> np.ndarray:
    """Bytes that every text takes with every dictionary, its chunks compressed one by one."""
    import zstandard

    out = np.zeros((len(texts), len(dictionaries)), dtype=np.int64)
    chunks = [[t[i:i + CHUNK] for i in range(0, len(t), CHUNK)] for t in texts]
    for k, content in enumerate(dictionaries):
        known = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        known.precompute_compress(level=LEVEL)
        compress = zstandard.ZstdCompressor(
            dict_data=known, write_content_size=False, write_checksum=False, write_dict_id=False).compress
        out[:, k] = [sum([len(compress(c)) for c in own]) for own in chunks]
    return out


def predict_language(docs: DataFrame, model: LanguageModel, into: str = "language",
                     text_col: str = "text") -> DataFrame:
    """``docs`` with a struct ``into``: ``lang, score, margin, accepted``.

    The whole text (A-Z lower-cased) is compressed in chunks with every
    language's passages as dictionary; ``lang`` is the one that needs the fewest
    bytes, of equal ones that with more texts to learn from. ``score`` halves
    for another language as small as the best, and nearly for one a byte larger;
    ``margin`` is the share of bytes saved against the second, and ``accepted``
    tells whether it is wide enough. A null text, one without a letter, and any
    text under a model without languages is ``und`` with score 0, not accepted.
    With a single language the margin is 1.
    A clashing column ``into`` is replaced. No rows give no rows. A text has to
    fit a task.
    """
    known, names = model.dictionaries, model.names
    text, letter = fresh("_text", docs.columns), fresh("_letter", docs.columns)
    given = docs.schema.fields
    kept = [f for f in given if f.name.lower() != into.lower()]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept),
                        f"`{into}` struct<lang: string, score: double, margin: double, accepted: boolean>"])

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column, usable = batch.column(text), batch.column(letter).to_numpy(zero_copy_only=False)
            at = np.flatnonzero(usable) if names else np.empty(0, dtype=np.int64)
            lowered = [LOWER[np.frombuffer(column[i].as_py().encode(), dtype=np.uint8)].tobytes() for i in at.tolist()]
            size = compressed_sizes(lowered, known.value).astype(np.float64)
            lang, score = np.full(batch.num_rows, UNKNOWN, dtype=object), np.zeros(batch.num_rows)
            margin = np.zeros(batch.num_rows)
            if len(at):
                best = size.argmin(axis=1)
                least = size[np.arange(len(at)), best]
                lang[at] = np.array(names, dtype=object)[best]
                score[at] = 1 / np.exp2(np.maximum(least[:, None] - size, -1000)).sum(axis=1)
                margin[at] = 1.0 if len(names) == 1 else 1 - least / np.partition(size, 1, axis=1)[:, 1]
            verdict = pa.StructArray.from_arrays(
                [pa.array(lang, pa.string()), pa.array(score), pa.array(margin),
                 pa.array((lang != UNKNOWN) & (margin >= MARGIN))], ["lang", "score", "margin", "accepted"])
            yield pa.RecordBatch.from_arrays([batch.column(f.name) for f in kept] + [verdict],
                                             [*(f.name for f in kept), into])

    held = docs.withColumn(text, F.col(f"`{text_col}`")).withColumn(
        letter, F.coalesce(F.col(f"`{text_col}`").rlike(r"\p{L}"), F.lit(False)))
    return held.mapInArrow(scored, schema)
