"""Toxic passages: maximal-scoring segments of token log-odds, calibrated by extreme-value statistics."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prepforge.llm.tables import fold, only
from prepforge.llm.textblocks import Block, blocks

SAMPLE = 20_000         # labelled documents to learn from, the first in the order of a hash of their ids
BUCKETS = 1 << 18       # hashed vocabulary: the size of everything that is collected or broadcast
STEM = 4                # bytes of a word that stand for words too rare to have log-odds of their own
PRIOR = 0.5             # pseudo-texts of the Dirichlet prior on either side
SURE = 2.7              # standard errors from which a token's log-odds count
STRONG = 1.5            # and the least log-odds that count
DRIFT = 0.15            # what every token costs, so that unrelated hits do not join
RARE = 0.05             # expected number of chance passages below which a passage is significant
BINS, TOP = 128, 64.0   # histogram of evidence that the calibration is fitted to

PASSAGES = T.ArrayType(T.StructType([
    T.StructField("first_word", T.IntegerType()), T.StructField("last_word", T.IntegerType()),
    T.StructField("score", T.DoubleType()), T.StructField("expected", T.DoubleType())]))


def log_odds(toxic: np.ndarray, clean: np.ndarray, n_toxic: float, n_clean: float,
             prior: float = PRIOR) -> tuple[np.ndarray, np.ndarray]:
    """Log-odds of each token between the classes, by texts that hold it, and their standard errors.

    Both classes start from ``prior`` texts with and ``prior`` texts without the token.
    """
    a, b = toxic + prior, clean + prior
    not_a, not_b = n_toxic - toxic + prior, n_clean - clean + prior
    odds = np.log(a / not_a) - np.log(b / not_b)
    return odds, odds / np.sqrt(1 / a + 1 / not_a + 1 / b + 1 / not_b)


def maximal_segments(tokens: np.ndarray, low: np.ndarray, high: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments, in time linear in the number of positive tokens.

    ``tokens`` are the places of tokens with positive scores, ``low`` and
    ``high`` the running total of all scores before and after each of them.
    Returns first token, last token and score, in order.
    """
    found: list[tuple[int, int, float, float, int]] = []      # first, last, low, high, link to the left
    for token, lo, hi in zip(tokens.tolist(), low.tolist(), high.tolist(), strict=True):
        first, link = token, len(found) - 1
        while True:
            while link >= 0 and found[link][2] >= lo:
                link = found[link][4]
            if link < 0 or found[link][3] >= hi:
                break
            first, lo, to = found[link][0], found[link][2], found[link][4]
            del found[link:]
            link = to
        found.append((first, token, lo, hi, link))
    return [(first, last, hi - lo) for first, last, lo, hi, _ in found]


def decay(scores: np.ndarray, share: np.ndarray) -> float:
    """The positive root of sum(share * exp(x * scores)) = 1: how fast chance segments thin out with score."""
    excess = lambda x: float((share * np.exp(np.minimum(x * scores, 500))).sum()) - 1
    low, high = 0.0, 1.0
    if not (scores[share > 0] > 0).any():
        return 1.0
    while excess(high) < 0:
        low, high = high, 2 * high
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if excess(mid) < 0 else (low, mid)
    return max(high, 1e-3)


def logistic(x: np.ndarray, positives: np.ndarray, totals: np.ndarray) -> tuple[float, float]:
    """Intercept and slope of P(label 1) from binned counts, by Newton steps with a little ridge."""
    w = np.zeros(2)
    design = np.stack([np.ones_like(x), x], axis=1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        gradient = design.T @ (positives - totals * p) - 1e-2 * w
        curve = (design * (totals * p * (1 - p))[:, None]).T @ design + 1e-2 * np.eye(2)
        step = np.linalg.solve(curve, gradient)
        w = w + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1])


@dataclass(frozen=True)
class ToxicityModel:
    """Token scores by hash bucket; ``rate`` and ``size`` of chance segments; the calibration."""

    scores: Broadcast
    rate: float
    size: float
    intercept: float
    slope: float

    def probability(self, evidence: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.intercept + self.slope * evidence, -30, 30)))


def _buckets(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of every word and of its stem, and for each text the number of words before it."""
    low = block.lowered()
    starts, ends, first = low.words()
    of = lambda spans: (spans % np.uint64(BUCKETS)).astype(np.int64)
    return (of(low.hashes(starts, ends)),
            of(~low.hashes(starts, np.minimum(ends, starts + STEM))), first)


def _values(block: Block, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The score of every token: its own log-odds, else those of its stem, less the drift."""
    token, stem, first = _buckets(block)
    own = scores[token]
    return np.where(own == 0, scores[stem], own) - DRIFT, first


def _segments(block: Block, scores: np.ndarray) -> Iterator[tuple[int, int, list[tuple[int, int, float]]]]:
    """Of each text with a positive token: its row in the block, its words, its maximal segments."""
    values, first = _values(block, scores)
    hits = np.flatnonzero(values > 0)
    if not len(hits):
        return
    running = np.concatenate(([0.0], np.cumsum(values, dtype=np.float64)))
    place = np.searchsorted(hits, first)
    for i in np.flatnonzero(np.diff(place)):
        own = hits[place[i]:place[i + 1]]
        yield int(i), int(first[i + 1] - first[i]), maximal_segments(own - first[i], running[own], running[own + 1])


def _evidence(segments: list[tuple[int, int, float]], words: int, rate: float, size: float):
    """Significant passages, and minus the logarithm of their chance expectations in total."""
    kept, total = [], 0.0
    for a, b, score in segments:
        expected = size * words * float(np.exp(-rate * score))
        if expected < RARE:
            kept.append((a, b, score, expected))
            total -= float(np.log(max(expected, 1e-300)))
    return kept, min(total, TOP)


def _labelled(docs: DataFrame, labels: DataFrame, label: str) -> DataFrame:
    """At most SAMPLE labelled documents: ``text, label, part``; a quarter, part 0, calibrates, the rest teaches."""
    known = (only(labels, doc_id="doc_id", label=label).where("doc_id IS NOT NULL AND label IN (0, 1)")
             .groupBy("doc_id").agg(F.max("label").alias("label"))
             .where(fold("doc_id", 3) != 1).withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit("part")), F.lit(4)))
             .orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE))
    return only(docs, doc_id="doc_id", text="text").join(F.broadcast(known), "doc_id").select("text", "label", "part")


def _token_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many toxic and clean texts of this task each bucket occurs; slot BUCKETS counts the texts."""
    counts = np.zeros((2, BUCKETS + 1), dtype=np.int64)
    for batch in batches:
        label = np.asarray(batch.column("label").to_pylist(), dtype=np.int64)
        for block in blocks(batch.column("text")):
            token, stem, first = _buckets(block)
            for i in range(block.rows):
                own = np.unique(np.concatenate((token[first[i]:first[i + 1]], stem[first[i]:first[i + 1]])))
                side = 0 if label[block.first + i] else 1
                counts[side, own] += 1
                counts[side, BUCKETS] += 1
    used = np.flatnonzero(counts.any(axis=0))
    yield pa.RecordBatch.from_arrays(
        [pa.array(used), pa.array(counts[0, used]), pa.array(counts[1, used])], ["bucket", "toxic", "clean"])


def fit_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> ToxicityModel:
    """Learns token scores from three quarters of the sample and the calibration from the rest.

    Labels of ids whose crc32 leaves 1 modulo 3 are never read. Collected are
    BUCKETS counts and BINS bins, whatever the size of the corpus. Without
    labels of both classes every text gets the share of label 1, or 0.
    """
    spark = docs.sparkSession
    sample = _labelled(docs, labels, label)
    rows = (sample.where("part <> 0").mapInArrow(_token_counts, "bucket bigint, toxic bigint, clean bigint")
            .groupBy("bucket").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).toPandas())
    toxic, clean = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)
    toxic[rows["bucket"]], clean[rows["bucket"]] = rows["toxic"], rows["clean"]
    (toxic, n_toxic), (clean, n_clean) = ((c[:-1], c[-1]) for c in (toxic, clean))
    if n_toxic and clean.sum():
        odds, errors = log_odds(toxic, clean, n_toxic, n_clean)
        scores = np.where((np.abs(errors) >= SURE) & (np.abs(odds) >= STRONG), odds, 0.0)
        rate = decay(scores - DRIFT, clean / clean.sum())
    else:
        scores, rate = np.zeros(BUCKETS), 1.0
    shared = spark.sparkContext.broadcast(scores.astype(np.float32))
    least = float(scores[scores > DRIFT].min()) - DRIFT if (scores > DRIFT).any() else 1.0

    def chance(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segments, words = 0, 0.0
        for batch in batches:
            for block in blocks(batch.column("text")):
                words += float(block.words()[2][-1])
                segments += sum(len(s) for _, _, s in _segments(block, shared.value))
        yield pa.RecordBatch.from_arrays([pa.array([segments]), pa.array([words])], ["segments", "words"])

    seen = (sample.where("part = 0 AND label = 0").mapInArrow(chance, "segments bigint, words double")
            .agg(F.sum("segments").alias("s"), F.sum("words").alias("w")).first())
    size = ((seen["s"] or 0) + 0.5) / ((seen["w"] or 0.0) + 1.0) * float(np.exp(rate * least))

    def evidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros(batch.num_rows)
            for block in blocks(batch.column("text")):
                for i, words, found in _segments(block, shared.value):
                    out[block.first + i] = _evidence(found, words, rate, size)[1]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.minimum(out / TOP * BINS, BINS).astype(np.int64)),
                 batch.column("label").cast(pa.int64())], ["bin", "label"])

    bins = (sample.where("part = 0").mapInArrow(evidence, "bin bigint, label bigint")
            .groupBy("bin").agg(F.sum("label").alias("ones"), F.count("*").alias("n")).toPandas())
    x = bins["bin"].to_numpy(dtype=float) * TOP / BINS
    ones, n = bins["ones"].to_numpy(dtype=float), bins["n"].to_numpy(dtype=float)
    if not n.sum():
        return ToxicityModel(shared, rate, size, -30.0, 0.0)
    intercept, slope = logistic(x, ones, n)
    return ToxicityModel(shared, rate, size, intercept, max(slope, 0.0))


def score_toxicity(docs: DataFrame, model: ToxicityModel, text_col: str = "text",
                   into: str = "toxicity") -> DataFrame:
    """``docs`` with one more column ``into``: a struct of ``score`` (0 to 1) and the significant ``passages``.

    Passages give first and last word and the expected number of such passages
    in a clean text of that length. Rows stay where they are: no shuffle. Null
    and empty texts have no passage and get the score of such texts. Any other
    columns pass through; ``into`` must not be among them.
    """
    if into in docs.columns:
        raise ValueError(f"the table already has a column {into!r}")
    added = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("passages", PASSAGES)])
    kinds = pa.struct([("score", pa.float64()), ("passages", pa.list_(pa.struct(
        [("first_word", pa.int32()), ("last_word", pa.int32()), ("score", pa.float64()),
         ("expected", pa.float64())])))])

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, passages = np.zeros(batch.num_rows), [[] for _ in range(batch.num_rows)]
            for block in blocks(batch.column(text_col)):
                for i, words, found in _segments(block, model.scores.value):
                    passages[block.first + i], total[block.first + i] = _evidence(
                        found, words, model.rate, model.size)
            out = [{"score": s, "passages": [dict(zip(("first_word", "last_word", "score", "expected"), p,
                                                      strict=True)) for p in own]}
                   for s, own in zip(model.probability(total).tolist(), passages, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, kinds)], [*batch.schema.names, into])

    return docs.mapInArrow(scored, T.StructType([*docs.schema.fields, T.StructField(into, added)]))
