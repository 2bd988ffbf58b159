"""A byte-level convolutional network for text quality, in numpy, trained and applied by Spark tasks."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prepforge.llm.tables import Scratch, fold, only
from prepforge.llm.textblocks import blocks

WIDTH = 6               # bytes that a filter sees
FILTERS = 16
HALF = 256              # a chunk is two halves; consecutive chunks share one
SAMPLE = 1_500          # labelled documents per class to train on, the first in the order of a hash of their ids
SHARDS = 4              # parts of the sample that train side by side
ROUNDS, EPOCHS = 5, 2   # times the shards' weights are averaged; passes over a shard in between
BATCH = 16
RATE = 0.02
SEED = 11


@dataclass
class Weights:
    """``filters``: (width, 256, filters), the response to each byte at each place. ``head``: mean, max, min, bias."""

    filters: np.ndarray
    offset: np.ndarray
    head: np.ndarray

    @staticmethod
    def fresh() -> "Weights":
        rng = np.random.default_rng(SEED)
        return Weights(rng.normal(0, 0.3, (WIDTH, 256, FILTERS)).astype(np.float32),
                       np.zeros(FILTERS, np.float32),
                       np.concatenate((rng.normal(0, 0.05, 3 * FILTERS), [0.0])).astype(np.float32))

    def arrays(self) -> list[np.ndarray]:
        return [self.filters, self.offset, self.head]

    def packed(self) -> bytes:
        return b"".join(a.astype("<f4").tobytes() for a in self.arrays())

    @staticmethod
    def unpacked(data: bytes) -> "Weights":
        flat = np.frombuffer(data, dtype="<f4").copy()
        a, b = WIDTH * 256 * FILTERS, WIDTH * 256 * FILTERS + FILTERS
        return Weights(flat[:a].reshape(WIDTH, 256, FILTERS), flat[a:b], flat[b:])


class Layout:
    """Texts laid out with WIDTH zero bytes after each, and where their halves and chunks lie."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray):
        rows, lengths = len(bounds) - 1, np.diff(bounds)
        starts = bounds[:-1] + np.arange(rows) * WIDTH
        self.data = np.zeros(len(data) + rows * WIDTH, dtype=np.uint8)
        self.data[np.arange(len(data)) + np.repeat(np.arange(rows) * WIDTH, lengths)] = data
        # windows that start after the first zero byte reach into the next text
        tails = starts + lengths + 1
        self.unused = (tails[:, None] + np.arange(WIDTH - 1)).reshape(-1)
        halves = -(-(lengths + 1) // HALF)
        self.first_half = np.concatenate(([0], np.cumsum(halves)))
        place = np.arange(self.first_half[-1]) - np.repeat(self.first_half[:-1], halves)
        self.half_starts = np.repeat(starts, halves) + place * HALF
        chunks = np.maximum(halves - 1, 1)
        self.first_chunk = np.concatenate(([0], np.cumsum(chunks)))
        self.chunk_text = np.repeat(np.arange(rows), chunks)
        inside = np.arange(self.first_chunk[-1]) - np.repeat(self.first_chunk[:-1], chunks)
        self.left = np.repeat(self.first_half[:-1], chunks) + inside
        self.right = np.minimum(self.left + 1, np.repeat(self.first_half[1:], chunks) - 1)
        self.rows, self.chunks = rows, chunks

    def responses(self, weights: Weights, start: int, end: int) -> np.ndarray:
        """Filter responses of the windows from ``start`` to ``end``."""
        out = weights.filters[0][self.data[start:end]]
        for k in range(1, WIDTH):
            part = self.data[start + k:end + k]
            out[:len(part)] += weights.filters[k][part]
        a, b = np.searchsorted(self.unused, (start, end))
        out[self.unused[a:b] - start] = -np.inf
        return out

    def maxima(self, weights: Weights, step: int = 48) -> np.ndarray:
        """The largest response of each filter in each half."""
        out = np.empty((len(self.half_starts), FILTERS), dtype=np.float32)
        for at in range(0, len(self.half_starts), step):
            stop = min(at + step, len(self.half_starts))
            start = self.half_starts[at]
            end = self.half_starts[stop] if stop < len(self.half_starts) else len(self.data)
            out[at:stop] = np.maximum.reduceat(
                self.responses(weights, start, end), self.half_starts[at:stop] - start, axis=0)
        return out

    def features(self, maxima: np.ndarray, weights: Weights) -> tuple[np.ndarray, np.ndarray]:
        """Chunk activations, and per text their mean, largest and smallest."""
        chunk = np.maximum(np.maximum(maxima[self.left], maxima[self.right]) + weights.offset, 0)
        at = self.first_chunk[:-1]
        mean = np.add.reduceat(chunk, at, axis=0) / self.chunks[:, None]
        return chunk, np.concatenate(
            (mean, np.maximum.reduceat(chunk, at, axis=0), np.minimum.reduceat(chunk, at, axis=0)), axis=1)


def logits(data: np.ndarray, bounds: np.ndarray, weights: Weights) -> np.ndarray:
    layout = Layout(data, bounds)
    _, found = layout.features(layout.maxima(weights), weights)
    return found @ weights.head[:-1] + weights.head[-1]


def gradients(data: np.ndarray, bounds: np.ndarray, labels: np.ndarray, weights: Weights) -> list[np.ndarray]:
    """Gradient of the mean log-loss; only the places that hold a maximum pass it on."""
    layout = Layout(data, bounds)
    everything = layout.responses(weights, 0, len(layout.data))
    maxima = np.maximum.reduceat(everything, layout.half_starts, axis=0)
    chunk, found = layout.features(maxima, weights)
    z = found @ weights.head[:-1] + weights.head[-1]
    delta = ((1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels) / len(labels)).astype(np.float32)
    head = np.concatenate((delta @ found, [delta.sum()])).astype(np.float32)
    mean, high, low = weights.head[:FILTERS], weights.head[FILTERS:2 * FILTERS], weights.head[2 * FILTERS:-1]
    text = layout.chunk_text
    one = np.float32(1)
    at_high = chunk == found[text, FILTERS:2 * FILTERS]
    at_low = chunk == found[text, 2 * FILTERS:]
    first = layout.first_chunk[:-1]
    n_high = np.add.reduceat(at_high.astype(np.float32), first, axis=0)[text]
    n_low = np.add.reduceat(at_low.astype(np.float32), first, axis=0)[text]
    to_chunk = delta[text][:, None] * (
        mean / layout.chunks[text][:, None].astype(np.float32)
        + high * at_high / np.maximum(n_high, one) + low * at_low / np.maximum(n_low, one))
    to_chunk = np.where(chunk > 0, to_chunk, 0).astype(np.float32)
    offset = to_chunk.sum(axis=0)
    from_left = maxima[layout.left] >= maxima[layout.right]
    to_half = np.zeros_like(maxima)
    np.add.at(to_half, layout.left, np.where(from_left, to_chunk, 0))
    np.add.at(to_half, layout.right, np.where(from_left, 0, to_chunk))
    spans = np.diff(np.append(layout.half_starts, len(layout.data)))
    half = np.repeat(np.arange(len(spans)), spans)
    place, unit = np.nonzero(everything == maxima[half])
    own = half[place]
    shared = np.zeros_like(maxima)
    np.add.at(shared, (own, unit), one)
    share = to_half[own, unit] / shared[own, unit]
    busy = share != 0
    place, unit, share = place[busy], unit[busy], share[busy]
    filters = np.zeros_like(weights.filters)
    for k in range(WIDTH):
        seen = np.minimum(place + k, len(layout.data) - 1)
        np.add.at(filters[k], (layout.data[seen], unit), share)
    return [filters, offset, head]


def _train(texts: list[bytes], labels: np.ndarray, weights: Weights, epochs: int, seed: int) -> Weights:
    """Adam over shuffled batches of whole texts."""
    rng = np.random.default_rng(seed)
    params = weights.arrays()
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for at in range(0, len(order), BATCH):
            own = order[at:at + BATCH]
            parts = [np.frombuffer(texts[i], dtype=np.uint8) for i in own]
            bounds = np.concatenate(([0], np.cumsum([len(p) for p in parts])))
            grads = gradients(np.concatenate(parts), bounds, labels[own], Weights(*params))
            step += 1
            for p, g, m, v in zip(params, grads, first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p -= RATE * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-6)
    return Weights(*params)


def _trainer(current: bytes, seed: int):
    def train(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["doc_id", "text"], kind="stable")
        trained = _train([t.encode() for t in frame["text"]], frame["label"].to_numpy(np.float32),
                         Weights.unpacked(current), EPOCHS, seed)
        return pd.DataFrame({"shard": frame["shard"].iloc[:1], "n": [len(frame)], "weights": [trained.packed()]})
    return train


@dataclass(frozen=True)
class QualityModel:
    weights: bytes
    shift: float            # log-odds of label 1 among the labels, over those in the sample


def fit_quality(docs: DataFrame, labels: DataFrame, label: str = "quality") -> QualityModel:
    """Trains on at most SAMPLE documents of each class, whole texts, shards side by side with averaged weights.

    Labels of ids whose crc32 leaves 1 modulo 3 are never read. The result does
    not depend on how the tables are partitioned. Without labels of both
    classes the network stays as initialised, with the shift of what there is.
    """
    spark = docs.sparkSession
    known = (only(labels, doc_id="doc_id", label=label).where("doc_id IS NOT NULL AND label IN (0, 1)")
             .groupBy("doc_id").agg(F.min("label").alias("label")).where(fold("doc_id", 3) != 1))
    counts = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    ones, zeros = counts.get(1, 0), counts.get(0, 0)
    shift = math.log((ones + 1) / (zeros + 1)) - math.log((min(ones, SAMPLE) + 1) / (min(zeros, SAMPLE) + 1))
    weights = Weights.fresh()
    if not ones or not zeros:
        return QualityModel(weights.packed(), shift)
    draw = F.xxhash64("doc_id", F.lit(SEED))
    part = lambda v: known.where(F.col("label") == v).orderBy(draw, "doc_id").limit(SAMPLE)
    chosen = part(0).union(part(1)).withColumn("shard", F.pmod(draw, F.lit(SHARDS)))
    sample = (only(docs, doc_id="doc_id", text="text").join(F.broadcast(chosen), "doc_id")
              .select("doc_id", "shard", "label", F.coalesce("text", F.lit("")).alias("text")))
    scratch = Scratch(spark, "cnn")
    sample = scratch.write(sample)
    for round_ in range(ROUNDS):
        made = sorted((r["shard"], r["n"], r["weights"]) for r in sample.groupBy("shard").applyInPandas(
            _trainer(weights.packed(), SEED + round_), "shard bigint, n bigint, weights binary").collect())
        total = sum(n for _, n, _ in made)
        parts = [(n / total, Weights.unpacked(bytes(w)).arrays()) for _, n, w in made]
        weights = Weights(*[sum(share * arrays[i] for share, arrays in parts).astype(np.float32) for i in range(3)])
    scratch.drop(sample)
    return QualityModel(weights.packed(), shift)


def score_quality(docs: DataFrame, model: QualityModel, text_col: str = "text", into: str = "quality_score") -> DataFrame:
    """``docs`` with one more column ``into``: the probability of label 1, from all bytes of each text.

    Rows stay where they are. Null and empty texts get the network's answer to
    no bytes. Other columns pass through; ``into`` must not be among them.
    """
    if into in docs.columns:
        raise ValueError(f"the table already has a column {into!r}")
    shared = docs.sparkSession.sparkContext.broadcast(model.weights)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = Weights.unpacked(shared.value)
        for batch in batches:
            z = np.zeros(batch.num_rows)
            for block in blocks(batch.column(text_col)):
                z[block.first:block.first + block.rows] = logits(block.data, block.bounds, weights)
            out = 1 / (1 + np.exp(-np.clip(z + model.shift, -30, 30)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], [*batch.schema.names, into])

    return docs.mapInArrow(scored, T.StructType([*docs.schema.fields, T.StructField(into, T.DoubleType())]))
