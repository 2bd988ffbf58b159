"""Feature attributions, averaged over all scored rows or for chosen rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prepforge.errors import DataError
from prepforge.functions.columns import quoted
from prepforge.models.forest import ForestModel
from prepforge.models.linear import LinearModel
from prepforge.models.mlp import MlpModel
from prepforge.models.trees import Tree
from prepforge.operators.ordering import background_sample
from prepforge.session import settle

BACKGROUND_ROWS = 100
# Defaults of the local explanation.
LIME_SAMPLES, LIME_RIDGE, LIME_WIDTH = 5000, 1.0, 0.75
GRID_CELLS = 1 << 15        # boxes of a tree whose contributions a task works out beforehand
BLOCK_ROWS = 512            # rows that a network explains at once, so that its layers stay in the cache


def contribution_name(feature: str) -> str:
    return f"phi_{feature}"


def mean_absolute(contributions: DataFrame, features: list[str]) -> DataFrame:
    """feature, importance: the mean absolute contribution of each feature."""
    wide = contributions.agg(*[
        F.avg(F.abs(quoted(contribution_name(f)))).alias(f"a{i}") for i, f in enumerate(features)])
    return wide.select(F.stack(
        F.lit(len(features)),
        *[x for i, f in enumerate(features) for x in (F.lit(f), F.col(f"a{i}"))],
    ).alias("feature", "importance"))


def contributions(df: DataFrame, model, keep: list[str] = ()) -> DataFrame:
    """Per row one ``phi_<feature>`` per feature; they add up to f(x) - E[f]."""
    if isinstance(model, LinearModel):
        return linear_contributions(df, model, keep)
    if isinstance(model, ForestModel):
        return forest_contributions(df, model, keep)
    if isinstance(model, MlpModel):
        return network_contributions(df, model, keep)
    raise DataError("no attribution for this model")


def shap_importance(df: DataFrame, model) -> DataFrame:
    return mean_absolute(contributions(df, model), model.features)


# linear --------------------------------------------------------------------

def linear_contributions(df: DataFrame, model: LinearModel, keep: list[str] = ()) -> DataFrame:
    """weight * (x - mean); closed form, so it stays a projection."""
    means = df.agg(*[F.avg(quoted(f).cast("double")).alias(f"m{i}")
                     for i, f in enumerate(model.features)]).first()
    return df.select(*[quoted(k) for k in keep], *[
        (F.lit(w) * (quoted(f).cast("double") - F.lit(means[f"m{i}"]))).alias(contribution_name(f))
        for i, (f, w) in enumerate(zip(model.features, model.weights))])


# trees ---------------------------------------------------------------------

def tree_leaves(parts: dict[int, Tree]) -> list[tuple]:
    """Per leaf of a tree (value, features, low, high, share).

    A leaf is described by one interval and one share per feature on its path:
    the part of the training rows that follow the path where that feature
    splits. Of several classes the first one is explained.
    """
    out = []
    start = -1 if -1 in parts else 0
    open_ = [(start, 0, {})]
    while open_:
        unit, node, path = open_.pop()
        tree = parts[unit]
        f = int(tree.feature[node])
        if f < -1:                              # the upper part ends where a unit begins
            open_.append((-2 - f, 0, path))
            continue
        if f < 0:
            known = sorted(path)
            if path:
                out.append((float(tree.value[node]), np.array(known), *[
                    np.array([path[k][i] for k in known]) for i in range(3)]))
            continue
        cut, (low, high, share) = tree.threshold[node], path.get(f, (-np.inf, np.inf, 1.0))
        whole = _weight(parts, unit, node)
        for child, ends in ((tree.left[node], (low, min(high, cut))), (tree.right[node], (max(low, cut), high))):
            part = share * _weight(parts, unit, child) / whole
            open_.append((unit, child, {**path, f: (*ends, part)}))
    return out


def _weight(parts: dict[int, Tree], unit: int, node: int) -> float:
    f = int(parts[unit].feature[node])
    return float(parts[-2 - f].weight[0] if f < -1 else parts[unit].weight[node])


def leaf_shapley(x: np.ndarray, leaves: list[tuple]) -> np.ndarray:
    """Exact Shapley values of every row for a sum of leaf indicator products.

    In one leaf's game a known feature contributes whether its interval holds
    the value, an unknown one its training share. The value of a product game
    is an integral of a polynomial in one variable, which Gauss quadrature
    with enough points evaluates exactly.
    """
    phi = np.zeros(x.shape)
    rules = {}
    for value, features, low, high, share in leaves:
        size = len(features)
        if size not in rules:
            at, weight = np.polynomial.legendre.leggauss((size + 1) // 2)
            rules[size] = (at + 1) / 2, weight / 2
        points, weights = rules[size]
        cell = x[:, features]
        gain = ((cell > low) & (cell <= high)) - share
        factors = share[None, :, None] + gain[:, :, None] * points
        others = np.prod(factors, axis=1, keepdims=True) / factors
        phi[:, features] += value * gain * (others @ weights)
    return phi


def tree_shapley(leaves: list[tuple], width: int):
    """A function from rows to their contributions in one tree.

    Between the cuts of its features a tree's contributions are constant: if
    there are at most GRID_CELLS such boxes, they are worked out once and looked
    up for every row. A missing value and minus infinity lie in no interval.
    """
    ends = [np.unique([e for _, known, low, high, _ in leaves for k, *pair in zip(known, low, high) if k == f
                       for e in pair if np.isfinite(e)]) for f in range(width)]
    shape = [len(e) + 2 for e in ends]
    if np.prod(shape, dtype=float) > GRID_CELLS:
        return lambda x: leaf_shapley(x, leaves)
    inside = [np.concatenate([e, [np.inf, np.nan]]) for e in ends]
    grid = leaf_shapley(np.stack(np.meshgrid(*inside, indexing="ij"), axis=-1).reshape(-1, width), leaves)

    def look_up(x):
        place = [np.where(np.isnan(c) | (c == -np.inf), len(e) + 1, np.searchsorted(e, c)) for e, c in zip(ends, x.T)]
        return grid[np.ravel_multi_index(place, shape)]

    return look_up


def forest_contributions(df: DataFrame, model: ForestModel, keep: list[str] = ()) -> DataFrame:
    """Trees are read in groups of bounded size; rows carry what the groups before added up."""
    spark, width = df.sparkSession, len(model.features)
    names = [f"__x{i}" for i in range(width)]
    out = df.select(*[quoted(k) for k in keep], *[quoted(f).cast("double").alias(n) for f, n in zip(model.features, names)],
                    F.lit(None).cast("array<double>").alias("__phi"))
    for number, group in enumerate(model.groups(spark, whole_trees=True)):
        if number:
            out = settle(out, "forest-contributions")
        out = out.withColumn("__phi", _adds_group(spark.sparkContext.broadcast(group), width)(*names, "__phi"))
    return out.select(*[quoted(k) for k in keep], *[
        (F.get("__phi", F.lit(i)) / model.trees).alias(contribution_name(f)) for i, f in enumerate(model.features)])


def _adds_group(known, width: int):
    """Adds the contributions in a broadcast group of trees to those that a row has so far."""
    @F.pandas_udf("array<double>")
    def add(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        parts: dict[int, dict[int, Tree]] = {}
        for tree, unit, arrays, _ in known.value:
            parts.setdefault(tree, {})[unit] = arrays
        trees = [tree_shapley(tree_leaves(own), width) for own in parts.values()]
        for columns in batches:
            x = np.column_stack([c.to_numpy(dtype=float) for c in columns[:width]])
            phi = np.zeros(x.shape)
            for explain in trees:
                phi += explain(x)
            before = columns[width]
            yield pd.Series([row if b is None else row + b for row, b in zip(phi, before, strict=True)])

    return add


# network -------------------------------------------------------------------

def network_contributions(df: DataFrame, model: MlpModel, keep: list[str] = ()) -> DataFrame:
    """Difference-from-reference attribution, averaged over a bounded background."""
    background = np.array([
        list(r) for r in background_sample(df, model.features, BACKGROUND_ROWS).collect()], dtype=float)
    layers = model.layers.views(model.weights)

    def activations(x):
        out = []
        for weights, bias in layers[:-1]:
            out.append(x @ weights + bias)
            x = np.maximum(out[-1], 0.0)
        return out

    there = [[v.T for v in activations(reference[None, :])[::-1]] for reference in background]
    last, inner = layers[-1][0], [np.ascontiguousarray(weights) for weights, _ in layers[-2::-1]]

    def explain_block(x):
        """A column for each row, so that every unit's values lie side by side."""
        here, total = [np.ascontiguousarray(v.T) for v in activations(x)[::-1]], np.zeros(x.T.shape)
        positive, columns = [np.maximum(a, 0.0) for a in here], np.ascontiguousarray(x.T)
        moved, slope, small = ([np.empty(a.shape, t) for a in here] for t in (float, float, bool))
        for reference, ends in zip(background, there):
            back = last
            for k, (weights, a, b) in enumerate(zip(inner, here, ends)):
                np.subtract(a, b, out=moved[k])
                np.abs(moved[k], out=slope[k])
                still = np.less(slope[k], 1e-9, out=small[k])
                np.subtract(positive[k], np.maximum(b, 0.0), out=slope[k])
                if still.any():
                    moved[k][still], slope[k][still] = 1.0, a[still] > 0
                np.divide(slope[k], moved[k], out=slope[k])
                back = weights @ np.multiply(back, slope[k], out=slope[k])
            total += back * (columns - reference[:, None])
        return total.T / len(background)

    def explain(x):
        return np.concatenate([explain_block(x[at:at + BLOCK_ROWS]) for at in range(0, len(x), BLOCK_ROWS)] or [x])

    return _in_batches(df, model.features, keep, explain)


def _in_batches(df: DataFrame, features: list[str], keep: list[str], explain) -> DataFrame:
    names = [contribution_name(f) for f in features]
    kept = df.select(*[quoted(k) for k in keep],
                     *[quoted(f).cast("double").alias(f"__x{i}") for i, f in enumerate(features)])
    types = [f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:len(keep)]]
    schema = ", ".join(types + [f"`{n}` double" for n in names])

    def run(batches):
        for batch in batches:
            x = batch.iloc[:, len(keep):].to_numpy(dtype=float)
            out = pd.DataFrame(explain(x), columns=names, index=batch.index)
            yield pd.concat([batch.iloc[:, :len(keep)], out], axis=1)

    return kept.mapInPandas(run, schema)


# local explanation -----------------------------------------------------------

def _uniform(parts) -> "F.Column":
    """Deterministic number in (0, 1) from the values of ``parts``."""
    bits = F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double")
    return (bits + 0.5) / F.lit(float(2 ** 53))


def lime(rows: DataFrame, model, key: str, deviations: dict[str, float],
         samples: int = LIME_SAMPLES, ridge: float = LIME_RIDGE, seed: int = 42) -> DataFrame:
    """Local linear explanation of each given row: key, feature, weight.

    Every row is varied ``samples`` times around itself in units of the
    ``deviations``; the model's answers are fitted by weighted least squares.
    The noise is a function of (key, sample, feature), so a recomputed task
    draws the same. Weights are per standard deviation of the feature.
    """
    features = model.features
    d = len(features)
    base = rows.select(quoted(key).alias("__k"), *[
        quoted(f).cast("double").alias(f"__x{i}") for i, f in enumerate(features)])
    drawn = base.withColumn("__s", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))))
    noise = []
    for i in range(d):
        u, v = (_uniform([F.lit(seed), F.lit(2 * i + half), F.col("__k"), F.col("__s")])
                for half in (0, 1))
        normal = F.sqrt(-2 * F.log(u)) * F.cos(F.lit(2 * np.pi) * v)
        noise.append(F.when(F.col("__s") == 0, 0.0).otherwise(normal).alias(f"__z{i}"))
    drawn = drawn.select("__k", *[F.col(f"__x{i}") for i in range(d)], *noise)
    varied = drawn.select("__k", *[F.col(f"__z{i}") for i in range(d)], *[
        (F.col(f"__x{i}") + F.lit(float(deviations[f])) * F.col(f"__z{i}")).alias(f)
        for i, f in enumerate(features)])
    scored = model.predict(varied, "__y")
    distance = sum(F.pow(F.col(f"__z{i}"), 2) for i in range(d))
    weight = F.sqrt(F.exp(-distance / F.lit(LIME_WIDTH ** 2 * d)))
    weighed = scored.withColumn("__w", weight)
    terms = [F.lit(1.0)] + [F.col(f"__z{i}") for i in range(d)]
    sums = [F.sum(F.col("__w") * terms[i] * terms[j]) for i in range(d + 1) for j in range(d + 1)]
    right = [F.sum(F.col("__w") * t * F.col("__y")) for t in terms]
    per_key = weighed.groupBy("__k").agg(F.array(*sums).alias("left"), F.array(*right).alias("right"))

    penalty = np.diag([0.0] + [ridge] * d)

    @F.pandas_udf("array<double>")
    def solve(left: pd.Series, right: pd.Series) -> pd.Series:
        a = np.stack(left.to_list()).reshape(-1, d + 1, d + 1) + penalty
        b = np.stack(right.to_list())[:, :, None]
        return pd.Series(list(np.linalg.solve(a, b)[:, 1:, 0]))

    solved = per_key.select("__k", solve("left", "right").alias("__c"))
    return solved.select(F.col("__k").alias(key), F.posexplode("__c").alias("__i", "weight")).select(
        key, F.get(F.array(*[F.lit(f) for f in features]), F.col("__i")).alias("feature"), "weight")


def standard_deviations(df: DataFrame, features: list[str]) -> dict[str, float]:
    row = df.agg(*[F.stddev_pop(quoted(f).cast("double")).alias(f"s{i}")
                   for i, f in enumerate(features)]).first()
    return {f: row[f"s{i}"] or 1.0 for i, f in enumerate(features)}
