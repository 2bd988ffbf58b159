"""Random forests, grown to any depth.

Rows are drawn for every tree by a hash of their number. Nodes with more than
UNIT_ROWS rows are split one level at a time from histograms that all tasks add
up; what is smaller is a unit, whose rows go to one task and are split exactly
until its leaves are pure. Equal rows are one row with their weights added up;
trees are grown in rounds, so that what they send stays within a few times the
rows themselves. A forest is a table of units; scoring reads it in
groups of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import and_
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from prepforge.errors import TrainingError
from prepforge.functions.columns import as_number, clean, quoted
from prepforge.models.trees import DIGITS, KINDS, Tree, bootstrap_weights, grow, leaves, merged, packed_votes
from prepforge.operators.encode import Categories, fit_categories, with_code
from prepforge.session import drop, freed_shuffles, scratch_path, settle, small_frame

# Defaults of the usual random forest; no depth means until the leaves are pure.
DEFAULTS = {"n_estimators": 100, "max_depth": None, "min_samples_split": 2, "random_state": 42, "bootstrap": True,
            "max_features": None}
UNIT_ROWS = 200_000         # rows that one task splits exactly
BINS = 255                  # cuts per feature that larger nodes choose from
CELLS = 1 << 20             # histogram cells that a task holds at once
CHUNK = 1 << 17             # rows of which equal ones are merged at once
ROUND_BYTES = 256 << 20     # that the trees grown at once may send, or as much as the table's rows take
GROUP_BYTES = 64 << 20      # arrays of trees that are collected and broadcast at once
NODE_BYTES = 48

_ARRAYS = ", ".join(f"{k} {v}" for k, v in KINDS.items())


class ForestModel:
    """A fitted forest: the table ``path`` of units, and ``labels`` that map class numbers back for a classifier."""

    def __init__(self, kind: str, features: list[str], path: str, trees: int,
                 labels: Categories | None = None) -> None:
        self.kind, self.features, self.path, self.trees, self.labels = kind, list(features), path, trees, labels

    @property
    def classify(self) -> bool:
        return self.labels is not None

    def units(self, spark: SparkSession) -> DataFrame:
        """``tree, unit, n_nodes`` and the arrays; unit -1 is the upper part of a tree that has several units."""
        return spark.read.parquet(self.path)

    def groups(self, spark: SparkSession, whole_trees: bool = False) -> Iterator[list[tuple[int, int, Tree, bool]]]:
        """``tree, unit, arrays, own``: lists of at most GROUP_BYTES, or of one unit (of one tree).

        Every unit is some list's own; the upper parts that a list's units need come along.
        """
        units = self.units(spark)
        if whole_trees:
            sizes = [(r["tree"], None, r["n"]) for r in units.groupBy("tree").agg(F.sum("n_nodes").alias("n")).collect()]
        else:
            sizes = [tuple(r) for r in units.select("tree", "unit", "n_nodes").collect()]
        sizes.sort(key=lambda r: (r[0], -2 if r[1] is None else r[1]))
        held, size = [], 0
        for i, (t, u, n) in enumerate(sizes):
            held.append((t, u))
            size += NODE_BYTES * n
            if i + 1 < len(sizes) and size + NODE_BYTES * sizes[i + 1][2] <= GROUP_BYTES:
                continue
            (low, first), (high, last) = held[0], held[-1]
            inside = F.col("tree").between(low, high)
            if not whole_trees:
                inside &= ((F.col("tree") > low) | (F.col("unit") >= first) | (F.col("unit") == -1)) & (
                    (F.col("tree") < high) | (F.col("unit") <= last))
            found = units.where(inside).toArrow()
            own = set(held)
            yield [(t, u, _tree(found, k), whole_trees or (t, u) in own) for k, (t, u) in enumerate(zip(
                found.column("tree").to_pylist(), found.column("unit").to_pylist(), strict=True))]
            held, size = [], 0

    def nodes(self, spark: SparkSession) -> DataFrame:
        """One row per node: ``tree, unit, node, feature`` (its name, null in a leaf), ``threshold, left, right, value,
        weight, gain``. Of a unit, node 0 is the root."""
        names = list(KINDS)[:7]
        flat = self.units(spark).select("tree", "unit", F.posexplode(F.arrays_zip(*names)).alias("node", "n"))
        feature = F.get(F.array(*[F.lit(f) for f in self.features]), F.col("n.feature"))
        return flat.select("tree", "unit", "node", F.when(F.col("n.feature") >= 0, feature).alias("feature"),
                           *[F.col(f"n.{k}").alias(k) for k in names[1:]])

    def expected(self, spark: SparkSession) -> float:
        """The mean output over the rows that the trees were grown on (of several classes, of the first one)."""
        roots = self.units(spark).groupBy("tree").agg(F.min_by(F.get("value", F.lit(0)), "unit").alias("v"))
        return roots.agg(F.avg("v")).first()[0]

    def predict(self, df: DataFrame, output: str = "prediction") -> DataFrame:
        """The mean of the trees' answers, or the class with the highest mean share, the smallest of equal ones.

        Every group of units is one pass over the rows, which carry what the
        groups before them added up; a forest of one group stays lazy.
        """
        part, columns = "__forest", df.columns
        kind = "struct<codes: array<int>, sums: array<double>>" if self.classify else "double"
        out, first = df, True
        known = None
        for group in self.groups(df.sparkSession):
            if known is not None:
                out = settle(out, "forest-scores")
            known = df.sparkSession.sparkContext.broadcast(group)
            before = F.lit(None).cast(kind) if first else F.col(part)
            out = out.withColumn(part, _scorer(known, len(self.features), self.classify, kind)(
                *[as_number(df, f) for f in self.features], before))
            first = False
        if not self.classify:
            return out.select(*[quoted(c) for c in columns], (F.col(part) / self.trees).alias(output))
        best = F.array_position(F.col(part)["sums"], F.array_max(F.col(part)["sums"])) - 1
        code = F.get(F.col(part)["codes"], best.cast("int")).cast("bigint")
        return self._decoded(out.withColumn(part, code), part, columns, output)

    def _decoded(self, out: DataFrame, code: str, columns: list[str], output: str) -> DataFrame:
        keep = [quoted(c) for c in columns]
        if self.labels.values is not None:
            return out.select(*keep, F.get(self.labels.literals(), F.col(code).cast("int")).alias(output))
        names = self.labels.frame(out.sparkSession).select(F.col("code").alias(code), F.col("value").alias("__value"))
        return out.join(names, code, "left").select(*keep, F.col("__value").alias(output))

    def importances(self, spark: SparkSession) -> DataFrame:
        """feature, importance: the share of a tree's gains that come from splits on the feature, averaged over trees."""
        split = F.explode(F.filter(F.arrays_zip("feature", "gain"), lambda s: s["feature"] >= 0)).alias("s")
        by = (self.units(spark).select("tree", split).groupBy("tree", F.col("s.feature").alias("f"))
              .agg(F.sum("s.gain").alias("g")))
        of_tree = W.partitionBy("tree")
        shares = by.withColumn("share", F.col("g") / F.nullif(F.sum("g").over(of_tree), F.lit(0.0)))
        per = shares.groupBy("f").agg(F.sum("share").alias("v"))
        names = small_frame(spark, [{"f": i, "feature": f} for i, f in enumerate(self.features)], "f int, feature string")
        joined = names.join(per, "f", "left")
        total = F.sum(F.coalesce("v", F.lit(0.0))).over(W.partitionBy(F.lit(1)))
        return joined.select("feature", F.coalesce(F.col("v") / F.nullif(total, F.lit(0.0)), F.lit(0.0)).alias("importance"))

    def to_dict(self) -> dict[str, Any]:
        return {"kind": self.kind, "features": self.features, "trees": self.trees,
                "labels": self.labels.to_dict() if self.labels else None}

    @staticmethod
    def from_dict(data: dict[str, Any], path: str) -> "ForestModel":
        labels = Categories.from_dict(data["labels"]) if data["labels"] else None
        return ForestModel(data["kind"], data["features"], path, data["trees"], labels)


def _tree(table: pa.Table, row: int) -> Tree:
    return Tree(*[table.column(k)[row].values.to_numpy(zero_copy_only=False) for k in KINDS])


def _scorer(known, width: int, classify: bool, kind: str):
    """Adds the answers of a broadcast group of units to what a row has so far."""
    @F.pandas_udf(kind)
    def add(*columns: pd.Series) -> pd.Series:
        x = np.column_stack([c.to_numpy(dtype=float) for c in columns[:width]])
        n = len(x)
        ends = {t: leaves(tree, x) for t, u, tree, _ in known.value if u < 0}
        where = {t: -2 - tree.feature[ends[t]].astype(np.int64) for t, u, tree, _ in known.value if u < 0}
        total = np.zeros(n)
        rows, codes, shares = [], [], []
        for t, u, tree, mine in known.value:
            if not mine:
                continue
            own = np.flatnonzero(where[t] == u) if t in where else np.arange(n)
            leaf = ends[t][own] if u < 0 else leaves(tree, x[own])
            if not classify:
                total[own] += tree.value[leaf]
                continue
            sizes = tree.votes_first[leaf + 1] - tree.votes_first[leaf]
            at = np.repeat(tree.votes_first[leaf] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
            rows.append(np.repeat(own, sizes))
            codes.append(tree.votes_class[at])
            shares.append(tree.votes_share[at])
        before = columns[width]
        if not classify:
            return pd.Series(total + before.fillna(0.0).to_numpy(dtype=float))
        if isinstance(before, pd.DataFrame):
            for i, (c, v) in enumerate(zip(before["codes"], before["sums"], strict=True)):
                if c is not None:
                    rows.append(np.full(len(c), i))
                    codes.append(np.asarray(c))
                    shares.append(np.asarray(v))
        row, code, share = (np.concatenate(v) if v else np.empty(0) for v in (rows, codes, shares))
        order = np.lexsort((code, row))
        row, code, share = row[order], code[order], share[order]
        new = np.ones(len(row), dtype=bool)
        new[1:] = (row[1:] != row[:-1]) | (code[1:] != code[:-1])
        share = np.add.reduceat(share, np.flatnonzero(new)) if len(row) else share
        row, code = row[new], code[new].astype(np.int32)
        ends = np.searchsorted(row, np.arange(n + 1))
        return pd.DataFrame({"codes": [code[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)],
                             "sums": [share[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]})

    return add


def _numbered(df: DataFrame, features: list[str], target: str, code: str | None) -> tuple[DataFrame, Any]:
    """Written rows ``id, x, y`` and their statistics; raises with the number of rows that lack something."""
    x = F.array(*[as_number(df, f) for f in features])
    y = F.col(code).cast("double") if code else as_number(df, target)
    whole = reduce(and_, [clean(df, c).isNotNull() for c in [*features, target]])
    spark = df.sparkSession
    if df.rdd.getNumPartitions() < spark.sparkContext.defaultParallelism:      # every tree works on every row
        df = df.repartition(spark.sparkContext.defaultParallelism)
    data = settle(df.select(F.monotonically_increasing_id().alias("id"), x.alias("x"), y.alias("y"),
                            whole.alias("whole")), "forest-rows")
    cuts = [F.percentile_approx(F.get("x", F.lit(i)), F.array(*[F.lit(k / (BINS + 1)) for k in range(1, BINS + 1)]),
                                F.lit(10_000)).alias(f"c{i}") for i in range(len(features))]
    found = data.agg(F.count("*").alias("n"), F.count_if(~F.col("whole")).alias("gaps"), F.avg("y").alias("mean")).first()
    if found["gaps"]:
        raise TrainingError(f"{found['gaps']} rows lack a feature or the target; impute or drop them first")
    if not found["n"]:
        raise TrainingError("no rows to train on")
    edges = [np.empty(0)] * len(features)
    if found["n"] > UNIT_ROWS:
        row = data.agg(*cuts).first()
        edges = [np.unique(np.asarray(row[f"c{i}"], dtype=float)) for i in range(len(features))]
    return data.drop("whole"), (found["n"], found["mean"], edges)


def _matrix(batch: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids = batch.column("id").to_numpy(zero_copy_only=False)
    x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
    return ids, x, batch.column("y").to_numpy(zero_copy_only=False)


def _merged_chunks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Numbers of rows, where each is among the different ones, and those: features and target."""
    def chunk(held):
        ids, x, y = (np.concatenate([h[i] for h in held]) for i in range(3))
        x, y, place = merged(x, y)
        return ids, place, x, y

    held, size = [], 0
    for batch in batches:
        held.append(_matrix(batch, width))
        size += batch.num_rows
        if size >= CHUNK:
            yield chunk(held)
            held, size = [], 0
    if size:
        yield chunk(held)


class _Upper:
    """The part of one tree above its units, while it grows; its ends are units, or leaves with many rows."""

    def __init__(self) -> None:
        self.nodes: list[dict[str, Any]] = [{"feature": -1, "depth": 0}]

    def tree(self) -> Tree:
        """Open nodes and units are marked by the feature ``-2 - number``, leaves by -1."""
        get = lambda k, d: np.array([n.get(k, d) for n in self.nodes])
        number = np.arange(len(self.nodes))
        feature = np.where(get("feature", -1) >= 0, get("feature", -1), np.where(get("leaf", False), -1, -2 - number))
        votes = [(np.full(len(v), i), np.array(list(v)), np.array(list(v.values())))
                 for i, v in enumerate(n.get("votes") or {} for n in self.nodes) if v]
        return Tree(feature.astype(np.int32), get("threshold", 0.0), get("left", -1).astype(np.int32),
                    get("right", -1).astype(np.int32), get("value", 0.0), get("weight", 0.0), get("gain", 0.0),
                    *packed_votes(votes, len(number)))


def _fit(df: DataFrame, features: list[str], target: str, code: str | None, tried: int,
         options: dict[str, Any]) -> tuple[str, int]:
    given = {**DEFAULTS, **{k: v for k, v in options.items() if k in DEFAULTS}}
    depth = np.inf if given["max_depth"] is None else int(given["max_depth"])
    trees, seed, least = int(given["n_estimators"]), int(given["random_state"]), int(given["min_samples_split"])
    if trees < 1 or depth < 0 or least < 2:
        raise TrainingError("a forest needs a tree, a depth of 0 or more and min_samples_split of 2 or more")
    if given["max_features"] is not None:
        tried = int(given["max_features"])
    classify, width = code is not None, len(features)
    data, (n, mean, edges) = _numbered(df, features, target, code)
    drawn = bool(given["bootstrap"])
    weights = lambda ids, t: bootstrap_weights(ids, t, seed) if drawn else np.ones(len(ids))
    uppers = [_Upper() for _ in range(trees)]
    if n > UNIT_ROWS:
        _grow_upper(data, uppers, weights, edges, classify, mean, depth, least, tried, width, seed)
    spark = df.sparkSession
    tops = spark.sparkContext.broadcast([u.tree() for u in uppers])
    depths = spark.sparkContext.broadcast([[node["depth"] for node in u.nodes] for u in uppers])

    sent = spark.sparkContext.accumulator(0)

    def dealt(first: int, last: int):
        """The rows of every unit of the trees from ``first`` to before ``last``; equal ones of a task are merged."""
        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, size = [], 0

            def joined():
                x, y, place = merged(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]))
                w, times = (np.stack([np.bincount(place, v, minlength=len(y)) for v in np.concatenate([h[i] for h in held], axis=1)])
                            for i in (2, 3))
                return x, y, w, times

            def packed() -> pa.RecordBatch:
                x, y, all_w, all_times = joined()
                out: dict[str, list] = {k: [] for k in ("tree", "unit", "x", "y", "w", "times")}
                for t in range(first, last):
                    w, times, top = all_w[t - first], all_times[t - first], tops.value[t]
                    own = np.flatnonzero(w)
                    unit = -2 - top.feature[leaves(top, x[own])].astype(np.int64)
                    order = np.argsort(unit, kind="stable")
                    order = order[unit[order] >= 0]
                    sent.add(len(order))
                    cut = np.flatnonzero(np.diff(unit[order])) + 1
                    for rows in np.split(order, cut) if len(order) else []:
                        at = own[rows]
                        for k, v in (("tree", t), ("unit", int(unit[rows[0]])), ("x", x[at].ravel()), ("y", y[at]),
                                     ("w", w[at]), ("times", times[at].astype(np.int64))):
                            out[k].append(v)
                return pa.RecordBatch.from_pydict(out, pa.schema([
                    ("tree", pa.int32()), ("unit", pa.int32()), ("x", pa.list_(pa.float64())), ("y", pa.list_(pa.float64())),
                    ("w", pa.list_(pa.float64())), ("times", pa.list_(pa.int64()))]))

            for ids, place, x, y in _merged_chunks(batches, width):
                drawn_rows = [weights(ids, t) for t in range(first, last)]
                held.append((x, y, *(np.stack([np.bincount(place, v, minlength=len(y)) for v in rows])
                                     for rows in (drawn_rows, [w > 0 for w in drawn_rows]))))
                size += len(y) * max(8, last - first)
                if size > CELLS:
                    held = [joined()]
                    size = len(held[0][1]) * max(8, last - first)
                    if size > CELLS // 2:       # few are equal
                        yield packed()
                        held, size = [], 0
            if held:
                yield packed()

        return deal

    def grown(rows: pa.Table) -> pa.Table:
        """The tree of one unit, the same whatever order its rows arrive in."""
        t, u = rows.column("tree")[0].as_py(), rows.column("unit")[0].as_py()
        flat = {k: rows.column(k).combine_chunks().flatten().to_numpy(zero_copy_only=False) for k in ("x", "y", "w", "times")}
        x, y, place = merged(flat["x"].reshape(-1, width), flat["y"])
        w, times = (np.bincount(place, flat[k], minlength=len(y)) for k in ("w", "times"))
        tree = grow(x, y, w, classify, depth - depths.value[t][u], least, tried, np.random.default_rng([seed & 0x7FFFFFFF, t, u]),
                    times)
        return pa.table({"tree": pa.array([t], pa.int32()), "unit": pa.array([u], pa.int32()),
                         "n_nodes": pa.array([len(tree.feature)], pa.int64()),
                         **{k: pa.array([v], _LISTS[KINDS[k]]) for k, v in tree._asdict().items()}})

    path = scratch_path(spark, "forest")
    # a number given here is kept: small as they are, units are seconds of work each
    most = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    row_bytes = 8 * width + 24
    room = max(ROUND_BYTES, n * row_bytes)
    at, per_tree = 0, n * row_bytes
    while at < trees:
        to = min(trees, at + max(1, int(room / max(1, per_tree))))
        ends = sum(1 for u in uppers[at:to] for node in u.nodes if node["feature"] < 0 and not node.get("leaf"))
        units = (data.mapInArrow(dealt(at, to), "tree int, unit int, x array<double>, y array<double>, w array<double>, times array<bigint>")
                 .repartition(max(1, min(ends, most)), "tree", "unit").groupBy("tree", "unit").applyInArrow(
                     grown, f"tree int, unit int, n_nodes bigint, {_ARRAYS}"))
        upper = [(t, uppers[t].tree()) for t in range(at, to) if len(uppers[t].nodes) > 1 or uppers[t].nodes[0].get("leaf")]
        if upper:
            units = units.unionByName(spark.createDataFrame(pa.table({
                "tree": pa.array([t for t, _ in upper], pa.int32()), "unit": pa.array([-1] * len(upper), pa.int32()),
                "n_nodes": pa.array([len(x.feature) for _, x in upper], pa.int64()),
                **{k: pa.array([getattr(x, k) for _, x in upper], _LISTS[v]) for k, v in KINDS.items()}})))
        before = sent.value
        with freed_shuffles(spark):
            units.write.mode("append").parquet(path)
        per_tree = (sent.value - before) * row_bytes / (to - at)        # of equal rows a task sends one
        at = to
    drop(data)
    return path, trees


_LISTS = {"array<int>": pa.list_(pa.int32()), "array<double>": pa.list_(pa.float64())}


def _grow_upper(data, uppers, weights, edges, classify, mean, depth, least, tried, width, seed) -> None:
    """Splits every node of more than UNIT_ROWS rows, one level of all trees at a time.

    A pass over the rows serves as many nodes as fit CELLS histogram cells. The
    histograms are added up and searched by Spark; one row per node, its best
    cut, comes back. Where a feature has no more than BINS values, the cuts are
    those that an exact search would find.
    """
    spark = data.sparkSession
    bins = max(len(e) for e in edges) + 1
    open_ = [(t, 0) for t in range(len(uppers))]
    per_pass = max(1, CELLS // (bins * width))
    while open_:
        following: list[tuple[int, int]] = []
        for at in range(0, len(open_), per_pass):
            part = open_[at:at + per_pass]
            slots = {t: {} for t, _ in part}
            for slot, (t, node) in enumerate(part):
                slots[t][node] = slot
            tops = {t: uppers[t].tree() for t in slots}
            found = _histograms(data, spark.sparkContext.broadcast((tops, slots, edges)), weights, bins, width, mean,
                                classify)
            ends = []
            for r in _best_cuts(found, classify, tried, width, seed, at).collect():
                t, node = part[r["slot"]]
                own = uppers[t].nodes[node]
                if r["rows"] <= UNIT_ROWS:
                    continue            # a unit: finished by one task
                own |= {"weight": r["weight"], "value": r["value"] if classify else r["value"] + mean}
                if r["feature"] is None or own["depth"] >= depth or r["rows"] < least:
                    own["leaf"] = True
                    ends.append(r["slot"])
                    continue
                left = len(uppers[t].nodes)
                own |= {"feature": r["feature"], "threshold": r["threshold"], "gain": r["gain"],
                        "left": left, "right": left + 1}
                uppers[t].nodes += [{"feature": -1, "depth": own["depth"] + 1} for _ in range(2)]
                following += [(t, left), (t, left + 1)]
            if classify and ends:
                for r in (found.where((F.col("feature") == 0) & F.col("slot").isin(ends))
                          .groupBy("slot", "class").agg(F.sum("w").alias("w")).collect()):
                    t, node = part[r["slot"]]
                    uppers[t].nodes[node].setdefault("votes", {})[r["class"]] = r["w"]
        open_ = following


def _histograms(data, known, weights, bins, width, mean, classify) -> DataFrame:
    """``slot, feature, bin, class, w, rows, s, q, low, high``: what each bin of each open node holds."""
    names = ["slot", "feature", "bin", "class", "w", "rows", "s", "q", "low", "high", "y_low", "y_high"]

    def placed(batches):
        """Rows of open nodes, one tree and chunk at a time: slot, bin of every feature, values, targets, weights, rows
        that one stands for."""
        tops, slots, edges = known.value
        for ids, of, x, y in _merged_chunks(batches, width):
            place = np.column_stack([np.searchsorted(e, x[:, f]) for f, e in enumerate(edges)])
            for t, top in tops.items():
                drawn = weights(ids, t)
                w, times = np.bincount(of, drawn, minlength=len(y)), np.bincount(of, drawn > 0, minlength=len(y))
                own = np.flatnonzero(w)
                node = -2 - top.feature[leaves(top, x[own])].astype(np.int64)
                slot = np.array([*(slots[t].get(i, -1) for i in range(len(top.feature))), -1])[node]     # -1: a leaf
                own, slot = own[slot >= 0], slot[slot >= 0]
                yield slot, place[own], x[own], y[own], w[own], times[own]

    def numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of numeric targets: one set of cells per task, sent once."""
        size = sum(map(len, known.value[1].values())) * width * bins
        total = {k: np.zeros(size) for k in ("w", "rows", "s", "q")}
        total |= {k: np.full(size, np.inf) for k in ("low", "y_low")}
        total |= {k: np.full(size, -np.inf) for k in ("high", "y_high")}
        for slot, place, x, y, w, times in placed(batches):
            off = y - mean
            for f in range(width):
                cell = (slot * width + f) * bins + place[:, f]
                for k, v in (("w", w), ("rows", times), ("s", w * off), ("q", w * off * off)):
                    np.add.at(total[k], cell, v)        # as long as the rows, however many cells are open
                np.minimum.at(total["low"], cell, x[:, f])
                np.maximum.at(total["high"], cell, x[:, f])
                np.minimum.at(total["y_low"], cell, y)
                np.maximum.at(total["y_high"], cell, y)
        used = np.flatnonzero(total["rows"])
        keys = used // (width * bins), used // bins % width, used % bins, np.zeros(len(used))
        yield pa.RecordBatch.from_arrays(
            [*[pa.array(k.astype(np.int32)) for k in keys],
             *[pa.array(total[k][used].astype(np.int64 if k == "rows" else np.float64)) for k in names[4:]]], names)

    def classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of classes, however many: one row per cell and class of a batch."""
        for slot, place, x, y, w, times in placed(batches):
            for f in range(width):
                key = np.stack([slot, place[:, f], y.astype(np.int64)])
                order = np.lexsort(key[::-1])
                key, own, value, code = key[:, order], w[order], x[order, f], y[order]
                new = np.ones(len(order), dtype=bool)
                new[1:] = (key[:, 1:] != key[:, :-1]).any(axis=0)
                first = np.flatnonzero(new)
                if len(first):
                    zero = np.zeros(len(first))
                    yield pa.RecordBatch.from_arrays([
                        pa.array(key[0, first], pa.int32()), pa.array(np.full(len(first), f), pa.int32()),
                        pa.array(key[1, first], pa.int32()), pa.array(key[2, first], pa.int32()),
                        pa.array(np.add.reduceat(own, first)), pa.array(np.add.reduceat(times[order], first).astype(np.int64)),
                        pa.array(zero), pa.array(zero), pa.array(np.minimum.reduceat(value, first)),
                        pa.array(np.maximum.reduceat(value, first)), pa.array(code[first]), pa.array(code[first])], names)

    return (data.mapInArrow(classes if classify else numbers, "slot int, feature int, bin int, class int, w double, rows bigint, s double, "
                                   "q double, low double, high double, y_low double, y_high double")
            .groupBy("slot", "feature", "bin", "class").agg(
                F.sum("w").alias("w"), F.sum("rows").alias("rows"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.min("low").alias("low"),
                F.max("high").alias("high"), F.min("y_low").alias("y_low"), F.max("y_high").alias("y_high")))


def _best_cuts(found: DataFrame, classify: bool, tried: int, width: int, seed: int, salt: int) -> DataFrame:
    """``slot, rows, weight, value, feature, threshold, gain`` of every open node; null where nothing can be cut."""
    cut = W.partitionBy("slot", "feature").orderBy("bin")
    upto = cut.rowsBetween(W.unboundedPreceding, W.currentRow)
    whole = W.partitionBy("slot", "feature")
    if classify:
        of_class = W.partitionBy("slot", "feature", "class")
        seen = F.sum("w").over(of_class.orderBy("bin").rowsBetween(W.unboundedPreceding, W.currentRow))
        found = found.withColumn("seen", seen).withColumn("of_class", F.sum("w").over(of_class)).withColumn(
            "squares", F.pow("seen", F.lit(2)) - F.pow(F.col("seen") - F.col("w"), F.lit(2))).withColumn(
            "product", F.col("w") * F.col("of_class")).withColumn("zero", F.when(F.col("class") == 0, F.col("w")))
        extra = [F.sum("squares").alias("squares"), F.sum("product").alias("product"), F.sum("zero").alias("s")]
    else:
        extra = [F.sum("s").alias("s"), F.sum("q").alias("q")]
    bins = found.groupBy("slot", "feature", "bin").agg(
        F.sum("w").alias("w"), F.sum("rows").alias("rows"), F.min("low").alias("low"), F.max("high").alias("high"),
        F.min("y_low").alias("y_low"), F.max("y_high").alias("y_high"), *extra)
    run = bins.select(
        "slot", "feature", "bin", "high", F.lead("low").over(cut).alias("next"), F.sum("w").over(upto).alias("wl"),
        F.sum("w").over(whole).alias("wt"), F.sum("rows").over(whole).alias("rows"), F.sum("s").over(upto).alias("sl"),
        F.sum("s").over(whole).alias("st"), F.min("y_low").over(whole).alias("y_low"),
        F.max("y_high").over(whole).alias("y_high"),
        *([F.sum("squares").over(upto).alias("ql"), F.sum("product").over(upto).alias("pl"),
           F.sum("product").over(whole).alias("pt")] if classify else [F.sum("q").over(whole).alias("qt")]))
    rest = F.col("wt") - F.col("wl")
    if classify:
        gain = F.col("ql") / F.col("wl") + (F.col("pt") - 2 * F.col("pl") + F.col("ql")) / rest - F.col("pt") / F.col("wt")
        impurity = F.col("wt") - F.col("pt") / F.col("wt")
    else:
        moved = F.col("sl") - F.col("wl") * F.col("st") / F.col("wt")
        gain = moved * moved * (1 / F.col("wl") + 1 / rest)
        impurity = F.col("qt") - F.col("st") * F.col("st") / F.col("wt")
    able = F.col("next").isNotNull() & (F.col("y_low") < F.col("y_high"))
    middle = F.col("high") + (F.col("next") - F.col("high")) / 2
    run = run.withColumn("cut", F.when(able, F.struct(
        F.greatest(F.round(gain / impurity, DIGITS), F.lit(0.0)).alias("share"), (-F.col("feature")).alias("f"), (-F.col("bin")).alias("b"),
        F.when(middle < F.col("next"), middle).otherwise(F.col("high")).alias("threshold"), gain.alias("gain"))))
    per = run.groupBy("slot", "feature").agg(F.max("cut").alias("cut"), F.max("rows").alias("rows"),
                                             F.max("wt").alias("weight"), F.max("st").alias("total"))
    draw = W.partitionBy("slot").orderBy(F.col("cut").isNull(), F.xxhash64(F.lit(seed), F.lit(salt), "slot", "feature"))
    if tried < width:
        per = per.withColumn("cut", F.when(F.row_number().over(draw) <= tried, F.col("cut")))
    best = per.groupBy("slot").agg(F.max("cut").alias("cut"), F.max("rows").alias("rows"), F.max("weight").alias("weight"),
                                   F.max("total").alias("total"))
    return best.select("slot", "rows", "weight", (F.coalesce("total", F.lit(0.0)) / F.col("weight")).alias("value"),
                       (-F.col("cut.f")).alias("feature"), F.col("cut.threshold").alias("threshold"),
                       F.col("cut.gain").alias("gain"))


def fit_forest(df: DataFrame, features: list[str], target: str, **options) -> ForestModel:
    """Regression forest; all features are tried in every node unless ``max_features`` says fewer."""
    path, trees = _fit(df, features, target, None, len(features), options)
    return ForestModel("random_forest", features, path, trees)


def fit_forest_classifier(df: DataFrame, features: list[str], target: str, **options) -> ForestModel:
    """Classification forest for any number of classes; the square root of the features is tried in every node."""
    labels = fit_categories(df, [target])[target]
    coded = with_code(df, target, labels, "__code", unseen="null")
    path, trees = _fit(coded, features, target, "__code", max(1, int(np.sqrt(len(features)))), options)
    return ForestModel("random_forest_classifier", features, path, trees, labels)
