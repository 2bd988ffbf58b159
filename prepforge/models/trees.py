"""Decision trees as arrays: growing one task's rows exactly, and walking down.

A tree is held by its nodes, parents before children: ``feature`` (-1 in a
leaf), ``threshold`` (values up to it go left), ``left``, ``right``, ``value``
(the mean target, or the share of the first class), ``weight`` (of the rows
that reach the node), ``gain`` (weighted impurity that the split takes away).
Leaves of a classifier also hold the shares of their classes.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np


DIGITS = 10             # of the share of impurity that a cut takes; cuts equal to them are equal


class Tree(NamedTuple):
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    weight: np.ndarray
    gain: np.ndarray
    votes_first: np.ndarray     # where the votes of each node begin, and one end more
    votes_class: np.ndarray
    votes_share: np.ndarray


#: Types of the arrays in tables.
KINDS = {"feature": "array<int>", "threshold": "array<double>", "left": "array<int>", "right": "array<int>",
         "value": "array<double>", "weight": "array<double>", "gain": "array<double>",
         "votes_first": "array<int>", "votes_class": "array<int>", "votes_share": "array<double>"}


def bootstrap_weights(ids: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """How often each row is drawn for a tree: Poisson with mean 1, a function of row, tree and seed."""
    x = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64((seed * 1_000_003 + tree) & (2 ** 64 - 1))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    u = ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) / 2.0 ** 53
    upto = np.cumsum(np.exp(-1.0) / np.cumprod(np.concatenate([[1.0], np.arange(1, 20)])))
    return np.searchsorted(upto, u, side="right").astype(np.float64)


def merged(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different rows, in order, and where each row is among them."""
    order = np.lexsort((y, *x.T[::-1]))
    new = np.ones(len(y), dtype=bool)
    new[1:] = (x[order[1:]] != x[order[:-1]]).any(axis=1) | (y[order[1:]] != y[order[:-1]])
    place = np.empty(len(y), dtype=np.int64)
    place[order] = np.cumsum(new) - 1
    return x[order[new]], y[order[new]], place


def _class_votes(node: np.ndarray, code: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Node, class and weight of every class in every node."""
    order = np.lexsort((code, node))
    node, code = node[order], code[order]
    new = np.ones(len(node), dtype=bool)
    new[1:] = (node[1:] != node[:-1]) | (code[1:] != code[:-1])
    return node[new], code[new], np.add.reduceat(weight[order], np.flatnonzero(new)) if len(node) else weight


def grow(x: np.ndarray, y: np.ndarray, w: np.ndarray, classify: bool, max_depth: float, min_split: int,
         tried: int, rng: np.random.Generator, times: np.ndarray | None = None) -> Tree:
    """A tree grown level by level on exact values until its leaves are pure.

    ``times`` says how many rows each row stands for, all of which make up its weight.

    A node is split while it has ``min_split`` rows, different targets, some
    feature that differs, and depth is left; the best of ``tried`` features
    (drawn per node among those that differ) wins, of equal splits the first
    feature and lowest threshold. Thresholds lie midway between neighbours.
    Every level costs a few passes over the rows, whatever the number of nodes.
    """
    n, d = x.shape
    times = np.ones(n, dtype=np.int64) if times is None else times
    perm = [np.argsort(x[:, f], kind="stable") for f in range(d)]
    bounds, ids = np.array([0, n]), np.array([0])
    out: dict[str, list[np.ndarray]] = {k: [] for k in Tree._fields[:7]}
    votes: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    depth = made = 0
    while len(ids):
        rows, sizes = perm[0], np.diff(bounds)
        starts, at = bounds[:-1], np.repeat(np.arange(len(ids)), sizes)
        weight = np.add.reduceat(w[rows], starts)
        share = (y == 0).astype(np.float64) if classify else y
        value = np.add.reduceat((w * share)[rows], starts) / weight
        mixed = np.minimum.reduceat(y[rows], starts) < np.maximum.reduceat(y[rows], starts)
        level = {"feature": np.full(len(ids), -1, np.int32), "threshold": np.zeros(len(ids)),
                 "left": np.full(len(ids), -1, np.int32), "right": np.full(len(ids), -1, np.int32),
                 "value": value, "weight": weight, "gain": np.zeros(len(ids))}
        able = mixed & (np.add.reduceat(times[rows], starts) >= min_split) if depth < max_depth else np.zeros(len(ids), dtype=bool)
        gains, places = np.full((d, len(ids)), -1.0), np.zeros((d, len(ids)), dtype=np.int64)
        total = np.zeros(len(ids))
        if able.any():
            for f in range(d):
                gains[f], places[f], found = _best_places(x[:, f], y, w, perm[f], starts, sizes, at, classify)
                total = np.maximum(total, found)
            gains[:, ~able] = -1.0
            if tried < d:
                rank = np.where(gains >= 0, rng.random(gains.shape), 2.0).argsort(axis=0).argsort(axis=0)
                gains[rank >= tried] = -1.0
        best = gains.argmax(axis=0)
        gain = gains[best, np.arange(len(ids))]
        split = gain >= 0
        if split.any():
            f, place = best[split], places[best, np.arange(len(ids))][split]
            low, high = np.empty(len(f)), np.empty(len(f))
            for k in range(d):
                own = f == k
                low[own], high[own] = x[perm[k][place[own]], k], x[perm[k][place[own] + 1], k]
            cut = low + (high - low) / 2
            cut = np.where(cut < high, cut, low)
            level["feature"][split], level["threshold"][split], level["gain"][split] = f, cut, (gain * total)[split]
            first = made + len(ids) + 2 * np.arange(int(split.sum()))
            level["left"][split], level["right"][split] = first, first + 1
        if classify and not split.all():
            leaf = ~split[at]
            votes.append(_class_votes(made + at[leaf], y[rows[leaf]].astype(np.int64), w[rows[leaf]]))
        for k, v in level.items():
            out[k].append(v)
        made += len(ids)
        if not split.any():
            break
        kept = split[at]
        number = np.cumsum(split) - 1
        of = np.empty(n, dtype=np.int64)            # the split node of each row
        of[rows[kept]] = number[at[kept]]
        goes = np.zeros(n, dtype=bool)
        inside = rows[kept]
        goes[inside] = x[inside, f[of[inside]]] <= cut[of[inside]]
        size = sizes[split]
        start = np.cumsum(size) - size
        n_left = np.add.reduceat(goes[inside].astype(np.int64), start)
        for k in range(d):
            own = perm[k][kept]
            left = goes[own]
            node = np.repeat(np.arange(len(size)), size)
            before = np.cumsum(left) - left         # rows to the left before each, all nodes
            before -= before[start][node]
            inside_at = np.arange(len(own)) - start[node]
            place_at = start[node] + np.where(left, before, n_left[node] + inside_at - before)
            moved = np.empty_like(own)
            moved[place_at] = own
            perm[k] = moved
        bounds = np.empty(2 * len(size) + 1, dtype=np.int64)
        bounds[0:-1:2], bounds[1::2], bounds[-1] = start, start + n_left, len(inside)
        ids = np.arange(2 * len(size))
        depth += 1
    arrays = [np.concatenate(out[k]) for k in Tree._fields[:7]]
    return Tree(*arrays, *packed_votes(votes, made))


def packed_votes(votes: list[tuple[np.ndarray, np.ndarray, np.ndarray]], nodes: int) -> tuple[np.ndarray, ...]:
    node, code, weight = ((np.concatenate([v[i] for v in votes]) for i in range(3)) if votes
                          else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)))
    order = np.argsort(node, kind="stable")
    node, code, weight = node[order], code[order], weight[order]
    first = np.searchsorted(node, np.arange(nodes + 1)).astype(np.int32)
    total = np.bincount(node, weights=weight, minlength=nodes)
    return first, code.astype(np.int32), weight / total[node]


def _best_places(column, y, w, perm, starts, sizes, at, classify) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per node the best share of impurity that a cut behind a row takes, and where that row stands in ``perm``.

    Without a cut the share is -1.
    """
    xs, ws, ys = column[perm], w[perm], y[perm]
    n = len(perm)
    weight = np.add.reduceat(ws, starts)

    def running(values):
        total = np.cumsum(values)
        before = np.concatenate([[0.0], total])[starts]
        return total - before[at]

    left = running(ws)
    right = weight[at] - left
    with np.errstate(divide="ignore", invalid="ignore"):
        if classify:
            order = np.lexsort((np.arange(n), ys, at))          # rows of one class of a node side by side
            new = np.ones(n, dtype=bool)
            new[1:] = (at[order][1:] != at[order][:-1]) | (ys[order][1:] != ys[order][:-1])
            group = np.cumsum(new) - 1
            summed = np.cumsum(ws[order])
            first = np.concatenate([[0.0], summed])[np.flatnonzero(new)]
            seen, of_class = np.empty(n), np.empty(n)           # weight of the row's class before it, and in all
            seen[order] = summed - ws[order] - first[group]
            of_class[order] = np.add.reduceat(ws[order], np.flatnonzero(new))[group]
            squares = running(ws * (2 * seen + ws))
            whole = np.add.reduceat(ws * of_class, starts)[at]
            rest = whole - 2 * running(ws * of_class) + squares
            gain = squares / left + rest / right - whole / weight[at]
            total = weight - np.add.reduceat(ws * of_class, starts) / weight
        else:
            mean = np.add.reduceat(ws * ys, starts) / weight
            off = ws * (ys - mean[at])
            moved = running(off)
            gain = moved * moved * (1 / left + 1 / right)
            total = np.add.reduceat(off * (ys - mean[at]), starts)
        gain = np.round(gain / total[at], DIGITS)
    usable = np.zeros(n, dtype=bool)
    usable[:-1] = (xs[:-1] < xs[1:]) & (at[:-1] == at[1:])
    gain = np.where(usable, np.maximum(gain, 0.0), -1.0)
    best = np.maximum.reduceat(gain, starts)
    total = np.where(best >= 0, total, 0.0)
    hits = np.flatnonzero(gain == best[at])
    nodes, place = np.unique(at[hits], return_index=True)
    out = np.zeros(len(sizes), dtype=np.int64)
    out[nodes] = hits[place]
    return best, out, total


def leaves(tree: Tree, x: np.ndarray) -> np.ndarray:
    """The leaf that each row ends in. A missing value goes right. Every right child follows its left one."""
    number = np.arange(len(tree.feature))
    ends = tree.feature < 0                     # a leaf leads to itself
    feature = np.where(ends, 0, tree.feature).astype(np.int64)
    left = np.where(ends, number, tree.left).astype(np.int64)
    threshold = np.where(ends, np.inf, tree.threshold)
    values = np.where(np.isnan(x), np.inf, x).ravel()
    row = np.arange(len(x), dtype=np.int64) * x.shape[1]
    node = np.zeros(len(x), dtype=np.int64)
    while True:
        following = left[node] + (values[row + feature[node]] > threshold[node])
        if (following == node).all():
            return node
        node = following
