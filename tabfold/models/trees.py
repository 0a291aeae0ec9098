"""Trees grown inside one task, by the rules of pyspark.ml, for training frames that one task holds.

pyspark.ml starts two stages for every level of every tree.  Where a frame is one task anyway, hundreds of small trees are
thousands of stages with next to no work in them; here that task grows them all.  Bins, impurities, gains, leaves and
boosting rounds are those of pyspark.ml; bags and feature subsets come from another random generator.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

FOREST_BINS = 32
#: Spark stops boosting when the held-out error falls by less than this share.
VALIDATION_TOL = 0.01
#: Nodes of all trees of a model; beyond them the fit is left to pyspark.ml.
MOST_NODES = 1 << 22
#: Row and tree pairs scored at once.
PAIRS = 1 << 20


#: Rows times features times trees that one task is given.
MOST_WORK = 1 << 26


class TooMuch(Exception):
    """One task should not grow this."""


@dataclass
class Trees:
    """Nodes of all trees: ``feature`` is -1 in a leaf, rows of a bin up to ``cut`` go to ``left``, others to ``left + 1``."""

    borders: list[np.ndarray]
    roots: np.ndarray
    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    value: np.ndarray

    def sums(self, features: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """The weighted sum of the leaves of each row, equal binned rows being looked up once."""
        rows, inverse = np.unique(binned(features, self.borders), axis=0, return_inverse=True)
        out = np.empty((len(rows), self.value.shape[1]))
        step = max(1, PAIRS // len(self.roots))
        for at in range(0, len(rows), step):
            part = rows[at : at + step]
            node = np.broadcast_to(self.roots, (len(part), len(self.roots))).copy()
            while True:
                feature = self.feature[node]
                inner = feature >= 0
                if not inner.any():
                    break
                beyond = np.take_along_axis(part, np.maximum(feature, 0), 1) > self.cut[node]
                node = np.where(inner, self.left[node] + beyond, node)
            out[at : at + step] = np.einsum("rtk,t->rk", self.value[node], weights)
        return out[inverse.reshape(-1)]


def borders(features: np.ndarray, weight: np.ndarray, bins: int) -> list[np.ndarray]:
    """Split points of each feature: between all values, or, of too many, at even steps of their weight."""
    found = []
    most = min(bins, len(features)) - 1
    for column in features.T:
        values, place = np.unique(column, return_inverse=True)
        between = (values[1:] + values[:-1]) / 2
        if len(between) > most:
            counts = np.bincount(place, weight)
            stride = counts.sum() / (most + 1)
            target, seen, kept = stride, np.cumsum(counts), []
            for i in range(1, len(values)):
                if abs(seen[i - 1] - target) < abs(seen[i] - target):
                    kept.append(i - 1)
                    target += stride
            between = between[kept]
        found.append(between)
    return found


def binned(features: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    columns = [np.searchsorted(c, x, "left") for c, x in zip(cuts, features.T)]
    return np.stack(columns, 1).astype(np.int32) if columns else np.zeros((len(features), 0), np.int32)


def _gini(stats: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    total = stats.sum(-1)
    return total, 1 - ((stats / np.where(total > 0, total, 1.0)[..., None]) ** 2).sum(-1)


def _variance(stats: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    total = np.where(stats[..., 0] > 0, stats[..., 0], 1.0)
    return stats[..., 0], (stats[..., 2] - stats[..., 1] ** 2 / total) / total


class Grower:
    """The nodes of a growing ensemble over one set of binned rows."""

    def __init__(self, bins: np.ndarray, depth: int, impurity, value, subset: int | None = None, random=None):
        self.bins, self.depth, self.impurity, self.value = bins, depth, impurity, value
        self.subset, self.random = subset, random
        self.width = int(bins.max(initial=0)) + 1
        self.parts: list[tuple] = []
        self.size = 0
        self.roots: list[int] = []

    def _best(self, rows: np.ndarray, node: np.ndarray, stats: np.ndarray, totals: np.ndarray):
        """Gain, feature and cut of the best split of each node."""
        n = len(totals)
        gain, feature, cut = np.zeros(n), np.full(n, -1, np.int32), np.zeros(n, np.int32)
        weight, whole = self.impurity(totals)
        allowed = None
        if self.subset is not None and self.subset < self.bins.shape[1]:
            order = self.random.random((n, self.bins.shape[1])).argsort(1)
            allowed = np.zeros(order.shape, bool)
            np.put_along_axis(allowed, order[:, : self.subset], True, 1)
        for j in range(self.bins.shape[1]):
            key, place = np.unique(node * self.width + self.bins[rows, j], return_inverse=True)
            sums = np.stack([np.bincount(place, stats[:, s], len(key)) for s in range(stats.shape[1])], 1)
            owner = key // self.width
            ahead = np.cumsum(sums, 0)
            first = np.searchsorted(owner, np.arange(n))
            before = np.where((first > 0)[:, None], ahead[np.maximum(first - 1, 0)], 0.0)
            lower = ahead - before[owner]
            upper = totals[owner] - lower
            last = np.append(owner[1:] != owner[:-1], True)
            low_weight, low = self.impurity(lower)
            high_weight, high = self.impurity(upper)
            won = whole[owner] - (low_weight * low + high_weight * high) / weight[owner]
            won[last] = -np.inf
            if allowed is not None:
                won[~allowed[owner, j]] = -np.inf
            top = np.maximum.reduceat(won, first)
            at = np.flatnonzero(won == top[owner])
            chosen = at[np.searchsorted(owner[at], np.arange(n))]
            better = top > gain
            gain[better], feature[better] = top[better], j
            cut[better] = (key[chosen] % self.width)[better]
        return gain, feature, cut

    def grow(self, stats: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Grows one tree over ``rows`` with their ``stats``; returns the value of the leaf of every row of all bins."""
        start, end = self.size, self.size + 1
        self.roots.append(start)
        node = np.zeros(len(rows), np.int64)
        reached = np.full(len(rows), start, np.int64)
        totals = stats.sum(0, keepdims=True)
        levels = []
        live = np.arange(len(rows))
        for level in range(self.depth + 1):
            n = len(totals)
            if level < self.depth:
                gain, feature, cut = self._best(rows[live], node, stats[live], totals)
                feature[gain <= 0] = -1
            else:
                feature, cut = np.full(n, -1, np.int32), np.zeros(n, np.int32)
            split = feature >= 0
            left = np.where(split, end + 2 * (np.cumsum(split) - 1), 0)
            levels.append([feature, cut, left, totals])
            if not split.any():
                break
            moving = split[node]
            live, node = live[moving], node[moving]
            beyond = self.bins[rows[live], feature[node]] > cut[node]
            reached[live] = left[node] + beyond
            node = reached[live] - end
            n = 2 * int(split.sum())
            totals = np.stack([np.bincount(node, stats[live, s], n) for s in range(stats.shape[1])], 1)
            self.size, end = end, end + n
            if end > MOST_NODES:
                raise TooMuch
        self.size = end
        feature, cut, left, totals = (np.concatenate(x) for x in zip(*levels))
        value = self.value(totals)
        self.parts.append((feature, cut, left, value))
        return value[reached - start]

    def trees(self, cuts: list[np.ndarray]) -> Trees:
        feature, cut, left, value = (np.concatenate(x) for x in zip(*self.parts))
        return Trees(cuts, np.array(self.roots), feature.astype(np.int32), cut.astype(np.int32), left.astype(np.int64), value)


def _shares(totals: np.ndarray) -> np.ndarray:
    return totals / totals.sum(1, keepdims=True)


def _merge_agreeing(trees: Trees) -> Trees:
    """Two leaves of one parent that name the same class become a leaf, as in pyspark.ml."""
    names = trees.value.argmax(1)
    inner = np.flatnonzero(trees.feature >= 0)[::-1]
    while True:
        low = trees.left[inner]
        both = (trees.feature[low] < 0) & (trees.feature[low + 1] < 0) & (names[low] == names[low + 1])
        if not both.any():
            return trees
        trees.feature[inner[both]] = -1
        names[inner[both]] = names[low[both]]
        inner = inner[~both]


def forest(features, codes, weight, classes: int, n_trees: int, depth: int, seed: int) -> Trees:
    """Bagged classification trees: bags are Poisson counts, a node looks at the root of the features."""
    if features.size * n_trees > MOST_WORK:
        raise TooMuch
    cuts = borders(features, weight, FOREST_BINS)
    random = np.random.default_rng(seed)
    subset = int(np.ceil(np.sqrt(features.shape[1])))
    grower = Grower(binned(features, cuts), depth, _gini, _shares, subset, random)
    counts = np.zeros((len(codes), classes))
    counts[np.arange(len(codes)), codes] = weight
    # parts of equal rows have bags of their own, and are then one row of the tree
    same, place = np.unique(np.column_stack([grower.bins, codes]), axis=0, return_inverse=True)
    place = place.reshape(-1)
    grower.bins = same[:, :-1]
    for _ in range(n_trees):
        bag = random.poisson(1.0, len(codes))
        stats = np.stack([np.bincount(place, counts[:, c] * bag, len(same)) for c in range(classes)], 1)
        drawn = np.flatnonzero(stats.sum(1))
        grower.grow(stats[drawn], drawn)
    return _merge_agreeing(grower.trees(cuts))


def boosted(features, target, weight, held_out, *, rounds: int, rate: float, depth: int, bins: int) -> tuple[Trees, np.ndarray]:
    """Regression trees on the gradients of the log loss of ``target`` -1 and 1, with their weights."""
    if features.size * rounds > MOST_WORK:
        raise TooMuch
    fitted = np.ones(len(target), bool) if held_out is None else ~held_out
    cuts = borders(features[fitted], weight[fitted], bins)
    grower = Grower(binned(features, cuts), depth, _variance, lambda t: (t[:, 1] / t[:, 0])[:, None])
    rows, y, w = np.flatnonzero(fitted), target[fitted], weight[fitted]
    at = np.zeros(len(y))
    best, kept = np.inf, 1
    judged = None if held_out is None else np.zeros(int(held_out.sum()))
    for m in range(rounds):
        goal = y if m == 0 else 4 * y / (1 + np.exp(np.minimum(2 * y * at, 700)))
        at += (1.0 if m == 0 else rate) * grower.grow(np.stack([w, w * goal, w * goal * goal], 1), rows)[:, 0]
        if judged is None:
            continue
        one = Trees(cuts, np.zeros(1, np.int64), *grower.parts[-1])
        one.left = np.where(one.feature >= 0, one.left - grower.roots[-1], 0)
        judged += (1.0 if m == 0 else rate) * one.sums(features[held_out], np.ones(1))[:, 0]
        error = np.average(2 * np.logaddexp(0, -2 * target[held_out] * judged), weights=weight[held_out])
        if m == 0:
            best = error
        elif best - error < VALIDATION_TOL * max(error, 0.01):
            break
        elif error < best:
            best, kept = error, m + 1
    rounds = len(grower.roots) if judged is None else kept
    trees = grower.trees(cuts)
    trees.roots = trees.roots[:rounds]
    return trees, np.array([1.0] + [rate] * (rounds - 1))
