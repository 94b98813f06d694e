"""Gradient-boosted trees over dense features and isotonic calibration, in numpy."""

from __future__ import annotations

import numpy as np


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class BoostedTrees:
    """Second-order boosting of complete binary trees of a fixed depth on binned features with logistic loss."""

    def __init__(self, trees: int = 60, depth: int = 4, rate: float = 0.15, bins: int = 64, leaf_weight: float = 1.0):
        self.trees, self.depth, self.rate, self.bins, self.leaf_weight = trees, depth, rate, bins, leaf_weight

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        n, width = x.shape
        self.edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, self.bins + 1)[1:-1])) for f in range(width)]
        binned = np.stack([np.searchsorted(self.edges[f], x[:, f], side="left") for f in range(width)], axis=1)
        rate = np.clip(y.mean(), 1e-4, 1 - 1e-4)
        self.base = float(np.log(rate / (1 - rate)))
        score = np.full(n, self.base)
        self.feature, self.cut, self.value = [], [], []
        inner = (1 << self.depth) - 1
        for _ in range(self.trees):
            p = _sigmoid(score)
            g, h = p - y, p * (1 - p)
            node = np.zeros(n, dtype=np.int64)
            feature, cut = np.zeros(inner, dtype=np.int64), np.full(inner, np.inf)
            for level in range(self.depth):
                first, k = (1 << level) - 1, 1 << level
                at = node - first
                best = np.full(k, 1e-9)
                gt, ht = np.bincount(at, g, k), np.bincount(at, h, k)
                for f in range(width):
                    if not len(self.edges[f]):
                        continue
                    nb = len(self.edges[f]) + 1
                    cell = at * nb + binned[:, f]
                    gl = np.cumsum(np.bincount(cell, g, k * nb).reshape(k, nb), axis=1)[:, :-1]
                    hl = np.cumsum(np.bincount(cell, h, k * nb).reshape(k, nb), axis=1)[:, :-1]
                    gr, hr = gt[:, None] - gl, ht[:, None] - hl
                    lam = self.leaf_weight
                    gain = gl**2 / (hl + lam) + gr**2 / (hr + lam) - (gt**2 / (ht + lam))[:, None]
                    gain[(hl < 0.5) | (hr < 0.5)] = 0
                    top = gain.argmax(axis=1)
                    found = gain[np.arange(k), top]
                    for j in np.flatnonzero(found > best):
                        best[j], feature[first + j], cut[first + j] = found[j], f, self.edges[f][top[j]]
                node = 2 * node + 1 + (x[np.arange(n), feature[node]] > cut[node])
            leaf = node - inner
            value = -np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + self.leaf_weight) * self.rate
            score = score + value[leaf]
            self.feature.append(feature)
            self.cut.append(cut)
            self.value.append(value)
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log odds."""
        rows = np.arange(len(x))
        total = np.full(len(x), self.base)
        inner = (1 << self.depth) - 1
        for feature, cut, value in zip(self.feature, self.cut, self.value):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            total += value[node - inner]
        return total


class Isotonic:
    """Monotone calibration by pooling adjacent violators, linear between the pools' centres."""

    def fit(self, score: np.ndarray, y: np.ndarray) -> Isotonic:
        order = np.argsort(score, kind="stable")
        pools: list[list[float]] = []
        for s, v in zip(score[order], y[order]):
            pools.append([v, 1.0, s])
            while len(pools) > 1 and pools[-2][0] / pools[-2][1] >= pools[-1][0] / pools[-1][1]:
                v1, n1, s1 = pools.pop()
                v0, n0, s0 = pools.pop()
                pools.append([v0 + v1, n0 + n1, (s0 * n0 + s1 * n1) / (n0 + n1)])
        # one success and one failure shared among the rows keep the ends off 0 and 1
        rate = (y.sum() + 0.5) / (len(y) + 1) if len(y) else 0.5
        self.at = np.array([p[2] for p in pools] or [0.0])
        self.p = np.array([(p[0] + rate) / (p[1] + 1) for p in pools] or [rate])
        self.p = np.maximum.accumulate(self.p)
        return self

    def probability(self, score: np.ndarray) -> np.ndarray:
        return np.interp(score, self.at, self.p)
