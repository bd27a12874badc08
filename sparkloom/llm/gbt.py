"""Histogram gradient boosting for binary labels, kept as flat arrays.

Trees are complete binary trees of one depth in heap order, so a whole batch walks down all of them with
``depth`` gathers and no branch.  A node that was not split sends every row left.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Forest:
    """feature, threshold: (trees, 2**depth - 1); leaf: (trees, 2**depth); base: log-odds before any tree."""

    depth: int
    base: float
    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of each row of ``x`` (rows, features)."""
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            out += leaf[node - (2**self.depth - 1)]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.margin(x), -40.0, 40.0)))


def fit(
    x: np.ndarray,
    y: np.ndarray,
    trees: int = 60,
    depth: int = 4,
    rate: float = 0.15,
    bins: int = 64,
    l2: float = 1.0,
    least: float = 1.0,
) -> Forest:
    """Fit on rows ``x`` and labels ``y``.  Without rows, or with one class only, the forest has no tree and a smoothed base rate."""
    n, width = x.shape if x.ndim == 2 else (0, 0)
    rate_of_ones = (float(y.sum()) + 1.0) / (n + 2.0)
    base = float(np.log(rate_of_ones / (1.0 - rate_of_ones)))
    inner = 2**depth - 1
    if n == 0 or y.min() == y.max():
        return Forest(depth, base, np.zeros((0, inner), int), np.zeros((0, inner)), np.zeros((0, inner + 1)))
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(width)]
    binned = np.stack([np.searchsorted(edges[f], x[:, f], side="left") for f in range(width)])
    margin = np.full(n, base)
    features, thresholds, leaves = [], [], []
    for _ in range(trees):
        p = 1.0 / (1.0 + np.exp(-margin))
        g, h = p - y, np.maximum(p * (1 - p), 1e-9)
        feature, threshold = np.zeros(inner, int), np.full(inner, np.inf)
        node = np.zeros(n, dtype=np.int64)
        for level in range(depth):
            first, count = 2**level - 1, 2**level
            at = (node - first) * (bins + 1)
            best = np.full(count, 1e-6)
            for f in range(width):
                key = at + binned[f]
                gl = np.cumsum(np.bincount(key, g, count * (bins + 1)).reshape(count, -1), axis=1)
                hl = np.cumsum(np.bincount(key, h, count * (bins + 1)).reshape(count, -1), axis=1)
                gt, ht = gl[:, -1:], hl[:, -1:]
                gain = gl**2 / (hl + l2) + (gt - gl) ** 2 / (ht - hl + l2) - gt**2 / (ht + l2)
                gain[(hl < least) | (ht - hl < least)] = -1.0
                gain = gain[:, : len(edges[f])]
                if not gain.size:
                    continue
                cut = gain.argmax(axis=1)
                top = gain[np.arange(count), cut]
                better = np.flatnonzero(top > best)
                best[better] = top[better]
                feature[first + better] = f
                threshold[first + better] = edges[f][cut[better]]
            node = 2 * node + 1 + (x[np.arange(n), feature[node]] > threshold[node])
        at = node - inner
        leaf = -rate * np.bincount(at, g, inner + 1) / (np.bincount(at, h, inner + 1) + l2)
        margin += leaf[at]
        features.append(feature)
        thresholds.append(threshold)
        leaves.append(leaf)
    return Forest(depth, base, np.array(features), np.array(thresholds), np.array(leaves))
