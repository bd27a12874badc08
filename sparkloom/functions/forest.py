"""Regression models on bounded samples, kept as plain lists: ridge, bagged trees, boosted trees."""

from __future__ import annotations

import numpy as np


def ridge(gram: np.ndarray, xy: np.ndarray, strength: float = 1e-3) -> np.ndarray:
    """Coefficients from X'X and X'y with an intercept first; the intercept is not shrunk."""
    k = len(gram)
    penalty = np.eye(k) * strength * max(1.0, gram[0, 0]) * 1e-3
    penalty[0, 0] = 0.0
    return np.linalg.lstsq(gram + penalty, xy, rcond=None)[0]


def _grow(x: np.ndarray, binned: np.ndarray, edges: list[np.ndarray], y: np.ndarray, w: np.ndarray, depth: int, least: float, rng, share: float):
    """A complete tree of ``depth`` levels: feature, threshold, leaf."""
    n, width = x.shape
    inner = 2**depth - 1
    feature, threshold, node = np.zeros(inner, int), np.full(inner, np.inf), np.zeros(n, int)
    bins = int(binned.max()) + 2 if binned.size else 2
    for level in range(depth):
        first, count = 2**level - 1, 2**level
        best = np.full(count, 1e-9)
        for f in sorted(rng.choice(width, max(1, round(share * width)), replace=False).tolist()):
            key = (node - first) * bins + binned[f]
            s = np.cumsum(np.bincount(key, w * y, count * bins).reshape(count, -1), axis=1)
            c = np.cumsum(np.bincount(key, w, count * bins).reshape(count, -1), axis=1)
            rest_s, rest_c = s[:, -1:] - s, c[:, -1:] - c
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = s**2 / c + rest_s**2 / rest_c - s[:, -1:] ** 2 / c[:, -1:]
            gain[~np.isfinite(gain) | (c < least) | (rest_c < least)] = -1
            gain = gain[:, : len(edges[f])]
            if not gain.size:
                continue
            cut = gain.argmax(axis=1)
            top = gain[np.arange(count), cut]
            better = np.flatnonzero(top > best)
            best[better] = top[better]
            feature[first + better], threshold[first + better] = f, edges[f][cut[better]]
        node = 2 * node + 1 + (x[np.arange(n), feature[node]] > threshold[node])
    at = node - inner
    total, size = np.bincount(at, w * y, inner + 1), np.bincount(at, w, inner + 1)
    mean = float((w * y).sum() / max(w.sum(), 1e-12))
    leaf = np.where(size > 0, total / np.maximum(size, 1e-12), mean)
    return feature, threshold, leaf, node


def fit(x: np.ndarray, y: np.ndarray, boosted: bool, trees: int = 60, depth: int = 5, rate: float = 0.1, bins: int = 48, seed: int = 0) -> dict:
    """A model of trees as a dictionary of lists."""
    rng = np.random.default_rng(seed)
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(edges[f], x[:, f], side="left") for f in range(x.shape[1])])
    base = float(y.mean()) if boosted else 0.0
    now, out = np.full(len(y), base), []
    for _ in range(trees):
        w = np.ones(len(y)) if boosted else rng.multinomial(len(y), np.full(len(y), 1 / len(y))).astype(float)
        feature, threshold, leaf, node = _grow(x, binned, edges, y - now if boosted else y, w, depth, 2.0, rng, 1.0 if boosted else 0.7)
        leaf = leaf * (rate if boosted else 1 / trees)
        if boosted:
            now += leaf[node - (2**depth - 1)]
        out.append({"feature": feature.tolist(), "threshold": [t if np.isfinite(t) else None for t in threshold.tolist()], "leaf": leaf.tolist()})
    return {"kind": "trees", "depth": depth, "base": base, "trees": out}


def predict(model: dict, x: np.ndarray) -> np.ndarray:
    if model["kind"] == "linear":
        return model["beta"][0] + x @ np.array(model["beta"][1:])
    out, rows = np.full(len(x), model["base"]), np.arange(len(x))
    for t in model["trees"]:
        feature = np.array(t["feature"])
        threshold = np.array([np.inf if v is None else v for v in t["threshold"]])
        node = np.zeros(len(x), int)
        for _ in range(model["depth"]):
            node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
        out += np.array(t["leaf"])[node - (2 ** model["depth"] - 1)]
    return out
