"""Chained equations of linear models, fitted on all rows from products of their cells.

Rows with the same missing cells form a pattern.  What a linear chain needs of a pattern is the matrix of products of its
cells, which tasks sum up and one small shuffle adds; the estimates of a row's missing cells are linear in its other
cells at every step, so the whole chain runs on the driver on these matrices and no row is looked at twice.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import forest
from ..operators.columns import number


class Products:
    """Sums of products of (1, cells) by pattern of missing cells, and by fold for complete rows; missing cells are 0."""

    def __init__(self, columns: Sequence[str], centre: np.ndarray, scale: np.ndarray, sums: dict[tuple[bytes, int], np.ndarray]) -> None:
        self.columns, self.centre, self.scale = list(columns), centre, scale
        k = len(columns)
        gone = lambda code: np.unpackbits(np.frombuffer(code, np.uint8), count=k).astype(bool)
        by: dict[bytes, np.ndarray] = {}
        for (code, _), g in sums.items():
            by[code] = by.get(code, 0) + g
        self.patterns = [(gone(code), by[code]) for code in sorted(by)]
        self.folds = {fold: g for (code, fold), g in sorted(sums.items()) if not gone(code).any()}
        self.rows = sum(g[0, 0] for _, g in self.patterns)

    def missing(self, c: int) -> float:
        return sum(g[0, 0] for gone, g in self.patterns if gone[c])

    def share(self) -> float:
        """Of all cells, those that are missing."""
        return sum(self.missing(c) for c in range(len(self.columns))) / max(1.0, self.rows * len(self.columns))

    def complete(self) -> float:
        return sum(g[0, 0] for gone, g in self.patterns if not gone.any()) / max(1.0, self.rows) if self.rows else 1.0

    def correlation(self, a: int, b: int) -> float | None:
        """Of the rows that have both cells."""
        g = sum((g for gone, g in self.patterns if not gone[a] and not gone[b]), np.zeros((len(self.columns) + 1,) * 2))
        n, (sa, sb) = g[0, 0], g[0, [a + 1, b + 1]]
        if n < 2:
            return None
        va, vb = g[a + 1, a + 1] - sa * sa / n, g[b + 1, b + 1] - sb * sb / n
        if min(va, vb) <= 1e-12 * max(1.0, n):
            return None
        return float((g[a + 1, b + 1] - sa * sb / n) / math.sqrt(va * vb))


def scaled(df: DataFrame, columns: Sequence[str], centre: Sequence[float], scale: Sequence[float], folds: int, seed: int) -> DataFrame:
    """x0, x1, ... (centred and scaled) and fold, a hash of the cells."""
    cells = [((number(df, c) - F.lit(float(m))) / F.lit(float(s))).alias(f"x{i}") for i, (c, m, s) in enumerate(zip(columns, centre, scale))]
    return df.select(*cells, F.pmod(F.xxhash64(F.lit(seed), *[number(df, c) for c in columns]), F.lit(folds)).cast("int").alias("fold"))


def products(df: DataFrame, columns: Sequence[str], centre: Sequence[float], scale: Sequence[float], folds: int, seed: int) -> Products:
    k = len(columns)
    schema = "code binary, fold int, sums binary"

    def rows_of(sums: dict[tuple[bytes, int], np.ndarray]) -> pa.RecordBatch:
        keys = list(sums)
        return pa.RecordBatch.from_arrays(
            [pa.array([c for c, _ in keys], pa.binary()), pa.array([f for _, f in keys], pa.int32()), pa.array([sums[x].tobytes() for x in keys], pa.binary())], ["code", "fold", "sums"]
        )

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[bytes, int], np.ndarray] = {}
        for batch in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns[:k]])
            gone, fold = np.isnan(x), batch.column(k).to_numpy(zero_copy_only=False)
            fold = np.where(gone.any(axis=1), -1, fold)
            codes = np.packbits(gone, axis=1)
            whole = np.ascontiguousarray(np.column_stack([codes, (fold + 1).astype(">u2").view(np.uint8).reshape(-1, 2)]))
            kinds, own = np.unique(whole.view([("", whole.dtype)] * whole.shape[1]).ravel(), return_inverse=True)
            cells = np.column_stack([np.ones(len(x)), np.where(gone, 0.0, x)])
            for i, kind in enumerate(kinds):
                raw = kind.tobytes()
                part, key = cells[own.ravel() == i], (raw[:-2], int.from_bytes(raw[-2:], "big") - 1)
                sums[key] = sums.get(key, 0) + part.T @ part
            if len(sums) > 4096:
                yield rows_of(sums)
                sums = {}
        if sums:
            yield rows_of(sums)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[bytes, int], np.ndarray] = {}
        for batch in batches:
            for code, fold, raw in zip(*[c.to_pylist() for c in batch.columns]):
                sums[(code, fold)] = sums.get((code, fold), 0) + np.frombuffer(raw).reshape(k + 1, k + 1)
        if sums:
            yield rows_of(sums)

    d = scaled(df, columns, centre, scale, folds, seed).mapInArrow(partial, schema).repartition("code").mapInArrow(add, schema)
    found = {(bytes(r["code"]), r["fold"]): np.frombuffer(bytes(r["sums"])).reshape(k + 1, k + 1) for r in d.collect()}
    return Products(columns, np.array(centre), np.array(scale), found)


def _regression(g: np.ndarray, c: int, used: Sequence[int]) -> np.ndarray:
    at = [0, *[u + 1 for u in used]]
    return forest.ridge(g[np.ix_(at, at)], g[at, c + 1])


def fit(p: Products, targets: Sequence[int], used: dict[int, list[int]], rounds: int, tol: float) -> tuple[dict[int, list[float]], int, bool]:
    """The coefficients of each target's model, the rounds, and whether all estimates moved by less than ``tol`` in root mean square."""
    k = len(p.columns)
    maps = [np.diag([1.0, *(~gone).astype(float)]) for gone, _ in p.patterns]
    models, turn, done = {}, 0, False
    while turn < rounds and not done:
        turn += 1
        moved = 0.0
        for c in targets:
            seen = np.zeros((k + 1, k + 1))
            for (gone, g), m in zip(p.patterns, maps):
                if not gone[c]:
                    seen += m @ g @ m.T
            beta = _regression(seen, c, used[c]) if seen[0, 0] >= 2 and used[c] else np.zeros(len(used[c]) + 1)
            models[c] = beta.tolist()
            for (gone, g), m in zip(p.patterns, maps):
                if gone[c]:
                    row = beta @ m[[0, *[u + 1 for u in used[c]]]]
                    off = row - m[c + 1]
                    moved = max(moved, math.sqrt(max(0.0, float(off @ g @ off) / g[0, 0])))
                    m[c + 1] = row
        done = moved < tol
    return models, turn, done


def estimates(p: Products, c: int, targets: Sequence[int], used: dict[int, list[int]], models: dict[int, list[float]], rounds: int) -> tuple[float, float, float, float] | None:
    """(observed mean, deviation, estimated mean, deviation) of a column, scaled, as the chain fills it; None without values."""
    seen, filled = np.zeros(3), np.zeros(3)
    for gone, g in p.patterns:
        m = np.diag([1.0, *(~gone).astype(float)])
        if not gone[c]:
            seen += [g[0, 0], g[0, c + 1], g[c + 1, c + 1]]
            continue
        for _ in range(rounds):
            for t in targets:
                if gone[t]:
                    m[t + 1] = np.array(models[t]) @ m[[0, *[u + 1 for u in used[t]]]]
        row = m[c + 1]
        filled += [g[0, 0], row @ g[0], row @ g @ row]
    if not seen[0]:
        return None
    of = lambda s: (s[1] / s[0], math.sqrt(max(0.0, s[2] / s[0] - (s[1] / s[0]) ** 2))) if s[0] else (math.nan, math.nan)
    return (*of(seen), *of(filled))


def fold_scores(df: DataFrame, p: Products, wanted: dict[int, list[int]], least: int, folds: int, seed: int) -> dict[int, tuple[float | None, float | None, float | None]]:
    """R², root mean square and mean absolute error of each column's model on complete rows, means over folds it was not fitted on.

    Squares come from the products; absolute errors take one more pass for all columns.
    """
    whole = sum(p.folds.values(), np.zeros((len(p.columns) + 1,) * 2))
    if whole[0, 0] < least or len(p.folds) < 2:
        return dict.fromkeys(wanted, (None, None, None))
    betas = {c: {f: _regression(whole - g, c, used) for f, g in p.folds.items()} for c, used in wanted.items()}
    d = scaled(df, p.columns, p.centre, p.scale, folds, seed)
    d = d.dropna(subset=[f"x{i}" for i in range(len(p.columns))])
    errors = []
    for c, used in wanted.items():
        tables = np.zeros((folds, len(used) + 1))
        for f, b in betas[c].items():
            tables[f] = b
        literal = lambda v: F.expr("array(" + ", ".join(f"{x!r}D" for x in v.tolist()) + ")")
        guess = F.get(literal(tables[:, 0]), F.col("fold"))
        for j, u in enumerate(used):
            guess = guess + F.get(literal(tables[:, j + 1]), F.col("fold")) * F.col(f"x{u}")
        errors.append(F.avg(F.abs(F.col(f"x{c}") - guess)).alias(f"e{c}"))
    absolute = {r["fold"]: r for r in d.groupBy("fold").agg(*errors).collect()}
    out = {}
    for c, used in wanted.items():
        scores = []
        for f, g in p.folds.items():
            at = [0, *[u + 1 for u in used]]
            b = betas[c][f]
            off = g[c + 1, c + 1] - 2 * b @ g[at, c + 1] + b @ g[np.ix_(at, at)] @ b
            n, spread = g[0, 0], g[c + 1, c + 1] - g[0, c + 1] ** 2 / g[0, 0]
            if n >= 2 and spread > 1e-12 * n:
                scores.append((1 - off / spread, math.sqrt(max(0.0, off / n)) * p.scale[c], absolute[f][f"e{c}"] * p.scale[c]))
        out[c] = tuple(float(np.mean(s)) for s in zip(*scores)) if scores else (None, None, None)
    return out


__all__ = ["Products", "estimates", "fit", "fold_scores", "products"]
