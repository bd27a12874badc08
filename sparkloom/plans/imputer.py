"""Fitting and applying imputation of numeric columns.

Scalar strategies are one aggregate to fit and one projection to apply.  Linear models are fitted on all rows, from sums of
products (``chains``); tree models on at most ``tree_rows`` rows, chosen by a hash of their values.  Models apply in one
narrow pass of Arrow batches; their state is plain lists, so a fitted imputer is JSON.  Applying needs no shuffle, apart from a left join where fills hang on a grouping column.
"""

from __future__ import annotations

import base64
import math
import warnings
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from functools import partial
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import ImputationConfig, NumericImputationConfig, NumericKind, PipelineConfig, PipelinePhase, SemanticType
from ..config import ImputationStrategy as S
from ..functions import forest, mathx
from ..functions.nulls import INTEGERS, normalize
from ..operators.base import col, value_counts
from ..operators.columns import kinds, number
from ..operators.quantiles import of_expressions, outline, quantiles
from ..results import ColumnImputationRecord, ImputationFitDiagnostic, ImputationResult, MissingnessFlag, NonlinearityTag, NumericFlag, NumericStats, SkewSeverity, StructuralProfileResult
from . import chains
from .chains import Products, products
from .router import Case, mnar_fill, route
from .serial import Serial

#: Rows that tree models are fitted on at most, unless ``ImputationOrchestrator`` is told otherwise.
TREE_ROWS = 50_000
SHIFTED = 0x7FFFFFFF


class UnseenColumnError(ValueError):
    """A table has a column that the imputer was not fitted on."""


class FittedColumnAbsentError(ValueError):
    """A column that the imputer was fitted on is not there."""


class UnfittedColumnError(ValueError):
    """A column that was complete when the imputer was fitted has missing cells."""


class DroppedColumnAbsentWarning(UserWarning):
    """A column that would be dropped is not there."""


# Fills


def mode_of(df: DataFrame, column: str) -> float:
    """The most frequent value, the smallest of equals; 0 without values."""
    counts = value_counts(df, [column], "double", lambda c: number(df, c))
    first = counts.orderBy(F.desc("n"), F.asc("value")).first()
    return float(first["value"]) if first else 0.0


def fills_of(df: DataFrame, wanted: dict[str, str]) -> dict[str, float | None]:
    """The mean, median or mode of each column: means from one aggregate, medians by selection."""
    out: dict[str, float | None] = {}
    means, medians = ([c for c, k in wanted.items() if k == kind] for kind in ("mean", "median"))
    if means:
        r = df.agg(*[F.avg(number(df, c)).alias(str(i)) for i, c in enumerate(means)]).first()
        out |= {c: r[str(i)] for i, c in enumerate(means)}
    if medians:
        out |= {c: q[0] for c, (_, q) in zip(medians, of_expressions(df, [number(df, c) for c in medians], [0.5]))}
    return out | {c: mode_of(df, c) for c, k in wanted.items() if k == "mode"}


def fill_column(df: DataFrame, column: str, value: Column) -> Column:
    """The column with ``value`` (a double) for null, in its own type; whole numbers are rounded half to even."""
    kind = kinds(df)[column]
    if isinstance(kind, INTEGERS):
        value = F.rint(value).cast(kind)
    elif isinstance(kind, T.StringType):
        return F.coalesce(number(df, column), value)
    return F.coalesce(col(column), value.cast(kind))


def matrix(df: DataFrame, columns: Sequence[str], rows: int, seed: int = 0) -> np.ndarray:
    """At most ``rows`` rows of the columns as numbers, NaN for missing, chosen by a hash of their values."""
    d = df.select(*[number(df, c).alias(str(i)) for i, c in enumerate(columns)])
    names = [F.col(str(i)) for i in range(len(columns))]
    got = d.orderBy(F.xxhash64(*names, F.lit(seed)), *names).limit(rows).toPandas()
    return got.to_numpy(dtype=float).reshape(len(got), len(columns))


def whole_matrix(df: DataFrame, columns: Sequence[str], seed: int = 0) -> np.ndarray:
    """All rows, in the order of ``matrix``: equal rows are counted by tasks, and the driver orders the different ones."""
    d = df.select(*[number(df, c).alias(str(i)) for i, c in enumerate(columns)])
    names = [F.col(str(i)) for i in range(len(columns))]
    counted = d.groupBy(*names).agg(F.count(F.lit(1)).alias("n")).select(*names, "n", F.xxhash64(*names, F.lit(seed)).alias("h")).toArrow()
    x = np.column_stack([counted.column(str(i)).to_numpy().astype(float) for i in range(len(columns))])
    order = np.lexsort([*np.where(np.isnan(x), -np.inf, x).T[::-1], counted.column("h").to_numpy()])
    return np.repeat(x[order], counted.column("n").to_numpy()[order], axis=0)


# Models on rows: each fits on a matrix and fills a matrix


def fit_neighbours(x: np.ndarray, columns: Sequence[str], k: int, weighted: bool, targets: Sequence[int] | None = None) -> dict:
    """Of all rows, those that can be among the ``k`` nearest of a row without a cell of ``targets`` (column numbers, all if None).

    Rows that differ in no other cell are equally far from any row, and the first of equals are taken, so the first ``k``
    of each such group stand for it.
    """
    mean, std = np.nan_to_num(np.nanmean(x, axis=0)), np.nan_to_num(np.nanstd(x, axis=0))
    std[std == 0] = 1.0
    z, targets = (x - mean) / std, list(range(x.shape[1]) if targets is None else targets)
    needed = np.zeros(len(z), bool)
    for c in targets:
        donors = np.flatnonzero(~np.isnan(z[:, c]))
        group = _groups(np.delete(z[donors], c, axis=1))
        order = np.argsort(group, kind="stable")
        place = np.arange(len(order)) - np.searchsorted(group[order], group[order])
        needed[donors[order[place < k]]] = True
    rows = np.ascontiguousarray(z[needed], dtype="<f8")
    return {"kind": "knn", "columns": list(columns), "k": k, "weighted": weighted, "targets": [int(c) for c in targets], "mean": mean.tolist(), "std": std.tolist(), "rows": base64.b64encode(rows.tobytes()).decode()}


def _groups(z: np.ndarray) -> np.ndarray:
    """A number for each row, the same for rows with the same cells."""
    if not z.size:
        return np.zeros(len(z), int)
    key = np.where(np.isnan(z), np.inf, z)
    order = np.lexsort(key.T)
    new = np.r_[False, (key[order][1:] != key[order][:-1]).any(axis=1)]
    out = np.empty(len(z), int)
    out[order] = np.cumsum(new)
    return out


def _boxes(z: np.ndarray, rows: np.ndarray, size: int) -> list[np.ndarray]:
    """``rows`` of ``z``, halved at the median of the widest column until at most ``size`` are left or all are equal."""
    out, todo = [], [rows]
    while todo:
        at = todo.pop()
        cells = z[at]
        if len(at) > size and cells.shape[1]:
            width = cells.max(axis=0) - cells.min(axis=0)
            c = int(width.argmax())
            if width[c] > 0:
                half = np.argpartition(cells[:, c], len(at) // 2)
                todo += [at[half[: len(at) // 2]], at[half[len(at) // 2 :]]]
                continue
        out.append(at)
    return out


class _Donors:
    """The rows that have the cell of column ``c``, in boxes of rows with the same missing cells, for an exact search."""

    SIZE = 128  # rows in a box
    CELLS = 4_000_000  # distances at a time

    def __init__(self, z: np.ndarray, c: int) -> None:
        z = z[~np.isnan(z[:, c])]
        self.value, self.width = z[:, c], z.shape[1]
        self.z = np.delete(z, c, axis=1)
        self.have = ~np.isnan(self.z)
        self.z0 = np.where(self.have, self.z, 0.0)
        pattern = _groups(np.where(self.have, 1.0, 0.0))
        by = np.argsort(pattern, kind="stable")
        parts = np.split(by, np.flatnonzero(np.diff(pattern[by])) + 1) if len(by) else []
        self.boxes = [box for part in parts for box in _boxes(self.z0, part, self.SIZE)]
        self.sizes = np.array([len(b) for b in self.boxes], dtype=int)
        shape = (len(self.boxes), self.width - 1)
        self.low = np.array([self.z0[b].min(axis=0) for b in self.boxes]).reshape(shape)
        self.high = np.array([self.z0[b].max(axis=0) for b in self.boxes]).reshape(shape)
        self.box_have = np.array([self.have[b[0]] for b in self.boxes], dtype=bool).reshape(shape)

    def nearest(self, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Distances and values of the ``k`` nearest donors of each row of ``q`` (cells without column ``c``), the first of equally
        far ones; infinite where there are fewer with a common cell."""
        dist, value = np.full((len(q), k), np.inf), np.zeros((len(q), k))
        group = _groups(q)
        first, place = np.unique(group, return_index=True)
        q, own = q[place], ~np.isnan(q[place])
        q0 = np.where(own, q, 0.0)
        found_d, found_v = np.full((len(q), k), np.inf), np.zeros((len(q), k))
        pattern = _groups(own.astype(float))
        for p in range(pattern.max(initial=-1) + 1):
            rows = np.flatnonzero(pattern == p)
            cells = np.flatnonzero(own[rows[0]])
            if len(cells) and len(self.boxes):
                boxes = (self.low[:, cells], self.high[:, cells], self.box_have[:, cells].astype(float))
                size = int(max(1, min(self.SIZE, math.sqrt(self.CELLS / 20 * len(rows) / len(self.value)))))  # few queries are far apart: small groups
                for at in _boxes(q0, rows, size):
                    self._settle(q0, at, cells, boxes, k, found_d, found_v)
        at = np.searchsorted(first, group)
        dist[:], value[:] = found_d[at], found_v[at]
        return dist, value

    def _settle(self, q0: np.ndarray, at: np.ndarray, cells: np.ndarray, boxes: tuple[np.ndarray, np.ndarray, np.ndarray], k: int, dist: np.ndarray, value: np.ndarray) -> None:
        q = q0[np.ix_(at, cells)]
        low, high, have = boxes
        gap = np.maximum(np.maximum(low - q.max(axis=0), q.min(axis=0) - high), 0.0) ** 2 * have
        with np.errstate(divide="ignore", invalid="ignore"):
            least = gap.sum(axis=1) * (self.width / have.sum(axis=1))
        least[np.isnan(least)] = np.inf
        near = np.flatnonzero(np.isfinite(least))
        if not len(near):
            return
        few = near if len(near) <= k else near[np.argpartition(least[near], k - 1)[:k]]  # the nearest boxes, which hold k donors, bound the distance of the k-th
        few = few[np.argsort(least[few], kind="stable")]
        few = few[: int(np.searchsorted(np.cumsum(self.sizes[few]), k)) + 1]
        step = lambda m: max(1, self.CELLS // max(1, m))
        if len(few) < len(near):
            some = np.concatenate([self.boxes[b] for b in few])
            bound = max(float(np.partition(self._squares(q[i : i + step(len(some))], some, cells)[0], k - 1, axis=1)[:, k - 1].max()) for i in range(0, len(q), step(len(some))))
            near = near[least[near] <= self._loose(bound, q, some, cells)]
        donors = np.sort(np.concatenate([self.boxes[b] for b in near]))
        m = min(k, len(donors))
        for i in range(0, len(q), step(len(donors))):
            part = q[i : i + step(len(donors))]
            squares, slack = self._squares(part, donors, cells)
            limit = np.partition(squares, m - 1, axis=1)[:, m - 1 : m]
            row, j = np.nonzero(squares <= limit * (1 + 1e-9) + slack)
            both = self.have[np.ix_(donors, cells)][j]
            off = np.where(both, part[row] - self.z0[np.ix_(donors, cells)][j], 0.0)
            exact = np.sqrt((off**2).sum(axis=1) * self.width / both.sum(axis=1))
            order = np.lexsort((j, exact, row))
            row, j, exact = row[order], j[order], exact[order]
            take = np.searchsorted(row, np.arange(len(part)))[:, None] + np.arange(m)
            rows = at[i : i + len(part)]
            dist[rows, :m], value[rows, :m] = exact[take], self.value[donors[j[take]]]

    def _squares(self, q: np.ndarray, donors: np.ndarray, cells: np.ndarray) -> tuple[np.ndarray, float]:
        """Squared distances by products, from cells moved to the middle of ``q``, and a bound on their error."""
        middle = q.mean(axis=0)
        have = self.have[np.ix_(donors, cells)].astype(float)
        a, t = q - middle, (self.z0[np.ix_(donors, cells)] - middle) * have
        s = (a**2) @ have.T + (t**2).sum(axis=1) - 2 * a @ t.T
        scale = self.width / have.sum(axis=1)
        error = 1e-13 * (len(cells) + 4) * float((a**2).sum(axis=1).max() + (t**2).sum(axis=1).max()) * float(scale.max())
        return np.maximum(s, 0.0) * scale, 2 * error

    def _loose(self, bound: float, q: np.ndarray, donors: np.ndarray, cells: np.ndarray) -> float:
        """``bound``, raised by the error of the products that gave it and of the boxes' sides."""
        return bound * (1 + 1e-9) + self._squares(q[:1], donors, cells)[1] * 4 + 1e-13 * float((q**2).sum(axis=1).max()) * self.width


class Neighbours:
    """A fitted search; ``fill`` gives missing cells from the ``k`` nearest fitted rows that have them.

    Distances are over the cells that both rows have.  Boxes only leave out rows that are proven to be farther than the ``k``-th.
    """

    def __init__(self, state: dict) -> None:
        self.state, self.mean, self.std = state, np.array(state["mean"]), np.array(state["std"])
        self.z = np.frombuffer(base64.b64decode(state["rows"]), "<f8").reshape(-1, len(self.mean))
        self.donors: dict[int, _Donors] = {}

    def fill(self, x: np.ndarray) -> np.ndarray:
        z, out = (x - self.mean) / self.std, x.copy()
        for c in self.state["targets"]:
            want = np.flatnonzero(np.isnan(x[:, c]))
            if not len(want):
                continue
            if c not in self.donors:
                self.donors[c] = _Donors(self.z, c)
            dist, values = self.donors[c].nearest(np.delete(z[want], c, axis=1), self.state["k"])
            w = np.isfinite(dist).astype(float)
            if self.state["weighted"]:
                zero = dist == 0
                with np.errstate(divide="ignore"):
                    w = np.where(zero.any(axis=1, keepdims=True), zero, np.where(np.isfinite(dist), 1 / dist, 0.0)).astype(float)
            total = w.sum(axis=1)
            value = np.where(total > 0, (w * values).sum(axis=1) / np.where(total > 0, total, 1), 0.0)
            out[want, c] = value * self.std[c] + self.mean[c]
        return out


def apply_neighbours(state: dict, x: np.ndarray) -> np.ndarray:
    return Neighbours(state).fill(x)


def fit_chain(x: np.ndarray, columns: Sequence[str], used: dict[int, list[int]], tag: NonlinearityTag | None, rounds: int, tol: float, centre: np.ndarray, scale: np.ndarray, config: NumericImputationConfig, seed: int) -> dict:
    """Chained equations on rows: each target is regressed on other columns, whose missing cells hold their last estimates."""
    targets = list(used)
    z = (x - centre) / scale
    missing = np.isnan(z)
    now = np.where(missing, 0.0, z)
    models: dict[int, dict] = {}
    done, turn = False, 0
    while turn < rounds and not done:
        turn += 1
        before = now.copy()
        for c in targets:
            seen = ~missing[:, c]
            if seen.sum() < 2 or not used[c]:
                models[c] = {"kind": "linear", "beta": [0.0] * (len(used[c]) + 1)}
            else:
                a, y = now[np.ix_(seen, used[c])], now[seen, c]
                models[c] = _regressor(a, y, tag, config, seed)
            if missing[:, c].any():
                now[missing[:, c], c] = forest.predict(models[c], now[np.ix_(missing[:, c], used[c])])
        done = bool(np.abs(now - before).max(initial=0.0) < tol)
    return chain_state(columns, used, centre, scale, models, turn, done)


def chain_state(columns: Sequence[str], used: dict[int, list[int]], centre, scale, models: dict[int, dict], rounds: int, converged: bool) -> dict:
    return {
        "kind": "chain", "columns": list(columns), "targets": [int(c) for c in used], "centre": list(map(float, centre)), "scale": list(map(float, scale)), "rounds": rounds,
        "converged": converged, "used": {str(c): u for c, u in used.items()}, "models": {str(c): m for c, m in models.items()},
    }


def _regressor(x: np.ndarray, y: np.ndarray, tag: NonlinearityTag | None, config: NumericImputationConfig, seed: int) -> dict:
    """Ridge for linear columns, bagged trees for monotonic ones, boosted trees for complex ones with many rows."""
    if tag in (None, NonlinearityTag.Linear):
        design = np.c_[np.ones(len(x)), x]
        return {"kind": "linear", "beta": forest.ridge(design.T @ design, design.T @ y).tolist()}
    return forest.fit(x, y, tag == NonlinearityTag.ComplexNonlinear and len(y) >= config.gradient_boost_min_rows, seed=seed)


def apply_chain(state: dict, x: np.ndarray) -> np.ndarray:
    centre, scale = np.array(state["centre"]), np.array(state["scale"])
    z = (x - centre) / scale
    missing = np.isnan(z)
    now = np.where(missing, 0.0, z)
    for _ in range(state["rounds"] if missing.any() else 0):
        for c in state["targets"]:
            if missing[:, c].any():
                now[missing[:, c], c] = forest.predict(state["models"][str(c)], now[np.ix_(missing[:, c], state["used"][str(c)])])
    return np.where(missing, now * scale + centre, x)


def apply_rows(df: DataFrame, states: Sequence[dict]) -> DataFrame:
    """``df`` with the missing cells of each model's targets filled, in one narrow pass; all models see the cells as they are in ``df``."""
    columns = sorted({c for state in states for c in state["columns"]})
    shared = df.sparkSession.sparkContext.broadcast(list(states))
    targets = [(i, t) for i, state in enumerate(states) for t in state["fills_columns"] if t in df.columns]
    numbers = {c: f"__x{i}" for i, c in enumerate(columns)}
    filled = [f"__y{i}" for i in range(len(targets))]
    wide = df.select("*", *[number(df, c).alias(n) for c, n in numbers.items()])
    schema = T.StructType([*df.schema.fields, *[T.StructField(f, T.DoubleType()) for f in filled]])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fills = [Neighbours(state).fill if state["kind"] == "knn" else partial(apply_chain, state) for state in shared.value]
        for frame in frames:
            done = [fill(frame[[numbers[c] for c in state["columns"]]].to_numpy(dtype=float)) for fill, state in zip(fills, shared.value)]
            out = frame.drop(columns=list(numbers.values()))
            for name, (i, t) in zip(filled, targets):
                out[name] = done[i][:, shared.value[i]["columns"].index(t)]
            yield out

    d = wide.mapInPandas(run, schema)
    values = dict(zip([t for _, t in targets], filled))
    return d.select(*[fill_column(d, c, F.col(values[c])).alias(c) if c in values else col(c) for c in df.columns])


# Mixtures


def uniform(df: DataFrame, seed: int, salt: str) -> Column:
    """A number in 0..1 that depends on a row's values, the seed and the salt, and on no partition."""
    h = F.xxhash64(*[col(c) for c, t in df.dtypes if not t.startswith("map")], F.lit(seed), F.lit(salt))
    return (F.shiftrightunsigned(h, 11).cast("double") + 0.5) / float(2**53)


def drawn(df: DataFrame, state: dict, seed: int, column: str) -> Column:
    """A draw from two normals by their weights."""
    first = uniform(df, seed, f"{column}:component") < state["weights"][0]
    pick = lambda k: F.when(first, F.lit(state[k][0])).otherwise(F.lit(state[k][1]))
    normal = F.sqrt(-2 * F.log(uniform(df, seed, f"{column}:radius"))) * F.cos(2 * math.pi * uniform(df, seed, f"{column}:angle"))
    return pick("means") + pick("stds") * normal


def fit_clusters(df: DataFrame, column: str, centres: tuple[float, float], features: Sequence[str], fill: str) -> dict:
    """Rows go to the nearer centre of ``column``; each side has its fill and the means of its features, over all rows."""
    x = number(df, column)
    first = F.abs(x - F.lit(centres[0])) <= F.abs(x - F.lit(centres[1]))
    sides = (first, ~first)
    exprs = [e.alias(f"{k}{i}") for i, side in enumerate(sides) for k, e in (("mean", F.avg(F.when(side, x))), ("n", F.count_if(side & x.isNotNull())), ("std", F.stddev_pop(F.when(side, x))))]
    exprs += [F.avg(F.when(side & x.isNotNull(), number(df, f))).alias(f"f{i}_{j}") for i, side in enumerate(sides) for j, f in enumerate(features)]
    r = df.agg(*exprs).first()
    fills = [r["mean0"], r["mean1"]] if fill == "mean" else [q[0] for _, q in of_expressions(df, [F.when(side, x) for side in sides], [0.5])]
    return {"kind": "cluster", "features": list(features), "fills": fills, "sizes": [r["n0"], r["n1"]], "centroids": [[r[f"f{i}_{j}"] or 0.0 for j in range(len(features))] for i in (0, 1)]}


def cluster_fill(df: DataFrame, state: dict) -> Column:
    distance = []
    for centroid in state["centroids"]:
        total = F.lit(0.0)
        for f, m in zip(state["features"], centroid):
            off = F.coalesce(number(df, f), F.lit(0.0)) - F.lit(m)
            total = total + off * off
        distance.append(total)
    return F.when(distance[0] <= distance[1], F.lit(state["fills"][0])).otherwise(F.lit(state["fills"][1]))


def fit_groups(df: DataFrame, column: str, group: str, fill: str) -> dict:
    """The fill of each group, as a fitted imputer holds it: a grouping column is a category, and its fills are collected."""
    rows = df.select(col(group).cast("string").alias("key"), number(df, column).alias("x")).where("key is not null and x is not null")
    fills = rows.groupBy("key").agg(F.avg("x").alias("v")) if fill == "mean" else quantiles(rows, [0.5]).select("key", F.get("q", F.lit(0)).alias("v"))
    return {"kind": "group", "group": group, "fills": {r["key"]: r["v"] for r in sorted(fills.collect(), key=lambda r: r["key"])}}


def group_fill(df: DataFrame, column: str, state: dict) -> DataFrame:
    """A left join with the fills; unseen and null groups stay null."""
    table = df.sparkSession.createDataFrame(list(state["fills"].items()), "__g string, __v double")
    d = df.join(table, col(state["group"]).cast("string") == F.col("__g"), "left")
    return d.select(*[fill_column(d, c, F.col("__v")).alias(c) if c == column else col(c) for c in df.columns])


# Fitting


def n_neighbours(config: NumericImputationConfig, features: int, rows: int, missing: float, complete: float) -> tuple[int, bool]:
    """How many neighbours, and whether a bound cut the number: more for wide, gappy tables with few complete rows."""
    if config.knn_n_neighbors:
        return min(config.knn_n_neighbors, max(1, rows - 1)), config.knn_n_neighbors > rows - 1
    base = max(config.knn_min_neighbors, math.isqrt(features))
    k = int(base * (1 + missing) * math.sqrt(1 / max(complete, 0.1)))
    most = max(1, min(rows - 1, config.knn_max_neighbors))
    return min(k, most), k > most


def chain_rounds(config: NumericImputationConfig, targets: Sequence[str], p: Products, tag: NonlinearityTag | None, stats: Sequence[NumericStats | None], correlation) -> tuple[int, float]:
    """Rounds and tolerance of chained equations.

    More rounds for complex columns, gaps, strong correlations and few complete rows, fewer for nearly linear columns; a
    tolerance that follows the narrowest interquartile range.
    """
    joint = len(targets) > 1
    declared = [config.per_column_max_iter[c] for c in targets if c in config.per_column_max_iter]
    tol = [s.iqr for s in stats if s and s.iqr]
    tol = max(1e-7, min(tol) * (5e-5 if tag == NonlinearityTag.ComplexNonlinear else 1e-4)) if tol else 1e-3
    if joint and config.mice_max_iter:
        return config.mice_max_iter, tol
    if declared:
        return max(declared), tol
    rounds = config.base_max_iter + 5 * (tag == NonlinearityTag.ComplexNonlinear)
    gappy = [c for i, c in enumerate(p.columns) if p.missing(i)]
    if joint:
        share = p.share()
        rounds += next((extra for least, extra in ((0.4, 5), (0.2, 3), (0.1, 2)) if share >= least), 0)
    else:
        rounds += 2 * sum(c != targets[0] for c in gappy)
    known = [s.r2_gap for s in stats if s and s.r2_gap is not None]
    if known and min(known) < 0.05:
        rounds = max(1, rounds - 3)
    linked = strengths(p.columns if joint else [c for c in gappy if c != targets[0]], p, correlation)
    if linked and (max(linked) if joint else float(np.mean(linked))) >= 0.7:
        rounds += 3
    complete = p.complete()
    return max(1, rounds + (5 if complete < 0.2 else 3 if complete < 0.5 else 0)), tol


def strengths(wanted: Sequence[str], p: Products, correlation) -> list[float]:
    """The sizes of the correlations of all pairs of the wanted columns, from the profile or else from the products."""
    out = []
    for a, b in combinations(wanted, 2):
        r = correlation.get_pearson(a, b) if correlation else None
        r = p.correlation(p.columns.index(a), p.columns.index(b)) if r is None else r
        if r is not None and math.isfinite(r):
            out.append(abs(r))
    return out


def nearest_features(config: NumericImputationConfig, p: Products, correlation) -> int | None:
    """For wide blocks, how many predictors a column typically correlates with; None: all."""
    if len(p.columns) <= config.mice_n_nearest_features_min_cols:
        return None
    counts = [sum(r > config.mice_correlation_threshold for o in p.columns if o != c for r in strengths([c, o], p, correlation)) for c in p.columns]
    return min(max(1, int(np.median(counts))), config.mice_max_nearest_features)


def predictors(p: Products, targets: Sequence[int], nearest: int | None) -> dict[int, list[int]]:
    """The columns that each target is regressed on: all others, or the most correlated."""
    out = {}
    for c in targets:
        others = [j for j in range(len(p.columns)) if j != c]
        if nearest and len(others) > nearest:
            others = sorted(sorted(others, key=lambda j: -abs(p.correlation(c, j) or 0.0))[:nearest])
        out[c] = others
    return out


def fold_metrics(x: np.ndarray, c: int, fill, folds: int, least: int) -> tuple[float | None, float | None, float | None]:
    """R², root mean square and mean absolute error of filling column ``c`` of complete rows, means over folds."""
    whole = x[~np.isnan(x).any(axis=1)]
    if len(whole) < least:
        return None, None, None
    whole = whole[np.random.default_rng(0).permutation(len(whole))]
    scores = []
    for part in np.array_split(np.arange(len(whole)), folds):
        train = np.delete(whole, part, axis=0)
        test = whole[part].copy()
        test[:, c] = np.nan
        off, spread = whole[part, c] - fill(train, test)[:, c], float(((whole[part, c] - whole[part, c].mean()) ** 2).sum())
        if len(part) >= 2 and spread:
            scores.append((1 - float((off**2).sum()) / spread, float(np.sqrt((off**2).mean())), float(np.abs(off).mean())))
    return tuple(float(np.mean(s)) for s in zip(*scores)) if scores else (None, None, None)


@dataclass
class FittedImputer:
    """What ``fit`` learnt; ``transform`` applies it to any table with the same columns."""

    records: dict[str, ColumnImputationRecord]
    scalars: dict[str, float | None]
    models: list[dict] = field(default_factory=list)
    numeric_sentinels: dict[str, list[float]] = field(default_factory=dict)
    string_sentinels: dict[str, list[str]] = field(default_factory=dict)
    seed: int = 0

    def to_dict(self) -> dict:
        return {
            "records": {c: r.to_dict() for c, r in self.records.items()}, "scalars": self.scalars, "models": self.models,
            "numeric_sentinels": self.numeric_sentinels, "string_sentinels": self.string_sentinels, "seed": self.seed,
        }

    @classmethod
    def from_dict(cls, data: dict) -> FittedImputer:
        records = {c: ColumnImputationRecord.from_dict(r) for c, r in data["records"].items()}
        return cls(records, **{k: v for k, v in data.items() if k != "records"})

    def apply_exclusions(self, config: PipelineConfig) -> None:
        """Dropped columns leave every phase; indicators are left out of the phases after imputation."""
        for c, r in self.records.items():
            if r.strategy == S.Dropped:
                config.add_exclusion(c)
            elif r.strategy == S.Indicator:
                for phase in (PipelinePhase.OutlierDetection, PipelinePhase.Normalization, PipelinePhase.Encoding, PipelinePhase.Scaling):
                    config.add_phase_exclusion(phase, c)

    def _check(self, df: DataFrame) -> None:
        fitted = {c for c, r in self.records.items() if r.strategy != S.Indicator}
        if unseen := [c for c in df.columns if c not in fitted]:
            raise UnseenColumnError(f"not fitted: {unseen}")
        absent = [c for c in fitted if c not in df.columns]
        if lost := sorted(c for c in absent if self.records[c].strategy != S.Dropped):
            raise FittedColumnAbsentError(f"absent: {lost}")
        for c in sorted(absent):
            warnings.warn(f"{c!r} would be dropped and is absent", DroppedColumnAbsentWarning, stacklevel=3)

    def plan(self, df: DataFrame) -> tuple[DataFrame, list[str]]:
        """The filled table and the dropped columns, without any look at the data; also for streams."""
        self._check(df)
        d = normalize(df, self.numeric_sentinels, self.string_sentinels)
        of = lambda *s: [c for c in d.columns if self.records[c].strategy in s]
        dropped = of(S.Dropped)
        d = d.drop(*dropped)
        flagged = [c for c in d.columns if self.records[c].indicator_added]
        d = d.withColumns({f"{c}_missing": col(c).isNull().cast("tinyint") for c in flagged}) if flagged else d
        marks = [f"{c}_missing" for c in flagged]
        if rows := [state for state in self.models if state["kind"] in ("knn", "chain")]:
            d = apply_rows(d, rows)  # before other fills: models were fitted on cells that none had filled
        filled = {c: fill_column(d, c, F.lit(self.scalars[c]).cast("double")).alias(c) for c in d.columns if self.scalars.get(c) is not None}
        d = d.select(*[filled.get(c, col(c)) for c in d.columns])
        for state in self.models:
            targets = [t for t in state["fills_columns"] if t in d.columns]
            if state["kind"] in ("knn", "chain"):
                continue
            if state["kind"] == "group":
                d = group_fill(d, targets[0], state)
            else:
                value = cluster_fill(d, state) if state["kind"] == "cluster" else drawn(d, state, self.seed, targets[0])
                d = d.select(*[fill_column(d, c, value).alias(c) if c == targets[0] else col(c) for c in d.columns])
        snapped = {c: self.records[c].domain_snap_bounds for c in d.columns if c not in marks and self.records[c].domain_snap_bounds}
        if snapped:
            snap = lambda c, b: F.least(F.greatest(F.rint(col(c)), F.lit(b[0])), F.lit(b[1])).cast(kinds(d)[c]).alias(c)
            d = d.select(*[snap(c, snapped[c]) if c in snapped else col(c) for c in d.columns])
        return d, dropped

    def transform(self, df: DataFrame) -> ImputationResult:
        self._check(df)
        clean = normalize(df, self.numeric_sentinels, self.string_sentinels)
        whole = [c for c in df.columns if self.records[c].strategy == S.Passthrough]
        if whole:
            r = clean.agg(*[F.count_if(col(c).isNull()).alias(str(i)) for i, c in enumerate(whole)]).first()
            if gaps := [c for i, c in enumerate(whole) if r[str(i)]]:
                raise UnfittedColumnError(f"complete when fitted, now with missing cells: {gaps}")
        d, dropped = self.plan(df)
        return ImputationResult(d, dict(self.records), dropped)


class ImputationOrchestrator:
    """``fit(train, profile)`` and ``fit_transform``."""

    def __init__(self, config: PipelineConfig | ImputationConfig | None = None, tree_rows: int = TREE_ROWS) -> None:
        self.tree_rows = tree_rows
        self.pipeline = config if isinstance(config, PipelineConfig) else PipelineConfig()
        self.config = config if isinstance(config, ImputationConfig) else self.pipeline.imputation
        self.seed = (self.pipeline.random_seed or 0) & SHIFTED

    def fit(self, train: DataFrame, profile: StructuralProfileResult) -> FittedImputer:
        self.config.validate()
        clean = normalize(train, profile.numeric_sentinels, profile.string_sentinels)
        typed = {c: p for c, p in profile.columns.items() if p.semantic_type is not None and c in train.columns}
        numeric = [c for c, p in typed.items() if p.semantic_type == SemanticType.Numeric]
        clean = clean.persist()
        try:
            out = _Fit(clean, profile, numeric, self.config, self.seed, self.tree_rows).run()
        finally:
            clean.unpersist()
        records = {c: out.records.get(c) or ColumnImputationRecord(c, p.semantic_type, S.Passthrough, signals=["not numeric"]) for c, p in typed.items()}
        for c, r in list(records.items()):
            if r.indicator_added:
                records[f"{c}_missing"] = ColumnImputationRecord(f"{c}_missing", SemanticType.Boolean, S.Indicator)
        out.records = records
        out.numeric_sentinels, out.string_sentinels = dict(profile.numeric_sentinels), dict(profile.string_sentinels)
        return out

    def fit_transform(self, train: DataFrame, profile: StructuralProfileResult) -> tuple[FittedImputer, ImputationResult]:
        fitted = self.fit(train, profile)
        return fitted, fitted.transform(train)


class _Fit:
    """One fit: routes, scalar fills, then models in the order in which they are applied."""

    def __init__(self, df: DataFrame, profile: StructuralProfileResult, numeric: list[str], config: ImputationConfig, seed: int, tree_rows: int) -> None:
        self.df, self.profile, self.numeric, self.config, self.seed, self.tree_rows = df, profile, numeric, config, seed, tree_rows
        self.rows = df.count()
        self.out = FittedImputer({}, {}, seed=seed)

    def _stats(self, c: str) -> NumericStats | None:
        s = self.profile.columns[c].stats
        return s if isinstance(s, NumericStats) else None

    def _tag(self, c: str) -> NonlinearityTag | None:
        s = self._stats(c)
        tag = s.nonlinearity_tag if s else None
        return NonlinearityTag.MonotonicNonlinear if s and s.has_flag(NumericFlag.Bimodal) and tag == NonlinearityTag.Linear else tag

    def _guard(self, c: str) -> None:
        n, declared = self.config.numeric, self.config.numeric.per_column_strategy.get(c)
        if declared == S.Regression and self.rows < n.regression_min_rows:
            raise ValueError(f"regression for {c!r} needs {n.regression_min_rows} rows, there are {self.rows}")
        if declared == S.KNN and (self.rows > n.knn_max_rows or len(self.numeric) > n.knn_max_features):
            raise ValueError(f"knn for {c!r} is bounded by {n.knn_max_rows} rows and {n.knn_max_features} features")

    def run(self) -> FittedImputer:
        columns, mnar = self.profile.columns, frozenset(self.config.mnar_columns)
        suspects = [c for c in self.numeric if (m := columns[c].missingness) and m.has_flag(MissingnessFlag.MARSuspect) and not m.has_flag(MissingnessFlag.DropCandidate) and c not in mnar]
        wanted: dict[str, str] = {}
        by: dict[S, list[str]] = {s: [] for s in S}
        for c in self.numeric:
            self._guard(c)
            case = Case(c, columns[c], self.config.numeric, self.rows, len(self.numeric), len(suspects) >= 2, mnar, self.profile.dataset.feature_correlation)
            s, why = route(case)
            self.out.records[c] = ColumnImputationRecord(c, SemanticType.Numeric, s, signals=why, indicator_added=s == S.MNAR)
            by[s].append(c)
            if s in (S.Mean, S.Median, S.Mode):
                wanted[c] = s.value
            elif s == S.MNAR:
                wanted[c] = mnar_fill(case)
            elif s == S.Constant:
                self._scalar(c, self.config.numeric.per_column_constant_fill[c])
        for c, v in fills_of(self.df, wanted).items():
            self._scalar(c, v)
        self._mice(by[S.MICE])
        self._neighbours(by[S.KNN])
        for c in by[S.Regression]:
            self._regression(c)
        for c in by[S.ClusterConditional]:
            self._cluster(c)
        for c in by[S.GMMSampling]:
            self._mixture(c)
        return self.out

    def _scalar(self, c: str, value: float | None) -> None:
        self.out.scalars[c] = value
        self.out.records[c].fill_value = value

    def _fall_back(self, c: str, why: str) -> None:
        """The median, or for few whole numbers the mode."""
        bounded = self.profile.columns[c].numeric_kind == NumericKind.BoundedDiscrete
        r = self.out.records[c]
        r.strategy, r.domain_snap_bounds = (S.Mode if bounded else S.Median), None
        r.signals.append(f"{r.strategy.value}: {why}")
        self._scalar(c, fills_of(self.df, {c: r.strategy.value})[c])

    def _keep(self, state: dict, targets: list[str], scores: dict[str, tuple], spreads: dict[str, tuple]) -> None:
        """Keep a model, with bounds for few whole numbers and diagnostics: cross-validated scores, means and deviations."""
        self.out.models.append({**state, "fills_columns": targets})
        for c in targets:
            r, s = self.out.records[c], self._stats(c)
            if self.profile.columns[c].numeric_kind == NumericKind.BoundedDiscrete and s and s.min is not None:
                r.domain_snap_bounds = (s.min, s.max)
            d = ImputationFitDiagnostic(*scores[c])
            d.converged, d.n_iter, d.n_neighbors_used, d.k_capped = state.get("converged"), state.get("rounds"), state.get("k"), state.get("capped")
            d.observed_mean, d.observed_std, d.imputed_mean, d.imputed_std = spreads[c]
            d.variance_ratio = d.imputed_std / d.observed_std if d.observed_std and d.imputed_std is not None else None
            r.diagnostic = d

    def _add(self, state: dict, targets: list[str], x: np.ndarray, apply, fill) -> None:
        """Keep a model that was fitted on the rows ``x``."""
        done, n, at = apply(state, x), self.config.numeric, state["columns"].index
        scores = {c: fold_metrics(x, at(c), fill, n.refit_r2_cv_folds, n.refit_r2_min_complete_rows) for c in targets}
        of = lambda v: (float(v.mean()), float(v.std())) if len(v) else (None, None)
        spreads = {c: (*of(x[~np.isnan(x[:, at(c)]), at(c)]), *of(done[np.isnan(x[:, at(c)]), at(c)])) for c in targets}
        self._keep(state, targets, scores, spreads)

    def _chain(self, columns: list[str], targets: list[str], tag: NonlinearityTag | None) -> None:
        skewed = any((s := self._stats(c)) and s.skewness_severity not in (None, SkewSeverity.Normal) for c in targets)
        n, correlation = self.config.numeric, self.profile.dataset.feature_correlation
        values = [number(self.df, c) for c in columns]
        r = self.df.agg(*[e.alias(f"{k}{i}") for i, x in enumerate(values) for k, e in (("m", F.avg(x)), ("s", F.stddev_pop(x)))]).first()
        centre = [q[0] or 0.0 for _, q in of_expressions(self.df, values, [0.5])] if skewed else [r[f"m{i}"] or 0.0 for i in range(len(columns))]
        scale = [r[f"s{i}"] or 1.0 for i in range(len(columns))]
        p = products(self.df, columns, centre, scale, n.refit_r2_cv_folds, self.seed)
        rounds, tol = chain_rounds(n, targets, p, tag, [self._stats(c) for c in targets], correlation)
        used = predictors(p, [columns.index(c) for c in targets], nearest_features(n, p, correlation) if len(targets) > 1 else None)
        if tag not in (None, NonlinearityTag.Linear):
            x = matrix(self.df, columns, self.tree_rows, self.seed)
            fit = lambda m: fit_chain(m, columns, used, tag, rounds, tol, p.centre, p.scale, n, self.seed)
            return self._add(fit(x), targets, x, apply_chain, lambda train, test: apply_chain(fit(train), test))
        models, turns, done = chains.fit(p, list(used), used, rounds, tol)
        state = chain_state(columns, used, centre, scale, {c: {"kind": "linear", "beta": b} for c, b in models.items()}, turns, done)
        found = chains.fold_scores(self.df, p, used, n.refit_r2_min_complete_rows, n.refit_r2_cv_folds, self.seed)
        spreads = {}
        for c in targets:
            i = columns.index(c)
            e = chains.estimates(p, i, list(used), used, models, turns)
            back = lambda m, s, i=i: (None, None) if math.isnan(m) else (m * scale[i] + centre[i], s * scale[i])
            spreads[c] = (*back(*e[:2]), *back(*e[2:])) if e else (None,) * 4
        return self._keep(state, targets, {c: found[columns.index(c)] for c in targets}, spreads)

    def _mice(self, targets: list[str]) -> None:
        if not targets:
            return
        tags = [self._tag(c) for c in targets]
        if all(t == NonlinearityTag.Unpredictable for t in tags) or len(self.numeric) < 2:
            for c in targets:
                self._fall_back(c, "nothing predicts the block")
            return
        order = [NonlinearityTag.Linear, NonlinearityTag.MonotonicNonlinear, NonlinearityTag.ComplexNonlinear]
        self._chain(self._usable(targets), targets, max((t for t in tags if t in order), key=order.index, default=None))

    def _usable(self, first: list[str]) -> list[str]:
        """The columns of a model: its targets and all numeric columns that stay."""
        stay = [c for c in self.numeric if self.out.records[c].strategy != S.Dropped]
        return [*first, *[c for c in stay if c not in first]]

    def _regression(self, c: str) -> None:
        if self._tag(c) == NonlinearityTag.Unpredictable or len(self._usable([c])) < 2:
            self._fall_back(c, "nothing predicts it")
        else:
            self._chain(self._usable([c]), [c], self._tag(c))

    def _neighbours(self, targets: list[str]) -> None:
        if not targets:
            return
        n, columns = self.config.numeric, self._usable(targets)
        if len(columns) < 2:
            for c in targets:
                self._fall_back(c, "no other column to measure distances by")
            return
        x = whole_matrix(self.df, columns, self.seed)
        gaps = float(np.isnan(x[:, : len(targets)]).mean()) if x.size else 0.0
        complete = float((~np.isnan(x).any(axis=1)).mean()) if len(x) else 0.0
        k, capped = n_neighbours(n, len(columns), len(x), gaps, complete)
        weighted = gaps <= n.knn_distance_weight_max_null_ratio and len(columns) <= n.knn_distance_weight_max_features
        fit = lambda m: fit_neighbours(m, columns, k, weighted, range(len(targets)))
        self._add({**fit(x), "capped": capped}, targets, x, apply_neighbours, lambda train, test: apply_neighbours(fit(train), test))

    def _fill_kind(self, c: str) -> str:
        s = self._stats(c)
        return "mean" if s and s.skewness_severity == SkewSeverity.Normal else "median"

    def _cluster(self, c: str) -> None:
        group = self.config.numeric.bimodal_grouping_variables.get(c)
        if group:
            if group not in self.df.columns:
                return self._fall_back(c, f"no grouping column {group!r}")
            self.out.models.append({**fit_groups(self.df, c, group, self._fill_kind(c)), "fills_columns": [c]})
            return None
        s, correlation = self._stats(c), self.profile.dataset.feature_correlation
        b = s.bimodal_stats if s else None
        row = correlation.pearson_matrix.get(c, {}) if correlation else {}
        features = [f for f, r in row.items() if f != c and abs(r) > self.config.numeric.bimodal_correlation_threshold and f in self.df.columns]
        if not b or b.center1 is None or not features:
            return self._fall_back(c, "no two clusters with features")
        state = fit_clusters(self.df, c, (b.center1, b.center2), features, self._fill_kind(c))
        if None in state["fills"]:
            return self._fall_back(c, "a cluster is empty")
        self._keep(state, [c], {c: self._cluster_scores(c, (b.center1, b.center2), features)}, {c: self._spread(c, cluster_fill(self.df, state))})
        return None

    def _spread(self, c: str, fill: Column) -> tuple:
        """Mean and deviation of the values that are there, and of what ``fill`` gives for the others."""
        x = number(self.df, c)
        r = self.df.agg(F.avg(x), F.stddev_pop(x), F.avg(F.when(x.isNull(), fill)), F.stddev_pop(F.when(x.isNull(), fill))).first()
        return tuple(r)

    def _cluster_scores(self, c: str, centres: tuple[float, float], features: list[str]) -> tuple:
        """Scores over folds of complete rows, each filled by clusters fitted on the other folds."""
        n = self.config.numeric
        numbers = [number(self.df, f).alias(f) for f in [c, *features]]
        d = self.df.select(*numbers).dropna()
        d = d.withColumn("__fold", F.pmod(F.xxhash64(F.lit(self.seed), *[col(f) for f in [c, *features]]), F.lit(n.refit_r2_cv_folds))).persist()
        try:
            if d.count() < n.refit_r2_min_complete_rows:
                return None, None, None
            scores = []
            for f in range(n.refit_r2_cv_folds):
                state = fit_clusters(d.where(F.col("__fold") != f), c, centres, features, self._fill_kind(c))
                state["fills"] = [m if v is None else v for v, m in zip(state["fills"], centres)]
                off = col(c) - cluster_fill(d, state)
                r = d.where(F.col("__fold") == f).agg(F.count(F.lit(1)).alias("n"), F.var_pop(c).alias("v"), F.avg(off * off).alias("s"), F.avg(F.abs(off)).alias("a")).first()
                if r["n"] >= 2 and r["v"]:
                    scores.append((1 - r["s"] / r["v"], math.sqrt(r["s"]), r["a"]))
            return tuple(float(np.mean(s)) for s in zip(*scores)) if scores else (None, None, None)
        finally:
            d.unpersist()

    def _mixture(self, c: str) -> None:
        """Two normals by expectation maximisation from the profile's modes, over the outline of all values."""
        s = self._stats(c)
        b = s.bimodal_stats if s else None
        if not b or b.center1 is None:
            return self._fall_back(c, "no two modes in the profile")
        cells = outline(self.df, number(self.df, c))
        if not cells:
            return self._fall_back(c, "no values")
        values, counts = np.array([(low + high) / 2 for low, high, _ in cells]), np.array([float(m) for _, _, m in cells])
        means, stds, weights = mathx.mixture_of_two(values, counts, start=(b.center1, b.center2))
        state = {"kind": "mixture", "means": means.tolist(), "stds": stds.tolist(), "weights": weights.tolist()}
        self._keep(state, [c], {c: (None, None, None)}, {c: self._spread(c, drawn(self.df, state, self.seed, c))})
        return None


__all__ = ["FittedImputer", "ImputationOrchestrator", "Serial"]
