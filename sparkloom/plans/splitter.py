"""Train and test splits, folds, and splits stratified by what a profile found."""

from __future__ import annotations

import math
import random
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import SemanticType, SplitConfig
from ..functions.casts import to_boolean
from ..functions.nulls import normalize, normalized
from ..operators import splits as S
from ..operators.base import col
from ..operators.columns import number
from ..operators.quantiles import of_expressions
from ..results import (
    BooleanStats, CategoricalStats, FoldResult, MissingnessFlag, NumericStats, SkewSeverity, SplitResult, StructuralProfileResult,
)

_UNSET = object()
TARGET_BUCKETS = 5


def signal_columns(df: DataFrame, profile: StructuralProfileResult, target: str | None = None, config: SplitConfig | None = None) -> dict[str, Column]:
    """Named boolean signals of the normalised table ``df``: missing cells, extremes, rare labels, minorities, target."""
    config = config or SplitConfig()
    out: dict[str, Column] = {}
    never = lambda e: F.coalesce(e, F.lit(False))
    some = {c: p for c, p in profile.columns.items() if c in df.columns}
    missing = [c for c, p in some.items() if p.missingness and p.missingness.effective_null_count]
    for c in missing:
        out[f"{c}:missing"] = col(c).isNull()
    suspects = [c for c in missing if MissingnessFlag.MARSuspect in some[c].missingness.flags]
    for a, b in combinations(suspects, 2):
        if b in some[a].missingness.correlated_with:
            out[f"{a}|{b}:missing"] = col(a).isNull() | col(b).isNull()
    for c, p in some.items():
        s = p.stats
        if isinstance(s, NumericStats) and s.percentiles:
            x, q = number(df, c), s.percentiles
            out[f"{c}:low"] = never(x < q.p5)
            out[f"{c}:high"] = never(x > (q.p99 if s.skewness_severity == SkewSeverity.Severe else q.p95))
            if s.skewness and s.skewness > 0 and s.skewness_severity != SkewSeverity.Normal:
                out[f"{c}:not positive"] = never(x <= 0)
        elif isinstance(s, CategoricalStats) and s.rare_categories.rare_label_values:
            out[f"{c}:rare"] = never(col(c).cast("string").isin(list(s.rare_categories.rare_label_values)))
        elif isinstance(s, BooleanStats) and s.true_count + s.false_count:
            b = to_boolean(col(c), df.schema[c].dataType)
            for ratio, value in ((s.true_ratio, True), (s.false_ratio, False)):
                if 0 < ratio < config.boolean_minority_threshold:
                    out[f"{c}:{value}"] = never(b == value)
    if target is not None:
        kind = df.schema[target].dataType
        if isinstance(kind, T.NumericType):
            x = number(df, target)
            edges = [q for q in of_expressions(df, [x], [i / TARGET_BUCKETS for i in range(1, TARGET_BUCKETS)])[0][1] if q is not None]
            bounds = [-math.inf, *sorted(set(edges)), math.inf]
            for i, (a, b) in enumerate(zip(bounds, bounds[1:])):
                out[f"{target}:bucket {i}"] = never((x > a) & (x <= b)) if a > -math.inf else never(x <= b)
        else:
            for r in sorted(str(r[0]) for r in df.select(col(target).cast("string")).distinct().collect() if r[0] is not None):
                out[f"{target}:{r}"] = never(col(target).cast("string") == r)
    p90 = profile.dataset.row_distribution.row_missing_p90
    if p90 > 0 and some:
        total = F.lit(0)
        for c in some:
            total = total + col(c).isNull().cast("int")
        out["row:many missing"] = total > p90
    return out


def label_matrix(df: DataFrame, profile: StructuralProfileResult, target: str | None = None, config: SplitConfig | None = None) -> tuple[DataFrame, dict[str, Column]]:
    """The normalised table, and the signals that occur, the rarest ``max_stratification_signals`` of them in their order."""
    config = config or SplitConfig()
    clean = normalize(df, profile.numeric_sentinels, profile.string_sentinels)
    signals = signal_columns(clean, profile, target, config)
    if not signals:
        return clean, {}
    names = list(signals)
    share = clean.agg(*[F.avg(signals[n].cast("double")).alias(str(i)) for i, n in enumerate(names)]).first()
    present = [(share[str(i)], i, n) for i, n in enumerate(names) if share[str(i)]]
    kept = {n for _, _, n in sorted(present)[: config.max_stratification_signals]}
    return clean, {n: signals[n] for n in names if n in kept}


class DataSplitter:
    """Splits of ``df``.  Without a seed a random one is drawn and kept in ``random_seed``, so a splitter repeats itself."""

    def __init__(self, df: DataFrame, target: str | None = None, random_seed: int | None = None, config: SplitConfig | None = None) -> None:
        if not isinstance(df, DataFrame):
            raise TypeError(f"a Spark DataFrame is needed, not {type(df).__name__}")
        if df.isEmpty():
            raise ValueError("an empty table cannot be split")
        if target is not None and target not in df.columns:
            raise ValueError(f"no column {target!r} to stratify by")
        self.df, self.target, self.config = df, target, config or SplitConfig()
        self.random_seed = random.SystemRandom().randrange(2**31) if random_seed is None else random_seed

    def _stratify(self, stratify) -> bool:
        if stratify is _UNSET:
            return self.target is not None
        if stratify and self.target is None:
            raise ValueError("stratify=True needs a target")
        return bool(stratify)

    @staticmethod
    def _share(test_size: float) -> float:
        if not 0 < test_size < 1:
            raise ValueError("test_size must lie between 0 and 1")
        return test_size

    @staticmethod
    def _result(train: DataFrame, test: DataFrame, a: int, b: int, n: int) -> SplitResult:
        return SplitResult(train, test, a, b, a / n, b / n)

    def _marked(self, d: DataFrame, rows: int, test_rows: int) -> SplitResult:
        """Parts of known sizes: nothing is counted again."""
        names = [col(c) for c in self.df.columns]
        return self._result(d.where(~F.col("__test")).select(*names), d.where("__test").select(*names), rows - test_rows, test_rows, rows)

    def random_split(self, test_size: float, stratify=_UNSET) -> SplitResult:
        n = self.df.count()
        rows = math.ceil(n * self._share(test_size))
        if self._stratify(stratify):
            return self._marked(S.stratified_split(self.df, self.target, rows, self.random_seed), n, rows)
        return self._marked(S.random_split(self.df, rows, self.random_seed), n, rows)

    def time_split(self, time_column: str, test_size: float | None = None, cutoff=None) -> SplitResult:
        """By ``cutoff`` if given, else the last ``test_size`` of the rows; rows without time are in neither part of a cutoff."""
        if time_column not in self.df.columns:
            raise ValueError(f"no column {time_column!r}")
        if cutoff is not None:
            t = col(time_column)
            n, a, b = self.df.agg(F.count(F.lit(1)), F.count_if(t < F.lit(cutoff)), F.count_if(t >= F.lit(cutoff))).first()
            return self._result(*S.cutoff_split(self.df, time_column, cutoff), a, b, n)
        if test_size is None:
            raise ValueError("time_split needs test_size or cutoff")
        n = self.df.count()
        return self._marked(S.time_split(self.df, time_column, self._share(test_size), n), n, math.floor(n * test_size))

    def _folds(self, d: DataFrame, k: int, part: str) -> list[FoldResult]:
        names = [col(c) for c in self.df.columns]
        sizes = {r[part]: r["count"] for r in d.groupBy(part).count().collect()}
        n = sum(sizes.values())
        return [FoldResult(d.where(F.col(part) != i).select(*names), d.where(F.col(part) == i).select(*names), i, n - sizes.get(i, 0), sizes.get(i, 0)) for i in range(k)]

    @staticmethod
    def _check_k(k: int) -> int:
        if k < 2:
            raise ValueError("k must be at least 2")
        return k

    def kfold(self, k: int, stratify=_UNSET) -> list[FoldResult]:
        by = self.target if self._stratify(stratify) else None
        return self._folds(S.folds(self.df, self._check_k(k), self.random_seed, by), k, "__fold")

    def _parts(self, profile: StructuralProfileResult, parts: list[float]) -> DataFrame | None:
        """The rows as they came with ``__part``; signals look at normalised cells beside them."""
        _, signals = label_matrix(self.df, profile, self.target, self.config)
        if not signals:
            return None
        raw = [f"__raw{i}" for i in range(len(self.df.columns))]
        clean = normalized(self.df, profile.numeric_sentinels, profile.string_sentinels)
        both = self.df.select(*clean, *[col(c).alias(r) for c, r in zip(self.df.columns, raw)])
        d = S.by_signals(both, list(signals.values()), parts, self.random_seed)
        return d.select(*[F.col(r).alias(c) for c, r in zip(self.df.columns, raw)], "__part")

    def profile_stratified_split(self, profile: StructuralProfileResult, test_size: float) -> SplitResult:
        d = self._parts(profile, [1 - self._share(test_size), test_size])
        if d is None:
            return self.random_split(test_size, stratify=False)
        n = self.df.count()
        return self._marked(d.withColumn("__test", F.col("__part") == 1), n, S.quotas_of_parts(n, [1 - test_size, test_size])[1])

    def profile_stratified_kfold(self, profile: StructuralProfileResult, k: int) -> list[FoldResult]:
        d = self._parts(profile, [1 / self._check_k(k)] * k)
        return self.kfold(k, stratify=False) if d is None else self._folds(d, k, "__part")


__all__ = ["DataSplitter", "SemanticType", "label_matrix", "signal_columns"]
