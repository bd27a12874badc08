"""Structural profiling of a table.

Every step is a job over the table that brings back a few numbers a column or pair; decisions are made on the driver.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from datetime import datetime, timezone

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import Modality, NumericKind, PipelineConfig, PipelinePhase, ProfileConfig, SemanticType
from ..functions import mathx
from ..functions.nulls import normalize
from ..operators import columns as C
from ..operators import pairs as P
from ..operators.base import col, per_column, top_values, value_counts
from ..operators.quantiles import outline
from ..operators.types import detect
from ..results import (
    BimodalStats, BooleanFlag, BooleanStats, CategoricalFlag, CategoricalStats, CategoricalTargetCorrelation, ColumnMissingnessProfile, ColumnProfile,
    CorrelationPair, CorrelationProfileResult, CramerVPair, DatasetStats, DatetimeFlag, DatetimeStats, EtaSquaredPair, HistogramBin, ImbalanceMetrics,
    InferredGranularity, KurtosisTag, MissingnessFlag, MissingSeverity, MutualInformationEntry, NearRedundancyGroup, NonlinearityTag, NumericFlag, NumericStats,
    NumericTargetCorrelation, OverrideCoercionError, PercentileSnapshot, RareCategoryStats, RowMissingnessDistribution, SkewSeverity, StructuralProfileResult,
    TailAsymmetryTag, TargetFlag, TargetProblemType, TargetProfileResult, TargetType, TemporalSignals, TextStats, TopValueEntry, TypeFlag,
)

#: Estimated bytes from which a profile says that the table is large and breaks its size down by column.
CHUNKED_BYTES = 500 * 1024 * 1024


# Decisions on collected numbers


def severity(ratio: float, config) -> MissingSeverity | None:
    if ratio == 0:
        return None
    for limit, name in ((config.severity_minor, MissingSeverity.Minor), (config.severity_moderate, MissingSeverity.Moderate), (config.severity_high, MissingSeverity.High)):
        if ratio < limit:
            return name
    return MissingSeverity.Severe


def skew_severity(skew: float | None, config) -> SkewSeverity | None:
    if skew is None:
        return None
    for limit, name in ((config.skew_normal, SkewSeverity.Normal), (config.skew_moderate, SkewSeverity.Moderate), (config.skew_high, SkewSeverity.High)):
        if abs(skew) < limit:
            return name
    return SkewSeverity.Severe


def kurtosis_tag(kurtosis: float | None, config) -> KurtosisTag | None:
    if kurtosis is None:
        return None
    if kurtosis < config.kurt_platykurtic_upper:
        return KurtosisTag.Platykurtic
    return KurtosisTag.Leptokurtic if kurtosis > config.kurt_leptokurtic_lower else KurtosisTag.Mesokurtic


def scale_anomaly(low: float, high: float, orders: int) -> bool:
    """The maximum is at least 10**orders times the minimum, in size; ends within 1 are exempt, a zero minimum counts as 1."""
    a, b = abs(low), abs(high)
    return b > 0 and max(a, b) > 1 and b / (a or 1.0) >= 10**orders


def tail_share(q: PercentileSnapshot, config) -> tuple[float | None, TailAsymmetryTag | None]:
    """The right tail's part of both tails."""
    right, left = q.p99 - q.p95, q.p5 - q.p1
    if right + left <= 0:
        return None, None
    share = right / (right + left)
    tag = TailAsymmetryTag.RightHeavy if share > config.tail_asymmetry_right_share_threshold else TailAsymmetryTag.LeftHeavy if share < config.tail_asymmetry_left_share_threshold else TailAsymmetryTag.Symmetric
    return share, tag


def nonlinearity_tag(r2_forest: float, r2_linear: float, discrepancy: float, excess: float, config) -> NonlinearityTag:
    gap = r2_forest - r2_linear
    if r2_forest < config.r2_rf_unpredictable_threshold:
        return NonlinearityTag.Unpredictable
    if discrepancy >= config.spearman_pearson_discrepancy_threshold and gap < config.r2_gap_threshold:
        return NonlinearityTag.MonotonicNonlinear
    if gap >= config.r2_gap_threshold or excess >= config.mutual_information_threshold:
        return NonlinearityTag.ComplexNonlinear
    return NonlinearityTag.Linear


def redundancy_groups(pairs: Sequence[tuple[str, str]]) -> list[NearRedundancyGroup]:
    groups: list[set[str]] = []
    for a, b in pairs:
        touched = [g for g in groups if a in g or b in g]
        groups = [g for g in groups if g not in touched] + [set().union({a, b}, *touched)]
    return [NearRedundancyGroup(sorted(g), sorted(g)[1:]) for g in sorted(groups, key=sorted)]


# Profiles of columns by type


def missingness_profiles(df: DataFrame, columns: Sequence[str], config: ProfileConfig) -> tuple[dict[str, ColumnMissingnessProfile], dict[str, dict[str, float]]]:
    """Profiles by column, and the matrix of indicator correlations of columns with missing cells."""
    if not columns:
        return {}, {}
    m = config.missingness
    sentinels = (config.numeric_sentinels, config.string_sentinels)
    out = {}
    for r in C.missingness(df, columns, *sentinels).collect():
        n = r["total_rows"]
        p = ColumnMissingnessProfile(r["column"], n, r["standard_nulls"], r["effective_nulls"], *[x / n if n else 0.0 for x in (r["standard_nulls"], r["effective_nulls"])])
        p.severity = severity(p.effective_null_ratio, m)
        if n and p.effective_null_count == n:
            p.flags.append(MissingnessFlag.FullyNull)
        elif p.effective_null_ratio > m.col_drop_threshold:
            p.flags.append(MissingnessFlag.DropCandidate)
        out[p.column] = p
    out = {c: out[c] for c in columns}
    some = [c for c in columns if out[c].effective_null_count]
    matrix = {c: {c: 1.0} for c in some}
    for r in P.missing_correlation(df, some, *sentinels).collect():
        a, b, x = r["column_a"], r["column_b"], r["r"]
        matrix[a][b] = matrix[b][a] = x
        if x > m.mar_correlation_threshold:
            for one, other in ((a, b), (b, a)):
                out[one].correlated_with.append(other)
                if MissingnessFlag.MARSuspect not in out[one].flags:
                    out[one].flags.append(MissingnessFlag.MARSuspect)
    return out, matrix


def numeric_profiles(df: DataFrame, columns: Sequence[str], config, overrides: set[str] = frozenset()) -> dict[str, NumericStats]:
    if not columns:
        return {}
    types = C.kinds(df)
    summary = C.numeric_summary(df, columns)
    rows = {r["column"]: r for r in summary.join(C.shape(summary), "column").collect()}
    counts = value_counts(df, columns, "double", lambda c: C.number(df, c))
    tops: dict[str, list] = {c: [] for c in columns}
    for r in sorted(top_values(counts, 10).collect(), key=lambda r: r["place"]):
        tops[r["column"]].append(r)
    centre = {c: (rows[c]["mean"], rows[c]["std"]) for c in columns if rows[c]["n"] and rows[c]["std"]}
    density = {r["column"]: r["outlier_density"] for r in C.outlier_density(df, centre, config.outlier_sigma_threshold).collect()} if centre else {}
    out = {}
    for c in columns:
        r, s = rows[c], NumericStats()
        if r["n"] < r["raw_n"]:
            s.flags.append(NumericFlag.FormatMismatch)
        if not r["n"]:
            if c in overrides and r["raw_n"]:
                raise OverrideCoercionError(f"no value of {c!r} is a number")
            out[c] = s
            continue
        s.percentiles = PercentileSnapshot(*[r[k] for k in C.QUANTILES])
        s.mean, s.median, s.min, s.max, s.std = r["mean"], r["p50"], r["min"], r["max"], r["std"]
        s.variance = s.std**2
        s.mean_median_ratio = s.mean / s.median if s.median else (1.0 if s.mean == 0 else None)
        s.skewness, s.kurtosis = r["skewness"], r["kurtosis"]
        s.skewness_severity, s.kurtosis_tag = skew_severity(s.skewness, config), kurtosis_tag(s.kurtosis, config)
        first = tops[c][0]
        s.mode, s.mode_frequency = first["value"], first["n"] / r["rows"]
        if s.mode_frequency > config.near_constant_threshold:
            s.flags.append(NumericFlag.NearConstant)
        if isinstance(types[c], (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
            s.top_values = [TopValueEntry(int(t["value"]), t["n"], t["n"] / r["rows"]) for t in tops[c]]
        else:
            bins = mathx.histogram_bins(r["n"], s.min, s.max, s.percentiles.iqr)
            low, high = (s.min, s.max) if s.min < s.max else (s.min - 0.5, s.max + 0.5)
            found = {h["bin"]: h["n"] for h in C.histogram(df, c, s.min, s.max, bins).collect()}
            width = (high - low) / bins
            s.histogram = [HistogramBin(low + i * width, low + (i + 1) * width, found.get(i, 0), found.get(i, 0) / r["n"]) for i in range(bins)]
        if scale_anomaly(s.min, s.max, config.scale_orders_of_magnitude):
            s.flags.append(NumericFlag.ScaleAnomaly)
        s.tail_asymmetry_share, s.tail_asymmetry_tag = tail_share(s.percentiles, config)
        s.outlier_density = density.get(c, 0.0)
        if s.outlier_density > config.high_outlier_density_threshold:
            s.flags.append(NumericFlag.HighOutlierDensity)
        if NumericFlag.NearConstant not in s.flags and r["n"] >= 3 and s.std:
            s.bimodal_stats = bimodal(df, c, s, r["n"], config)
            if s.bimodal_stats and s.bimodal_stats.minority_weight is not None:
                s.flags.append(NumericFlag.Bimodal)
        out[c] = s
    return out


#: Cells of a distribution on which the dip and the mixture are computed: single values up to that many, else straight pieces.
SUMMARY_POINTS = 2000


def dip_of(cells: Sequence[tuple[float, float, int]]) -> float:
    """The dip of a distribution given as cells of values, straight within a cell."""
    n = sum(c for _, _, c in cells)
    x, below, above, run = [], [], [], 0
    for low, high, c in cells:
        if low == high:
            x.append(low)
            below.append(run / n)
            above.append((run + c) / n)
        else:
            x += [low, high]
            below += [run / n, (run + c) / n]
            above += [run / n, (run + c) / n]
        run += c
    return mathx.dip_between(np.array(x), np.array(below), np.array(above), n)


def bimodal(df: DataFrame, column: str, s: NumericStats, n: int, config) -> BimodalStats | None:
    """The dip test, and behind it a mixture of two with separated, weighty components; all rows count."""
    cells = outline(df, C.number(df, column), SUMMARY_POINTS)
    values, counts = np.array([(a + b) / 2 for a, b, _ in cells]), np.array([float(c) for _, _, c in cells])
    d = dip_of(cells)
    p = mathx.dip_p_value(d, n)
    if p >= config.bimodal_dip_p_value_threshold:
        return None
    mean, std, share = mathx.mixture_of_two(values, counts)
    separation = float(abs(mean[0] - mean[1]) * math.sqrt(2) / math.sqrt(float(std[0] ** 2 + std[1] ** 2))) if std.any() else math.inf
    weight = float(share.min())
    if separation < config.bimodal_min_separation_threshold or weight < config.bimodal_min_component_weight:
        return None
    first, second = sorted(map(float, mean))
    return BimodalStats(d, p, first, second, separation, weight)


def categorical_profiles(df: DataFrame, columns: Sequence[str], config) -> dict[str, CategoricalStats]:
    if not columns:
        return {}
    every = value_counts(df, columns).persist()
    try:
        rows = {r["column"]: r for r in C.categorical_summary(df, columns, config.rare_threshold_pct, every).collect()}
        tops: dict[str, list] = {c: [] for c in columns}
        for r in sorted(top_values(C.listed(df, columns, every), 10).collect(), key=lambda r: r["place"]):
            tops[r["column"]].append(r)
        labels: dict[str, list[str]] = {c: [] for c in columns}
        for r in sorted(C.rare_labels(df, columns, config.stratification_rare_threshold_pct, every).collect(), key=lambda r: (-r["n"], r["value"])):
            labels[r["column"]].append(r["value"])
    finally:
        every.unpersist()
    out = {}
    for c in columns:
        r = rows[c]
        n, total = r["rows"], r["total"]
        s = CategoricalStats(r["cardinality"], r["cardinality"] / n if n else 0.0, r["mode_count"] / total if total else 0.0)
        s.top_values = [TopValueEntry(t["value"], t["n"], t["n"] / total) for t in tops[c]]
        s.rare_categories = RareCategoryStats(
            config.rare_threshold_pct, r["rare_categories"], r["rare_rows"], r["rare_rows"] / total if total else 0.0, labels[c], config.stratification_rare_threshold_pct
        )
        s.imbalance = ImbalanceMetrics(r["dominant_ratio"], r["normalized_entropy"], r["normalized_gini"])
        minor = min(r["numeric_values"], r["present"] - r["numeric_values"])
        if minor and mathx.wilson_lower(minor, r["present"]) >= config.mixed_type_min_minor_pct:
            s.flags.append(CategoricalFlag.MixedType)
        if s.mode_frequency > config.near_constant_threshold:
            s.flags.append(CategoricalFlag.NearConstant)
        out[c] = s
    return out


def boolean_profiles(df: DataFrame, columns: Sequence[str], overrides: set[str] = frozenset()) -> dict[str, BooleanStats]:
    if not columns:
        return {}
    out = {}
    for r in C.boolean_summary(df, columns).collect():
        t, f = r["true_count"], r["false_count"]
        if r["present"] and not t + f and r["column"] in overrides:
            raise OverrideCoercionError(f"no value of {r['column']!r} is a boolean")
        s = BooleanStats(t, f, *[x / (t + f) if t + f else 0.0 for x in (t, f)], None if t == f else t > f)
        if t + f < r["present"]:
            s.flags.append(BooleanFlag.FormatMismatch)
        out[r["column"]] = s
    return out


def text_profiles(df: DataFrame, columns: Sequence[str]) -> dict[str, TextStats]:
    if not columns:
        return {}
    names = ["avg_token_count", "median_token_count", "vocabulary_size", "char_length_min", "char_length_max", "char_length_mean", "char_length_median", "empty_ratio", "whitespace_ratio"]
    return {r["column"]: TextStats(*[r[n] or 0 for n in names]) for r in C.text_summary(df, columns).collect()}


def datetime_profiles(df: DataFrame, columns: Sequence[str], config, formats=None, units=None, now: datetime | None = None, overrides: set[str] = frozenset()) -> dict[str, DatetimeStats]:
    if not columns:
        return {}
    now = now or datetime.now(timezone.utc)
    formats, units = dict(formats or {}), {k: str(v) for k, v in (units or {}).items()}
    out = {}
    for r in C.datetime_summary(df, columns, now, formats, units).collect():
        c, s = r["column"], DatetimeStats()
        how = {"fmt": formats.get(c), "unit": units.get(c)}
        if r["n"] < r["raw_n"]:
            s.flags.append(DatetimeFlag.FormatMismatch)
        if not r["n"]:
            if c in overrides and r["raw_n"]:
                raise OverrideCoercionError(f"no value of {c!r} is a datetime")
            out[c] = s
            continue
        s.min_date, s.max_date, s.date_range_days = r["min_date"].isoformat(), r["max_date"].isoformat(), r["range_days"]
        s.future_date_count = r["future_dates"]
        if s.future_date_count:
            s.flags.append(DatetimeFlag.FutureDates)
        if r["rows"] and 1 - r["raw_n"] / r["rows"] > config.mnar_null_ratio_threshold:
            s.flags.append(DatetimeFlag.MnarSuspected)
        if s.date_range_days > 0:
            cutoff = r["max_date"] - (r["max_date"] - r["min_date"]) * config.recent_window_fraction
            recent = C.recent_count(df, c, cutoff, **how).first()["recent"]
            if recent / (r["n"] * config.recent_window_fraction) < config.recent_density_threshold:
                s.flags.append(DatetimeFlag.RecentDateMissing)
        g = C.gap_summary(df, c, **how).first()
        s.median_gap_seconds, s.gap_cv = g["median_gap_seconds"], g["gap_cv"]
        s.inferred_granularity = InferredGranularity(C.granularity(s.median_gap_seconds))
        if s.gap_cv is not None and s.gap_cv > config.high_gap_cv_threshold:
            s.flags.append(DatetimeFlag.HighGapVariance)
        s.signals = TemporalSignals(*[r[f] for f in ("has_year", "has_month", "has_day", "has_day_of_week", "has_hour", "has_is_weekend", "has_is_month_end")])
        out[c] = s
    return {c: out[c] for c in columns}


def target_profile(df: DataFrame, column: str, config: ProfileConfig) -> TargetProfileResult:
    """Problem type and profile of a target, with the default settings of all profilers."""
    from ..config import CategoricalProfileConfig, NumericProfileConfig

    one = df.select(col(column).alias(column))
    info = detect(one)[column]
    m = missingness_profiles(one, [column], ProfileConfig())[0][column]
    n_unique = one.na.drop().distinct().count()
    kind = TargetProblemType.Unknown
    coded = info.semantic_type == SemanticType.Categorical or (info.semantic_type == SemanticType.Text and info.original_dtype == "string")
    if info.semantic_type == SemanticType.Boolean:
        kind = TargetProblemType.BinaryClassification
    elif coded:
        too_many = n_unique > 100 or (m.total_rows > 1000 and n_unique / m.total_rows > 0.05)
        kind = TargetProblemType.Unknown if too_many or n_unique < 2 else TargetProblemType.BinaryClassification if n_unique == 2 else TargetProblemType.MulticlassClassification
    elif info.semantic_type == SemanticType.Numeric:
        kind = TargetProblemType.Regression
    t = TargetProfileResult(column, kind, m.effective_null_count, m.effective_null_ratio)
    if t.missing_count:
        t.flags.append(TargetFlag.ContainsMissing)
    if info.semantic_type == SemanticType.Identifier:
        t.flags.append(TargetFlag.IsIdentifier)
    if kind in (TargetProblemType.BinaryClassification, TargetProblemType.MulticlassClassification):
        t.categorical_profile = categorical_profiles(one.select(col(column).cast("string").alias(column)), [column], CategoricalProfileConfig())[column]
        ratio = t.categorical_profile.imbalance.dominant_class_ratio
        if ratio is not None and ratio > 5:
            t.flags.append(TargetFlag.SevereImbalance if ratio > 20 else TargetFlag.HighImbalance)
    elif kind == TargetProblemType.Regression:
        t.numeric_profile = numeric_profiles(one, [column], NumericProfileConfig())[column]
        if t.numeric_profile.skewness_severity == SkewSeverity.Severe:
            t.flags.append(TargetFlag.HighlySkewed)
    return t


# Pairs


class CorrelationProfiler:
    """Associations between features, and of features with a target."""

    def __init__(self, numeric_columns: Sequence[str] = (), categorical_columns: Sequence[str] = (), config=None, top_n_feature_target: int = 10) -> None:
        from ..config import CorrelationProfileConfig

        self.numeric, self.categorical = list(numeric_columns), list(categorical_columns)
        self.config, self.top = config or CorrelationProfileConfig(), top_n_feature_target

    def profile(self, df: DataFrame) -> CorrelationProfileResult:
        return self.profile_features(df)

    def profile_features(self, df: DataFrame) -> CorrelationProfileResult:
        out = CorrelationProfileResult(list(self.numeric), list(self.categorical))
        for kind, matrix in (("pearson", out.pearson_matrix), ("spearman", out.spearman_matrix)):
            matrix |= {c: {c: 1.0} for c in self.numeric}
            if len(self.numeric) > 1:
                for r in getattr(P, kind)(df, self.numeric).collect():
                    matrix[r["column_a"]][r["column_b"]] = matrix[r["column_b"]][r["column_a"]] = r[kind]
        limit = self.config.near_redundant_pearson_threshold
        for i, a in enumerate(self.numeric):
            for b in self.numeric[i + 1 :]:
                r, s = out.pearson_matrix[a][b], out.spearman_matrix[a][b]
                out.pairwise.append(CorrelationPair(a, b, r, s, abs(r) > limit or abs(s) > limit))
        out.near_redundant_pairs = [p for p in out.pairwise if p.near_redundant]
        out.near_redundancy_groups = redundancy_groups([(p.col_a, p.col_b) for p in out.near_redundant_pairs])
        for i, a in enumerate(self.categorical):
            for b in self.categorical[i + 1 :]:
                v = P.cramers_v(df, a, b).first()["cramers_v"]
                out.cramer_v_pairs.append(CramerVPair(a, b, v, v is not None and v > self.config.near_redundant_cramer_v_threshold))
        for a in self.numeric:
            for b in self.categorical:
                e = P.between_groups(df, a, b).first()["eta_squared"]
                out.eta_squared_pairs.append(EtaSquaredPair(a, b, e, e is not None and e > self.config.near_redundant_eta_squared_threshold))
        out.near_redundant_cramer_v_pairs = [p for p in out.cramer_v_pairs if p.near_redundant]
        out.near_redundant_eta_squared_pairs = [p for p in out.eta_squared_pairs if p.near_redundant]
        return out

    def profile_target(self, df: DataFrame, features: CorrelationProfileResult, target: str) -> CorrelationProfileResult:
        out = CorrelationProfileResult(**{k: getattr(features, k) for k in ("analysed_numeric_columns", "analysed_categorical_columns", "pearson_matrix", "spearman_matrix", "pairwise", "near_redundant_pairs", "near_redundancy_groups", "cramer_v_pairs", "near_redundant_cramer_v_pairs", "eta_squared_pairs", "near_redundant_eta_squared_pairs")})
        numeric = [c for c in self.numeric if c != target]
        categorical = [c for c in self.categorical if c != target]
        is_number = isinstance(C.kinds(df)[target], T.NumericType)
        out.target_column, out.target_type = target, TargetType.Numeric if is_number else TargetType.Categorical
        if is_number:
            values = {c: C.number(df, c) for c in [target, *numeric]}
            rows = P.correlations(df, values, "r", [(target, c) for c in numeric]).collect()
            scores = [NumericTargetCorrelation(r["column_b"], r["r"]) for r in rows]
            out.feature_target_numeric = sorted(scores, key=lambda s: (-abs(s.pearson_r), s.feature))[: self.top]
            groups = [(target, c, c) for c in categorical]
        else:
            groups = [(c, target, c) for c in numeric]
        found = []
        for x, g, feature in groups:
            r = P.between_groups(df, x, g).first()
            if r["f"] is not None:
                found.append(CategoricalTargetCorrelation(feature, r["f"], mathx.f_sf(r["f"], r["k"] - 1, r["n"] - r["k"]), r["eta_squared"]))
        out.feature_target_categorical = sorted(found, key=lambda s: (-s.eta_squared, s.feature))[: self.top]
        out.mutual_information = self._information(df, numeric, categorical, target, is_number)
        return out

    def _information(self, df: DataFrame, numeric: Sequence[str], categorical: Sequence[str], target: str, is_number: bool) -> list[MutualInformationEntry]:
        """Exact from counts where both sides are categories, else by neighbours, from all complete rows."""
        out = []
        for c in [*numeric, *categorical]:
            discrete = c in categorical
            if discrete and not is_number:
                r = P.mutual_information_discrete(df, c, target).first()
                if r["n"] and r["n"] >= self.config.mi_min_rows:
                    out.append(MutualInformationEntry(c, r["mi"]))
                continue
            levels = [name for name, is_code in ((c, discrete), (target, not is_number)) if is_code]
            n, found = P.mutual_information(df, [c, target], levels, [(c, target)])
            if n >= self.config.mi_min_rows:
                out.append(MutualInformationEntry(c, found[(c, target)]))
        out.sort(key=lambda s: (-s.mi_score, s.feature))
        for place, entry in enumerate(out, 1):
            entry.rank = place
        return out


class NonlinearityProfiler:
    """How each numeric column depends on the others: rank against plain correlation, information, and two kinds of models."""

    def __init__(self, numeric_columns: Sequence[str], config=None) -> None:
        from ..config import NonlinearityProfileConfig

        self.columns, self.config = list(numeric_columns), config or NonlinearityProfileConfig()

    def profile(self, df: DataFrame, correlation: CorrelationProfileResult | None = None) -> dict[str, dict]:
        if len(self.columns) < 2:
            return {}
        d = df.select(*[C.number(df, c).alias(c) for c in self.columns])
        d = d.dropna().where(~F.greatest(*[F.isnan(col(c)).cast("int") for c in self.columns]).cast("boolean"))
        rows = P.sample(d, self.columns, self.config.bootstrap_sample_size, self.config.random_state).collect()
        if len(rows) < self.config.min_rows:
            return {}
        x = np.array([list(r) for r in rows], dtype=float)
        x = x[np.random.default_rng(self.config.random_state).permutation(len(x))]
        correlation = correlation or CorrelationProfiler(self.columns).profile_features(df)
        _, information = P.mutual_information(d, self.columns, [], [(a, b) for i, a in enumerate(self.columns) for b in self.columns[i + 1 :]])
        out = {}
        for i, c in enumerate(self.columns):
            others = [j for j in range(len(self.columns)) if j != i]
            pearson = {self.columns[j]: correlation.get_pearson(c, self.columns[j]) or 0.0 for j in others}
            gap = max(abs(correlation.get_spearman(c, k) or 0.0) - abs(r) for k, r in pearson.items())
            mi = [information[(c, k) if (c, k) in information else (k, c)] for k in pearson]
            expected = [-0.5 * math.log(max(1e-12, 1 - min(pearson[self.columns[j]] ** 2, 1 - 1e-12))) for j in others]
            excess = float(np.mean([max(0.0, m - e) for m, e in zip(mi, expected)]))
            linear, forest = _cross_validated(x[:, others], x[:, i], self.config.random_state)
            out[c] = {
                "spearman_pearson_discrepancy": gap, "mean_mutual_information": float(np.mean(mi)), "excess_mutual_information": excess,
                "r2_gap": forest - linear, "r2_linear": linear, "r2_forest": forest, "heteroscedasticity_p_value": breusch_pagan(d, c, [self.columns[j] for j in others]),
                "nonlinearity_tag": nonlinearity_tag(forest, linear, gap, excess, self.config),
            }
        return out


def _r2(y: np.ndarray, p: np.ndarray) -> float:
    total = float(((y - y.mean()) ** 2).sum())
    return 1 - float(((y - p) ** 2).sum()) / total if total > 0 else 0.0


def _cross_validated(x: np.ndarray, y: np.ndarray, seed: int, folds: int = 3, trees: int = 50, depth: int = 4) -> tuple[float, float]:
    """Mean R² over contiguous folds of least squares and of a forest of shallow trees, on a bounded sample."""
    bounds = np.linspace(0, len(y), folds + 1).astype(int)
    linear, forest = [], []
    r = np.random.default_rng(seed)
    for a, b in zip(bounds, bounds[1:]):
        train = np.r_[0:a, b : len(y)]
        design = np.c_[np.ones(len(train)), x[train]]
        beta = np.linalg.lstsq(design, y[train], rcond=None)[0]
        linear.append(_r2(y[a:b], np.c_[np.ones(b - a), x[a:b]] @ beta))
        p = np.zeros(b - a)
        for _ in range(trees):
            own = r.choice(train, len(train))
            p += _tree(x[own], y[own], depth)(x[a:b])
        forest.append(_r2(y[a:b], p / trees))
    return float(np.mean(linear)), float(np.mean(forest))


def _tree(x: np.ndarray, y: np.ndarray, depth: int):
    """A regression tree by variance, as a function of rows."""
    if depth == 0 or len(y) < 2 or np.ptp(y) == 0:
        value = float(y.mean())
        return lambda z: np.full(len(z), value)
    best = (0.0, None, 0.0)
    n, total = len(y), y.sum()
    for f in range(x.shape[1]):
        order = np.argsort(x[:, f], kind="stable")
        v, s = x[order, f], np.cumsum(y[order])[:-1]
        k = np.arange(1, n)
        gain = s**2 / k + (total - s) ** 2 / (n - k) - total**2 / n
        gain[v[1:] == v[:-1]] = -1
        if len(gain) and gain.max() > best[0] + 1e-12:
            at = int(gain.argmax())
            best = (float(gain[at]), f, float((v[at] + v[at + 1]) / 2))
    if best[1] is None:
        value = float(y.mean())
        return lambda z: np.full(len(z), value)
    _, f, cut = best
    left = x[:, f] <= cut
    low, high = _tree(x[left], y[left], depth - 1), _tree(x[~left], y[~left], depth - 1)
    return lambda z: np.where(z[:, f] <= cut, low(z), high(z))


def normal_equations(df: DataFrame, target, features: Sequence) -> tuple[int, np.ndarray, np.ndarray, float, float]:
    """(n, X'X, X'y, sum y, sum y²) with an intercept first, from one aggregate over columns or expressions."""
    terms = [F.lit(1.0), *features]
    k = len(terms)
    sums = [F.sum(terms[i] * terms[j]).alias(f"g{i}_{j}") for i in range(k) for j in range(i, k)]
    sums += [F.sum(terms[i] * target).alias(f"y{i}") for i in range(k)]
    r = df.agg(F.count(F.lit(1)).alias("n"), F.sum(target * target).alias("yy"), *sums).first()
    gram = np.zeros((k, k))
    for i in range(k):
        for j in range(i, k):
            gram[i, j] = gram[j, i] = r[f"g{i}_{j}"] or 0.0
    return r["n"], gram, np.array([r[f"y{i}"] or 0.0 for i in range(k)]), r["y0"] or 0.0, r["yy"] or 0.0


def breusch_pagan(d: DataFrame, column: str, features: Sequence[str]) -> float | None:
    """p-value of the test for heteroscedasticity, over all complete rows ``d``; two aggregates."""
    centre = d.agg(*[F.avg(col(c)).alias(f"m{i}") for i, c in enumerate([column, *features])], *[F.coalesce(F.stddev_pop(col(c)), F.lit(0.0)).alias(f"s{i}") for i, c in enumerate([column, *features])]).first()
    scaled = [(col(c) - F.lit(centre[f"m{i}"])) / F.lit(centre[f"s{i}"] or 1.0) for i, c in enumerate([column, *features])]
    y, xs = scaled[0], scaled[1:]
    n, gram, xy, _, _ = normal_equations(d, y, xs)
    if n <= len(features) + 1:
        return None
    beta = np.linalg.lstsq(gram, xy, rcond=None)[0]
    fitted = F.lit(float(beta[0]))
    for b, x in zip(beta[1:], xs):
        fitted = fitted + F.lit(float(b)) * x
    square = (y - fitted) * (y - fitted)
    n, gram, xy, total, squares = normal_equations(d, square, xs)
    spread = squares - total * total / n
    if spread <= 0:
        return None
    gamma = np.linalg.lstsq(gram, xy, rcond=None)[0]
    explained = float(gamma @ xy) - total * total / n
    return mathx.chi2_sf(n * max(0.0, explained / spread), len(features))


# The whole


class StructuralProfiler:
    """``StructuralProfiler(config).profile(df)``: types, missingness, statistics, targets and associations of a table."""

    def __init__(self, config: PipelineConfig | None = None, now: datetime | None = None) -> None:
        self.config, self.now = config or PipelineConfig(), now
        if self.config.profiling.modality != Modality.Tabular:
            raise NotImplementedError(f"only tabular data can be profiled, not {self.config.profiling.modality}")

    def profile(self, data: DataFrame) -> StructuralProfileResult:
        if not isinstance(data, DataFrame):
            raise TypeError(f"a Spark DataFrame is needed, not {type(data).__name__}")
        config, p = self.config, self.config.profiling
        hard = [c for c in data.columns if c not in config.exclude_columns]
        active = config.resolve_active_columns(PipelinePhase.Profiling, data.columns)
        types = {f.name: f.dataType for f in data.schema.fields}
        data = data.persist()
        try:
            out = StructuralProfileResult(numeric_sentinels=dict(p.numeric_sentinels), string_sentinels=dict(p.string_sentinels))
            out.dataset = self._dataset(data)
            missing, matrix = missingness_profiles(data, active, p)
            out.dataset.missingness_matrix = matrix
            if active:
                r = C.row_distribution(data, active, p.row_drop_threshold, p.numeric_sentinels, p.string_sentinels).first()
                out.dataset.row_distribution = RowMissingnessDistribution(**r.asDict())
            for c, info in detect(data, active, p.type_detection).items():
                out.columns[c] = ColumnProfile(c, info.semantic_type, info.numeric_kind, info.flags, info.original_dtype, info.inferred_dtype, missing[c], c in p.target_columns)
            self._override(out)
            self._statistics(out, data, active)
            for t in p.target_columns:
                if t in data.columns:
                    out.targets[t] = target_profile(data, t, p)
            numeric = [c for c in active if out.columns[c].semantic_type == SemanticType.Numeric]
            features = None
            if p.compute_correlation:
                categorical = [c for c in active if out.columns[c].semantic_type == SemanticType.Categorical]
                profiler = CorrelationProfiler(numeric, categorical, p.correlation)
                features = out.dataset.feature_correlation = profiler.profile_features(data)
                for t in [t for t in p.target_columns if t in data.columns]:
                    out.dataset.target_correlations[t] = profiler.profile_target(data, features, t)
            if p.compute_nonlinearity:
                for c, values in NonlinearityProfiler(numeric, p.nonlinearity).profile(data, features).items():
                    for k, v in values.items():
                        setattr(out.columns[c].stats, k, v)
            for c in hard:
                if c not in out.columns:
                    out.columns[c] = ColumnProfile(c, original_dtype=types[c].simpleString(), inferred_dtype=types[c].simpleString())
            return out
        finally:
            data.unpersist()

    def _dataset(self, data: DataFrame) -> DatasetStats:
        d = C.duplicates(data).first()
        sizes = {r["column"]: r["bytes"] for r in C.memory(data).collect()} if data.columns else {}
        total = sum(sizes.values())
        return DatasetStats(
            row_count=d["rows"], column_count=len(data.columns), memory_bytes=total, memory_breakdown=sizes if total > CHUNKED_BYTES else None,
            duplicate_count=d["duplicate_rows"], duplicate_ratio=d["duplicate_ratio"], overall_sparsity=C.sparsity(data).first()["sparsity"] if data.columns else 0.0,
            was_chunked=total > CHUNKED_BYTES,
        )

    def _override(self, out: StructuralProfileResult) -> None:
        for c, kind in self.config.column_overrides.items():
            if c in out.columns:
                out.columns[c].semantic_type = kind
                out.columns[c].numeric_kind = (out.columns[c].numeric_kind or NumericKind.Continuous) if kind == SemanticType.Numeric else None
                out.columns[c].type_flags.append(TypeFlag.UserOverride)
        for c, kind in self.config.numeric_kind_overrides.items():
            if c in out.columns:
                if out.columns[c].semantic_type != SemanticType.Numeric:
                    raise ValueError(f"{c!r} is not numeric, so it has no numeric kind")
                out.columns[c].numeric_kind = kind
                out.columns[c].type_flags.append(TypeFlag.NumericKindOverride)

    def _statistics(self, out: StructuralProfileResult, data: DataFrame, active: Sequence[str]) -> None:
        p, overrides = self.config.profiling, set(self.config.column_overrides)
        clean = normalize(data, p.numeric_sentinels, p.string_sentinels)
        of = lambda kind: [c for c in active if out.columns[c].semantic_type == kind]
        dated = [c for c in of(SemanticType.Datetime) if not out.columns[c].original_dtype.startswith("interval")]
        found = {
            **numeric_profiles(clean, of(SemanticType.Numeric), p.numeric, overrides),
            **categorical_profiles(clean, of(SemanticType.Categorical), p.categorical),
            **boolean_profiles(clean, of(SemanticType.Boolean), overrides),
            **text_profiles(clean, [c for c in of(SemanticType.Text) if dict(data.dtypes)[c] == "string"]),
            **datetime_profiles(clean, dated, p.datetime_, p.datetime_formats, p.datetime_epoch_units, self.now, overrides),
        }
        for c, s in found.items():
            out.columns[c].stats = s


def flat(profile: StructuralProfileResult, spark) -> DataFrame:
    """The profile as rows (column, metric, value), values as text."""
    rows = []

    def walk(column: str, prefix: str, value) -> None:
        if isinstance(value, dict):
            for k, v in value.items():
                walk(column, f"{prefix}.{k}" if prefix else k, v)
        elif isinstance(value, list):
            rows.append((column, prefix, ", ".join(map(str, value))))
        else:
            rows.append((column, prefix, None if value is None else str(value)))

    for c, p in profile.to_dict()["columns"].items():
        walk(c, "", p)
    return spark.createDataFrame(rows, "column string, metric string, value string")


__all__ = ["CorrelationProfiler", "NonlinearityProfiler", "StructuralProfiler", "per_column"]
