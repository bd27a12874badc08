"""What profiling, splitting and imputation give back, and how it is written."""

from __future__ import annotations

from dataclasses import dataclass, field, fields
from enum import StrEnum
from typing import Any

from pyspark.sql import DataFrame

from .config import ImputationStrategy, Modality, NumericKind, SemanticType
from .plans.serial import Serial, plain


class TypeFlag(StrEnum):
    NumericCoerced = "numeric_coerced"
    DatetimeCoerced = "datetime_coerced"
    BooleanCandidate = "boolean_candidate"
    EncodedCategory = "encoded_category"
    IdentifierColumn = "identifier_column"
    SequentialIndex = "sequential_index"
    FloatSequentialIndex = "float_sequential_index"
    FreeTextCandidate = "free_text_candidate"
    UserOverride = "user_override"
    NumericKindOverride = "numeric_kind_override"


class MissingSeverity(StrEnum):
    Minor = "minor"
    Moderate = "moderate"
    High = "high"
    Severe = "severe"


class MissingnessFlag(StrEnum):
    FullyNull = "fully_null"
    MARSuspect = "mar_suspect"
    DropCandidate = "drop_candidate"


class NumericFlag(StrEnum):
    NearConstant = "near_constant"
    ScaleAnomaly = "scale_anomaly"
    Bimodal = "bimodal"
    HighOutlierDensity = "high_outlier_density"
    FormatMismatch = "format_mismatch"


class SkewSeverity(StrEnum):
    Normal = "normal"
    Moderate = "moderate"
    High = "high"
    Severe = "severe"


class KurtosisTag(StrEnum):
    Platykurtic = "platykurtic"
    Mesokurtic = "mesokurtic"
    Leptokurtic = "leptokurtic"


class TailAsymmetryTag(StrEnum):
    Symmetric = "symmetric"
    RightHeavy = "right_heavy"
    LeftHeavy = "left_heavy"


class NonlinearityTag(StrEnum):
    Linear = "linear"
    MonotonicNonlinear = "monotonic_nonlinear"
    ComplexNonlinear = "complex_nonlinear"
    Unpredictable = "unpredictable"


class CategoricalFlag(StrEnum):
    MixedType = "mixed_type"
    NearConstant = "near_constant"


class BooleanFlag(StrEnum):
    FormatMismatch = "format_mismatch"


class InferredGranularity(StrEnum):
    Yearly = "yearly"
    Monthly = "monthly"
    Weekly = "weekly"
    Daily = "daily"
    Hourly = "hourly"
    Minutely = "minutely"
    Secondly = "secondly"
    Irregular = "irregular"


class DatetimeFlag(StrEnum):
    FutureDates = "future_dates"
    HighGapVariance = "high_gap_variance"
    MnarSuspected = "mnar_suspected"
    RecentDateMissing = "recent_date_missing"
    FormatMismatch = "format_mismatch"


class TargetProblemType(StrEnum):
    Regression = "regression"
    BinaryClassification = "binary_classification"
    MulticlassClassification = "multiclass_classification"
    Unknown = "unknown"


class TargetFlag(StrEnum):
    ContainsMissing = "contains_missing"
    HighImbalance = "high_imbalance"
    SevereImbalance = "severe_imbalance"
    HighlySkewed = "highly_skewed"
    IsIdentifier = "is_identifier"


class OverrideCoercionError(ValueError):
    """A column that the user gave a type cannot be read as that type at all."""


class Flagged(Serial):
    def has_flag(self, flag: StrEnum) -> bool:
        return flag in self.flags


@dataclass
class ColumnTypeInfo(Flagged):
    column: str
    original_dtype: str
    inferred_dtype: str
    numeric_kind: NumericKind | None = None
    flags: list[TypeFlag] = field(default_factory=list)
    semantic_type: SemanticType | None = None


@dataclass
class ColumnMissingnessProfile(Flagged):
    column: str
    total_rows: int
    standard_null_count: int = 0
    effective_null_count: int = 0
    standard_null_ratio: float = 0.0
    effective_null_ratio: float = 0.0
    severity: MissingSeverity | None = None
    flags: list[MissingnessFlag] = field(default_factory=list)
    correlated_with: list[str] = field(default_factory=list)


@dataclass
class RowMissingnessDistribution(Serial):
    row_missing_p90: int = 0
    pct_zero_missing: float = 0.0
    pct_one_to_two: float = 0.0
    pct_three_to_five: float = 0.0
    pct_over_five: float = 0.0
    pct_over_half_missing: float = 0.0
    drop_candidate_row_count: int = 0


@dataclass
class TopValueEntry(Serial):
    value: Any
    count: int
    percentage: float


@dataclass
class HistogramBin(Serial):
    low: float
    high: float
    count: int
    percentage: float


@dataclass
class PercentileSnapshot(Serial):
    p1: float
    p5: float
    p25: float
    p50: float
    p75: float
    p95: float
    p99: float

    @property
    def iqr(self) -> float:
        return self.p75 - self.p25


@dataclass
class BimodalStats(Serial):
    dip_statistic: float
    dip_p_value: float
    center1: float | None = None
    center2: float | None = None
    cluster_separation: float | None = None
    minority_weight: float | None = None


@dataclass
class NumericStats(Flagged):
    mean: float | None = None
    median: float | None = None
    mean_median_ratio: float | None = None
    mode: float | None = None
    mode_frequency: float = 0.0
    top_values: list[TopValueEntry] = field(default_factory=list)
    histogram: list[HistogramBin] = field(default_factory=list)
    std: float | None = None
    variance: float | None = None
    min: float | None = None
    max: float | None = None
    percentiles: PercentileSnapshot | None = None
    skewness: float | None = None
    kurtosis: float | None = None
    skewness_severity: SkewSeverity | None = None
    kurtosis_tag: KurtosisTag | None = None
    flags: list[NumericFlag] = field(default_factory=list)
    nonlinearity_tag: NonlinearityTag | None = None
    spearman_pearson_discrepancy: float | None = None
    mean_mutual_information: float | None = None
    excess_mutual_information: float | None = None
    r2_gap: float | None = None
    r2_linear: float | None = None
    r2_forest: float | None = None
    heteroscedasticity_p_value: float | None = None
    bimodal_stats: BimodalStats | None = None
    tail_asymmetry_tag: TailAsymmetryTag | None = None
    tail_asymmetry_share: float | None = None
    outlier_density: float | None = None

    @property
    def iqr(self) -> float | None:
        return self.percentiles.iqr if self.percentiles else None


@dataclass
class RareCategoryStats(Serial):
    threshold_pct: float = 0.01
    rare_category_count: int = 0
    total_rare_rows: int = 0
    rare_row_percentage: float = 0.0
    rare_label_values: list[str] = field(default_factory=list)
    rare_label_threshold_pct: float = 0.05


@dataclass
class ImbalanceMetrics(Serial):
    dominant_class_ratio: float | None = None
    normalized_shannon_entropy: float | None = None
    normalized_gini: float | None = None


@dataclass
class CategoricalStats(Flagged):
    cardinality: int = 0
    unique_ratio: float = 0.0
    mode_frequency: float = 0.0
    top_values: list[TopValueEntry] = field(default_factory=list)
    rare_categories: RareCategoryStats = field(default_factory=RareCategoryStats)
    imbalance: ImbalanceMetrics = field(default_factory=ImbalanceMetrics)
    flags: list[CategoricalFlag] = field(default_factory=list)


@dataclass
class BooleanStats(Flagged):
    true_count: int = 0
    false_count: int = 0
    true_ratio: float = 0.0
    false_ratio: float = 0.0
    mode: bool | None = None
    flags: list[BooleanFlag] = field(default_factory=list)


@dataclass
class TextStats(Serial):
    avg_token_count: float = 0.0
    median_token_count: float = 0.0
    vocabulary_size: int = 0
    char_length_min: int = 0
    char_length_max: int = 0
    char_length_mean: float = 0.0
    char_length_median: float = 0.0
    empty_ratio: float = 0.0
    whitespace_ratio: float = 0.0


@dataclass
class TemporalSignals(Serial):
    has_year: bool = False
    has_month: bool = False
    has_day: bool = False
    has_day_of_week: bool = False
    has_hour: bool = False
    has_is_weekend: bool = False
    has_is_month_end: bool = False

    def extractable_features(self) -> list[str]:
        return [f.name.removeprefix("has_") for f in fields(self) if getattr(self, f.name)]


@dataclass
class DatetimeStats(Flagged):
    min_date: str | None = None
    max_date: str | None = None
    date_range_days: float | None = None
    future_date_count: int = 0
    inferred_granularity: InferredGranularity | None = None
    median_gap_seconds: float | None = None
    gap_cv: float | None = None
    signals: TemporalSignals = field(default_factory=TemporalSignals)
    flags: list[DatetimeFlag] = field(default_factory=list)


@dataclass
class TargetProfileResult(Flagged):
    column: str
    problem_type: TargetProblemType
    missing_count: int = 0
    missing_ratio: float = 0.0
    numeric_profile: NumericStats | None = None
    categorical_profile: CategoricalStats | None = None
    flags: list[TargetFlag] = field(default_factory=list)


@dataclass
class CorrelationPair(Serial):
    col_a: str
    col_b: str
    pearson_r: float | None = None
    spearman_r: float | None = None
    near_redundant: bool = False


@dataclass
class NearRedundancyGroup(Serial):
    columns: list[str] = field(default_factory=list)
    suggested_drop: list[str] = field(default_factory=list)


@dataclass
class CramerVPair(Serial):
    col_a: str = ""
    col_b: str = ""
    cramer_v: float | None = None
    near_redundant: bool = False


@dataclass
class EtaSquaredPair(Serial):
    numeric_col: str = ""
    categorical_col: str = ""
    eta_squared: float | None = None
    near_redundant: bool = False


@dataclass
class NumericTargetCorrelation(Serial):
    feature: str
    pearson_r: float | None = None


@dataclass
class CategoricalTargetCorrelation(Serial):
    feature: str
    f_statistic: float | None = None
    p_value: float | None = None
    eta_squared: float | None = None


@dataclass
class MutualInformationEntry(Serial):
    feature: str
    mi_score: float = 0.0
    rank: int = 0


class TargetType(StrEnum):
    Numeric = "numeric"
    Categorical = "categorical"


@dataclass
class CorrelationProfileResult(Serial):
    analysed_numeric_columns: list[str] = field(default_factory=list)
    analysed_categorical_columns: list[str] = field(default_factory=list)
    pearson_matrix: dict[str, dict[str, float]] = field(default_factory=dict)
    spearman_matrix: dict[str, dict[str, float]] = field(default_factory=dict)
    pairwise: list[CorrelationPair] = field(default_factory=list)
    near_redundant_pairs: list[CorrelationPair] = field(default_factory=list)
    near_redundancy_groups: list[NearRedundancyGroup] = field(default_factory=list)
    cramer_v_pairs: list[CramerVPair] = field(default_factory=list)
    near_redundant_cramer_v_pairs: list[CramerVPair] = field(default_factory=list)
    eta_squared_pairs: list[EtaSquaredPair] = field(default_factory=list)
    near_redundant_eta_squared_pairs: list[EtaSquaredPair] = field(default_factory=list)
    target_column: str | None = None
    target_type: TargetType | None = None
    feature_target_numeric: list[NumericTargetCorrelation] = field(default_factory=list)
    feature_target_categorical: list[CategoricalTargetCorrelation] = field(default_factory=list)
    mutual_information: list[MutualInformationEntry] = field(default_factory=list)

    def get_pearson(self, a: str, b: str) -> float | None:
        return self.pearson_matrix.get(a, {}).get(b)

    def get_spearman(self, a: str, b: str) -> float | None:
        return self.spearman_matrix.get(a, {}).get(b)

    def top_mi(self, n: int = 10) -> list[MutualInformationEntry]:
        return self.mutual_information[:n]


Stats = NumericStats | CategoricalStats | BooleanStats | TextStats | DatetimeStats


@dataclass
class ColumnProfile(Serial):
    name: str = ""
    semantic_type: SemanticType | None = None
    numeric_kind: NumericKind | None = None
    type_flags: list[TypeFlag] = field(default_factory=list)
    original_dtype: str = ""
    inferred_dtype: str = ""
    missingness: ColumnMissingnessProfile | None = None
    is_target: bool = False
    stats: Any = None


@dataclass
class DatasetStats(Serial):
    modality: Modality = Modality.Tabular
    row_count: int = 0
    column_count: int = 0
    memory_bytes: int = 0
    memory_breakdown: dict[str, int] | None = None
    duplicate_count: int = 0
    duplicate_ratio: float = 0.0
    overall_sparsity: float = 0.0
    was_chunked: bool = False
    missingness_matrix: dict[str, dict[str, float]] | None = None
    row_distribution: RowMissingnessDistribution = field(default_factory=RowMissingnessDistribution)
    feature_correlation: CorrelationProfileResult | None = None
    target_correlations: dict[str, CorrelationProfileResult] = field(default_factory=dict)


def _lines(value: Any, indent: int = 0) -> list[str]:
    """Nested Markdown bullets of plain data."""
    pad = "  " * indent
    if isinstance(value, dict):
        out = []
        for k, v in value.items():
            deep = isinstance(v, (dict, list)) and bool(v)
            out += [f"{pad}- **{k}**:", *_lines(v, indent + 1)] if deep else [f"{pad}- **{k}**: {'none' if v in (None, [], {}) else v}"]
        return out
    if isinstance(value, list):
        return [line for v in value for line in (_lines(v, indent) if isinstance(v, dict) else [f"{pad}- {v}"])]
    return [f"{pad}- {value}"]


def _tier(c: ColumnProfile) -> int:
    """Flagged columns in order: what must be dropped, what is missing, what has other flags."""
    m = c.missingness
    if m and (m.has_flag(MissingnessFlag.FullyNull) or m.has_flag(MissingnessFlag.DropCandidate)):
        return 0
    if m and m.severity in (MissingSeverity.High, MissingSeverity.Severe):
        return 1
    return 2


def _flags(c: ColumnProfile) -> list[str]:
    own = [*(c.missingness.flags if c.missingness else []), *getattr(c.stats, "flags", [])]
    return [f.value for f in own]


@dataclass
class StructuralProfileResult(Serial):
    columns: dict[str, ColumnProfile] = field(default_factory=dict)
    dataset: DatasetStats = field(default_factory=DatasetStats)
    targets: dict[str, TargetProfileResult] = field(default_factory=dict)
    numeric_sentinels: dict[str, list[float]] = field(default_factory=dict)
    string_sentinels: dict[str, list[str]] = field(default_factory=dict)

    def to_markdown(self) -> str:
        """A compact report."""
        d = self.dataset
        out = ["# Structural profile", "", "## Dataset overview", ""]
        out += [f"- Rows: {d.row_count}", f"- Columns: {d.column_count}", f"- Duplicate rows: {d.duplicate_count} ({d.duplicate_ratio:.2%})", f"- Sparsity: {d.overall_sparsity:.2%}", f"- Memory (estimate): {d.memory_bytes} bytes"]
        out += ["", "## Column summary", "", "| Column | Type | Dtype | Missing | Severity | Flags |", "|---|---|---|---|---|---|"]
        for c in self.columns.values():
            m = c.missingness
            out.append(f"| {c.name} | {c.semantic_type or '-'} | {c.original_dtype} | {m.effective_null_ratio if m else 0:.2%} | {m.severity if m and m.severity else '-'} | {', '.join(_flags(c)) or '-'} |")
        flagged = sorted((c for c in self.columns.values() if _flags(c) or (c.missingness and c.missingness.severity)), key=lambda c: (_tier(c), c.name))
        out += ["", "## Flagged columns", ""]
        for c in flagged:
            out += [f"### {c.name}", ""]
            if c.missingness and c.missingness.effective_null_count:
                out.append(f"- Missing: {c.missingness.effective_null_count} of {c.missingness.total_rows}")
                if c.missingness.correlated_with:
                    out.append(f"- Missing together with: {', '.join(c.missingness.correlated_with)}")
            if _flags(c):
                out.append(f"- Flags: {', '.join(_flags(c))}")
            if d.feature_correlation and c.name in d.feature_correlation.pearson_matrix:
                row = {k: v for k, v in d.feature_correlation.pearson_matrix[c.name].items() if k != c.name}
                best = sorted(row.items(), key=lambda x: (-abs(x[1]), x[0]))[:5]
                out.append("- Strongest correlations: " + ", ".join(f"{k} ({v:.3f})" for k, v in best))
            out.append("")
        if not flagged:
            out += ["No flagged columns.", ""]
        if self.targets:
            out += ["## Target analysis", ""]
            for t in self.targets.values():
                out += [f"### {t.column}", "", f"- Problem type: {t.problem_type}", f"- Missing: {t.missing_count} ({t.missing_ratio:.2%})", f"- Flags: {', '.join(t.flags) or '-'}"]
                if (k := d.target_correlations.get(t.column)) and k.feature_target_numeric:
                    out.append("- Top features: " + ", ".join(f"{x.feature} ({x.pearson_r:.3f})" for x in k.feature_target_numeric[:5]))
                out.append("")
        if self.numeric_sentinels or self.string_sentinels:
            out += ["## Sentinels", "", *[f"- {c}: {', '.join(map(str, v))}" for c, v in [*self.numeric_sentinels.items(), *self.string_sentinels.items()]], ""]
        return "\n".join(out)

    def to_full_markdown(self) -> str:
        """Everything that ``to_dict`` holds, as nested bullets."""
        data = plain(self)
        out = ["# Structural profile (full)", "", "## Dataset", "", *_lines(data["dataset"]), "", "## Columns", ""]
        for name, c in data["columns"].items():
            out += [f"### {name}", "", *_lines(c), ""]
        if data["targets"]:
            out += ["## Targets", ""]
            for name, t in data["targets"].items():
                out += [f"### {name}", "", *_lines(t), ""]
        out += ["## Sentinels", "", *_lines({"numeric": data["numeric_sentinels"], "string": data["string_sentinels"]})]
        return "\n".join(out)


@dataclass
class SplitResult:
    train: DataFrame
    test: DataFrame
    train_size: int
    test_size: int
    train_ratio: float
    test_ratio: float


@dataclass
class FoldResult:
    train: DataFrame
    val: DataFrame
    fold_index: int
    train_size: int
    val_size: int


@dataclass
class ImputationFitDiagnostic(Serial):
    r2_train: float | None = None
    rmse: float | None = None
    mae: float | None = None
    converged: bool | None = None
    n_iter: int | None = None
    imputed_mean: float | None = None
    imputed_std: float | None = None
    observed_mean: float | None = None
    observed_std: float | None = None
    variance_ratio: float | None = None
    n_neighbors_used: int | None = None
    k_capped: bool | None = None


@dataclass
class ColumnImputationRecord(Serial):
    column: str
    semantic_type: SemanticType | None
    strategy: ImputationStrategy
    fill_value: float | None = None
    indicator_added: bool = False
    signals: list[str] = field(default_factory=list)
    domain_snap_bounds: tuple[float, ...] | None = None
    diagnostic: ImputationFitDiagnostic | None = None


@dataclass
class ImputationResult:
    dataframe: DataFrame
    records: dict[str, ColumnImputationRecord] = field(default_factory=dict)
    dropped_columns: list[str] = field(default_factory=list)
    exclusions_applied: bool = False
