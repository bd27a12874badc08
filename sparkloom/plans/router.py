"""Which strategy fills a numeric column, from its profile alone.

Rules are tried in order; a rule gives a strategy with the reason, or None.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from ..config import ImputationStrategy as S
from ..config import NumericImputationConfig, NumericKind
from ..results import ColumnProfile, CorrelationProfileResult, KurtosisTag, MissingnessFlag, MissingSeverity, NonlinearityTag, NumericFlag, NumericStats, SkewSeverity

Choice = tuple[S, str] | None


@dataclass(frozen=True)
class Case:
    """What is known of a column and its table."""

    column: str
    profile: ColumnProfile
    config: NumericImputationConfig
    rows: int
    features: int
    several_mar: bool = False
    mnar: frozenset[str] = frozenset()
    correlation: CorrelationProfileResult | None = None

    @property
    def stats(self) -> NumericStats | None:
        return self.profile.stats if isinstance(self.profile.stats, NumericStats) else None

    @property
    def missing(self):
        return self.profile.missingness

    @property
    def severity(self) -> MissingSeverity | None:
        return self.missing.severity if self.missing else None

    @property
    def bounded(self) -> bool:
        return self.profile.numeric_kind == NumericKind.BoundedDiscrete

    def has(self, flag: NumericFlag) -> bool:
        return bool(self.stats and self.stats.has_flag(flag))

    @property
    def heavy_shape(self) -> list[str]:
        """Reasons of shape to use a model for few missing cells."""
        s = self.stats
        out = ["leptokurtic"] if s and s.kurtosis_tag == KurtosisTag.Leptokurtic else []
        return out + (["severely skewed"] if s and s.skewness_severity == SkewSeverity.Severe else [])

    @property
    def neighbours_fit(self) -> bool:
        return self.rows <= self.config.knn_max_rows and self.features <= self.config.knn_max_features

    def correlated(self, least: float) -> list[str]:
        row = self.correlation.pearson_matrix.get(self.column, {}) if self.correlation else {}
        return [c for c, r in row.items() if c != self.column and abs(r) > least]


def _by_size(case: Case, first: S) -> tuple[S, str]:
    """``first`` and then the other of regression and neighbours, as far as the table's size allows."""
    allowed = {S.Regression: case.rows >= case.config.regression_min_rows, S.KNN: case.neighbours_fit}
    for s in (first, S.KNN if first == S.Regression else S.Regression):
        if allowed[s]:
            return s, f"{s.value}: {case.rows} rows and {case.features} features allow it"
    return S.Median, f"median: no model fits {case.rows} rows and {case.features} features"


def model_at_random(case: Case, severity: MissingSeverity | None, look: bool = True) -> tuple[S, str]:
    """A model for values missing completely at random: chained equations if severe, else neighbours, then regression."""
    if severity == MissingSeverity.Severe:
        return S.MICE, "mice: severely missing"
    if look and case.correlation:
        row = case.correlation.pearson_matrix.get(case.column, {})
        others = [abs(r) for c, r in row.items() if c != case.column]
        if others and max(others) < case.config.mcar_feature_predictability_threshold:
            return S.Median, f"median: no feature correlates above {max(others):.2f}"
    return _by_size(case, S.KNN)


def missing_together(case: Case, severity: MissingSeverity | None, partners: list[str], several: bool, shape: list[str]) -> tuple[S, str]:
    """For values whose absence goes with that of other columns."""
    if several:
        return S.MICE, "mice: several columns are suspected to be missing at random"
    if severity == MissingSeverity.Severe:
        return S.MICE, "mice: suspected missing at random and severely missing"
    if severity == MissingSeverity.High:
        return _by_size(case, S.Regression) if partners else model_at_random(case, severity, look=False)
    if severity in (MissingSeverity.Minor, MissingSeverity.Moderate) and shape:
        s, why = model_at_random(case, severity, look=False)
        return s, f"{' and '.join(shape)}, so a model: {why}"
    return S.Median, "median: suspected missing at random, few cells"


def _two_modes(case: Case) -> tuple[S, str]:
    if case.column in case.config.bimodal_grouping_variables:
        return S.ClusterConditional, "bimodal with a declared grouping column"
    partners = case.correlated(case.config.bimodal_correlation_threshold)
    if len(partners) >= case.config.bimodal_min_correlated_features:
        s, why = missing_together(case, MissingSeverity.High, partners, False, [])
        return s, f"bimodal with {len(partners)} correlated features: {why}"
    if partners:
        return S.ClusterConditional, f"bimodal with {len(partners)} correlated features"
    return (S.Mode, "mode: bimodal on few whole numbers") if case.bounded else (S.GMMSampling, "bimodal without correlated features")


def _dropped(case: Case) -> Choice:
    if case.missing and case.missing.has_flag(MissingnessFlag.DropCandidate):
        return S.Dropped, f"dropped: {case.missing.effective_null_ratio:.1%} missing"
    return None


def _declared(case: Case) -> Choice:
    if case.column in case.config.per_column_constant_fill:
        return S.Constant, "constant declared by the user"
    if case.column in case.config.per_column_strategy:
        s = case.config.per_column_strategy[case.column]
        return s, f"{s.value} declared by the user"
    return None


def _mnar(case: Case) -> Choice:
    return (S.MNAR, f"missing not at random by declaration, filled with the {mnar_fill(case)}") if case.column in case.mnar else None


def mnar_fill(case: Case) -> str:
    if case.bounded:
        return "mode"
    return "mean" if case.stats and case.stats.skewness_severity == SkewSeverity.Normal else "median"


def _complete(case: Case) -> Choice:
    return (S.Passthrough, "nothing missing in the profile") if not case.missing or not case.missing.effective_null_count else None


def _unpredictable(case: Case) -> Choice:
    return (S.Median, "median: no feature predicts it") if case.stats and case.stats.nonlinearity_tag == NonlinearityTag.Unpredictable else None


def _near_constant(case: Case) -> Choice:
    return (S.Median, "median: nearly constant") if case.has(NumericFlag.NearConstant) else None


def _bimodal(case: Case) -> Choice:
    return _two_modes(case) if case.has(NumericFlag.Bimodal) else None


def _suspected(case: Case) -> Choice:
    if not case.missing.has_flag(MissingnessFlag.MARSuspect):
        return None
    shape = [] if case.bounded else case.heavy_shape
    return missing_together(case, case.severity, case.missing.correlated_with, case.several_mar, shape)


def _at_random(case: Case) -> Choice:
    severity, s = case.severity, case.stats
    if severity in (MissingSeverity.High, MissingSeverity.Severe):
        return model_at_random(case, severity)
    if case.bounded:
        return S.Median, "median: few cells missing"
    if severity == MissingSeverity.Minor and "leptokurtic" in case.heavy_shape:
        return model_at_random(case, severity)
    if severity == MissingSeverity.Minor and (s is None or s.skewness_severity in (None, SkewSeverity.Normal)):
        return S.Mean, "mean: few cells missing, not skewed"
    if severity == MissingSeverity.Moderate and case.heavy_shape:
        return model_at_random(case, severity)
    return S.Median, "median: few cells missing"


FIRST: list[Callable[[Case], Choice]] = [_dropped, _declared, _mnar, _complete]
BOUNDED = [_unpredictable, _near_constant, _bimodal, _suspected, _at_random]
OTHER = [_bimodal, _unpredictable, _suspected, _near_constant, _at_random]
MODELS = (S.KNN, S.Regression, S.MICE)


def route(case: Case) -> tuple[S, list[str]]:
    """The strategy and the reasons.  Bounded discrete columns take the mode where others take the median."""
    for rule in FIRST:
        if choice := rule(case):
            return choice[0], [choice[1]]
    for rule in BOUNDED if case.bounded else OTHER:
        if choice := rule(case):
            s, reasons = choice[0], [choice[1]]
            if case.bounded and s == S.Median:
                s, reasons = S.Mode, [*reasons, "mode: the median need not be one of the values"]
            elif case.bounded and s in MODELS and case.stats:
                reasons.append(f"snapped to whole numbers in {case.stats.min}..{case.stats.max}")
            return s, reasons
    raise AssertionError("the last rule always chooses")
