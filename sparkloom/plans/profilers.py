"""Profilers of one kind of column each, for use without a whole profile."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from datetime import datetime
from typing import Any

from pyspark.sql import DataFrame

from ..config import CategoricalProfileConfig, DatetimeProfileConfig, EpochUnit, MissingnessProfileConfig, NumericProfileConfig, ProfileConfig, TypeDetectionConfig
from ..functions.nulls import normalize
from ..operators import columns as C
from ..operators.types import detect
from ..results import ColumnTypeInfo, DatasetStats, RowMissingnessDistribution, TargetProfileResult
from ..plans.serial import Serial
from . import profiler as P


@dataclass
class ProfileResult(Serial):
    """Statistics by column."""

    columns: dict[str, Any] = field(default_factory=dict)
    analysed_columns: list[str] = field(default_factory=list)


@dataclass
class MissingnessProfileResult(ProfileResult):
    fully_null_columns: list[str] = field(default_factory=list)
    correlation_matrix: dict[str, dict[str, float]] = field(default_factory=dict)
    row_distribution: RowMissingnessDistribution = field(default_factory=RowMissingnessDistribution)


class TypeDetector:
    def __init__(self, columns: Sequence[str], config: TypeDetectionConfig | None = None) -> None:
        self.columns, self.config = list(columns), config

    def detect(self, df: DataFrame) -> dict[str, ColumnTypeInfo]:
        return detect(df, self.columns, self.config)


class TabularProfiler:
    def profile(self, data: DataFrame) -> DatasetStats:
        return P.StructuralProfiler()._dataset(data)


class MissingnessProfiler:
    """Without columns the result is empty."""

    def __init__(self, config: MissingnessProfileConfig | None = None, numeric_sentinels: Mapping | None = None, string_sentinels: Mapping | None = None) -> None:
        self.config = ProfileConfig(missingness=config or MissingnessProfileConfig())
        for c, v in (numeric_sentinels or {}).items():
            self.config.set_numeric_sentinel(c, v)
        for c, v in (string_sentinels or {}).items():
            self.config.set_string_sentinel(c, v)

    def profile(self, data: DataFrame, columns: Sequence[str] | None = None) -> MissingnessProfileResult:
        if not columns:
            return MissingnessProfileResult()
        found, matrix = P.missingness_profiles(data, columns, self.config)
        rows = C.row_distribution(data, columns, 0.5, self.config.numeric_sentinels, self.config.string_sentinels).first()
        full = [c for c, p in found.items() if p.has_flag("fully_null")]
        return MissingnessProfileResult(found, list(columns), full, matrix, RowMissingnessDistribution(**rows.asDict()))


class NumericProfiler:
    def __init__(self, config: NumericProfileConfig | None = None) -> None:
        self.config = config or NumericProfileConfig()

    def profile(self, data: DataFrame, columns: Sequence[str], user_overrides: set[str] | None = None) -> ProfileResult:
        return ProfileResult(P.numeric_profiles(normalize(data), columns, self.config, user_overrides or set()), list(columns))


class CategoricalProfiler:
    def __init__(self, config: CategoricalProfileConfig | None = None) -> None:
        self.config = config or CategoricalProfileConfig()

    def profile(self, data: DataFrame, columns: Sequence[str], user_overrides: set[str] | None = None) -> ProfileResult:
        return ProfileResult(P.categorical_profiles(data, columns, self.config), list(columns))


class BooleanProfiler:
    def profile(self, data: DataFrame, columns: Sequence[str], user_overrides: set[str] | None = None) -> ProfileResult:
        return ProfileResult(P.boolean_profiles(data, columns, user_overrides or set()), list(columns))


class TextProfiler:
    def profile(self, data: DataFrame, columns: Sequence[str], user_overrides: set[str] | None = None) -> ProfileResult:
        return ProfileResult(P.text_profiles(data, columns), list(columns))


class DatetimeProfiler:
    def __init__(self, config: DatetimeProfileConfig | None = None, epoch_units: Mapping[str, EpochUnit] | None = None, formats: Mapping[str, str] | None = None, now: datetime | None = None) -> None:
        self.config, self.units, self.formats, self.now = config or DatetimeProfileConfig(), epoch_units, formats, now

    def profile(self, data: DataFrame, columns: Sequence[str], user_overrides: set[str] | None = None) -> ProfileResult:
        return ProfileResult(P.datetime_profiles(data, columns, self.config, self.formats, self.units, self.now, user_overrides or set()), list(columns))


class TargetProfiler:
    def __init__(self, target_column: str, config: ProfileConfig | None = None) -> None:
        self.target, self.config = target_column, config or ProfileConfig()

    def profile(self, data: DataFrame) -> TargetProfileResult:
        return P.target_profile(data, self.target, self.config)
