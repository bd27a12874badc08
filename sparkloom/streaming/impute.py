"""Fitted imputers and missing-cell counts on Structured Streaming tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.nulls import missing_exprs
from ..operators.base import col
from ..plans.imputer import FittedImputer


def impute_stream(stream: DataFrame, fitted: FittedImputer) -> DataFrame:
    """The filled stream: the plan of a fitted imputer is projections, narrow passes and joins with fixed tables."""
    return fitted.plan(stream)[0]


def missing_counts(stream: DataFrame, time: str, columns: Sequence[str], window: str = "5 minutes", late: str = "10 minutes", numeric: Mapping | None = None, strings: Mapping | None = None) -> DataFrame:
    """Rows and effective nulls of each column in windows of ``time``; data later than ``late`` is left out."""
    gone = missing_exprs(stream, columns, numeric, strings)
    counts = [F.count_if(gone[c]).alias(f"{c}_missing") for c in columns]
    windowed = stream.withWatermark(time, late).groupBy(F.window(col(time), window)).agg(F.count(F.lit(1)).alias("rows"), *counts)
    return windowed.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "rows", *[f"{c}_missing" for c in columns])
