"""Semantic types of columns: aggregates in Spark, decisions on one small row a column."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import NumericKind, SemanticType, TypeDetectionConfig
from ..functions.casts import to_double, to_timestamp
from ..functions.nulls import FLOATS, INTEGERS
from ..results import ColumnTypeInfo, TypeFlag
from .base import col, distinct_counts, per_column, value_counts
from .columns import kinds

#: Words of a string column that may be a boolean.
BOOLEAN_WORDS = ("true", "false", "yes", "no", "t", "f", "0", "1")
#: Below this many values, a run without holes is a category.
TIGHT_RUN = 50


def evidence(df: DataFrame, columns: Sequence[str], formats: Mapping[str, str] | None = None) -> DataFrame:
    """One row a column: counts, ranges, parse successes and text shape, null where they do not apply.

    Texts are parsed once for each distinct value, from the value counts that the number of distinct values takes anyway.
    """
    types = kinds(df)
    nothing = lambda kind: F.lit(None).cast(kind)
    words = [c for c in columns if isinstance(types[c], T.StringType)]
    others = [c for c in columns if c not in words]
    parts = []
    if others:

        def make(c: str) -> dict[str, Column]:
            number = to_double(col(c), types[c])
            finite = F.when(~F.isnan(number), number)
            return {
                "rows": F.count(F.lit(1)), "n": F.count(col(c)), "numeric_n": F.count(number), "datetime_n": nothing("long"), "low": F.min(finite), "high": F.max(finite),
                "fractions": F.count_if(finite != F.floor(finite)), "not_boolean": nothing("long"), "median_chars": nothing("double"), "median_gaps": nothing("double"), "p90_chars": nothing("double"),
            }

        wanted = [c for c in others if not isinstance(types[c], (T.BinaryType, T.ArrayType, T.MapType, T.StructType))]
        d = per_column(df, others, make)
        unique = distinct_counts(df, wanted) if wanted else df.sparkSession.createDataFrame([], "column string, distinct long")
        d = d.join(F.broadcast(unique.select(F.col("column").alias("u_column"), F.col("distinct").alias("unique"))), F.col("column") == F.col("u_column"), "left").drop("u_column")
        parts.append(d.withColumn("levels", F.when(F.col("column").isin([c for c in others if isinstance(types[c], (*INTEGERS, *FLOATS))]), F.col("unique"))))
    if words:
        counts = value_counts(df, words)
        v, n = F.col("value"), F.col("n")
        number = to_double(v, T.StringType())
        stamp = to_timestamp(v, T.StringType())
        for c, fmt in (formats or {}).items():
            stamp = F.when(F.col("column") == c, to_timestamp(v, T.StringType(), fmt)).otherwise(stamp)
        counts = counts.select("column", n, v, number.alias("number"), stamp.isNotNull().alias("dated"), F.char_length(v).alias("length"), F.regexp_count(v, F.lit(r"\s+")).alias("gaps"))
        finite = F.when(~F.isnan("number"), F.col("number"))
        total = lambda keep: F.coalesce(F.sum(F.when(keep, n)), F.lit(0).cast("long"))
        d = counts.groupBy("column").agg(
            F.sum("n").alias("n"), total(F.col("number").isNotNull()).alias("numeric_n"), total(F.col("dated")).alias("datetime_n"), F.min(finite).alias("low"), F.max(finite).alias("high"),
            total(finite != F.floor(finite)).alias("fractions"), total(~F.lower("value").isin(list(BOOLEAN_WORDS))).alias("not_boolean"),
            F.percentile("length", 0.5, n).alias("median_chars"), F.percentile("gaps", 0.5, n).alias("median_gaps"), F.percentile("length", 0.9, n).alias("p90_chars"),
            F.count(F.lit(1)).alias("unique"), F.count_distinct("number").alias("levels"),
        )
        rows = per_column(df, words, lambda c: {"rows": F.count(F.lit(1))})
        none = ["n", "numeric_n", "datetime_n", "fractions", "not_boolean"]
        d = rows.join(d, ["column"], "left").fillna(0, none)
        parts.append(d)
    d = reduce(lambda a, b: a.unionByName(b), parts)
    return d.withColumn("unique", F.coalesce("unique", F.lit(0))).withColumn("levels", F.coalesce("levels", F.lit(0)))


def _encoded(e: Mapping, n: int, levels: int, config: TypeDetectionConfig) -> bool:
    """Few whole numbers among many values, or a short run of them without holes."""
    if n == 0 or levels == 0:
        return False
    tight = e["high"] - e["low"] + 1 == levels
    few = levels < (TIGHT_RUN if tight else config.encoded_category_max_unique)
    return few and (tight or levels / n < config.encoded_category_max_ratio)


def _kind(e: Mapping, levels: int) -> NumericKind:
    """Bounded discrete: a short run of whole numbers without holes that starts at 0 or 1."""
    if levels == 0 or e["fractions"] or round(e["high"] - e["low"]) + 1 != levels:
        return NumericKind.Continuous
    many = e["rows"] > 0 and levels / e["rows"] >= 0.05 and levels > 10
    fits = e["high"] - e["low"] <= 20 and not many and e["low"] in (0.0, 1.0)
    return NumericKind.BoundedDiscrete if fits else NumericKind.Continuous


def _free_text(e: Mapping, unique_ratio: float, config: TypeDetectionConfig) -> bool:
    if not e["n"]:
        return False
    chars, gaps, p90 = e["median_chars"] or 0, e["median_gaps"] or 0, e["p90_chars"] or 0
    return (
        (chars > config.free_text_median_chars and gaps >= 1)
        or gaps + 1 > config.free_text_avg_words
        or (p90 > config.free_text_p90_chars and unique_ratio > config.free_text_min_unique_ratio)
        or (unique_ratio >= config.free_text_high_unique_with_spaces and gaps >= 1)
    )


def decide(e: Mapping, kind: T.DataType, config: TypeDetectionConfig | None = None) -> ColumnTypeInfo:
    """The semantic type of a column from its row of ``evidence``.  Distinct values count null as one for identifiers."""
    config = config or TypeDetectionConfig()
    name = kind.simpleString()
    info = ColumnTypeInfo(e["column"], name, name)
    rows, n = e["rows"], e["n"]
    unique_ratio = (e["unique"] + (n < rows)) / rows if rows else 0.0
    is_string, is_int, is_float = isinstance(kind, T.StringType), isinstance(kind, INTEGERS), isinstance(kind, FLOATS)

    def told(kind: SemanticType, *flags: TypeFlag) -> ColumnTypeInfo:
        info.semantic_type = kind
        info.flags += flags
        return info

    if is_string and rows:
        of = n or rows
        if e["numeric_n"] / of >= config.numeric_coerce_threshold:
            info.inferred_dtype, is_string, is_float = "double", False, True
            info.flags.append(TypeFlag.NumericCoerced)
            if not e["fractions"] and _encoded(e, e["numeric_n"], e["levels"], config):
                return told(SemanticType.Categorical, TypeFlag.EncodedCategory)
        elif e["datetime_n"] / of >= config.datetime_coerce_threshold:
            info.inferred_dtype = "timestamp"
            return told(SemanticType.Datetime, TypeFlag.DatetimeCoerced)
    whole_bits = is_int and (e["levels"] == 0 or (e["low"] >= 0 and e["high"] <= 1))
    if isinstance(kind, T.BooleanType) or whole_bits or (is_string and n and not e["not_boolean"]):
        return told(SemanticType.Boolean, TypeFlag.BooleanCandidate)
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType, T.DayTimeIntervalType)):
        return told(SemanticType.Datetime)
    if is_int and _encoded(e, n, e["levels"], config):
        return told(SemanticType.Categorical, TypeFlag.EncodedCategory)
    if is_int and unique_ratio > config.identifier_unique_ratio:
        counted = e["low"] == 1 and e["high"] == rows and e["levels"] + (n < rows) == rows
        return told(SemanticType.Identifier, TypeFlag.IdentifierColumn, *[TypeFlag.SequentialIndex] * counted)
    if is_int or is_float:
        info.numeric_kind = _kind(e, e["levels"])
        return told(SemanticType.Numeric)
    if is_string:
        if _free_text(e, unique_ratio, config):
            return told(SemanticType.Text, TypeFlag.FreeTextCandidate)
        token = n and (e["median_chars"] or 0) <= config.identifier_max_median_length and not e["median_gaps"]
        if unique_ratio > config.identifier_unique_ratio and token:
            return told(SemanticType.Identifier, TypeFlag.IdentifierColumn)
        return told(SemanticType.Categorical)
    return told(SemanticType.Text)


def detect(df: DataFrame, columns: Sequence[str] | None = None, config: TypeDetectionConfig | None = None) -> dict[str, ColumnTypeInfo]:
    columns = list(df.columns if columns is None else columns)
    if not columns:
        return {}
    types = kinds(df)
    rows = {r["column"]: r.asDict() for r in evidence(df, columns).collect()}
    return {c: decide(rows[c], types[c], config) for c in columns}
