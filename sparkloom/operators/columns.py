"""Statistics of columns, one row a column."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.casts import NUMBER, to_boolean, to_double, to_timestamp
from ..functions.nulls import NULL_WORDS, is_blank, missing_exprs, stripped
from .base import col, per_column, top_values, value_counts
from .quantiles import of_expressions

QUANTILES = {"p1": 0.01, "p5": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95, "p99": 0.99}


def kinds(df: DataFrame) -> dict[str, T.DataType]:
    return {f.name: f.dataType for f in df.schema.fields}


def number(df: DataFrame, name: str) -> Column:
    return to_double(col(name), kinds(df)[name])


# Missingness


def missingness(df: DataFrame, columns: Sequence[str], numeric: Mapping | None = None, strings: Mapping | None = None) -> DataFrame:
    """column, total_rows, standard_nulls, effective_nulls."""
    gone = missing_exprs(df, columns, numeric, strings)
    return per_column(
        df,
        columns,
        lambda c: {
            "total_rows": F.count(F.lit(1)),
            "standard_nulls": F.count_if(col(c).isNull()),
            "effective_nulls": F.count_if(gone[c]),
        },
    )


def missing_per_row(df: DataFrame, columns: Sequence[str], numeric: Mapping | None = None, strings: Mapping | None = None) -> DataFrame:
    """One long column, the number of effective nulls of each row."""
    total = F.lit(0).cast("long")
    for e in missing_exprs(df, columns, numeric, strings).values():
        total = total + e.cast("long")
    return df.select(total.alias("missing"))


def row_distribution(df: DataFrame, columns: Sequence[str], threshold: float = 0.5, numeric: Mapping | None = None, strings: Mapping | None = None) -> DataFrame:
    """Shares of rows by their number of missing cells; counts of numbers of cells are exact and small, so p90 is too."""
    least = max(1, -(-len(columns) * threshold // 1))
    share = lambda e: F.coalesce(F.avg(e.cast("double")), F.lit(0.0))
    m = F.col("missing")
    return missing_per_row(df, columns, numeric, strings).agg(
        F.coalesce(F.floor(F.percentile("missing", 0.9)), F.lit(0)).cast("long").alias("row_missing_p90"),
        share(m == 0).alias("pct_zero_missing"),
        share(m.between(1, 2)).alias("pct_one_to_two"),
        share(m.between(3, 5)).alias("pct_three_to_five"),
        share(m > 5).alias("pct_over_five"),
        share(m >= least).alias("pct_over_half_missing"),
        F.count_if(m >= least).alias("drop_candidate_row_count"),
    )


def sparsity(df: DataFrame) -> DataFrame:
    """One row: cells, effective nulls by the built-in rules, their ratio."""
    total = F.lit(0).cast("long")
    for e in missing_exprs(df, df.columns).values():
        total = total + F.count_if(e)
    cells = F.count(F.lit(1)) * len(df.columns)
    return df.agg(cells.alias("cells"), total.alias("effective_nulls"), F.coalesce(F.try_divide(total, cells), F.lit(0.0)).alias("sparsity"))


def duplicates(df: DataFrame) -> DataFrame:
    """One row: rows, duplicate rows (nulls equal), their ratio; rows are compared by value, not by hash."""
    comparable = [F.to_json(col(f.name)).alias(f.name) if isinstance(f.dataType, T.MapType) else col(f.name) for f in df.schema.fields]
    groups = df.select(*comparable).groupBy(*[col(c) for c in df.columns]).agg(F.count(F.lit(1)).alias("__n"))
    rows, distinct = F.coalesce(F.sum("__n"), F.lit(0)), F.count(F.lit(1))
    return groups.agg(rows.alias("rows"), (rows - distinct).alias("duplicate_rows"), F.coalesce(F.try_divide(rows - distinct, rows), F.lit(0.0)).alias("duplicate_ratio"))


def memory(df: DataFrame) -> DataFrame:
    """column, bytes: an estimate from string lengths and fixed widths."""
    width = {"boolean": 1, "tinyint": 1, "smallint": 2, "int": 4, "float": 4, "date": 4}
    types = dict(df.dtypes)

    def size(c: str) -> Column:
        if types[c] in ("string", "binary"):
            return F.coalesce(F.sum(F.octet_length(col(c))), F.lit(0)).cast("long")
        return (F.count(F.lit(1)) * width.get(types[c], 8)).cast("long")

    return per_column(df, df.columns, lambda c: {"bytes": size(c)})


# Numeric columns


def moments(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Counts, moments and range of each column, from one scan for ``CHUNK`` columns."""

    def make(c: str) -> dict[str, Column]:
        x = number(df, c)
        return {
            "rows": F.count(F.lit(1)),
            "n": F.count(x),
            "raw_n": F.count(col(c)),
            "mean": F.avg(x),
            "std": F.when(F.count(x) > 0, F.coalesce(F.stddev_samp(x), F.lit(0.0))),
            "min": F.min(x),
            "max": F.max(x),
            "skew_pop": F.skewness(x),
            "kurt_pop": F.kurtosis(x),
        }

    return per_column(df, columns, make)


def quantile_table(df: DataFrame, columns: Sequence[str], shares: Sequence[float]) -> DataFrame:
    """(column, n, q) of the exact quantiles of each column; nothing of the size of a column is gathered."""
    found = of_expressions(df, [number(df, c) for c in columns], shares)
    return df.sparkSession.createDataFrame([(c, n, q) for c, (n, q) in zip(columns, found)], "column string, n long, q array<double>")


def numeric_summary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """n, moments and exact quantiles of each column."""
    q = quantile_table(df, columns, list(QUANTILES.values())).select(F.col("column").alias("q_column"), "q")
    d = moments(df, columns).join(F.broadcast(q), F.col("column") == F.col("q_column"), "left")
    return d.select("column", "rows", "n", "raw_n", "mean", "std", "min", "max", "skew_pop", "kurt_pop", *[F.get("q", F.lit(i)).alias(k) for i, k in enumerate(QUANTILES)])


def shape(summary: DataFrame) -> DataFrame:
    """column, skewness, kurtosis with the corrections for bias; null under 3 rows, 0 without spread."""
    n, g1, g2 = F.col("n").cast("double"), F.col("skew_pop"), F.col("kurt_pop")
    skew = F.try_divide(g1 * F.sqrt(n * (n - 1)), n - 2)
    kurt = F.when(n > 3, F.try_divide((n - 1) * ((n + 1) * g2 + 6), (n - 2) * (n - 3))).otherwise(g2)
    flat = F.col("std") == 0
    return summary.select(
        "column",
        F.when(n >= 3, F.when(flat, 0.0).otherwise(skew)).alias("skewness"),
        F.when(n >= 3, F.when(flat, 0.0).otherwise(kurt)).alias("kurtosis"),
    )


def outlier_density(df: DataFrame, centre: Mapping[str, tuple[float, float]], sigma: float = 3.0) -> DataFrame:
    """column, outlier_density: the share of values further than ``sigma`` deviations from the mean, in a second pass."""

    def make(c: str) -> dict[str, Column]:
        mean, std = centre[c]
        far = F.abs(number(df, c) - F.lit(float(mean))) > F.lit(float(sigma * std))
        return {"outlier_density": F.coalesce(F.avg(far.cast("double")), F.lit(0.0))}

    return per_column(df, list(centre), make)


def histogram(df: DataFrame, column: str, low: float, high: float, bins: int) -> DataFrame:
    """bin, n of equal bins over low..high; the last bin is closed."""
    if low == high:
        low, high, bins = low - 0.5, high + 0.5, 1
    x = number(df, column)
    place = F.least(F.floor((x - F.lit(low)) / F.lit((high - low) / bins)), F.lit(bins - 1)).cast("int")
    return df.where(x.isNotNull()).groupBy(place.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


# Categorical columns


def listed(df: DataFrame, columns: Sequence[str], every: DataFrame | None = None) -> DataFrame:
    """(column, value, n) of the values that count for distributions: not null, not blank, not a built-in null word.

    ``every``, here and below: the value counts of the columns, where they are there already.
    """
    counts = value_counts(df, columns) if every is None else every
    return counts.where(~is_blank(F.col("value")) & ~F.upper("value").isin(list(NULL_WORDS)))


def categorical_summary(df: DataFrame, columns: Sequence[str], rare: float = 0.01, every: DataFrame | None = None) -> DataFrame:
    """Cardinality, mode, imbalance and rare categories of each column."""
    every = value_counts(df, columns) if every is None else every
    numeric = F.col("value").rlike(NUMBER)
    whole = every.groupBy("column").agg(
        F.count(F.lit(1)).alias("cardinality"), F.sum("n").alias("present"), F.coalesce(F.sum(F.when(numeric, F.col("n"))), F.lit(0)).alias("numeric_values")
    )
    rows = per_column(df, columns, lambda c: {"rows": F.count(F.lit(1))})
    counts = listed(df, columns, every)
    totals = counts.groupBy(F.col("column").alias("t_column")).agg(F.sum("n").alias("total"))
    counts = counts.join(F.broadcast(totals), F.col("column") == F.col("t_column")).drop("t_column")
    n, total = F.col("n").cast("double"), F.col("total").cast("double")
    small = F.col("n") < F.greatest(F.lit(1), F.floor(total * rare))
    first = top_values(counts, 2).groupBy("column").agg(
        F.max(F.when(F.col("place") == 1, F.col("value"))).alias("mode"),
        F.max(F.when(F.col("place") == 1, F.col("n"))).alias("mode_count"),
        F.max(F.when(F.col("place") == 2, F.col("n"))).alias("second_count"),
    )
    spread = counts.groupBy("column").agg(
        F.count(F.lit(1)).alias("k"),
        F.first("total").alias("total"),
        F.sum(-(n / total) * F.log2(n / total)).alias("entropy"),
        (1 - F.sum((n / total) * (n / total))).alias("gini"),
        F.count_if(small).alias("rare_categories"),
        F.coalesce(F.sum(F.when(small, F.col("n"))), F.lit(0)).alias("rare_rows"),
    )
    d = rows.join(whole, "column", "left").join(first, "column", "left").join(spread, "column", "left")
    k = F.col("k").cast("double")
    return d.select(
        "column",
        "rows",
        F.coalesce("present", F.lit(0)).alias("present"),
        F.coalesce("cardinality", F.lit(0)).alias("cardinality"),
        F.coalesce("numeric_values", F.lit(0)).alias("numeric_values"),
        F.coalesce("total", F.lit(0)).alias("total"),
        "mode",
        F.coalesce("mode_count", F.lit(0)).alias("mode_count"),
        F.when(k >= 2, F.col("mode_count") / F.col("second_count")).alias("dominant_ratio"),
        F.when(k >= 2, F.col("entropy") / F.log2(k)).alias("normalized_entropy"),
        F.when(k >= 2, F.col("gini") / (1 - 1 / k)).alias("normalized_gini"),
        F.coalesce("rare_categories", F.lit(0)).alias("rare_categories"),
        F.coalesce("rare_rows", F.lit(0)).alias("rare_rows"),
    )


def rare_labels(df: DataFrame, columns: Sequence[str], share: float = 0.05, every: DataFrame | None = None) -> DataFrame:
    """(column, value, n) of the values under ``share`` of all rows."""
    counts = listed(df, columns, every)
    rows = per_column(df, columns, lambda c: {"rows": F.count(F.lit(1))}).withColumnRenamed("column", "r_column")
    d = counts.join(F.broadcast(rows), F.col("column") == F.col("r_column"))
    return d.where(F.col("n") < share * F.col("rows")).select("column", "value", "n")


# Boolean and text columns


def boolean_summary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    types = kinds(df)

    def make(c: str) -> dict[str, Column]:
        b = to_boolean(col(c), types[c])
        return {"present": F.count(col(c)), "true_count": F.count_if(b), "false_count": F.count_if(~b)}

    return per_column(df, columns, make)


def text_summary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Tokens, characters, blank shares and vocabulary of each column."""

    def make(c: str) -> dict[str, Column]:
        x = col(c).cast("string")
        tokens = F.regexp_count(x, F.lit(r"\S+")).cast("double")
        length = F.char_length(x)
        share = lambda e: F.coalesce(F.try_divide(F.count_if(e).cast("double"), F.count(F.lit(1))), F.lit(0.0))
        return {
            "rows": F.count(F.lit(1)),
            "avg_token_count": F.avg(tokens),
            "median_token_count": F.percentile(tokens, 0.5),
            "char_length_min": F.min(length),
            "char_length_max": F.max(length),
            "char_length_mean": F.avg(length),
            "char_length_median": F.percentile(length, 0.5),
            "empty_ratio": share(length == 0),
            "whitespace_ratio": share((length > 0) & (F.length(stripped(x)) == 0)),
        }

    words = None
    for c in columns:
        one = df.select(F.lit(c).alias("v_column"), F.explode(F.array_distinct(F.split(col(c).cast("string"), " "))).alias("piece"))
        words = one if words is None else words.unionByName(one)
    vocabulary = words.where("piece != ''").groupBy("v_column", "piece").agg(F.lit(1)).groupBy("v_column").agg(F.count(F.lit(1)).alias("vocabulary_size"))
    d = per_column(df, columns, make)
    return d.join(vocabulary, F.col("column") == F.col("v_column"), "left").drop("v_column").withColumn("vocabulary_size", F.coalesce("vocabulary_size", F.lit(0)))


# Datetime columns


def timestamps(df: DataFrame, column: str, fmt: str | None = None, unit: str | None = None) -> Column:
    return to_timestamp(col(column), kinds(df)[column], fmt, unit)


def datetime_summary(df: DataFrame, columns: Sequence[str], now: datetime, formats: Mapping | None = None, units: Mapping | None = None) -> DataFrame:
    """Range, future dates and temporal signals of each column, in one pass."""

    def make(c: str) -> dict[str, Column]:
        t = timestamps(df, c, (formats or {}).get(c), (units or {}).get(c))
        varies = lambda e: F.coalesce(F.min(e) != F.max(e), F.lit(False))
        some = lambda e: F.coalesce(F.bool_or(e), F.lit(False))
        return {
            "rows": F.count(F.lit(1)),
            "raw_n": F.count(col(c)),
            "n": F.count(t),
            "min_date": F.min(t),
            "max_date": F.max(t),
            "range_days": (F.unix_micros(F.max(t)) - F.unix_micros(F.min(t))) / 86_400_000_000,
            "future_dates": F.count_if(t > F.lit(now)),
            "has_year": varies(F.year(t)),
            "has_month": varies(F.month(t)),
            "has_day": varies(F.dayofmonth(t)),
            "has_day_of_week": varies(F.weekday(t)),
            "has_hour": some(F.hour(t) > 0),
            "has_is_weekend": some(F.weekday(t) + 1 >= 5),
            "has_is_month_end": some(F.last_day(t) == F.to_date(t)),
        }

    return per_column(df, columns, make)


def recent_count(df: DataFrame, column: str, cutoff: datetime, fmt: str | None = None, unit: str | None = None) -> DataFrame:
    return df.agg(F.count_if(timestamps(df, column, fmt, unit) >= F.lit(cutoff)).alias("recent"))


def gaps(df: DataFrame, column: str, fmt: str | None = None, unit: str | None = None) -> DataFrame:
    """gap: seconds between consecutive distinct times.

    Times are ordered within days; the first of a day is set against the last of the day before it in a table of days.
    """
    us = F.unix_micros(timestamps(df, column, fmt, unit))
    t = df.select(us.alias("t")).where("t is not null").distinct().withColumn("day", F.floor(F.col("t") / 86_400_000_000))
    days = t.groupBy(F.col("day").alias("d")).agg(F.max("t").alias("last"))
    days = days.select("d", F.lag("last").over(W.orderBy("d")).alias("carried"))
    within = F.lag("t").over(W.partitionBy("day").orderBy("t"))
    joined = t.withColumn("before", within).join(days, F.col("day") == F.col("d"))
    return joined.select(((F.col("t") - F.coalesce("before", "carried")) / 1e6).alias("gap")).where("gap is not null")


def gap_summary(df: DataFrame, column: str, **how) -> DataFrame:
    """One row: n_gaps, median_gap_seconds, gap_cv."""
    g = gaps(df, column, **how).persist()
    try:
        r = g.agg(F.count(F.lit(1)).alias("n"), F.try_divide(F.stddev_samp("gap"), F.avg("gap")).alias("cv")).first()
        middle = of_expressions(g, [F.col("gap")], [0.5])[0][1][0]
    finally:
        g.unpersist()
    return df.sparkSession.createDataFrame([(r["n"], middle, r["cv"])], "n_gaps long, median_gap_seconds double, gap_cv double")


def granularity(median_gap: float | None) -> str:
    """The band that a median gap in seconds falls into."""
    if median_gap is None:
        return "irregular"
    for limit, name in ((90, "secondly"), (3600, "minutely"), (7200, "hourly"), (172_800, "daily"), (1_209_600, "weekly"), (5_184_000, "monthly")):
        if median_gap < limit:
            return name
    return "yearly"
