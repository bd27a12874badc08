"""Shared shapes: one aggregate for many columns, value counts, ranks without a global window."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.nulls import quoted

#: Columns that share one scan; wider tables take several.
CHUNK = 25


def col(name: str) -> Column:
    return F.col(quoted(name))


def per_column(df: DataFrame, columns: Sequence[str], make: Callable[[str], dict[str, Column]]) -> DataFrame:
    """One row for each column: ``column`` and the aggregates that ``make`` names, all from one pass for ``CHUNK`` columns."""
    parts = []
    for at in range(0, len(columns), CHUNK):
        aggregates, rows = [], []
        for i, name in enumerate(columns[at : at + CHUNK]):
            fields = make(name)
            aggregates += [e.alias(f"{i}_{k}") for k, e in fields.items()]
            rows.append(F.struct(F.lit(name).alias("column"), *[col(f"{i}_{k}").alias(k) for k in fields]))
        parts.append(df.agg(*aggregates).select(F.explode(F.array(*rows)).alias("r")).select("r.*"))
    return reduce(DataFrame.unionByName, parts)


def unpivot(df: DataFrame, columns: Sequence[str], kind: str, value: Callable[[str], Column] | None = None) -> DataFrame:
    """(key, value) rows of the columns, cast to ``kind``, from one scan; ``key`` is the column's place as text."""
    value = value or col
    keys = [str(i) for i in range(len(columns))]
    return df.select(*[value(c).cast(kind).alias(k) for c, k in zip(columns, keys)]).unpivot([], keys, "key", "value")


def named(columns: Sequence[str]) -> Column:
    """The name that the ``key`` of ``unpivot`` stands for."""
    return F.get(F.array(*[F.lit(c) for c in columns]), F.col("key").cast("int"))


def _by_type(df: DataFrame, columns: Sequence[str], value: Callable[[str], Column] | None) -> list[DataFrame]:
    """(key, value, n) of the non-null values, one table for the columns of each type: values are counted as they are."""
    d = df.select(*[(value or col)(c).alias(str(i)) for i, c in enumerate(columns)])
    kinds: dict[str, list[str]] = {}
    for key, kind in d.dtypes:
        kinds.setdefault("bigint" if kind in ("tinyint", "smallint", "int", "bigint") else "double" if kind in ("float", "double") else kind, []).append(key)
    cells = [d.select(*[F.col(k).cast(kind).alias(k) for k in keys]).unpivot([], keys, "key", "value") for kind, keys in kinds.items()]
    return [c.where(F.col("value").isNotNull()).groupBy("key", "value").agg(F.count(F.lit(1)).alias("n")) for c in cells]


def value_counts(df: DataFrame, columns: Sequence[str], kind: str = "string", value: Callable[[str], Column] | None = None) -> DataFrame:
    """(column, value, n) of all non-null values, cast to ``kind`` after they are counted; one shuffle of partial counts a type."""
    counts = [c.select("key", F.col("value").cast(kind).alias("value"), "n") for c in _by_type(df, columns, value)]
    return reduce(DataFrame.unionByName, counts).select(named(columns).alias("column"), "value", "n")


def distinct_counts(df: DataFrame, columns: Sequence[str], value: Callable[[str], Column] | None = None) -> DataFrame:
    """(column, distinct) of the non-null values."""
    parts = [c.groupBy("key").agg(F.count(F.lit(1)).alias("distinct")) for c in _by_type(df, columns, value)]
    return reduce(DataFrame.unionByName, parts).select(named(columns).alias("column"), "distinct")


def top_values(counts: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` most frequent values of each column with their place; ties go to the smaller value."""
    place = F.row_number().over(W.partitionBy("column").orderBy(F.desc("n"), F.asc("value")))
    return counts.withColumn("place", place).where(F.col("place") <= k)


def ranked(df: DataFrame, order: Column, ties: Sequence[Column] = (), group: Sequence[str] = (), bits: int = 12) -> DataFrame:
    """``df`` with ``__rank`` from 1 in each group by the long ``order``, which should be spread like a hash.

    Rows are numbered within slices of the order and offset by the sizes of the slices before, so that no task holds a
    group, however large.
    """
    d = df.withColumn("__order", order).withColumn("__slice", F.shiftright(F.col("__order"), 64 - bits))
    sizes = d.groupBy(*group, "__slice").agg(F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(W.partitionBy(*group).orderBy("__slice").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("__n")
    sizes = sizes.withColumn("__before", before).select(*[F.col(g).alias(f"__g{i}") for i, g in enumerate(group)], F.col("__slice").alias("__s"), "__before")
    inside = F.row_number().over(W.partitionBy(*group, "__slice").orderBy("__order", *ties))
    d = d.withColumn("__inside", inside)
    same = reduce(lambda a, b: a & b, [F.col(g).eqNullSafe(F.col(f"__g{i}")) for i, g in enumerate(group)], F.col("__slice") == F.col("__s"))
    d = d.join(sizes, same).withColumn("__rank", F.col("__before") + F.col("__inside"))
    return d.drop("__order", "__slice", "__s", "__before", "__inside", *[f"__g{i}" for i in range(len(group))])


def average_ranks(df: DataFrame, column: str, cuts: int = 256) -> DataFrame:
    """(value, rank) of the distinct values of a numeric column: the mean of the places that equal values take.

    Distinct values are cut at quantiles; places are summed within a cut and offset by the cuts before.
    """
    counts = df.select(col(column).cast("double").alias("value")).where("value is not null and not isnan(value)").groupBy("value").agg(F.count(F.lit(1)).alias("n"))
    edges = counts.agg(F.percentile_approx("value", [i / cuts for i in range(1, cuts)], 4 * cuts)).first()[0] or []
    part = F.size(F.filter(F.array(*[F.lit(float(e)) for e in sorted(set(edges))]).cast("array<double>"), lambda e: e < F.col("value")))
    counts = counts.withColumn("part", part)
    sizes = counts.groupBy("part").agg(F.sum("n").alias("size"))
    sizes = sizes.select(F.col("part").alias("p"), (F.sum("size").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, 0)) - F.col("size")).alias("before"))
    inside = F.sum("n").over(W.partitionBy("part").orderBy("value").rowsBetween(W.unboundedPreceding, 0)) - F.col("n")
    d = counts.withColumn("inside", inside).join(sizes, F.col("part") == F.col("p"))
    return d.select("value", (F.col("before") + F.col("inside") + (F.col("n") + 1) / 2).alias("rank"))
