"""Statistics of pairs of columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import mathx
from ..functions.nulls import missing_exprs
from .base import average_ranks, col
from .columns import number

#: Pairs that share one scan.
PAIRS = 64
#: Rows of a block of neighbours, of numbers alone and with levels.
BLOCK, LEVELS_BLOCK = 256, 1000


def correlation(x: Column, y: Column) -> Column:
    """Pearson's r over rows where both are there; 0 where it is undefined; within -1 and 1."""
    a, b = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
    r = F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.coalesce(F.nanvl(r, F.lit(0.0)), F.lit(0.0))))


def correlations(df: DataFrame, values: Mapping[str, Column], name: str = "r", pairs: Sequence[tuple[str, str]] | None = None) -> DataFrame:
    """(column_a, column_b, ``name``) of each pair of the named expressions; ``PAIRS`` pairs share a pass."""
    pairs = list(combinations(values, 2)) if pairs is None else list(pairs)
    parts = []
    for at in range(0, len(pairs), PAIRS):
        some = pairs[at : at + PAIRS]
        one = df.agg(*[correlation(values[a], values[b]).alias(str(i)) for i, (a, b) in enumerate(some)])
        rows = [F.struct(F.lit(a).alias("column_a"), F.lit(b).alias("column_b"), col(str(i)).alias(name)) for i, (a, b) in enumerate(some)]
        parts.append(one.select(F.explode(F.array(*rows)).alias("p")).select("p.*"))
    if not parts:
        return df.sparkSession.createDataFrame([], f"column_a string, column_b string, {name} double")
    return reduce(DataFrame.unionByName, parts)


def pearson(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return correlations(df, {c: number(df, c) for c in columns}, "pearson")


def with_ranks(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``columns`` replaced by their average ranks; each is a join with the ranks of its distinct values."""
    d = df.select(*[number(df, c).alias(c) for c in columns])
    for i, c in enumerate(columns):
        ranks = average_ranks(df.select(number(df, c).alias(c)), c).select(F.col("value").alias(f"__v{i}"), F.col("rank").alias(f"__r{i}"))
        d = d.join(ranks, col(c) == F.col(f"__v{i}"), "left").drop(f"__v{i}")
    return d.select(*[F.col(f"__r{i}").alias(c) for i, c in enumerate(columns)])


def spearman(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    d = with_ranks(df, columns)
    return correlations(d, {c: col(c) for c in columns}, "spearman")


def missing_correlation(df: DataFrame, columns: Sequence[str], numeric: Mapping | None = None, strings: Mapping | None = None) -> DataFrame:
    """(column_a, column_b, r) of the missing-value indicators of the columns."""
    gone = {c: e.cast("double") for c, e in missing_exprs(df, columns, numeric, strings).items()}
    return correlations(df, gone, "r")


def contingency(df: DataFrame, a: str, b: str) -> DataFrame:
    """(a, b, n) over rows where both are there."""
    d = df.select(col(a).cast("string").alias("a"), col(b).cast("string").alias("b")).where("a is not null and b is not null")
    return d.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))


def cramers_v(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: column_a, column_b, n, levels, chi2 (Yates-corrected for two by two) and the bias-corrected V.

    Chi-square comes from cells that occur, as n * (sum of n_ij^2 / (n_i n_j) - 1); with the correction, all four cells
    of the two by two table deviate by the same amount, so one cell and the marginals give it.
    """
    cells = contingency(df, a, b)
    left = cells.groupBy(F.col("a").alias("l")).agg(F.sum("n").alias("n_a"))
    right = cells.groupBy(F.col("b").alias("r")).agg(F.sum("n").alias("n_b"))
    d = cells.join(left, F.col("a") == F.col("l")).join(right, F.col("b") == F.col("r"))
    n, na, nb = (F.col(x).cast("double") for x in ("n", "n_a", "n_b"))
    s = d.agg(
        F.sum(n).alias("n"), F.countDistinct("a").alias("r"), F.countDistinct("b").alias("k"), F.sum(n * n / (na * nb)).alias("share"),
        F.min(F.struct("a", "b", n.alias("o"), na.alias("na"), nb.alias("nb"))).alias("c"),
    )
    total = F.col("n")
    expected = F.col("c.na") * F.col("c.nb") / total
    off = F.abs(F.col("c.o") - expected)
    yates = F.pow(off - F.least(F.lit(0.5), off), F.lit(2.0)) * F.try_divide(total * total * total, F.col("c.na") * F.col("c.nb") * (total - F.col("c.na")) * (total - F.col("c.nb")))
    chi2 = F.when((F.col("r") == 2) & (F.col("k") == 2), yates).otherwise(total * (F.col("share") - 1))
    s = s.withColumn("chi2", F.greatest(F.lit(0.0), chi2))
    r, k = F.col("r").cast("double"), F.col("k").cast("double")
    phi = F.greatest(F.lit(0.0), F.col("chi2") / total - (r - 1) * (k - 1) / (total - 1))
    denominator = F.least(r - (r - 1) * (r - 1) / (total - 1), k - (k - 1) * (k - 1) / (total - 1)) - 1
    v = F.when((total >= 5) & (r >= 2) & (k >= 2) & (denominator > 0), F.sqrt(phi / denominator))
    return s.select(F.lit(a).alias("column_a"), F.lit(b).alias("column_b"), F.col("n").cast("long").alias("n"), F.col("r").alias("levels_a"), F.col("k").alias("levels_b"), "chi2", v.alias("cramers_v"))


def between_groups(df: DataFrame, feature: str, group: str) -> DataFrame:
    """One row: feature, grouping, n, k, SSB, SSW, SST (over all rows with the feature), eta_squared, f."""
    d = df.select(number(df, feature).alias("x"), col(group).cast("string").alias("g")).where("x is not null and not isnan(x)")
    parts = d.groupBy("g").agg(F.count("x").alias("n"), F.avg("x").alias("m"), F.coalesce(F.var_pop("x"), F.lit(0.0)).alias("v")).persist()
    inside = F.col("g").isNotNull()
    n, m, v = F.col("n").cast("double"), F.col("m"), F.col("v")
    own = F.when(inside, n)
    try:
        s = parts.agg(
            F.coalesce(F.sum(own), F.lit(0.0)).alias("n"), F.count_if(inside).alias("k"), F.try_divide(F.sum(own * m), F.sum(own)).alias("mean"),
            F.try_divide(F.sum(n * m), F.sum(n)).alias("all_mean"), F.coalesce(F.sum(own * v), F.lit(0.0)).alias("ssw"),
        ).first()
        off = lambda mean: (m - F.lit(mean or 0.0)) * (m - F.lit(mean or 0.0))
        total = lambda e: F.coalesce(F.sum(e), F.lit(0.0))
        t = parts.agg(total(n * (v + off(s["all_mean"]))).alias("sst"), total(own * off(s["all_mean"])).alias("ssb"), total(own * off(s["mean"])).alias("own_ssb")).first()
    finally:
        parts.unpersist()
    k, rows = s["k"], int(s["n"])
    eta = None if k < 2 else t["ssb"] / t["sst"] if t["sst"] else 0.0
    f = (t["own_ssb"] / (k - 1)) / (s["ssw"] / (rows - k)) if k >= 2 and rows > k and s["ssw"] else None
    schema = "feature string, grouping string, n long, k long, ssb double, ssw double, sst double, eta_squared double, f double"
    return df.sparkSession.createDataFrame([(feature, group, rows, k, t["ssb"], s["ssw"], t["sst"], eta, f)], schema)


def mutual_information_discrete(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: column_a, column_b, n, mi in nats, exact from the contingency table."""
    cells = contingency(df, a, b)
    left = cells.groupBy(F.col("a").alias("l")).agg(F.sum("n").alias("n_a"))
    right = cells.groupBy(F.col("b").alias("r")).agg(F.sum("n").alias("n_b"))
    d = cells.join(left, F.col("a") == F.col("l")).join(right, F.col("b") == F.col("r"))
    n, na, nb = (F.col(x).cast("double") for x in ("n", "n_a", "n_b"))
    s = d.agg(F.sum("n").alias("n"), F.sum(n * F.log(n / (na * nb))).alias("s"))
    mi = F.greatest(F.lit(0.0), F.col("s") / F.col("n") + F.log(F.col("n").cast("double")))
    return s.select(F.lit(a).alias("column_a"), F.lit(b).alias("column_b"), "n", mi.alias("mi"))


def mutual_information(df: DataFrame, columns: Sequence[str], discrete: Sequence[str], pairs: Sequence[tuple[str, str]], seed: int = 42) -> tuple[int, dict[tuple[str, str], float]]:
    """(complete rows, {pair: mutual information in nats}) by nearest neighbours, over all complete rows of ``columns``.

    Rows are dealt at random into blocks of about ``BLOCK`` rows (``LEVELS_BLOCK`` with ``discrete`` columns), each block gives an
    estimate, and their mean counts, so work grows with the rows and no task holds more than a block.
    """
    parts = [(col(c).cast("string") if c in discrete else number(df, c)).alias(str(i)) for i, c in enumerate(columns)]
    names = [str(i) for i in range(len(columns))]
    d = df.select(*parts).dropna()
    d = d.where(reduce(lambda a, b: a & b, [~F.isnan(n) for n, c in zip(names, columns) if c not in discrete], F.lit(True)))
    rows = d.count()
    blocks = max(1, round(rows / (LEVELS_BLOCK if discrete else BLOCK)))
    d = d.withColumn("block", F.pmod(F.xxhash64(F.lit(seed), F.monotonically_increasing_id(), *names), F.lit(blocks)))
    at = [(columns.index(a), columns.index(b)) for a, b in pairs]
    coded = [c in discrete for c in columns]

    def estimate(block: pd.DataFrame) -> pd.DataFrame:
        values = [np.unique(block[n].to_numpy(str), return_inverse=True)[1] if is_code else block[n].to_numpy(float) for n, is_code in zip(names, coded)]
        found = [mathx.mutual_information(values[i], values[j], coded[i], coded[j], clip=False) if len(block) > 4 else 0.0 for i, j in at]
        return pd.DataFrame({"pair": range(len(at)), "weight": float(len(block)) if len(block) > 4 else 0.0, "mi": found})

    if not rows or not pairs:
        return rows, {}
    got = d.groupBy("block").applyInPandas(estimate, "pair int, weight double, mi double").groupBy("pair").agg((F.sum(F.col("weight") * F.col("mi")) / F.sum("weight")).alias("mi")).collect()
    return rows, {tuple(pairs[r["pair"]]): max(0.0, r["mi"] or 0.0) for r in got}


def sample(df: DataFrame, columns: Sequence[str], rows: int, seed: int) -> DataFrame:
    """At most ``rows`` complete rows of ``columns``, by a hash of their values, so every run takes the same."""
    complete = df.select(*[col(c) for c in columns]).dropna(subset=list(columns))
    return complete.orderBy(F.xxhash64(*[col(c) for c in columns], F.lit(seed)), *[col(c) for c in columns]).limit(rows)
