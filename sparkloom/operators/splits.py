"""Splitting tables: random, stratified, by time, in folds, and by profile signals.

Rows are put in an order by a hash of their values and the seed, so a split is a function of content and seed, not of
partitions.  Sizes are exact: places come from ``ranked``, which never gathers a group in one task.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .base import col, ranked


def shuffled(df: DataFrame, seed: int) -> Column:
    """A long that puts the rows of ``df`` in a random order that only depends on their values."""
    cells = [F.to_json(col(c)) if t.startswith("map") else col(c) for c, t in df.dtypes]
    return F.xxhash64(*cells, F.lit(seed))


def quotas(sizes: Sequence[int], total: int) -> list[int]:
    """``total`` dealt in proportion to ``sizes``, whole numbers by largest remainder, none above its size."""
    n = sum(sizes)
    exact = [s * total / n if n else 0.0 for s in sizes]
    out = [min(s, math.floor(e)) for s, e in zip(sizes, exact)]
    for i in sorted(range(len(sizes)), key=lambda i: (-(exact[i] - out[i]), i))[: max(0, total - sum(out))]:
        out[i] += out[i] < sizes[i]
    return out


def random_split(df: DataFrame, test_rows: int, seed: int) -> DataFrame:
    """``df`` with ``__test``, true for exactly ``test_rows`` rows."""
    return ranked(df, shuffled(df, seed)).withColumn("__test", F.col("__rank") <= test_rows).drop("__rank")


def stratified_split(df: DataFrame, by: str, test_rows: int, seed: int) -> DataFrame:
    """As ``random_split``, with each value of ``by`` in proportion; the number of values is bounded by its counts table."""
    sizes = sorted(df.groupBy(col(by).cast("string").alias("__k")).count().collect(), key=lambda r: (r["__k"] is not None, r["__k"]))
    wanted = quotas([r["count"] for r in sizes], test_rows)
    table = df.sparkSession.createDataFrame([(r["__k"], q) for r, q in zip(sizes, wanted)], "__k string, __quota long")
    d = ranked(df.withColumn("__by", col(by).cast("string")), shuffled(df, seed), group=["__by"])
    d = d.join(F.broadcast(table), F.col("__by").eqNullSafe(F.col("__k")))
    return d.withColumn("__test", F.col("__rank") <= F.col("__quota")).drop("__rank", "__quota", "__k", "__by")


def folds(df: DataFrame, k: int, seed: int, by: str | None = None) -> DataFrame:
    """``df`` with ``__fold`` from 0; sizes differ by at most one, over the table and, with ``by``, for each of its values."""
    if by is None:
        n = df.count()
        base, more = divmod(n, k)
        at = F.col("__rank") - 1
        edge = more * (base + 1)
        fold = F.when(at < edge, F.floor(at / (base + 1))).otherwise(more + F.floor((at - edge) / max(base, 1)))
        return ranked(df, shuffled(df, seed)).withColumn("__fold", fold.cast("int")).drop("__rank")
    sizes = sorted(df.groupBy(col(by).cast("string").alias("__k")).count().collect(), key=lambda r: (r["__k"] is not None, r["__k"]))
    offset, rows = 0, []
    for r in sizes:
        rows.append((r["__k"], offset % k))
        offset += r["count"]
    table = df.sparkSession.createDataFrame(rows, "__k string, __offset int")
    d = ranked(df.withColumn("__by", col(by).cast("string")), shuffled(df, seed), group=["__by"])
    d = d.join(F.broadcast(table), F.col("__by").eqNullSafe(F.col("__k")))
    return d.withColumn("__fold", ((F.col("__rank") - 1 + F.col("__offset")) % k).cast("int")).drop("__rank", "__offset", "__k", "__by")


def time_order(df: DataFrame, time: str, seed: int = 0, cuts: int = 256) -> DataFrame:
    """``df`` with ``__rank`` by the time column, nulls first, ties by content.

    Times are cut at quantiles; rows are numbered within a cut and offset by the rows of the cuts before.  One time may
    hold many rows: a cut is divided again by content.
    """
    t = col(time)
    kind = dict(df.dtypes)[time]
    if kind.startswith(("timestamp", "date")):
        number = F.unix_micros(t.cast("timestamp"))
    elif kind == "string":  # the order of the first bytes; whole strings decide within a cut
        number = F.conv(F.rpad(F.hex(F.encode(F.substring(t, 1, 7), "utf-8")), 14, "0").substr(1, 14), 16, 10).cast("long")
    else:
        number = t
    d = df.withColumns({"__time": number, "__mix": shuffled(df, seed)})
    edges = d.agg(F.percentile_approx("__time", [i / cuts for i in range(1, cuts)], 4 * cuts)).first()[0]
    part = F.lit(0) if not edges else F.size(F.filter(F.array(*[F.lit(e) for e in sorted(set(edges))]), lambda e: e < F.col("__time")))
    d = d.withColumn("__part", F.when(F.col("__time").isNull(), F.lit(-1)).otherwise(part))
    sizes = d.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"), F.min(t).alias("__low"), F.max(t).alias("__high"))
    one = sorted(r["__part"] for r in sizes.where("__low <=> __high").collect())
    # In cuts that hold one time, or none, content alone orders the rows, so slices of it can be numbered apart.
    d = d.withColumn("__slice", F.when(F.col("__part").isin(one), F.shiftright("__mix", 56)).otherwise(F.lit(0)) if one else F.lit(0).cast("long"))
    sizes = d.groupBy("__part", "__slice").agg(F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(W.orderBy("__part", "__slice").rowsBetween(W.unboundedPreceding, 0)) - F.col("__n")
    sizes = sizes.select(F.col("__part").alias("__p"), F.col("__slice").alias("__s"), before.alias("__before"))
    inside = F.row_number().over(W.partitionBy("__part", "__slice").orderBy(t.asc_nulls_first(), "__mix"))
    d = d.withColumn("__inside", inside).join(F.broadcast(sizes), (F.col("__part") == F.col("__p")) & (F.col("__slice") == F.col("__s")))
    return d.withColumn("__rank", F.col("__before") + F.col("__inside")).drop("__time", "__mix", "__part", "__p", "__slice", "__s", "__inside", "__before")


def time_split(df: DataFrame, time: str, test_share: float, rows: int | None = None) -> DataFrame:
    """``df`` with ``__test``, true for the last ``floor(rows * test_share)`` rows."""
    n = df.count() if rows is None else rows
    return time_order(df, time).withColumn("__test", F.col("__rank") > n - math.floor(n * test_share)).drop("__rank")


def cutoff_split(df: DataFrame, time: str, cutoff) -> tuple[DataFrame, DataFrame]:
    """Rows before and from ``cutoff``; rows without time are in neither."""
    return df.where(col(time) < F.lit(cutoff)), df.where(col(time) >= F.lit(cutoff))


def by_signals(df: DataFrame, signals: Sequence[Column], parts: Sequence[float], seed: int) -> DataFrame:
    """``df`` with ``__part``, the number of the part of the share ``parts`` that each row falls into.

    Rows with the same signals are alike.  Each distinct combination deals its rows to the parts in proportion; what
    whole numbers leave over goes where the rarest of its signals is most behind, as in iterative stratification.
    Combinations are counted on the driver: at most the rows, in practice far fewer, and each a bit string and a count.
    """
    bits = F.concat_ws("", *[F.coalesce(s.cast("int"), F.lit(0)).cast("string") for s in signals])
    d = df.withColumn("__bits", bits)
    groups = sorted((r["__bits"], r["count"]) for r in d.groupBy("__bits").count().collect())
    n, width = sum(c for _, c in groups), len(signals)
    total = [sum(c for b, c in groups if b[i] == "1") for i in range(width)]
    lack = [[p * t for t in total] for p in parts]
    room = [float(x) for x in quotas_of_parts(n, parts)]
    shares: dict[str, list[int]] = {}
    left: list[tuple[str, int]] = []
    for b, c in groups:
        own = [math.floor(c * p) for p in parts]
        shares[b] = own
        for j, m in enumerate(own):
            room[j] -= m
            for i in range(width):
                lack[j][i] -= m * (b[i] == "1")
        left.append((b, c - sum(own)))
    rarity = lambda b: min((total[i] for i in range(width) if b[i] == "1"), default=n + 1)
    for b, c in sorted(left, key=lambda x: (rarity(x[0]), x[0])):
        rare = min((i for i in range(width) if b[i] == "1"), key=lambda i: total[i], default=None)
        for _ in range(c):
            j = max((j for j in range(len(parts)) if room[j] > 0), key=lambda j: ((lack[j][rare] if rare is not None else 0.0), room[j], -j))
            shares[b][j] += 1
            room[j] -= 1
            for i in range(width):
                lack[j][i] -= b[i] == "1"
    rows = []
    for b, own in shares.items():
        end = 0
        for j, m in enumerate(own):
            rows.append((b, j, end, end + m))
            end += m
    table = df.sparkSession.createDataFrame(rows, "__b string, __part int, __from long, __to long")
    d = ranked(d, shuffled(df, seed), group=["__bits"])
    here = (F.col("__bits") == F.col("__b")) & (F.col("__rank") > F.col("__from")) & (F.col("__rank") <= F.col("__to"))
    return d.join(table, here).drop("__bits", "__b", "__from", "__to", "__rank")


def quotas_of_parts(n: int, parts: Sequence[float]) -> list[int]:
    """Whole sizes of the parts of ``n`` rows; what is left over goes to the first ones."""
    out = [math.floor(n * p + 1e-9) for p in parts]
    for j in range(n - sum(out)):
        out[j % len(parts)] += 1
    return out
