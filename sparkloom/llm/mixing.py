"""Mixing sources to target weights by weighted fair queueing, in DataFrame functions only.

Every document of a source is put in a reproducible shuffled order.  Its virtual finish time is the running number of its
source's words, its own included, divided by its source's target; a second round through the source goes on where the
first ended.  All finish times are ranged globally and the mix takes what finishes before the total budget is spent.

Targets: sources in code point order (null last) weigh ``weights`` in turn and share ``share`` of all words; a target stops
at ``most`` times the source's size and the excess is shared again by weight (water filling, in closed form).

Running sums are exact longs and need no task with a whole source: a source is cut into ``slices`` slices of the shuffled
order; offsets of slices are summed per source over at most ``slices`` rows, and only within a slice are rows ordered.
The cut is found by two histograms of at most ``BINS`` rows, so it is exact to 1 / BINS**2 of a target: documents that
finish within that last bin are left out.

Defined cases: null text has size 0 and takes nothing; null source is a source; repeated rows are ordered by content, and
equal rows may swap without changing the result; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .native import carried, n_words, restored
from .store import keep

BINS = 65536


def targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """source, source_size, target from (source, source_size); one row per source, so the windows here are over sources only."""
    turn = (F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    weight = F.lit(weights[-1])
    for i, w in enumerate(weights[:-1]):
        weight = F.when(F.col("turn") == i, F.lit(w)).otherwise(weight)
    s = sizes.withColumn("turn", turn).withColumn("weight", weight.cast("double")).withColumn("cap", most * F.col("source_size"))
    order = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = W.partitionBy(F.lit(1))
    s = s.select(
        "source",
        "source_size",
        "weight",
        "cap",
        (F.sum("source_size").over(everything) * share).alias("budget"),
        (F.sum("cap").over(order.rowsBetween(W.unboundedPreceding, 0)) - F.col("cap")).alias("spent"),
        F.sum("weight").over(order.rowsBetween(0, W.unboundedFollowing)).alias("left"),
    )
    s = s.withColumn("level", (F.col("budget") - F.col("spent")) / F.col("left"))
    s = s.withColumn("full", F.col("cap") <= F.col("level") * F.col("weight"))
    s = s.withColumn("final", F.max(F.when(~F.col("full"), F.struct(-F.col("spent"), F.col("level").alias("level")))).over(everything)["level"])
    return s.select("source", "source_size", F.when(F.col("full"), F.col("cap")).otherwise(F.col("final") * F.col("weight")).alias("target"))


def queue(docs: DataFrame, seed: str = "mix", slices: int = 4096, **shares) -> DataFrame:
    """doc_id, source, text_hash, size, source_size, target, before (words of the source ahead in the shuffled order)."""
    text = F.coalesce("text", F.lit(""))
    d = docs.select("doc_id", "source", F.md5(text).alias("text_hash"), n_words(text).alias("size"))
    d = d.withColumn("key", F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "text_hash")))
    d = keep(d.withColumn("slice", (F.conv(F.substring("key", 1, 8), 16, 10).cast("long") % slices).cast("int")))
    sums = d.groupBy("source", "slice").agg(F.sum("size").alias("slice_size"))
    ahead = F.sum("slice_size").over(W.partitionBy("source").orderBy("slice").rowsBetween(W.unboundedPreceding, 0)) - F.col("slice_size")
    goal = targets(sums.groupBy("source").agg(F.sum("slice_size").alias("source_size")), **shares)
    goal = goal.select(F.col("source").alias("g_source"), "source_size", "target")
    offsets = sums.withColumn("ahead", ahead).join(goal, F.col("source").eqNullSafe(F.col("g_source")))
    offsets = offsets.select(F.col("source").alias("o_source"), F.col("slice").alias("o_slice"), "ahead", "source_size", "target")
    inside = W.partitionBy("source", "slice").orderBy("key").rowsBetween(W.unboundedPreceding, 0)
    d = d.withColumn("inside", F.sum("size").over(inside) - F.col("size"))
    d = d.join(offsets, F.col("source").eqNullSafe(F.col("o_source")) & (F.col("slice") == F.col("o_slice")))
    return d.select("doc_id", "source", "text_hash", "key", "size", "source_size", "target", (F.col("ahead") + F.col("inside")).alias("before"))


def _cut(bins: DataFrame, budget: float) -> tuple[int, float]:
    """The first of at most a few times ``BINS`` bins that ``budget`` does not hold whole, and the budget left before it."""
    run = bins.withColumn("run", F.sum("n").over(W.orderBy("bin").rowsBetween(W.unboundedPreceding, 0)))
    row = run.where(F.col("run") > budget).orderBy("bin").select("bin", "run", "n").first()
    return (row["bin"], budget - row["run"] + row["n"]) if row else (2**62, 0.0)


def mix(docs: DataFrame, share: float = 1.5, **options) -> DataFrame:
    """The queue with first and second finish time (null: none), copies (0, 1 or 2) and taken words of each row."""
    q = queue(docs, share=share, **options)
    positive = (F.col("size") > 0) & (F.col("target") > 0)
    finish = lambda n: F.when(positive, (F.col("before") + F.col("size") + n) / F.col("target"))
    q = keep(q.withColumn("first", finish(F.lit(0))).withColumn("second", finish(F.col("source_size"))))
    copies = q.select("size", F.explode(F.array("first", "second")).alias("f")).where("f is not null")
    coarse = F.floor(F.col("f") * BINS)
    fine = F.floor((F.col("f") * BINS - coarse) * BINS)

    budget = (q.groupBy("source").agg(F.first("source_size").alias("s")).agg(F.sum("s")).first()[0] or 0) * share
    top, rest = _cut(copies.groupBy(coarse.alias("bin")).agg(F.sum("size").alias("n")), budget)
    low, _ = _cut(copies.where(coarse == top).groupBy(fine.alias("bin")).agg(F.sum("size").alias("n")), rest)

    def within(f: str):
        c = F.floor(F.col(f) * BINS)
        return F.coalesce((c < top) | ((c == top) & (F.floor((F.col(f) * BINS - c) * BINS) < low)), F.lit(False)).cast("int")

    q = q.withColumn("copies", within("first") + within("second"))
    return q.select("doc_id", "source", "text_hash", "key", "size", "source_size", "target", "first", "second", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The documents of the mix in the columns of ``docs``, repeated as often as taken, in order of their finish times."""
    taken = mix(docs, **options).where("copies > 0")
    per = taken.groupBy("doc_id", "text_hash", "source").agg(F.sum("copies").alias("n"), F.min("first").alias("first"), F.min("second").alias("second"))
    per = per.select(F.col("doc_id").alias("p_doc"), F.col("text_hash").alias("p_hash"), F.col("source").alias("p_source"), "n", "first", "second")
    d = docs.select(carried(docs, "text"), "doc_id", "source", "text", F.md5(F.coalesce("text", F.lit(""))).alias("own"))
    alike = W.partitionBy("doc_id", "own", "source")
    same = F.col("doc_id").eqNullSafe(F.col("p_doc")) & (F.col("own") == F.col("p_hash")) & F.col("source").eqNullSafe(F.col("p_source"))
    d = d.join(per, same).withColumns({"at": F.row_number().over(alike.orderBy(F.lit(1))), "alike": F.count(F.lit(1)).over(alike)})
    mine = F.floor(F.col("n") / F.col("alike")) + (F.col("at") <= F.col("n") % F.col("alike")).cast("int")
    d = d.withColumn("copy", F.explode(F.when(mine > 0, F.sequence(F.lit(1), mine.cast("int"))).otherwise(F.array().cast("array<int>"))))
    time = F.when(F.col("copy") == 1, F.col("first")).otherwise(F.col("second"))
    return d.orderBy(time, "source", "doc_id", "own").select(*restored(docs, text=F.col("text")))
