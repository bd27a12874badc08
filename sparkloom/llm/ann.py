"""Approximate nearest neighbours by a permutation index.

A vector is represented by its ``depth`` nearest pivots in order.  An index block posts every vector of the block in the
inverted file of each of those pivots, with the pivot's place in the vector's order.  A query walks the files of its own
nearest pivots and sums, for every vector met, how much the truncated footrule distance falls below its largest value;
the ``rerank`` share of the block with the smallest distances is scored exactly and the best ``top`` of it go on.

Index blocks hold at most about ``block`` vectors, dealt by a hash of id, so equal vectors, however many, spread evenly;
within a block they are posted once.
Queries go to the blocks in groups of at most about ``block`` as well.  A task holds one block and one group of queries;
what it gives back is ``top`` rows for each query.  Pivots are at most ``pivots`` vectors, unlike each other, out of
``16 * pivots`` rows chosen by hash, the only thing that is collected; every row is indexed.

Defined cases: vectors that are null, zero, of another length than most, or that hold null or non-finite numbers take no part, nor do rows
without id; rows with the query's id are never its neighbours; a repeated id counts once, with its best score;
ties go to the smaller id; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def usable(vectors: DataFrame, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id long, v array<double>: the rows that take part."""
    d = vectors.select(F.col(id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    d = d.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & F.forall("v", fine) & F.exists("v", lambda x: x != 0))
    widths = d.groupBy(F.size("v").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).first()
    return d.where(F.size("v") == F.lit(widths["width"] if widths else 0))


def _order(x: np.ndarray, pivots: np.ndarray, depth: int) -> np.ndarray:
    """Places (rows, pivots) counted down from ``depth`` for the nearest pivot to 1; 0 beyond."""
    s = x @ pivots.T
    near = np.argsort(-s, axis=1, kind="stable")[:, :depth]
    out = np.zeros(s.shape, dtype=np.int16)
    np.put_along_axis(out, near, np.arange(depth, 0, -1, dtype=np.int16)[None, : near.shape[1]], axis=1)
    return out


def spread(sample: np.ndarray, pivots: int, alike: float = 0.7) -> np.ndarray:
    """Up to ``pivots`` rows of the sample, in order, none with a cosine over ``alike`` to one before it.

    A dense group, however many rows of the sample it has, gives few pivots, so permutations stay telling elsewhere.  If
    too few rows are that different, the next ones fill up.
    """
    if not len(sample):
        return sample
    unit = sample / np.linalg.norm(sample, axis=1, keepdims=True)
    chosen, closest = [0], unit @ unit[0]
    for i in range(1, len(sample)):
        if len(chosen) < pivots and closest[i] <= alike:
            chosen.append(i)
            closest = np.maximum(closest, unit @ unit[i])
    rest = np.setdiff1d(np.arange(len(sample)), chosen)[: max(0, pivots - len(chosen))]
    return sample[np.r_[chosen, rest].astype(int)]


def search_block(ids: np.ndarray, x: np.ndarray, q_ids: np.ndarray, q: np.ndarray, pivots: np.ndarray, depth: int, rerank: float, least: int, top: int):
    """(query position, id, score) of the best ``top`` that the index of this block finds for each query.

    Equal vectors are posted once, with their ids in order; as ties go to smaller ids, ``top + 1`` ids of each suffice.
    """
    if len(pivots) < 2:
        pivots = np.eye(x.shape[1])
    x, own = np.unique(x, axis=0, return_inverse=True)
    order = np.lexsort((ids, own.ravel()))
    names, starts = ids[order], np.searchsorted(own.ravel()[order], np.arange(len(x) + 1))
    places, q_places = _order(x, pivots, depth), _order(q, pivots, depth)
    posted = [(np.flatnonzero(c), c[c > 0]) for c in places.T]
    keep = min(len(x), max(least, int(np.ceil(rerank * len(x)))))
    out_q, out_id, out_s = [], [], []
    for i in range(len(q_ids)):
        near = np.zeros(len(x), dtype=np.int32)
        for p in np.flatnonzero(q_places[i]):
            rows, place = posted[p]
            near[rows] += np.minimum(place, q_places[i, p])
        found = np.argpartition(-near, keep - 1)[:keep] if keep < len(x) else np.arange(len(x))
        s = (x[found] * q[i]).sum(axis=1)
        if len(found) > top + 1:
            floor = np.partition(s, len(s) - top - 1)[len(s) - top - 1]
            found, s = found[s >= floor], s[s >= floor]
        best: dict[int, float] = {}
        for f, score in zip(found.tolist(), s.tolist()):
            for name in _first(names[starts[f] : starts[f + 1]], top + 1):
                best[name] = max(score, best.get(name, score))
        best.pop(int(q_ids[i]), None)
        for name, score in sorted(best.items(), key=lambda b: (-b[1], b[0]))[:top]:
            out_q.append(i)
            out_id.append(name)
            out_s.append(score)
    return out_q, out_id, out_s


def _first(names: np.ndarray, n: int) -> list[int]:
    """The first ``n`` distinct ids of a sorted run."""
    return names[np.append(True, names[1:] != names[:-1])][:n].tolist()


def neighbours(vectors: DataFrame, queries: DataFrame, top: int = 20, pivots: int = 256, depth: int = 64, rerank: float = 0.12, least: int = 512, block: int = 8192) -> DataFrame:
    """query_id, rank, vec_id, score of the best ``top`` found for each row of ``queries``; both as ``usable`` gives them."""
    spark = vectors.sparkSession
    n, m = vectors.count(), queries.count()
    chosen = vectors.orderBy(F.xxhash64("vec_id", F.lit(7)), "vec_id").limit(16 * pivots).select("v").collect()
    distinct = list(dict.fromkeys(tuple(r["v"]) for r in chosen))
    centres = spread(np.array(distinct, dtype=float), pivots)
    shared = spark.sparkContext.broadcast(centres)
    n_blocks, m_blocks = max(1, -(-n // block)), max(1, -(-m // block))
    cell = lambda own, other: (F.pmod(F.xxhash64("vec_id"), F.lit(own)), F.explode(F.sequence(F.lit(0), F.lit(other - 1))))
    a = vectors.select("vec_id", "v", F.lit(False).alias("is_query"), cell(n_blocks, m_blocks)[0].alias("o"), cell(n_blocks, m_blocks)[1].alias("q"))
    b = queries.select("vec_id", "v", F.lit(True).alias("is_query"), cell(m_blocks, n_blocks)[0].alias("q"), cell(m_blocks, n_blocks)[1].alias("o"))
    both = a.unionByName(b).select("vec_id", "v", "is_query", (F.col("o") * m_blocks + F.col("q")).cast("long").alias("cell"))
    parts = n_blocks * m_blocks
    both = both.repartition(min(parts, 20_000), "cell").sortWithinPartitions("cell", "is_query", "vec_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in by_key(batches, 3):
            asked = rows.column(2).to_numpy(zero_copy_only=False).astype(bool)
            ids = rows.column(0).to_numpy()
            x = rows.column(1).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
            if not asked.any() or asked.all():
                continue
            q_ids = ids[asked]
            q, i, s = search_block(ids[~asked], x[~asked], q_ids, x[asked], shared.value, depth, rerank, least, top)
            yield pa.RecordBatch.from_arrays([pa.array(q_ids[q] if q else [], pa.int64()), pa.array(i, pa.int64()), pa.array(s, pa.float64())], ["query_id", "vec_id", "score"])

    found = both.mapInArrow(run, "query_id long, vec_id long, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")


def by_key(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[int, pa.Table]]:
    """(key, rows) of each run of equal keys in batches that are sorted by the long in ``column``."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not len(batch):
            continue
        key = batch[column].to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(key)) + 1).tolist(), len(key)]
        for a, b in zip(cuts, cuts[1:]):
            part = batch.slice(a, b - a)
            if held and held[0][column][0].as_py() != int(key[a]):
                yield held[0][column][0].as_py(), pa.Table.from_batches(held)
                held = []
            held.append(part)
    if held:
        yield held[0][column][0].as_py(), pa.Table.from_batches(held)
