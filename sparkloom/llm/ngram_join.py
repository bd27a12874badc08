"""N-gram Jaccard join: classes of documents linked by a similarity of word shingle sets, exact.

1. Documents with equal shingle sets are one node (128-bit fingerprint of the set).
2. A pair at or above the threshold shares one of the first ``n - ceil(t * n) + 1`` shingles of either set in any common
   order, and that one is among the first ``n - ceil(2 t / (1 + t) * n) + 1`` of the smaller set.  The order puts rare shingles first, by a sketch of fixed size that counts all documents' shingles, so that
   passages in many documents hardly ever stand among those first ones.  Nodes that share one of them are compared.
3. Nodes to compare are ordered by set size and cut into tiles of ``tile`` nodes; a cell is a pair of tiles.  Within a
   cell, sizes bound the band of partners, and hashed parity bitmaps bound the overlap from above by their bit counts.
   Pairs within the bound connect nodes to blocks.
4. Blocks are cut into tiles and cells in the same way, and within a cell the pairs within the bound are settled by
   intersecting the sorted arrays of their shingles.  Pairs that are already connected need no look.
5. A cell gives back the edges of a forest, fewer than its nodes; components come from alternating large and small stars.

A group of near copies, however large, is settled tile by tile and then by one node of each component; only nodes outside
the largest component of a group meet its other tiles, so what is copied grows with the square of a group only as far as
its members share rare shingles without being alike.  No links or components reach the
driver; what is collected and broadcast is the sketch, ``2**SKETCH`` bytes.  The members of blocks are joined with the
texts by broadcast only if a count shows at most ``small`` of them, and by shuffling otherwise.  Lineage is cut in the
shared folder.

Defined cases: null texts and texts without words have no shingle and are linked with nothing; a null doc_id is linked
with nothing and has a null component; repeated rows are one node; an empty table gives an empty result; extra columns
are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import memo
from .ann import by_key
from .store import keep

SKETCH = 20
CHUNK = 16384
REMEMBERED = 250_000
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


class _Hashes(dict):
    """The hash of each word, remembered up to a bound."""

    def __missing__(self, word: bytes) -> bytes:
        if len(self) > REMEMBERED:
            self.clear()
        h = self[word] = xxhash.xxh64_digest(word)
        return h


_WORDS = _Hashes()
memo.register("words", _WORDS.clear)


def _hashed(texts: list[str | None], words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all shingles of all texts in order, and where those of each text begin and end."""
    parts, lengths = [], []
    for text in texts:
        ws = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
        lengths.append(len(ws))
        parts.append(b"".join(map(_WORDS.__getitem__, ws)))
    h = np.frombuffer(b"".join(parts), dtype=np.uint64)
    n = np.array(lengths, dtype=np.int64)
    starts = np.cumsum(n) - n
    x = h.copy()
    for i in range(1, words):
        x[: len(h) - i] = x[: len(h) - i] * np.uint64(0x9E3779B97F4A7C15) + h[i:]
    for t in np.flatnonzero((n > 0) & (n < words)):
        value = int(n[t])
        for word in h[starts[t] : starts[t] + n[t]].tolist():
            value = (value * 0x9E3779B97F4A7C15 + word + 1) % 2**64
        x[starts[t]] = value
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x, starts, starts + np.where(n > 0, np.maximum(n - words + 1, 1), 0)


def shingles(texts: list[str | None], words: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of the shingles of each text."""
    x, starts, ends = _hashed(texts, words)
    return [np.unique(x[a:b]) for a, b in zip(starts.tolist(), ends.tolist())]


def _packed(counts: np.ndarray) -> bytes:
    """Small counts in few bytes: byte planes, compressed."""
    return zlib.compress(counts.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def _unpacked(packed: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(packed), dtype=np.uint8).reshape(4, -1)
    return planes.T.copy().view("<u4")[:, 0].astype(np.int64)


def _sketch(docs: DataFrame, words: int) -> np.ndarray:
    """For each bin of shingles, how often they occur, as a step of half a power of two."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << SKETCH, dtype=np.int64)
        memo.use("words")
        for batch in batches:
            for at in range(0, len(batch), 2048):
                x, starts, ends = _hashed(batch[0].slice(at, 2048).to_pylist(), words)
                edge = np.zeros(len(x) + 1, dtype=np.int64)
                np.add.at(edge, starts, 1)
                np.add.at(edge, ends, -1)
                total += np.bincount((x[np.cumsum(edge[:-1]) > 0] >> np.uint64(64 - SKETCH)).astype(np.int64), minlength=1 << SKETCH)
        if total.any():
            parts = total.reshape(-1, CHUNK)
            yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array([_packed(p) for p in parts], pa.binary())], ["chunk", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, counts in zip(batch[0].to_pylist(), batch[1].to_pylist()):
                sums[chunk] = sums.get(chunk, 0) + _unpacked(counts)
        if sums:
            steps = [np.floor(2 * np.log2(np.maximum(x, 1))).astype(np.uint8).tobytes() for x in sums.values()]
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(steps, pa.binary())], ["chunk", "counts"])

    schema = "chunk int, counts binary"
    rows = docs.select("text").mapInArrow(count, schema).repartition("chunk").mapInArrow(add, schema).collect()
    steps = np.zeros(1 << SKETCH, dtype=np.uint8)
    for r in rows:
        steps[r["chunk"] * CHUNK : (r["chunk"] + 1) * CHUNK] = np.frombuffer(bytes(r["counts"]), dtype=np.uint8)
    return steps


def bitmap(s: np.ndarray, bits: int) -> np.ndarray:
    """Parities of the numbers of elements in each of ``width`` bins, a power of two of at least ``bits`` for each element.

    Unrelated sets differ in about half the bins, so one bit an element tells them apart at any threshold over 0.64; more
    bits bound the overlap of similar sets more closely.
    """
    width = 1 << max(6, int(bits * len(s) - 1).bit_length())
    odd = np.bincount((s & np.uint64(width - 1)).astype(np.int64), minlength=width).astype(np.uint8) & 1
    return np.packbits(odd).view(np.uint64)


def _digests(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """doc_id, n, fp, first (the shingles that must be shared), map of each row."""
    steps = docs.sparkSession.sparkContext.broadcast(_sketch(docs, words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo.use("words")
        for batch in batches:
            for at in range(0, len(batch), 512):
                part = batch.slice(at, 512)
                sizes, prints, firsts, maps = [], [], [], []
                for s in shingles(part[1].to_pylist(), words):
                    n = len(s)
                    sizes.append(n)
                    prints.append(xxhash.xxh128_digest(s.tobytes()) if n else None)
                    maps.append(bitmap(s, 1).tobytes() if n else None)
                    ranked = (steps.value[(s >> np.uint64(64 - SKETCH)).astype(np.int64)].astype(np.uint64) << np.uint64(57)) | (s >> np.uint64(7))
                    k = n - (percent * n + 99) // 100 + 1
                    firsts.append(np.sort(np.partition(ranked, k - 1)[:k]).view(np.int64) if n else None)
                columns = [part[0], pa.array(sizes, pa.int64()), pa.array(prints, pa.binary()), pa.array(firsts, pa.list_(pa.int64())), pa.array(maps, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "fp", "first", "map"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n long, fp binary, first array<long>, map binary")


def components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node it reaches) of every node of the edges (a, b)."""

    def tidy(e: DataFrame) -> DataFrame:
        return keep(e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct())

    def large(e: DataFrame) -> DataFrame:
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select("b", "a"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("m", "u").alias("m"))
        return both.join(least, F.col("u") == F.col("w")).where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))

    def small(e: DataFrame) -> DataFrame:
        least = e.groupBy(F.col("a").alias("w")).agg(F.min("b").alias("m"))
        moved = e.join(least, F.col("a") == F.col("w")).where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        return moved.union(least.select("w", "m"))

    mark = lambda e: tuple(e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())
    e = tidy(edges)
    before, now = None, mark(e)
    while now[0] and before != now:
        e = tidy(small(tidy(large(e))))
        before, now = now, mark(e)
    roots = e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)


class _Forest:
    """Union by the smaller name, over names as they come."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def find(self, i: int) -> int:
        parent = self.parent
        p = parent.setdefault(i, i)
        while p != i:
            parent[i] = parent[p]
            i = parent[i]
            p = parent[i]
        return i

    def unite(self, x: int, y: int) -> None:
        self.parent[max(x, y)] = min(x, y)


def _folded(maps: list[np.ndarray]) -> np.ndarray:
    """The bitmaps in the width of the narrowest: halves of a parity bitmap fold by exclusive or."""
    width = min(map(len, maps))
    out = np.empty((len(maps), width), dtype=np.uint64)
    for i, m in enumerate(maps):
        out[i] = m if len(m) == width else np.bitwise_xor.reduce(m.reshape(-1, width), axis=0)
    return out


def pairs_in_cell(n: np.ndarray, maps: list[np.ndarray], tiles: np.ndarray, early: np.ndarray, percent: int) -> Iterator[tuple[int, int]]:
    """Positions of the pairs of a cell, ordered by size, whose sizes and bit counts let them reach the threshold.

    The smaller one of a pair must be ``early``.
    """
    two = bool((tiles != tiles[0]).any())
    ends = np.searchsorted(n, 100 * n // percent, side="right")
    start = 0
    while start < len(n):
        # A band: rows that share one bitmap width, with all their partners.
        stop = int(np.searchsorted(n, 2 * n[start], side="right"))
        reach = int(ends[stop - 1])
        m = _folded(maps[start:reach])
        for i in range(start, stop):
            a, b = i + 1, int(ends[i])
            if a >= b or not early[i]:
                continue
            apart = np.bitwise_count(m[a - start : b - start] ^ m[i - start]).sum(axis=1, dtype=np.int64)
            both = n[a:b] + n[i]
            fits = (100 + percent) * (both - apart) >= 2 * percent * both
            if two:
                fits &= tiles[a:b] != tiles[i]
            for j in np.flatnonzero(fits).tolist():
                yield i, a + j
        start = stop


def _placed(rows: DataFrame, key: str, tile: int) -> DataFrame:
    """``rows`` (with ``key``, n, node) with at, the number of their tile in their group, and of, the size of the group; lone rows go."""
    by_size = W.partitionBy(key).orderBy("n", "node")
    d = rows.withColumn("of", F.count(F.lit(1)).over(W.partitionBy(key))).where("of > 1")
    return d.withColumn("at", F.floor((F.row_number().over(by_size) - 1) / tile))


def _pairs_of_tiles(placed: DataFrame, key: str, tile: int) -> DataFrame:
    """Each row with cell, once for each pair of tiles that it belongs to."""
    d = placed.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("of") / tile) - 1)))
    return d.withColumn("cell", F.xxhash64(key, F.least("at", "other"), F.greatest("at", "other"))).drop("other")


def _connect(placed: DataFrame, key: str, tile: int, edges, several: bool) -> DataFrame:
    """Edges (a, b) that connect all pairs of each group that ``edges`` accepts, from cells of at most two tiles.

    ``placed`` has ``key``, n, node, early, at and of; ``edges`` turns such rows with cell and name into edges.  Tiles are
    settled first.  Where a group has ``several``, one node of each of its components is compared next, so a large group of near copies
    becomes one component without any pair of tiles.  Then only nodes outside the largest component of their group visit
    the other tiles; what is copied grows with the nodes that are not alike, not with the square of the group.
    """
    placed = placed.withColumn("name", F.col("node"))
    first = edges(placed.withColumn("cell", F.xxhash64(key, "at")))
    if not several:
        return first
    large = keep(placed.where(F.col("of") > tile))
    named = lambda d, links: d.drop("name").join(components(links).select(F.col("node").alias("member"), F.col("root").alias("least")), F.col("node") == F.col("member"), "left").withColumn("name", F.coalesce("least", "node")).drop("member", "least")
    first = keep(first)
    large = keep(named(large, first))
    extra = [c for c in large.columns if c not in (key, "name", "of", "at")]
    some = large.groupBy(key, "name").agg(F.min_by(F.struct(*extra), "node").alias("one")).select(key, "one.*", "name")
    second = keep(edges(_pairs_of_tiles(_placed(some, key, tile), key, tile)))
    large = keep(named(large, first.unionByName(second)))
    sizes = large.groupBy(F.col(key).alias("group"), "name").agg(F.count(F.lit(1)).alias("size"))
    homes = sizes.groupBy("group").agg(F.max_by("name", F.struct("size", "name")).alias("home"), F.count(F.lit(1)).alias("parts")).where("parts > 1")
    d = large.join(homes, F.col(key) == F.col("group")).drop("group", "parts")
    visitors = d.where("name != home").withColumn("turn", F.floor((F.row_number().over(W.partitionBy(key).orderBy("n", "node")) - 1) / tile))
    turns = visitors.groupBy(F.col(key).alias("group")).agg((F.max("turn") + 1).alias("turns"))
    tiles = F.ceil(F.col("of") / tile)
    visits = visitors.withColumn("target", F.explode(F.sequence(F.lit(0).cast("long"), tiles - 1))).where("target != at").withColumn("at", F.lit(-1).cast("long"))
    staying = d.join(turns, F.col(key) == F.col("group")).drop("group").withColumn("target", F.col("at"))
    staying = staying.withColumn("turn", F.explode(F.sequence(F.lit(0).cast("long"), F.col("turns") - 1))).drop("turns")
    cells = visits.select(*staying.columns).unionByName(staying).withColumn("cell", F.xxhash64(key, "target", "turn")).drop("home", "target", "turn")
    return first.unionByName(second).unionByName(edges(cells))


def _edges(cells: DataFrame, key: str, settle, percent: int) -> DataFrame:
    """Edges (a, b) of forests of the pairs in the cells that ``settle`` accepts.

    ``cells`` has cell, ``key``, n, node, at, early, name (of what a node is known to belong to) and a binary payload, a bitmap
    or, with ``settle``, a set.  Where a cell has rows of several tiles, only pairs of different tiles count.
    """
    cells = cells.select("cell", key, "n", "node", "at", "payload", "early", "name").repartition("cell").sortWithinPartitions("cell", key, "n", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, a, b = _Forest(), [], []
        for _, rows in by_key(batches, 0):
            group, sizes, nodes, ats = (rows.column(i).to_numpy() for i in (1, 2, 3, 4))
            payload, early, known = rows.column(5), rows.column(6).to_numpy(zero_copy_only=False), rows.column(7).to_numpy()
            new = np.append(True, (nodes[1:] != nodes[:-1]) | (group[1:] != group[:-1]))
            cuts = [0, *(np.flatnonzero(group[1:] != group[:-1]) + 1).tolist(), len(group)]
            for first, last in zip(cuts, cuts[1:]):
                own = np.flatnonzero(new[first:last]) + first
                if len(own) < 2:
                    continue
                names = known[own].tolist()
                if len({forest.find(i) for i in names}) < 2:
                    continue
                sets = [np.frombuffer(payload[i].as_py(), dtype=np.uint64) for i in own.tolist()]
                maps = sets if settle is None else [bitmap(s, 4) for s in sets]
                for i, j in pairs_in_cell(sizes[own], maps, ats[own], early[own], percent):
                    x, y = forest.find(names[i]), forest.find(names[j])
                    if x != y and (settle is None or settle(sets[i], sets[j])):
                        forest.unite(x, y)
                        a.append(max(names[i], names[j]))
                        b.append(min(names[i], names[j]))
            if len(a) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
                a, b = [], []
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return cells.mapInArrow(run, "a long, b long")


def _links(docs: DataFrame, nodes: DataFrame, words: int, percent: int, tile: int, small: int) -> DataFrame:
    """Edges (a, b) that connect all linked nodes; ``nodes`` has node, fp, n, first, map."""
    shared = nodes.select("node", "n", F.posexplode("first").alias("place", "token"))
    least = F.floor((2 * percent * F.col("n") + (99 + percent)) / (100 + percent))
    shared = shared.select("node", "n", "token", (F.col("place") < F.col("n") - least + 1).alias("early"))
    order = W.partitionBy("token").orderBy("n", "node")
    smaller = F.max(F.when(F.col("early"), F.col("n"))).over(order.rowsBetween(W.unboundedPreceding, -1))
    partner = F.coalesce(100 * smaller >= percent * F.col("n"), F.lit(False)) | (F.col("early") & F.coalesce(percent * F.lead("n").over(order) <= 100 * F.col("n"), F.lit(False)))
    shared = shared.withColumn("partner", partner).where("partner").drop("partner")
    maps = nodes.select(F.col("node").alias("owner"), F.col("map").alias("payload"))
    shared = keep(_placed(shared, "token", tile))
    several = shared.where(F.col("of") > tile).limit(1).count() > 0
    blocks = components(_connect(shared, "token", tile, lambda cells: _edges(cells.join(maps, F.col("node") == F.col("owner")), "token", None, percent), several))
    members = nodes.select(F.col("node").alias("own"), "fp").join(blocks, F.col("own") == F.col("node")).select("node", "fp", "root")
    members = keep(members)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo.use("words")
        for batch in batches:
            for at in range(0, len(batch), 512):
                part = batch.slice(at, 512)
                sets = shingles(part[1].to_pylist(), words)
                right = [bool(len(s)) and xxhash.xxh128_digest(s.tobytes()) == f for s, f in zip(sets, part[2].to_pylist())]
                columns = [part[0], part[3], pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["node", "root", "n", "payload"]).filter(pa.array(right, pa.bool_()))

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    several = members.groupBy("root").count().where(F.col("count") > tile).limit(1).count() > 0
    members = F.broadcast(members) if members.count() <= small else members
    sets = texts.join(members, F.col("doc_id") == F.col("node")).select("node", "text", "fp", "root")
    sets = sets.mapInArrow(gather, "node long, root long, n long, payload binary")

    def settle(x: np.ndarray, y: np.ndarray) -> bool:
        common = len(np.intersect1d(x, y, assume_unique=True))
        return 100 * common >= percent * (len(x) + len(y) - common)

    sets = _placed(sets.withColumn("early", F.lit(True)), "root", tile)
    return _connect(sets, "root", tile, lambda cells: _edges(cells, "root", settle, percent), several)


def classes(docs: DataFrame, words: int = 4, percent: int = 85, tile: int = 2048, small: int = 100_000) -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    d = keep(_digests(docs, words, percent))
    nodes = d.where(F.col("fp").isNotNull() & F.col("doc_id").isNotNull()).groupBy("fp")
    nodes = keep(nodes.agg(F.min("doc_id").alias("node"), F.first("n").alias("n"), F.first("first").alias("first"), F.first("map").alias("map")))
    roots = components(_links(docs, nodes, words, percent, tile, small)).withColumnRenamed("node", "member")
    named = nodes.select("node", F.col("fp").alias("own")).join(roots, F.col("node") == F.col("member"), "left")
    named = named.select("own", F.coalesce("root", "node").alias("class"))
    out = d.select("doc_id", "n", "fp").join(named, F.col("fp") == F.col("own"), "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("class", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))


def distinct(docs: DataFrame, **options) -> DataFrame:
    """One document of each class, the one with the smallest id, in the columns of ``docs``; rows without id stay.

    Texts that share an id are documents of their own: beside the first of them, in the order of a hash, the others are
    known by a hash of id and text.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    d = docs.select(row.alias("row"), F.col("doc_id").cast("long").alias("id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("hash"), "text")
    shared = d.where("id is not null").groupBy("id").agg(F.min("hash").alias("least"), F.max("hash").alias("most")).where("least != most")
    shared = keep(shared.select(F.col("id").alias("shared"), "least"))
    if shared.limit(1).count():
        other = F.col("shared").isNotNull() & (F.col("hash") != F.col("least"))
        d = d.join(shared, F.col("id") == F.col("shared"), "left").select("row", F.when(other, F.xxhash64("id", "hash")).otherwise(F.col("id")).alias("id"), "text")
    first = classes(d.select(F.col("id").alias("doc_id"), "text"), **options).where("doc_id = component_id").select(F.col("doc_id").alias("first")).distinct()
    kept = d.join(first, F.col("id") == F.col("first")).dropDuplicates(["id"])
    return kept.select("row.*").unionByName(docs.where("doc_id is null"))
