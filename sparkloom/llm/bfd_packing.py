"""Token ids as packed matrices, by best-fit-decreasing packing with a segment tree over free capacities.

Documents longer than a row are cut losslessly into row-long pieces and a rest.  The pieces of a window of documents are
placed longest first, each into the fullest open row that still holds it; a segment tree over capacities finds that row
in log(row length) steps.  A row is a packed id vector of fixed width, the cumulative lengths of its segments and
position ids that start again at each segment.

Narrow: every task packs windows of ``window`` documents, so memory is bounded by a window and no row waits for a
shuffle.  Only the last rows of a window are padded noticeably.

Defined cases: as in ``packing``: null texts give the end token alone, repeated rows are packed each, null ids stay.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import default_path, encoder


class Capacities:
    """Segment tree over free capacities 0..width: which hold an open row."""

    def __init__(self, width: int) -> None:
        self.leaves = 1 << width.bit_length()
        self.open: list[int] = [0] * (2 * self.leaves)
        self.rows: list[list[int]] = [[] for _ in range(width + 1)]

    def _count(self, capacity: int, by: int) -> None:
        at = capacity + self.leaves
        while at:
            self.open[at] += by
            at >>= 1

    def add(self, capacity: int, row: int) -> None:
        self.rows[capacity].append(row)
        self._count(capacity, 1)

    def take(self, least: int) -> tuple[int, int] | None:
        """Remove and return (capacity, row) of the smallest capacity of at least ``least``."""
        at = least + self.leaves
        if not self.open[at]:
            while at > 1 and (at & 1 or not self.open[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.leaves:
                at = 2 * at if self.open[2 * at] else 2 * at + 1
        capacity = at - self.leaves
        row = self.rows[capacity].pop()
        self._count(capacity, -1)
        return capacity, row


def best_fit_decreasing(lengths: list[int], width: int) -> tuple[list[int], list[int], int]:
    """Row and offset of each length (each 1..width), and the number of rows."""
    row, offset, rows, free = [0] * len(lengths), [0] * len(lengths), 0, Capacities(width)
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        found = free.take(lengths[i])
        capacity, at = found or (width, rows)
        rows += found is None
        row[i], offset[i] = at, width - capacity
        if capacity > lengths[i]:
            free.add(capacity - lengths[i], at)
    return row, offset, rows


def _windows(batches: Iterator[pa.RecordBatch], words, last: bytes, width: int, window: int):
    """(pieces, rows) of each window; a piece is (doc, start, ids, doc tokens, row, offset)."""
    pieces: list[tuple] = []
    docs = 0

    def placed():
        row, offset, rows = best_fit_decreasing([len(p[2]) // 4 for p in pieces], width)
        return [(*p, r, o) for p, r, o in zip(pieces, row, offset)], rows

    for batch in batches:
        for at in range(0, len(batch), 512):
            part = batch.slice(at, 512)
            for doc, raw in zip(part[0].to_pylist(), words.encode([t or "" for t in part[1].to_pylist()])):
                raw += last
                pieces += [(doc, s // 4, raw[s : s + 4 * width], len(raw) // 4) for s in range(0, len(raw), 4 * width)]
            docs += len(part)
            if docs >= window:
                yield placed()
                pieces, docs = [], 0
    words.rest()
    if pieces:
        yield placed()


def pack(docs: DataFrame, path: str | None = None, end: int = 1, width: int = 2048, window: int = 8192) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of each piece."""
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = 0
        for pieces, rows in _windows(batches, encoder(path), np.array([end], dtype="<u4").tobytes(), width, window):
            doc, start, raw, tokens, row, offset = zip(*pieces)
            columns = (doc, start, [len(x) // 4 for x in raw], [zlib.crc32(x) for x in raw], tokens, [before + r for r in row], offset)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], NAMES)
            before += rows

    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, ", ".join(f"{n} long" for n in NAMES))
    return out.withColumn("sequence_id", F.spark_partition_id().cast("long") * F.lit(1 << 33) + F.col("sequence_id"))


NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def matrices(docs: DataFrame, path: str | None = None, end: int = 1, width: int = 2048, window: int = 8192, pad: int = 0) -> DataFrame:
    """One row a sequence: sequence_id, ids and positions (little-endian unsigned 32-bit, ``width`` each), cu_seqlens,
    and of each segment its doc_ids, starts (its place in the document) and doc_tokens."""
    path = path or default_path()
    binary = lambda x: pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(np.arange(len(x) + 1, dtype=np.int32) * (4 * width)), pa.py_buffer(x)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, count = 0, np.arange(width, dtype="<u4")
        for pieces, rows in _windows(batches, encoder(path), np.array([end], dtype="<u4").tobytes(), width, window):
            pieces.sort(key=lambda p: (p[4], p[5]))
            at = 0
            for first in range(0, rows, 256):
                n = min(256, rows - first)
                ids, positions = np.full((n, width), pad, dtype="<u4"), np.zeros((n, width), dtype="<u4")
                bounds: list[list[int]] = [[0] for _ in range(n)]
                owners: list[list[int | None]] = [[] for _ in range(n)]
                starts: list[list[int]] = [[] for _ in range(n)]
                totals: list[list[int]] = [[] for _ in range(n)]
                while at < len(pieces) and pieces[at][4] < first + n:
                    doc, start, raw, tokens, row, offset = pieces[at]
                    length, row = len(raw) // 4, row - first
                    ids[row, offset : offset + length] = np.frombuffer(raw, dtype="<u4")
                    positions[row, offset : offset + length] = count[:length]
                    bounds[row].append(offset + length)
                    owners[row].append(doc)
                    starts[row].append(start)
                    totals[row].append(tokens)
                    at += 1
                columns = [pa.array(range(before + first, before + first + n), pa.int64()), binary(ids), binary(positions), pa.array(bounds, pa.list_(pa.int32()))]
                columns += [pa.array(x, pa.list_(pa.int64())) for x in (owners, starts, totals)]
                yield pa.RecordBatch.from_arrays(columns, ["sequence_id", "ids", "positions", "cu_seqlens", "doc_ids", "starts", "doc_tokens"])
            before += rows

    schema = "sequence_id long, ids binary, positions binary, cu_seqlens array<int>, doc_ids array<long>, starts array<long>, doc_tokens array<long>"
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)
    return out.withColumn("sequence_id", F.spark_partition_id().cast("long") * F.lit(1 << 33) + F.col("sequence_id"))


def write(docs: DataFrame, folder: str, **options) -> None:
    """Write the packed matrices as Parquet."""
    matrices(docs, **options).write.parquet(folder)
