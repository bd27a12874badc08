"""Packing by power-of-two decomposition.

A document of n tokens, its end token included, is cut into pieces whose lengths are powers of two of at most
``longest``: as many of ``longest`` as fit, then the binary digits of the rest, largest first.  Pieces of one length
belong in one bucket; every piece is a sequence of its own, so no sequence crosses documents and none needs padding.

Narrow: a scan, one Arrow operator, no shuffle; a task holds one batch.  Sequence ids are the task's number and the
row's place in it, which a task that runs again repeats.

Defined cases: a null text is empty and gives its end token alone; repeated rows are packed each; a null doc_id stays
null; an empty table gives no piece; extra columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import default_path, encoder

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def cuts(n: int, longest: int = 2048) -> list[int]:
    """Lengths, in order, of the pieces of ``n`` tokens."""
    return [longest] * (n // longest) + [1 << b for b in range(longest.bit_length() - 1, -1, -1) if n % longest >> b & 1]


def pieces(docs: DataFrame, path: str | None = None, end: int = 1, longest: int = 2048, with_ids: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens of each piece; ``with_ids`` adds the ids as an array."""
    path = path or default_path()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, last = encoder(path), np.array([end], dtype="<u4").tobytes()
        for batch in batches:
            for at in range(0, len(batch), 512):
                part = batch.slice(at, 512)
                docs, starts, lengths, sums, totals, ids = [], [], [], [], [], []
                for doc, raw in zip(part[0].to_pylist(), words.encode([t or "" for t in part[1].to_pylist()])):
                    raw += last
                    start, n = 0, len(raw) // 4
                    for length in cuts(n, longest):
                        piece = raw[4 * start : 4 * (start + length)]
                        docs.append(doc)
                        starts.append(start)
                        lengths.append(length)
                        sums.append(zlib.crc32(piece))
                        totals.append(n)
                        if with_ids:
                            ids.append(np.frombuffer(piece, dtype="<u4").astype(np.int32))
                        start += length
                columns = [pa.array(x, pa.int64()) for x in (docs, starts, lengths, sums, totals)]
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
                if with_ids:
                    columns.append(pa.array(ids, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)
        words.rest()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, PIECES + ", ids array<int>" * with_ids)


def pack(docs: DataFrame, **options) -> DataFrame:
    """The pieces with sequence_id and offset: each piece fills a sequence of its own length."""
    return pieces(docs, **options).withColumn("sequence_id", F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))


def write_buckets(docs: DataFrame, folder: str, **options) -> None:
    """Write the pieces with their ids as Parquet, one folder for each length."""
    pack(docs, with_ids=True, **options).withColumn("bucket", F.col("length")).write.partitionBy("bucket").parquet(folder)
