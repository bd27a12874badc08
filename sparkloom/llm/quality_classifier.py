"""Quality classifier: histogram gradient-boosted trees over statistics of whole texts.

Statistics come from the text alone, by byte histograms and sets over Arrow batches, and are scored in the same pass with
the flat arrays of ``gbt.Forest``.  The model is fitted on the driver on at most ``sample`` labelled rows that are not
held out (first by a hash of their id), which bounds what is collected and broadcast; everything else sees all rows.

Defined cases: null and empty texts get the score of an empty text; null labels and labels of unknown documents are not
learnt from; without labels, or with one class, the score is a constant; repeated rows are scored each; a null doc_id is
held out by nobody (its remainder is unknown, so ``held_out`` is false); extra columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import gbt

NAMES = [
    "log_bytes", "log_words", "word_bytes", "space", "upper", "lower", "digit", "high", "stop", "comma", "exclaim", "pipe",
    "symbol", "other", "log_lines", "line_words", "distinct_words", "distinct_lines", "short_words", "top_byte", "entropy",
    "ends_well", "starts_upper", "longest_line",
]
_SYMBOLS = np.frombuffer(b"#*$%&<>~^=_+@\\", dtype=np.uint8)


def statistics(text: str) -> list[float]:
    """One row of ``NAMES``; shares are of the text's bytes, words or lines."""
    raw = text.encode("utf-8", "surrogatepass")
    n = len(raw)
    if n == 0:
        return [0.0] * len(NAMES)
    h = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    w, k = max(len(words), 1), max(len(lines), 1)
    space = int(h[32] + h[9:14].sum())
    upper, lower, digit, high = int(h[65:91].sum()), int(h[97:123].sum()), int(h[48:58].sum()), int(h[128:].sum())
    symbol = int(h[_SYMBOLS].sum())
    stop, comma, exclaim, pipe = int(h[46]), int(h[44]), int(h[33] + h[63]), int(h[124])
    p = h[h > 0] / n
    return [
        math.log1p(n), math.log1p(len(words)), (n - space) / w, space / n, upper / n, lower / n, digit / n, high / n,
        stop / w, comma / w, exclaim / w, pipe / w, symbol / n,
        (n - space - upper - lower - digit - high - symbol - stop - comma - exclaim - pipe) / n,
        math.log1p(len(lines)), w / k, len(set(words)) / w, len(set(lines)) / k, sum(len(x) < 4 for x in words) / w,
        float(p.max()), float(-(p * np.log(p)).sum()), sum(x[-1:] in b".!?:" for x in lines) / k,
        sum(x[:1].isupper() for x in words) / w, max((len(x) for x in lines), default=0) / n,
    ]


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = 20_000, **fit) -> gbt.Forest:
    """Fit on at most ``sample`` rows of ``labels`` (doc_id and ``label``) that are not held out."""
    known = labels.select(F.col("doc_id").alias("l_doc"), F.col(label).cast("double").alias("y"))
    known = known.where(F.col("l_doc").isNotNull() & F.col("y").isNotNull() & ~held_out(F.col("l_doc")))
    known = known.orderBy(F.xxhash64("l_doc"), "l_doc", "y").limit(sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(known), F.col("doc_id") == F.col("l_doc")).select("doc_id", "y", "text")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [statistics(t or "") for t in batch[2].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch[0].cast(pa.int64()), batch[1], pa.array(x, pa.list_(pa.float64()))], ["doc_id", "y", "x"])

    got = sorted((r["doc_id"], r["y"], *r["x"]) for r in rows.mapInArrow(features, "doc_id long, y double, x array<double>").collect())
    data = np.array(got, dtype=float).reshape(len(got), 2 + len(NAMES))
    return gbt.fit(data[:, 2:], (data[:, 1] > 0).astype(float), **fit)


def score(docs: DataFrame, forest: gbt.Forest, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    model = docs.sparkSession.sparkContext.broadcast(forest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([statistics(t or "") for t in batch[2].to_pylist()], dtype=float).reshape(len(batch), len(NAMES))
            s = model.value.score(x)
            columns = [batch[0], batch[1], pa.array(s), pa.array((s >= threshold).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "score", "predicted"])

    d = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    kind = dict(docs.dtypes)["doc_id"]
    return d.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **options) -> DataFrame:
    return score(docs, train(docs, labels, **options), threshold)
