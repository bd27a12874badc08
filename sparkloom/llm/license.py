"""Licence scans: exact base phrases, and fuzzy search for short notices.

A text becomes its words, lower case and one space apart.  Each notice may differ by some edits; it is split into one
piece more than edits, so by the pigeonhole principle every occurrence holds a piece exactly.  Places of pieces mark
windows, and only there the ``regex`` library's bounded-error matching verifies the notice and reports span and edits.

Defined cases: a null text is empty; repeated rows are scanned each; an empty table gives an empty result; extra columns
are not read.  Narrow: one Arrow operator, no shuffle; memory is a batch and one text.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: Base phrases and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Short notices and their labels; edits allowed are a share of the length.
NOTICES = {
    "licensed under the apache license version 2 0": "apache",
    "released under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "licensed under the gnu general public license version": "gpl",
    "this program is free software you can redistribute it and or modify": "gpl",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "redistribution and use in source and binary forms with or without": "bsd",
    "mozilla public license version": "mpl",
    "licensed under cc by nc 4 0": "cc-by-nc",
    "licensed under cc by sa 4 0": "cc-by-sa",
    "creative commons attribution": "cc-by",
    "permission to use copy modify and or distribute this software for any purpose": "isc",
    "released into the public domain": "public-domain",
}
EDITS_PER_CHARACTER = 1 / 14

_LOWER = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)


@cache
def _searches(share: float) -> list[tuple[bytes, str, int, object, list[tuple[bytes, int]]]]:
    """(notice, label, edits, pattern, (piece, place) ...) of each notice."""
    out = []
    for notice, label in NOTICES.items():
        raw = notice.encode()
        edits = max(1, int(len(raw) * share))
        ends = [len(raw) * i // (edits + 1) for i in range(edits + 2)]
        pieces = [(raw[a:b], a) for a, b in zip(ends, ends[1:])]
        pattern = regex.compile(b"(?b)(?<![^ ])(?:" + regex.escape(raw, special_only=False, literal_spaces=True) + b"){e<=%d}(?![^ ])" % edits)
        out.append((raw, label, edits, pattern, pieces))
    return out


def normal(text: str) -> bytes:
    """The words of a text, one space apart."""
    return b" ".join(text.encode("utf-8", "surrogatepass").translate(_LOWER).split())


def fuzzy(words: bytes, share: float = EDITS_PER_CHARACTER) -> list[tuple[int, int, str, int, int]]:
    """(first byte, end, label, edits, notice length) of the notices in normalised ``words``."""
    found = []
    for raw, label, edits, pattern, pieces in _searches(share):
        windows = []
        for piece, place in pieces:
            at = words.find(piece)
            while at >= 0:
                windows.append((max(0, at - place - edits), at - place + len(raw) + edits))
                at = words.find(piece, at + 1)
        windows.sort()
        merged: list[list[int]] = []
        for a, b in windows:
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(b, merged[-1][1])
            else:
                merged.append([a, b])
        for a, b in merged:
            found += [(m.start(), m.end(), label, sum(m.fuzzy_counts), len(raw)) for m in pattern.finditer(words, a, min(b, len(words)))]
    return sorted(found)


def word_numbers(words: bytes, places: list[int]) -> dict[int, int]:
    """The number of spaces before each byte, counted on from one place to the next."""
    out, at, n = {}, 0, 0
    for place in sorted(set(places)):
        n += words.count(b" ", at, place)
        at = place
        out[place] = n
    return out


def scan(text: str) -> dict:
    """All results of one text; spans are word numbers, end exclusive."""
    words = normal(text)
    padded = b" " + words + b" "
    places, labels = [], set()
    if b"license" in words:
        for phrase, label in BASE.items():
            needle = b" " + phrase.encode() + b" "
            at = padded.find(needle)
            while at >= 0:
                places.append(at)
                labels.add(label)
                at = padded.find(needle, at + 1)
    number = word_numbers(padded, places)
    places = [number[at] for at in places]
    matches = fuzzy(words)
    number = word_numbers(words, [x for m in matches for x in m[:2]])
    spans = [(number[a], number[b] + 1, label, edits, 1 - edits / n) for a, b, label, edits, n in matches]
    return {
        "n_words": words.count(b" ") + 1 if words else 0,
        "n_base": len(places),
        "first_word": min(places, default=None),
        "last_word": max(places, default=None),
        "base_labels": ",".join(sorted(labels)),
        "labels": ",".join(sorted(labels | {s[2] for s in spans})),
        "score": 1.0 if places else max((s[4] for s in spans), default=0.0),
        "spans": [{"first_word": a, "end_word": b, "label": x, "edits": e} for a, b, x, e, _ in spans],
    }


FIELDS = {"n_words": pa.int64(), "n_base": pa.int64(), "first_word": pa.int64(), "last_word": pa.int64(), "base_labels": pa.string(), "labels": pa.string(), "score": pa.float64()}
SPAN = pa.struct([("first_word", pa.int64()), ("end_word", pa.int64()), ("label", pa.string()), ("edits", pa.int64())])


def licenses(docs: DataFrame) -> DataFrame:
    """doc_id, the fields of ``scan``, and the verified spans of the notices."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [scan(t or "") for t in batch[1].to_pylist()]
            columns = [pa.array([r[k] for r in rows], kind) for k, kind in FIELDS.items()]
            yield pa.RecordBatch.from_arrays([batch[0], *columns, pa.array([r["spans"] for r in rows], pa.list_(SPAN))], ["doc_id", *FIELDS, "spans"])

    kind = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<first_word: long, end_word: long, label: string, edits: long>>"
    return docs.select("doc_id", "text").mapInArrow(run, schema)
