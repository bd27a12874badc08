"""Personal data: exact base spans, and candidate spans chosen by boosted trees, in DataFrame functions only.

Generators with high recall propose spans beyond the base formats: phone numbers without a plus sign, e-mail addresses
spelled with "at" and "dot", eight-group network addresses, grouped digit strings.  Each candidate has features of its
format and of the characters before it; small boosted trees, fitted on the driver on generated examples and written as
one SQL expression, score it, and a threshold chosen for precision on other generated examples selects.  A candidate
that overlaps a base span is dropped, and so is one that overlaps a chosen candidate with a higher score (earlier on ties).

Positions come from one split and one extraction by the same pattern: lengths of gaps and matches, summed in two levels.
All patterns are possessive, so they neither backtrack through long runs nor overflow the stack.  Narrow: no shuffle.

Defined cases: a null text is empty and has no span; repeated rows are scanned each; an empty table gives an empty
result; extra columns are not read.
"""

from __future__ import annotations

import re
from functools import cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import gbt
from .native import carried, let, restored

#: Kinds in order, and the base patterns in a form that never backtracks.
KINDS = ("email", "ip", "card", "phone")
LOCAL = "[A-Za-z0-9._%+-]"
EMAIL = rf"(?:\G|(?<!{LOCAL})){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
PART = "0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{0,2})(?![0-9])"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"

#: Candidate generators: kind and pattern.  Each is tried on its own, so their spans may overlap.
GENERATORS = (
    ("phone", r"(?<![0-9+.-])(?:\([0-9]{2,4}\)\x20?|[0-9]{2,4}[\x20.-])[0-9]{3,4}[\x20.-][0-9]{3,4}(?![0-9.-])"),
    ("email", r"(?<![A-Za-z0-9])[A-Za-z0-9][A-Za-z0-9._-]{0,63}\x20?(?:\(at\)|\[at\]|\x20at\x20)\x20?[A-Za-z0-9-]{1,63}\x20?(?:\(dot\)|\[dot\]|\x20dot\x20|\.)\x20?[a-z]{2,6}(?![A-Za-z0-9])"),
    ("ip", r"(?<![0-9A-Fa-f:])[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){7}(?![0-9A-Fa-f:])"),
    ("card", r"(?<![0-9.])[0-9]{4}(?:[./_][0-9]{4}){3}(?![0-9.])"),
)
HINTS = r"(?i)tel|phone|call|fax|mobil|contact|reach|mail|write|address|host|server|login|card|visa|credit|pay"
#: More candidates than one can overlap; see ``all_spans``.
NEAR = 64
FEATURES = ["kind", "n_chars", "n_digits", "n_seps", "brackets", "hint", "hex", "year"]


def _features(kind: int, text: str, before: str) -> list[float]:
    """What ``_feature_columns`` gives, for the generated examples."""
    return [
        float(kind),
        float(len(text)),
        float(len(re.sub(r"[^0-9]", "", text))),
        float(len(re.sub(r"[^ ./:_-]", "", text))),
        float(bool(re.search(r"[\[(]", text))),
        float(bool(re.search(HINTS[4:], before, re.I))),
        float(len(re.sub(r"[^A-Fa-f]", "", text))),
        float(bool(re.search(r"(?:19|20)[0-9]{2}", text))),
    ]


def _feature_columns(kind: int, text: Column, before: Column) -> list[Column]:
    gone = lambda rx: F.length(F.regexp_replace(text, rx, "")).cast("double")
    return [
        F.lit(float(kind)),
        F.length(text).cast("double"),
        gone("[^0-9]"),
        gone("[^ ./:_-]"),
        text.rlike(r"[\[(]").cast("double"),
        before.rlike(HINTS).cast("double"),
        gone("[^A-Fa-f]"),
        text.rlike("(?:19|20)[0-9]{2}").cast("double"),
    ]


def _examples(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Generated candidates with labels: real formats near a hint or in a telling form, against dates, versions, codes."""
    r = np.random.default_rng(seed)
    digits = lambda k: "".join(map(str, r.integers(0, 10, k)))
    word = lambda: "".join(r.choice(list("abcdefghiklmnoprstuv"), r.integers(3, 9)))
    hint = lambda p: str(r.choice(["call ", "tel: ", "phone ", "contact ", "mail: ", "card no ", "host "])) if r.random() < p else f"{word()} "
    x, y = [], []
    for _ in range(n):
        good, kind = r.random() < 0.5, int(r.integers(0, 4))
        sep = str(r.choice([" ", "-", "."]))
        if KINDS[kind] == "phone":
            text = (f"({digits(3)}) {digits(3)}-{digits(4)}" if r.random() < 0.5 else sep.join((digits(3), digits(3), digits(4)))) if good else str(r.choice([f"{r.integers(1900, 2100)}{sep}{digits(3)}{sep}{digits(3)}", f"{digits(2)}{sep}{digits(3)}{sep}{digits(3)}", f"{digits(4)}{sep}{digits(4)}{sep}{digits(4)}"]))
            before = hint(0.8 if good else 0.03)
        elif KINDS[kind] == "email":
            text = str(r.choice([f"{word()} (at) {word()} (dot) com", f"{word()}[at]{word()}.org", f"{word()} at {word()} dot net"])) if good else str(r.choice([f"{word()} at {word()}. the", f"{word()} at {word()}.in"]))
            before = hint(0.5 if good else 0.05)
        elif KINDS[kind] == "ip":
            text = ":".join("".join(r.choice(list("0123456789abcdef"), 4)) for _ in range(8)) if good else ":".join(digits(2) for _ in range(8))
            before = hint(0.3 if good else 0.05)
        else:
            text = str(r.choice([".", "/", "_"])).join(digits(4) for _ in range(4))
            before = hint(0.95 if good else 0.0)
        x.append(_features(kind, text, before))
        y.append(float(good))
    return np.array(x), np.array(y)


@cache
def model(precision: float = 0.98) -> tuple[gbt.Forest, float]:
    """The forest and the smallest margin at which other examples are right with at least ``precision``."""
    forest = gbt.fit(*_examples(4000, 11), trees=20, depth=3, rate=0.3, bins=32)
    x, y = _examples(2000, 12)
    m = forest.margin(x)
    order = np.argsort(-m, kind="stable")
    right = np.cumsum(y[order]) / np.arange(1, len(y) + 1)
    good = np.flatnonzero(right >= precision)
    return forest, float(max(m[order][good[-1]], 0.0)) if len(good) else float("inf")


def _running(values: Column, join=lambda a, b: a + b, block: int = 1024) -> Column:
    """``join`` (with 0 as its neutral element) of the elements ahead of each, in blocks, so copying grows with the number times ``block`` only."""
    zero = F.lit(0).cast("long")
    pair = F.struct(zero.alias("s"), F.array().cast("array<bigint>").alias("a"))

    def ahead(x: Column) -> Column:
        return F.aggregate(x, pair, lambda acc, n: F.struct(join(acc["s"], n).alias("s"), F.concat(acc["a"], F.array(acc["s"])).alias("a")), lambda acc: acc["a"])

    def total(x: Column) -> Column:
        return F.aggregate(x, zero, join)

    def of_blocks(parts: Column) -> Column:
        return let(ahead(F.transform(parts, total)), lambda at: F.flatten(F.transform(parts, lambda p, j: F.transform(ahead(p), lambda n: join(n, F.get(at, j))))))

    return let(_blocks(values, block), of_blocks)


def _further(a: Column, b: Column) -> Column:
    return F.greatest(a, b)


def _blocks(values: Column, block: int) -> Column:
    """Slices of ``block`` elements of an array that is not empty."""
    return F.transform(F.sequence(F.lit(0), ((F.size(values) - 1) / block).cast("int")), lambda b: F.slice(values, b * block + 1, block))


def _found(text: Column, pattern: str, gate: Column, pick) -> Column:
    """``pick(match, start, text before)`` of every match, where ``gate`` lets the pattern run at all.

    The text before is given from the third match ahead on, the whole one if there are fewer.
    """

    def behind(m: Column, g: Column, i: Column) -> Column:
        return F.concat_ws("", F.get(m, i - 3), F.get(g, i - 2), F.get(m, i - 2), F.get(g, i - 1), F.get(m, i - 1), F.get(g, i))

    def placed(m: Column) -> Column:
        return let(
            F.split(text, pattern, -1),
            lambda g: let(
                F.transform(m, lambda x, i: (F.length(x) + F.length(F.get(g, i))).cast("long")),
                lambda n: let(_running(n), lambda at: F.transform(m, lambda x, i: pick(x, F.get(at, i) + F.length(F.get(g, i)), behind(m, g, i)))),
            ),
        )

    none = F.array().cast("array<struct<start: bigint, kind: int, end: bigint, score: double>>")
    matched = let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: F.when(F.size(m) == 0, none).otherwise(F.filter(placed(m), lambda s: s.isNotNull())))
    return F.when(gate, matched).otherwise(none)


def _span(kind: str, x: Column, at: Column, score: Column) -> Column:
    return F.struct(at.alias("start"), F.lit(KINDS.index(kind)).alias("kind"), (at + F.length(x)).cast("long").alias("end"), score.cast("double").alias("score"))


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(d: Column) -> Column:
    value = lambda c, i: c.cast("int") * (1 + i % 2)
    each = F.transform(F.split(F.reverse(d), ""), lambda c, i: value(c, i) - F.when(value(c, i) > 9, 9).otherwise(0))
    return F.aggregate(each, F.lit(0), lambda a, b: a + b) % 10 == 0


def base_spans(text: Column) -> Column:
    """Array of (start, kind, end, score) of all base spans, by start, then kind."""

    def of(kind: str, pattern: str, gate: Column, valid) -> Column:
        return _found(text, pattern, gate, lambda x, at, _: F.when(valid(x), _span(kind, x, at, F.lit(1.0))))

    def card(x: Column) -> Column:
        return let(_digits(x), lambda d: F.when(F.length(d).between(12, 19), _luhn(d)).otherwise(False))

    digit = text.rlike("[0-9]")
    return F.sort_array(
        F.concat(
            of("email", EMAIL, F.contains(text, F.lit("@")), lambda x: F.lit(True)),
            of("ip", IP, F.contains(text, F.lit(".")) & digit, lambda x: x.rlike(rf"^{PART}(?:\.{PART}){{3}}$")),
            of("card", CARD, digit, card),
            of("phone", PHONE, F.contains(text, F.lit("+")), lambda x: F.length(_digits(x)).between(9, 15)),
        )
    )


def candidates(text: Column) -> Column:
    """Array of (start, kind, end, score) of the generators' spans whose margin reaches the threshold."""
    forest, least = model()

    def of(kind: str, pattern: str) -> Column:
        def pick(x: Column, at: Column, behind: Column) -> Column:
            before = F.right(behind, F.lit(24))  # three matches of 9 characters or more are longer
            row = F.struct(*[c.alias(n) for c, n in zip(_feature_columns(KINDS.index(kind), x, before), FEATURES)])
            return let(row, lambda c: let(_margin(forest, c), lambda m: F.when(m >= least, _span(kind, x, at, m))))

        gate = {"phone": r"[0-9][\x20.-][0-9]", "email": r"(?:[(\[\x20]at[)\]\x20])", "ip": "[0-9A-Fa-f]:[0-9A-Fa-f]", "card": "[0-9][./_][0-9]"}[kind]
        return _found(text, pattern, text.rlike(gate), pick)

    return F.concat(*[of(k, p) for k, p in GENERATORS])


def _margin(forest: gbt.Forest, c: Column) -> Column:
    """The forest over the fields of the struct ``c``."""

    def tree(t: int, node: int) -> Column:
        inner = 2**forest.depth - 1
        if node >= inner:
            return F.lit(float(forest.leaf[t][node - inner]))
        cut = float(forest.threshold[t][node])
        if not np.isfinite(cut):
            return tree(t, 2 * node + 1)
        return F.when(c[FEATURES[forest.feature[t][node]]] > cut, tree(t, 2 * node + 2)).otherwise(tree(t, 2 * node + 1))

    total = F.lit(float(forest.base))
    for t in range(len(forest.feature)):
        total = total + tree(t, 0)
    return total


def _free(base: Column, more: Column) -> Column:
    """The spans of ``more`` that overlap none of ``base``, by end: one sort, and the furthest end of the base spans begun before."""

    def event(at: Column, is_base: int, reach: Column, s: Column) -> Column:
        return F.struct(at.alias("at"), F.lit(is_base).alias("base"), reach.cast("long").alias("reach"), s.alias("span"))

    def of_events(e: Column) -> Column:
        reach = _running(F.transform(e, lambda x: x["reach"]), _further)
        clear = lambda r: F.transform(e, lambda x, i: F.when((x["base"] == 0) & (F.get(r, i) <= x["span"]["start"]), x["span"]))
        return F.filter(let(reach, clear), lambda s: s.isNotNull())

    both = F.concat(F.transform(more, lambda s: event(s["end"], 0, F.lit(0), s)), F.transform(base, lambda s: event(s["start"], 1, s["end"], s)))
    return let(F.sort_array(both), of_events)


def all_spans(base: Column, more: Column) -> Column:
    """The base spans and the candidates that overlap none of them and no better candidate that is taken.

    A candidate has 9 to 146 characters and those of one generator do not overlap, so one can overlap fewer than ``NEAR``
    others; only that many on either side, by start, are looked at.
    """
    overlap = lambda a, b: (a["start"] < b["end"]) & (b["start"] < a["end"])
    better = lambda a, b: (a["score"] > b["score"]) | ((a["score"] == b["score"]) & (F.struct(a["start"], a["kind"]) < F.struct(b["start"], b["kind"])))
    near = lambda own, i: F.slice(own, F.greatest(i - NEAR, F.lit(0)) + 1, 2 * NEAR + 1)
    best_first = lambda own: F.array_sort(own, lambda a, b: F.when(better(a, b), -1).when(better(b, a), 1).otherwise(0))

    def pick(taken: Column, s: Column) -> Column:
        return F.when(F.exists(taken, lambda t: overlap(s, t)), taken).otherwise(F.concat(taken, F.array(s)))

    def greedy(own: Column) -> Column:
        """Those that no other beats; of the rest that overlap none of these, from the best on, each that overlaps none taken before."""
        beaten = F.transform(own, lambda s, i: F.struct(s.alias("span"), F.exists(near(own, i), lambda b: overlap(s, b) & better(b, s)).alias("met")))
        return let(beaten, lambda f: F.concat(spans(F.filter(f, lambda s: ~s["met"])), let(best_first(spans(open_ones(f))), settled)))

    def spans(flagged: Column) -> Column:
        return F.transform(flagged, lambda s: s["span"])

    def open_ones(f: Column) -> Column:
        return F.filter(f, lambda s, i: s["met"] & ~F.exists(near(f, i), lambda t: ~t["met"] & overlap(s["span"], t["span"])))

    def settled(rest: Column) -> Column:
        return F.aggregate(rest, F.filter(rest, lambda s: F.lit(False)), pick)

    chosen = let(F.sort_array(_free(base, more)), greedy)
    return F.when(F.size(more) == 0, base).otherwise(F.sort_array(F.concat(base, chosen)))


def written(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def spanned(d: DataFrame, text: Column) -> DataFrame:
    """``d`` with the columns base and spans of ``text``.

    One projection each: every name is used more than once, so the optimizer leaves them apart, and nested in one
    expression they take the analyzer more rounds than it allows.
    """
    d = d.withColumn("base", base_spans(text)).withColumn("more", candidates(text))
    return d.withColumn("spans", all_spans(F.col("base"), F.col("more"))).drop("more")


def find(docs: DataFrame) -> DataFrame:
    """doc_id, base and spans (arrays of start, kind, end, score) of each row."""
    return spanned(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), F.col("text")).drop("text")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, counts of base spans by kind, the hash of the base spans, and all spans."""
    d = find(docs)
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == KINDS.index(k))).cast("long").alias(f"n_{k}")
    return d.select("doc_id", *[count(k) for k in KINDS], F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))


def redacted(text: Column, spans: Column) -> Column:
    """The text with every span, overlapping ones as one, replaced by its first kind in brackets."""
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    cut = lambda x, at, end: F.substring(x, (at + 1).cast("int"), F.greatest(end - at, F.lit(0)).cast("int"))

    def part(p: Column) -> Column:
        """A block of spans with the ends ahead of them, written from its own stretch of the text, which positions are counted in."""
        lo = F.get(p, F.lit(0))["reach"]

        def one(x: Column, s: Column) -> Column:
            new = F.concat(cut(x, s["reach"] - lo, s["start"] - lo), F.get(names, s["kind"]))
            return F.when(s["start"] < s["reach"], F.lit("")).otherwise(new)

        return let(cut(text, lo, F.element_at(p, -1)["start"]), lambda x: F.array_join(F.transform(p, lambda s: one(x, s)), ""))

    def whole(reach: Column) -> Column:
        placed = F.transform(spans, lambda s, i: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), F.get(reach, i).alias("reach")))
        last = F.greatest(F.element_at(reach, -1), F.element_at(spans, -1)["end"])
        return F.concat(F.array_join(F.transform(_blocks(placed, 256), part), ""), F.substring(text, (last + 1).cast("int"), F.length(text)))

    return F.when(F.size(spans) == 0, text).otherwise(let(_running(F.transform(spans, lambda s: s["end"]), _further), whole))


def redact(docs: DataFrame) -> DataFrame:
    """The documents with all spans redacted, in the columns of ``docs``; ``n_chars``, an integer column, follows the text."""
    d = spanned(docs.select(carried(docs, "text"), "text"), F.col("text"))
    d = d.select("row", "text", F.when(F.col("text").isNotNull(), redacted(F.col("text"), F.col("spans"))).alias("new"))
    kind = dict(docs.dtypes).get("n_chars")
    if kind not in ("bigint", "int"):
        return d.select(*restored(docs, text=F.col("new")))
    n_chars = F.when(~F.col("new").eqNullSafe(F.col("text")), F.length("new").cast(kind)).otherwise(F.col("row.n_chars"))
    return d.select(*restored(docs, text=F.col("new"), n_chars=n_chars))
