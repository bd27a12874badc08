"""Exact quantiles by selection: the places that quantiles need are closed in on by counting, and no task holds a column.

Each round counts the values of the spans that still hold a wanted place in ``bins`` bins, which partial aggregates make
small before they are shuffled, and narrows every place to the smallest and largest value of its bin.  A place is found
when these are equal.  Rounds cut a span evenly and by its logarithm in turn, so neither evenly nor widely spread values
need more than a few; heavy values are found at once.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Spans up to which a table of them is broadcast; above it, rows are joined with them by key.
SMALL = 20_000


#: Expressions whose counts share a job.
TOGETHER = 25


Span = tuple[float, float, int]  # smallest and largest value, and how many values lie before


def _literal(values: Sequence[float], kind: str = "double") -> Column:
    """A constant array; generated code only looks places up in it, so its size does not grow with the array's."""
    return F.expr(f"array({', '.join(f'{v!r}D' if kind == 'double' else str(v) for v in values)})")


class Narrowing:
    """Rounds of counting for one expression: each puts the values of the open spans into bins, numbered over all spans.

    Rounds are projections on one another without filters, so the optimizer neither merges nor repeats what they compute;
    values outside the open spans have no bin.
    """

    def __init__(self, df: DataFrame, x: Column, lo: float, hi: float) -> None:
        self.factor = 0.0625 if max(abs(lo), abs(hi)) > 1e306 else 1.0
        self.rows = df.select((x * F.lit(self.factor) if self.factor < 1 else x).alias("x"))
        self.turn, self.each = 0, 0
        self.spans: list[Span] = []

    def open(self, spans: Sequence[Span], of_bin: dict[int, int] | None, bins: int) -> None:
        """Cut ``spans`` into ``bins`` bins in all; ``of_bin`` tells which bins of the last round they are."""
        last = self.each * len(self.spans)
        self.spans, self.each = list(spans), max(32, bins // len(spans))
        low = [s[0] * self.factor for s in spans]
        width = [s[1] * self.factor - a for s, a in zip(spans, low)]
        x, span = F.col("x"), F.col("span")
        d = self.rows.select("x", F.lit(0).alias("span") if of_bin is None else F.get(_literal([of_bin.get(i, -1) for i in range(last)], "int"), F.col("bin")).alias("span"))
        d = d.select("x", "span", F.when((span >= 0) & x.isNotNull(), (x - F.get(_literal(low), span)) / F.get(_literal(width), span)).alias("u"))
        octaves = self.each // 16
        cut = F.floor((F.log2(F.greatest("u", F.lit(2.0**-octaves))) + F.lit(octaves)) * 16) if self.turn % 2 else F.floor(F.col("u") * self.each)
        at = span * self.each + F.least(F.greatest(cut, F.lit(0)), F.lit(self.each - 1))
        self.rows = d.select("x", F.when(F.col("u").between(0, 1), at).cast("int").alias("bin"))
        self.turn += 1

    def counts(self, number: int) -> DataFrame:
        """(i, bin, c, lo, hi) of this round; a null bin stands for all other values."""
        d = self.rows.groupBy("bin").agg(F.count("x").alias("c"), (F.min("x") / self.factor).alias("lo"), (F.max("x") / self.factor).alias("hi"))
        return d.select(F.lit(number).alias("i"), "bin", "c", "lo", "hi")

    def placed(self, rows: Sequence) -> list[tuple[int, Span, int]]:
        """(bin, span, its values) of the counted bins, in order."""
        out, run, of = [], 0, -1
        for t in sorted((t for t in rows if t["bin"] is not None), key=lambda t: t["bin"]):
            if t["bin"] // self.each != of:
                of = t["bin"] // self.each
                run = self.spans[of][2]
            out.append((t["bin"], (t["lo"], t["hi"], run), t["c"]))
            run += t["c"]
        return out


def _ranges(df: DataFrame, values: Sequence[Column]) -> list[tuple[int, float, float]]:
    r = df.agg(*[e.alias(f"{k}{i}") for i, x in enumerate(values) for k, e in (("n", F.count(x)), ("lo", F.min(x)), ("hi", F.max(x)))]).first()
    return [(r[f"n{i}"], r[f"lo{i}"], r[f"hi{i}"]) for i in range(len(values))]


def _finite(x: Column) -> Column:
    return F.when(F.abs(x) < F.lit(math.inf), x)


def of_expressions(df: DataFrame, values: Sequence[Column], shares: Sequence[float], bins: int = 4096) -> list[tuple[int, list[float | None]]]:
    """(n, quantiles) of the finite values of each double expression; at most ``bins`` counts of each are collected a round."""
    if len(values) > TOGETHER:
        return of_expressions(df, values[:TOGETHER], shares, bins) + of_expressions(df, values[TOGETHER:], shares, bins)
    finite = [_finite(x) for x in values]
    ranges = _ranges(df, finite)
    place = lambda i, s: s * (ranges[i][0] - 1)
    spans = [{k: (lo, hi, 0) for s in shares for k in (math.floor(place(i, s)), math.ceil(place(i, s)))} if n else {} for i, (n, lo, hi) in enumerate(ranges)]
    work = {i: Narrowing(df, finite[i], lo, hi) for i, (n, lo, hi) in enumerate(ranges) if n and lo < hi}
    for i, w in work.items():
        w.open([(ranges[i][1], ranges[i][2], 0)], None, bins)
    while work:
        found = reduce(DataFrame.unionByName, [w.counts(i) for i, w in work.items()]).collect()
        for i, w in list(work.items()):
            cells = w.placed([t for t in found if t["i"] == i])
            hit: dict[int, Span] = {}
            for k, span in spans[i].items():
                if span[0] < span[1]:
                    at, spans[i][k], _ = next(c for c in cells if c[1][2] <= k < c[1][2] + c[2])
                    if spans[i][k][0] < spans[i][k][1]:
                        hit[at] = spans[i][k]
            if hit:
                w.open([hit[b] for b in sorted(hit)], {b: j for j, b in enumerate(sorted(hit))}, bins)
            else:
                del work[i]
    out = []
    for i, (n, _, _) in enumerate(ranges):
        row: list[float | None] = []
        for s in shares:
            if not n:
                row.append(None)
                continue
            low, high = math.floor(place(i, s)), math.ceil(place(i, s))
            a, b = spans[i][low][0], spans[i][high][0]
            row.append(a if a == b else (high - place(i, s)) * a + (place(i, s) - low) * b)
        out.append((n, row))
    return out


def outline(df: DataFrame, x: Column, points: int = 2000) -> list[tuple[float, float, int]]:
    """(smallest, largest, number) of the values in disjoint cells, in order, from all rows.

    Cells are single values wherever that takes no more than about ``points`` cells; else each but single values holds at
    most about a share of ``1 / points`` of the rows, so a distribution that is straight within cells is off by no more.
    """
    x = _finite(x)
    n, lo, hi = _ranges(df, [x])[0]
    if not n or lo == hi:
        return [(lo, hi, n)] if n else []
    w = Narrowing(df, x, lo, hi)
    w.open([(lo, hi, 0)], None, 2 * points)
    done: list[tuple[float, float, int]] = []
    while True:
        cells = w.placed(w.counts(0).collect())
        wide = [c for c in cells if c[1][0] < c[1][1]]
        coarse = wide if len(done) + len(cells) + 2 * len(wide) <= points else [c for c in wide if c[2] > n / points]
        keys = {c[0] for c in coarse}
        done += [(c[1][0], c[1][1], c[2]) for c in cells if c[0] not in keys]
        if not coarse:
            break
        w.open([c[1] for c in coarse], {c[0]: j for j, c in enumerate(coarse)}, 2 * points)
    merged: list[list] = []
    for low, high, c in sorted(done):
        if len(done) > 2 * points and merged and merged[-1][2] + c <= n / points:
            merged[-1][1:] = [high, merged[-1][2] + c]
        else:
            merged.append([low, high, c])
    return [tuple(m) for m in merged]


def _small(spans: DataFrame) -> DataFrame:
    """``spans`` to be broadcast if a count shows few of them."""
    return F.broadcast(spans) if spans.count() <= SMALL else spans


def quantiles(rows: DataFrame, shares: Sequence[float], bins: int = 4096) -> DataFrame:
    """key, n, q (array, interpolated between neighbours) from the ``x`` (finite doubles) of rows (key, x) without nulls."""
    rows = rows.select("key", "x").where("key is not null and x is not null")
    share = F.array(*[F.lit(float(s)) for s in shares])
    ranges = rows.groupBy("key").agg(F.count("x").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    place = lambda s: s * (F.col("n") - 1)
    wanted = F.array_distinct(F.flatten(F.transform(share, lambda s: F.array(F.floor(place(s)), F.ceil(place(s))))))
    want = ranges.select("key", "n", "lo", "hi", F.lit(0).cast("long").alias("before"), F.explode(wanted).alias("rank")).persist()
    turn, held = 0, [want]
    spans = want.where("lo < hi").select("key", "lo", "hi").distinct()
    live = rows.join(_small(spans), ["key"])
    try:
        while want.where("lo < hi").limit(1).count():
            u = (F.col("x") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2)
            octaves = bins / 16
            cut = F.floor((octaves + F.log2(F.greatest(u, F.lit(2.0**-octaves)))) * 16) if turn % 2 else F.floor(u * bins)
            live = live.withColumn("bin", F.least(cut, F.lit(bins - 1)).cast("int"))
            met = live.groupBy("key", "lo", "bin").agg(F.count("x").alias("c"), F.min("x").alias("low"), F.max("x").alias("high"))
            run = F.sum("c").over(W.partitionBy("key", "lo").orderBy("bin").rowsBetween(W.unboundedPreceding, 0))
            met = met.select("key", "lo", "bin", "c", "low", "high", (run - F.col("c")).alias("ahead"))
            own = F.col("rank") - F.col("before")
            found = want.where("lo < hi").join(met, ["key", "lo"]).where((own >= F.col("ahead")) & (own < F.col("ahead") + F.col("c")))
            found = found.select("key", "n", F.col("low").alias("lo"), F.col("high").alias("hi"), (F.col("before") + F.col("ahead")).alias("before"), "rank", F.col("lo").alias("old"), "bin")
            found = want.where("lo = hi").withColumns({"old": F.col("lo"), "bin": F.lit(-1)}).unionByName(found).persist()
            held.append(found)
            spans = found.where("lo < hi").select("key", F.col("old").alias("lo"), "bin", F.col("lo").alias("low"), F.col("hi").alias("high")).distinct()
            live = live.join(_small(spans), ["key", "lo", "bin"]).select("key", "x", F.col("low").alias("lo"), F.col("high").alias("hi"))
            want = found.drop("old", "bin")
            turn += 1
        values = F.map_from_entries(F.collect_list(F.struct("rank", "lo")))
        out = want.groupBy("key").agg(F.first("n").alias("n"), values.alias("at"))

        def one(s):
            low, high = F.floor(place(s)), F.ceil(place(s))
            a, b = F.element_at("at", low), F.element_at("at", high)
            return F.when(a == b, a).otherwise((high - place(s)) * a + (place(s) - low) * b)

        out = out.select("key", "n", F.transform(share, one).alias("q")).persist()
        held.append(out)
        out.count()
        return out.select("*")
    finally:
        for d in held[:-1]:
            d.unpersist()
