"""Quality rules: per-document counts and cross-document line frequency, in DataFrame functions only.

A line is normalised (lower case, white space runs to one space, trimmed) and hashed.  For every host (the column
``source``; null is a host of its own) the number of *distinct texts* that hold the line is counted, so exact copies
count once.  A line is above the limit if at least ``max(min_docs, min_share * texts of the host)`` texts
hold it.  Such lines are removed; a document that loses more than ``max_removed`` of its words is depleted and rejected.

Defined cases: a null text is an empty one; a null source or doc_id is a value like any other; repeated rows get the same
verdict each; an empty table gives an empty result; other columns of the input are never read.

At scale: only hashes are shuffled, never texts (``clean`` alone moves texts, once).  The line count is a partial
aggregate, so one line in a third of all documents costs a row per task; the join with the few frequent lines is a plain
inner join whose hot partitions adaptive execution may split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .native import SPACE, carried, let, restored, solid, words
from .store import keep

SYMBOLS = "#*$%&|<>"
WINDOW = 8


def repeat_words(ws: Column) -> Column:
    """Words that lie in ``WINDOW``-word windows found twice or more among ``ws``; overlapping windows count a word once."""

    def covered(starts: Column) -> Column:
        steps = F.transform(starts, lambda p, j: F.least(F.lit(WINDOW), F.coalesce(F.get(starts, j + 1) - p, F.lit(WINDOW))))
        return F.aggregate(steps, F.lit(0), lambda a, b: a + b)

    def repeated(s: Column) -> Column:
        """Starts of the windows whose neighbour in hash order is equal."""
        same = lambda e, other: F.coalesce(e["h"] == other["h"], F.lit(False))
        marked = F.transform(s, lambda e, j: F.when(same(e, F.get(s, j - 1)) | same(e, F.get(s, j + 1)), e["i"]))
        return F.sort_array(F.filter(marked, lambda p: p.isNotNull()))

    def of_windows(h: Column) -> Column:
        ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        slow = let(ordered, lambda s: let(repeated(s), covered))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(slow)

    windows = F.transform(F.sequence(F.lit(1), F.size(ws) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(ws, i, WINDOW)))
    return F.when(F.size(ws) < WINDOW + 1, F.lit(0)).otherwise(let(windows, of_windows))


def metrics(docs: DataFrame) -> DataFrame:
    """doc_id, source, text_hash and the per-document counts of each row."""
    text = F.coalesce("text", F.lit(""))
    d = docs.select("doc_id", "source", F.xxhash64(text).alias("text_hash"), text.alias("text"))
    with_word = lambda line: F.length(solid(line)) > 0
    lines = let(F.filter(F.split("text", "\n"), with_word), lambda x: F.size(x) - F.size(F.array_distinct(x)))
    counted = let(words(F.col("text")), lambda w: F.struct(F.size(w).alias("n"), repeat_words(w).alias("r")))
    bare = let(solid(F.col("text")), lambda s: F.struct(F.length(s).alias("n"), (F.length(s) - F.length(F.translate(s, SYMBOLS, ""))).alias("s")))
    d = d.select("doc_id", "source", "text_hash", counted.alias("c"), bare.alias("b"), lines.cast("long").alias("n_dup_lines"))
    d = d.select(
        "doc_id",
        "source",
        "text_hash",
        F.col("c.n").cast("long").alias("n_words"),
        F.col("b.n").cast("long").alias("word_chars"),
        F.col("b.s").cast("long").alias("n_symbols"),
        "n_dup_lines",
        F.col("c.r").cast("long").alias("n_repeat_words"),
    )
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return d.withColumn("base_failed", failed)


def line_hash(line: Column) -> Column:
    return F.xxhash64(F.lower(F.trim(F.regexp_replace(line, SPACE + "+", " "))))


def removals(docs: DataFrame, min_docs: int = 20, min_share: float = 0.05) -> DataFrame:
    """doc_id, text_hash, removed_words, removed_lines (hashes) of each document that holds a line above the limit."""
    text = F.coalesce("text", F.lit(""))
    own = docs.select("doc_id", "source", F.xxhash64(text).alias("text_hash"), text.alias("text"), F.monotonically_increasing_id().alias("row"))
    lines = own.select("doc_id", "source", "text_hash", "row", F.explode(F.split("text", "\n")).alias("line"))
    lines = lines.where(F.length(solid(F.col("line"))) > 0)
    lines = lines.select("doc_id", "source", "text_hash", "row", line_hash(F.col("line")).alias("line"), F.size(words(F.col("line"))).alias("n"))
    seen = lines.groupBy("source", "line").agg(F.countDistinct("text_hash").alias("texts")).where(F.col("texts") >= min_docs)
    hosts = own.groupBy(F.col("source").alias("host")).agg(F.countDistinct("text_hash").alias("all_texts"))
    limit = F.greatest(F.lit(float(min_docs)), min_share * F.col("all_texts"))
    above = seen.join(hosts, F.col("source").eqNullSafe(F.col("host"))).where(F.col("texts") >= limit)
    above = above.select(F.col("source").alias("host"), F.col("line").alias("above"))
    hits = lines.join(above, F.col("source").eqNullSafe(F.col("host")) & (F.col("line") == F.col("above")))
    return hits.groupBy("doc_id", "text_hash").agg(
        (F.sum("n") / F.countDistinct("row")).cast("long").alias("removed_words"),
        F.collect_set("line").alias("removed_lines"),
    )


def judge(docs: DataFrame, max_removed: float = 0.75, **limits) -> DataFrame:
    """The counts of each row, with removed_words, removed_lines and the verdict ``kept``."""
    m, r = metrics(docs), removals(docs, **limits)
    r = r.select(F.col("doc_id").alias("r_doc"), F.col("text_hash").alias("r_hash"), "removed_words", "removed_lines")
    d = m.join(r, F.col("doc_id").eqNullSafe(F.col("r_doc")) & (F.col("text_hash") == F.col("r_hash")), "left").drop("r_doc", "r_hash")
    d = d.withColumn("removed_words", F.coalesce("removed_words", F.lit(0).cast("long")))
    depleted = F.col("removed_words") > max_removed * F.col("n_words")
    return d.withColumn("kept", ~F.col("base_failed") & ~depleted)


def firsts(verdicts: DataFrame) -> DataFrame:
    """One of each group of depleted near copies: doc_id, text_hash and the lines that go from it all the same.

    A frequent line that no kept document of its host holds is the groups' own text, not a frame around others.  Of the
    depleted documents whose removed lines are mostly such, the first one for each smallest line of that kind stays with
    them, so at most one document stays for each frequent line.
    """
    held = verdicts.where(~F.col("base_failed")).select("source", "doc_id", "text_hash", "kept", "removed_lines", F.explode("removed_lines").alias("line"))
    own = held.groupBy(F.col("source").alias("o_source"), F.col("line").alias("o_line")).agg(F.max("kept").alias("framed")).where(~F.col("framed"))
    held = held.where(~F.col("kept")).join(own, F.col("source").eqNullSafe(F.col("o_source")) & (F.col("line") == F.col("o_line")))
    held = held.groupBy("source", "doc_id", "text_hash").agg(F.collect_set("line").alias("lines"), F.min("removed_lines").alias("removed"))
    held = held.where(2 * F.size("lines") > F.size("removed"))
    one = F.struct("doc_id", "text_hash", F.sort_array(F.array_except("removed", "lines")).alias("removed"))
    return held.groupBy("source", F.array_min("lines").alias("least")).agg(F.min(one).alias("one")).select("one.*")


def clean(docs: DataFrame, **limits) -> DataFrame:
    """The documents that are kept, without their removed lines, in the columns of ``docs``.

    Of a group of near copies whose shared lines are frequent only through the group, one document stays (``firsts``), as
    ``kept`` alone would lose the group whole.  ``n_chars``, where it is an integer column, is set to the new length of a
    changed text.  Verdicts are written first, as a filter on them would otherwise count every text once more for each of
    its conditions.
    """
    judged = keep(judge(docs, **limits).select("doc_id", "text_hash", "source", "base_failed", "kept", "removed_lines"))
    none = F.array().cast("array<bigint>")
    verdicts = judged.where("kept").select("doc_id", "text_hash", F.coalesce("removed_lines", none).alias("removed")).unionByName(firsts(judged))
    verdicts = verdicts.select(F.col("doc_id").alias("v_doc"), F.col("text_hash").alias("v_hash"), "removed")
    verdicts = verdicts.groupBy("v_doc", "v_hash").agg(F.first("removed").alias("removed"))
    d = docs.select(carried(docs, "text"), "doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("own"))
    d = d.join(verdicts, F.col("doc_id").eqNullSafe(F.col("v_doc")) & (F.col("own") == F.col("v_hash")))
    left = F.array_join(F.filter(F.split("text", "\n"), lambda x: ~F.array_contains("removed", line_hash(x))), "\n")
    d = d.select("row", F.size("removed").alias("n_removed"), F.when(F.size("removed") > 0, left).otherwise(F.col("text")).alias("text"))
    kind = dict(docs.dtypes).get("n_chars")
    if kind not in ("bigint", "int"):
        return d.select(*restored(docs, text=F.col("text")))
    n_chars = F.when(F.col("n_removed") > 0, F.length("text").cast(kind)).otherwise(F.col("row.n_chars"))
    return d.select(*restored(docs, text=F.col("text"), n_chars=n_chars))
