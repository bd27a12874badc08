"""Building blocks for operators that stay inside DataFrame and SQL functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space between words, as a regular expression class and as characters.
SPACE = r"[\x20\x09-\x0D]"
SPACES = " \t\n\x0b\x0c\r"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, evaluated once however often ``body`` names it, also inside lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """Runs of anything but white space, in order."""
    return F.array_remove(F.split(text, SPACE + "+"), "")


def n_words(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def solid(text: Column) -> Column:
    """The text without white space."""
    return F.translate(text, SPACES, "")


def carried(docs: DataFrame, *apart: str) -> Column:
    """The columns of ``docs`` but ``apart`` as one column, so that helper columns cannot clash with their names."""
    return F.struct(F.lit(True), *[F.col(quoted(c)) for c in docs.columns if c not in apart]).alias("row")


def restored(docs: DataFrame, **values: Column) -> list[Column]:
    """The columns of ``docs`` from ``carried`` ones, and ``values`` for those that were not."""
    return [(values[c] if c in values else F.col("row").getField(c)).alias(c) for c in docs.columns]


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"
