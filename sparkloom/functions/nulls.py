"""Effective nulls: which cells count as missing, as column expressions.

Strings: null, blank after trimming any white space, or a null word in any case (the untrimmed value is compared).
Declared words replace the built-in ones for their column.  Floats: null, NaN, infinite or a declared value.  Integers:
null or a declared value.  Everything else: null.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words that stand for a missing string.
NULL_WORDS = ("NA", "NAN", "NULL", "NONE", "?")

INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
FLOATS = (T.FloatType, T.DoubleType)


def stripped(c: Column) -> Column:
    """The string without white space of any kind around it."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def is_blank(c: Column) -> Column:
    return ~c.rlike(r"\S")


def effective_null(c: Column, kind: T.DataType, sentinels: Sequence | None = None) -> Column:
    """True where the cell is missing; never null."""
    missing = c.isNull()
    if isinstance(kind, T.StringType):
        words = [str(s).upper() for s in sentinels] if sentinels is not None else list(NULL_WORDS)
        found = is_blank(c) | F.upper(c).isin(words) if words else is_blank(c)
        return missing | F.coalesce(found, F.lit(False))
    if isinstance(kind, FLOATS):
        missing = missing | F.isnan(c) | (F.abs(c) == float("inf"))
        if sentinels:
            missing = missing | c.isin([float(s) for s in sentinels])
        return F.coalesce(missing, F.lit(True))
    if isinstance(kind, INTEGERS) and sentinels:
        return F.coalesce(missing | c.cast("double").isin([float(s) for s in sentinels]), F.lit(True))
    return missing


def missing_exprs(
    df: DataFrame,
    columns: Sequence[str],
    numeric: Mapping[str, Sequence[float]] | None = None,
    strings: Mapping[str, Sequence[str]] | None = None,
) -> dict[str, Column]:
    """The effective-null condition of each column."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    out = {}
    for name in columns:
        declared = (strings if isinstance(kinds[name], T.StringType) else numeric) or {}
        out[name] = effective_null(F.col(quoted(name)), kinds[name], declared.get(name))
    return out


def normalized(
    df: DataFrame,
    numeric: Mapping[str, Sequence[float]] | None = None,
    strings: Mapping[str, Sequence[str]] | None = None,
) -> list[Column]:
    """The columns of ``df`` with every effective null turned into null."""
    eligible = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.StringType, *FLOATS)) or (isinstance(f.dataType, INTEGERS) and (numeric or {}).get(f.name))]
    gone = missing_exprs(df, eligible, numeric, strings)
    return [F.when(~gone[c], F.col(quoted(c))).alias(c) if c in gone else F.col(quoted(c)) for c in df.columns]


def normalize(
    df: DataFrame,
    numeric: Mapping[str, Sequence[float]] | None = None,
    strings: Mapping[str, Sequence[str]] | None = None,
) -> DataFrame:
    """The table with every effective null turned into null, in one projection."""
    return df.select(*normalized(df, numeric, strings))


def quoted(name: str) -> str:
    """A column name that may hold dots or backticks."""
    return "`" + name.replace("`", "``") + "`"
