"""Casts that never fail a job: what does not parse becomes null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .nulls import stripped

#: The words of booleans.
TRUE_WORDS = ("true", "yes", "1", "t", "y")
FALSE_WORDS = ("false", "no", "0", "f", "n")

#: A plain number: Spark's own cast takes more, such as "1d" or white space.
NUMBER = r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$|^[+-]?(?i:inf|infinity|nan)$"

#: Strftime directives and their patterns.
DIRECTIVES = {
    "Y": "yyyy", "y": "yy", "m": "MM", "d": "dd", "H": "HH", "I": "hh", "M": "mm", "S": "ss", "f": "SSSSSS", "p": "a", "b": "MMM",
    "B": "MMMM", "a": "EEE", "A": "EEEE", "j": "DDD", "z": "xx", "Z": "z", "F": "yyyy-MM-dd", "T": "HH:mm:ss", "R": "HH:mm", "%": "%",
}

#: Shapes of strings that count as datetimes without a declared format, with the format that reads each.
DATE_SHAPES = (
    (r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$", "yyyy-MM-dd"),
    (r"^[0-9]{4}/[0-9]{2}/[0-9]{2}$", "yyyy/MM/dd"),
    (r"^[0-9]{2}/[0-9]{2}/[0-9]{4}$", "dd/MM/yyyy"),
    (r"^[0-9]{2}-[0-9]{2}-[0-9]{4}$", "dd-MM-yyyy"),
    (r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[ T][0-9]{2}:[0-9]{2}$", "yyyy-MM-dd[ ]['T']HH:mm"),
    (r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[ T][0-9]{2}:[0-9]{2}:[0-9]{2}$", "yyyy-MM-dd[ ]['T']HH:mm:ss"),
    (r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[ T][0-9]{2}:[0-9]{2}:[0-9]{2}\.[0-9]{1,9}$", "yyyy-MM-dd[ ]['T']HH:mm:ss.[SSSSSSSSS][SSSSSS][SSS]"),
    (r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[ T][0-9]{2}:[0-9]{2}:[0-9]{2}(?:Z|[+-][0-9]{2}:[0-9]{2})$", "yyyy-MM-dd[ ]['T']HH:mm:ssXXX"),
)


def to_double(c: Column, kind: T.DataType) -> Column:
    """Numbers as doubles; strings only where they are plain numbers."""
    if isinstance(kind, T.StringType):
        return F.when(c.rlike(NUMBER), c.try_cast("double"))
    if isinstance(kind, T.NumericType):
        return c.cast("double")
    return F.lit(None).cast("double")


def java_pattern(fmt: str) -> str:
    """The datetime pattern of a strftime format."""
    out, text, i = [], "", 0

    def plain() -> None:
        nonlocal text
        if text:
            out.append("'" + text.replace("'", "''") + "'" if any(ch.isalpha() or ch in "'[]{}#" for ch in text) else text)
        text = ""

    while i < len(fmt):
        if fmt[i] == "%" and i + 1 < len(fmt):
            i += 1
            if fmt[i] == "%":
                text += "%"
            elif fmt[i] in DIRECTIVES:
                plain()
                out.append(DIRECTIVES[fmt[i]])
            else:
                raise ValueError(f"unsupported directive %{fmt[i]} in {fmt!r}")
        else:
            text += fmt[i]
        i += 1
    plain()
    return "".join(out)


def to_timestamp(c: Column, kind: T.DataType, fmt: str | None = None, unit: str | None = None) -> Column:
    """A timestamp in UTC from a date, a timestamp, a string (by format or shape) or a number (by epoch unit)."""
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return c.cast("timestamp")
    if isinstance(kind, T.StringType):
        if fmt is not None:
            return F.try_to_timestamp(c, F.lit(java_pattern(fmt)))
        s = stripped(c)
        tries = [F.when(s.rlike(shape), F.try_to_timestamp(s, F.lit(pattern))) for shape, pattern in DATE_SHAPES]
        return F.coalesce(*tries)
    if isinstance(kind, T.NumericType) and unit is not None:
        n = c.cast("double") if isinstance(kind, (T.FloatType, T.DoubleType)) else c.cast("long")
        if unit == "d":
            return F.timestamp_seconds(n * 86400)
        if unit == "s":
            return F.timestamp_seconds(n)
        if unit == "ms":
            return F.timestamp_millis(n.cast("long"))
        if unit == "us":
            return F.timestamp_micros(n.cast("long"))
        if unit == "ns":
            return F.timestamp_micros(F.floor(n / 1000).cast("long"))
        raise ValueError(f"unknown epoch unit {unit!r}")
    return F.lit(None).cast("timestamp")


def to_boolean(c: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.BooleanType):
        return c
    if isinstance(kind, T.NumericType):
        return c != 0
    if isinstance(kind, T.StringType):
        s = F.lower(stripped(c))
        return F.when(s.isin(list(TRUE_WORDS)), F.lit(True)).when(s.isin(list(FALSE_WORDS)), F.lit(False))
    return c.try_cast("boolean")
