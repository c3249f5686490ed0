"""Cleaning predicates for correlated keys and node values (FLT1-FLT5, FN1-FN7)."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Tokens that mark a missing node value.  A value is dropped when
# its lower-cased, margin-stripped form equals one of these exactly (no trim).
# Listed in the reference's order: backslash-N (cannot match after lower-case,
# kept for fidelity), backslash-n, newline, one space, "n/a", "na", "none".
MISSING_TOKENS = ("\\N", "\\n", "\n", " ", "n/a", "na", "none")

# A key is usable when it is a plain signed decimal integer that fits a long.
_LONG_PATTERN = r"\A[+-]?[0-9]+\z"  # \z: no line end may follow

# Scala's stripMargin: on every line, leading characters <= ' ' followed by '|'
# are removed together with the bar.  Lines end at LF only ((?d) = UNIX_LINES),
# and the blank class excludes LF so a match never crosses a line.
_MARGIN_PATTERN = r"(?d)(?m)^[\x00-\x09\x0b-\x20]*\|"


def strip_margin(c: Column) -> Column:
    """FN2: remove a ``<blanks>|`` margin at the start of every line."""
    return F.regexp_replace(c, _MARGIN_PATTERN, "")


def remove_whitespace(c: Column) -> Column:
    """FN3: delete every whitespace character."""
    return F.regexp_replace(c, r"\s", "")


def is_long_key(c: Column) -> Column:
    """FLT1/FN6: true when the string form of ``c`` parses as a long.

    The regex rejects blanks and fractions (``' 8 '``, ``'12.0'``), which a bare
    cast would accept or reject differently between engines; ``try_cast``
    rejects values that overflow a long.
    """
    s = c.cast("string")
    return s.rlike(_LONG_PATTERN) & s.try_cast("bigint").isNotNull()


def is_missing_token(c: Column, extra_tokens: Iterable[str] = ()) -> Column:
    """FLT4: the lower-cased, margin-stripped value is one of the missing tokens."""
    tokens = list(MISSING_TOKENS) + list(extra_tokens)
    return strip_margin(F.lower(c.cast("string"))).isin(tokens)


def keep_node(c: Column, extra_tokens: Iterable[str] = ()) -> Column:
    """Node value is present: not null and not a missing token (Q4-Q6)."""
    return c.isNotNull() & ~is_missing_token(c, extra_tokens)


def keep_column(df: DataFrame, name: str, extra_tokens: Iterable[str] = ()) -> Column:
    """``keep_node`` for a column of ``df``: the token test only runs on
    string-like columns; numbers, booleans, dates and timestamps never print
    as a missing token, so for them only null drops."""
    dtype = df.schema[name].dataType
    if isinstance(dtype, (T.NumericType, T.BooleanType, T.DateType, T.TimestampType,
                          T.TimestampNTZType)):
        return F.col(name).isNotNull()
    return keep_node(F.col(name), extra_tokens)


def type_is_string(type_name: Column) -> Column:
    """FLT5: a description's type name contains ``string`` once lower-cased
    and stripped of whitespace (so ``varchar``/``char`` do not count, Q18)."""
    return F.instr(remove_whitespace(F.lower(type_name)), "string") > 0


def resolve_column(df: DataFrame, name: str) -> str:
    """PRJ1: the column of ``df`` called ``name`` (case-insensitive), or a clear error."""
    for field in df.schema.fields:
        if field.name == name:
            return field.name
    folded = [f.name for f in df.schema.fields if f.name.lower() == name.lower()]
    if len(folded) == 1:
        return folded[0]
    raise KeyError(f"column {name!r} not found; columns are {df.columns}")


def is_integral(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, (T.ByteType, T.ShortType, T.IntegerType,
                                                 T.LongType))


def is_fractional(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, (T.FloatType, T.DoubleType, T.DecimalType))
