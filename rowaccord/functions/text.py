"""Text forms of values: stripping, number rendering, the raw text of any column.

Functions take and return Spark SQL expressions as text.
"""

from __future__ import annotations

from pyspark.sql import types as T

from .names import in_list, lit

# The characters with the Unicode White_Space property. Spark's
# one-argument trim() removes blanks only, so the set is passed explicitly.
WHITESPACE = (
    "\t\n\x0b\x0c\r \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# Words that stand for a missing value, compared in lower case.
TEXTUAL_NULLS = (
    "null", "none", "na", "n/a", "#n/a", "nan", "nil",
    "missing", "unknown", "undefined", "n.a.", "n.a", "-",
)
_LONGEST_TEXTUAL_NULL = max(len(w) for w in TEXTUAL_NULLS)


def strip(c: str) -> str:
    """Remove leading and trailing Unicode white space (stays inside codegen, no regex)."""
    return f"trim(BOTH {lit(WHITESPACE)} FROM {c})"


def is_empty(c: str) -> str:
    return f"({c} = '')"


def is_whitespace_only(c: str) -> str:
    return f"({c} <> '' AND {strip(c)} = '')"


def is_textual_null(c: str) -> str:
    """The length test comes first, so long texts are never lower-cased."""
    return f"(char_length({c}) <= {_LONGEST_TEXTUAL_NULL} AND lower({c}) IN {in_list(TEXTUAL_NULLS)})"


def plain_number(c: str) -> str:
    """Float as text without an exponent over the range people write out.

    Spark renders 1.2345678E7 and 1.0E-4; files hold 12345678.0 and 0.0001.
    """

    def decimal_text(scale: int) -> str:
        digits = f"trim(TRAILING '0' FROM CAST(CAST(CAST({c} AS DOUBLE) AS DECIMAL(38,{scale})) AS STRING))"
        return f"regexp_replace({digits}, '[.]$', '.0')"

    return (
        f"(CASE WHEN abs({c}) >= 1e7 AND abs({c}) < 1e16 THEN {decimal_text(12)} "
        f"WHEN abs({c}) >= 1e-6 AND abs({c}) < 1e-3 THEN {decimal_text(26)} "
        f"ELSE CAST({c} AS STRING) END)"
    )


def is_text(t: T.DataType) -> bool:
    return isinstance(t, (T.StringType, T.CharType, T.VarcharType))


def is_float(t: T.DataType) -> bool:
    return isinstance(t, (T.FloatType, T.DoubleType))


def is_integral(t: T.DataType) -> bool:
    return isinstance(t, T.IntegralType)


def is_nested(t: T.DataType) -> bool:
    return isinstance(t, (T.ArrayType, T.StructType, T.MapType))


def is_ordered(t: T.DataType) -> bool:
    """Types whose own order differs from the order of their texts."""
    return isinstance(t, (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType))


def render(c: str, t: T.DataType) -> str:
    """Raw text of a value; null stays null."""
    if is_text(t):
        return c
    if is_float(t):
        return plain_number(c)
    if isinstance(t, T.MapType):
        return f"to_json({sorted_entries(c)})"
    if is_nested(t):
        return f"to_json({c})"
    if isinstance(t, (T.BinaryType, T.DayTimeIntervalType, T.YearMonthIntervalType, T.CalendarIntervalType)):
        raise TypeError(f"columns of type {t.simpleString()} have no text form to compare")
    return f"CAST({c} AS STRING)"


def exact_number(c: str, t: T.DataType) -> str:
    """Text in which a bigint and a float are equal exactly if they are the same number; null stays null.

    A float that is a whole number in the range of bigint is written as that number, every other one as itself.
    """
    if not is_float(t):
        return f"CAST({c} AS STRING)"
    d = f"CAST({c} AS DOUBLE)"
    whole = f"{d} >= -9223372036854775808D AND {d} < 9223372036854775808D AND floor({d}) = {d}"
    return f"CASE WHEN {whole} THEN CAST(try_cast({d} AS BIGINT) AS STRING) ELSE {plain_number(c)} END"


def sorted_entries(c: str) -> str:
    """Maps are not comparable; their sorted entries are."""
    return f"array_sort(map_entries({c}))"
