"""How far apart the two values of a field pair are.

The expressions over a pair's intermediate columns are given by column name and written as SQL.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from concord.functions.canon import raw_text

# The kinds of variance.
EXACT_MATCH = "EXACT_MATCH"
NULL_MISMATCH = "NULL_MISMATCH"
NUMERIC = "NUMERIC"
TEXT = "TEXT"

# Texts up to this length travel as they are; it is one less than the length of a digest.
SHORT_TEXT = 63


def short_text(c: Column) -> Column:
    """A text, or its digest when it is long: equal texts stay equal and no text equals a digest.

    What a verdict needs of a long text is whether it equals another, so the text itself need
    not be moved.
    """
    return F.when(F.length(c) <= SHORT_TEXT, c).otherwise(F.sha2(c, 256))


# The texts that read as a double, decimal or hexadecimal. Repetitions are possessive: each
# digit is looked at once.
DECIMAL_DIGITS = r"(\d++(\.\d*+)?+|\.\d++)([eE][+-]?+\d++)?+"
HEX_DIGITS = r"0[xX]([0-9a-fA-F]++(\.[0-9a-fA-F]*+)?+|\.[0-9a-fA-F]++)[pP][+-]?+\d++"
NAMED_NUMBERS = r"(NaN|Infinity)"
NUMBER = rf"^[\x00-\x20]*+[+-]?+({NAMED_NUMBERS}|({HEX_DIGITS}|{DECIMAL_DIGITS})[fFdD]?+)[\x00-\x20]*+$"


def text_number(text: Column) -> Column:
    """A text as a double, NULL when it is not a number.

    The pattern comes first because a failing cast is some hundred times slower than a
    failing match.
    """
    return F.when(text.rlike(NUMBER), text.try_cast("double"))


def long_number(c: Column) -> Column:
    """The number of a text too long for its short form, which no longer shows it."""
    return F.when(F.length(c) > SHORT_TEXT, text_number(c))


def short_number(short: Column, number: Column) -> Column:
    """The number of a text, from its short form and `long_number`."""
    return F.when(F.length(short) <= SHORT_TEXT, text_number(short)).otherwise(number)


def as_number(c: Column, dtype: T.DataType) -> Column:
    """The value as a double, NULL when its text is not a number."""
    if isinstance(dtype, (T.IntegralType, T.DecimalType, T.DoubleType)):
        return c.cast("double")
    if isinstance(dtype, T.FloatType):
        return raw_text(c, dtype).cast("double")
    if isinstance(dtype, T.StringType):
        return text_number(c)
    return F.lit(None).cast("double")


def same_text(a: Column, a_type: T.DataType, b: Column, b_type: T.DataType) -> Column:
    """Equality of the two values' own texts."""
    if a_type == b_type and not isinstance(a_type, (T.FloatType, T.DoubleType)):
        return a == b
    return raw_text(a, a_type) == raw_text(b, b_type)


def variance_type(nulls: str, same: str, a_number: str, b_number: str) -> Column:
    """Kind of variance, from the number of NULLs in the pair, text equality and the two numbers."""
    return F.expr(type_sql(nulls, same, a_number, b_number))


def type_sql(nulls: str, same: str, a_number: str, b_number: str) -> str:
    return f"""CASE WHEN {nulls} = 2 THEN '{EXACT_MATCH}'
                    WHEN {nulls} = 1 THEN '{NULL_MISMATCH}'
                    WHEN {same} THEN '{EXACT_MATCH}'
                    WHEN {a_number} IS NOT NULL AND {b_number} IS NOT NULL THEN '{NUMERIC}'
                    WHEN {nulls} = 0 THEN '{TEXT}' END"""


def variance_pct(kind: str, a_number: str, b_number: str) -> Column:
    """Percentage for a variance type; NULL for TEXT.

    Numbers differ in percent of the source value, or of the target value when the source is zero.
    """
    return F.expr(pct_sql(kind, a_number, b_number))


def pct_sql(kind: str, a_number: str, b_number: str) -> str:
    base = f"abs(if({a_number} = 0, {b_number}, {a_number}))"
    return f"""CASE {kind} WHEN '{EXACT_MATCH}' THEN 0D
                           WHEN '{NULL_MISMATCH}' THEN 100D
                           WHEN '{NUMERIC}' THEN if({base} = 0, 0D, abs({a_number} - {b_number}) / {base} * 100D) END"""


def exceeds(pct: str, threshold: float) -> str:
    """Condition: strictly above the threshold, and not NaN, which Spark orders above everything.

    NULL for a NULL percentage, which an `if` takes for not exceeding.
    """
    return f"({pct} > {float(threshold)!r}D AND NOT isnan({pct}))"
