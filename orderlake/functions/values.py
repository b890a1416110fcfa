"""Typing of text cells. User text is never cast without a guard: ANSI mode
would fail the job on the first bad cell."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from orderlake.functions.text import strip
from orderlake.schema import MONEY

# Signed decimal with an optional exponent, in plain spaces. Keeps out currency
# signs, thousands separators, type suffixes, "nan" and "inf", some of which a
# cast would accept.
NUMBER = r"^[\t-\r ]*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?[\t-\r ]*\z"

# An order number that is clean already; most are, and short enough to be exact.
CLEAN_NUMBER = r"^[1-9][0-9]{0,14}\z"


def to_money(c: Column) -> Column:
    """Exact decimal amount, NULL where the text is not a number."""
    return F.when(c.rlike(NUMBER), c).try_cast(MONEY)


def to_number(c: Column) -> Column:
    """Finite double, NULL where the text is not a number."""
    value = F.when(c.rlike(NUMBER), c).try_cast("double")
    return F.when(F.abs(value) < float("inf"), value)


def to_date(c: Column, formats: Sequence[str] = ("M/d/yyyy",)) -> Column:
    """First format that reads the text, so the result does not depend on the
    other rows; NULL where none does."""
    return F.coalesce(*[F.try_to_timestamp(c, F.lit(f)) for f in formats]).cast("date")


def clean_order_number(c: Column) -> Column:
    """Integer text without a decimal part or leading zeros; blank if not a number."""
    text = strip(c)
    value = F.when(text.rlike(NUMBER), text).try_cast("double")
    # Past the range of a long the digits come from the decimal form.
    cleaned = F.coalesce(
        value.try_cast("bigint").cast("string"),
        value.try_cast("decimal(38,0)").cast("string"),
        F.lit(""),
    )
    return F.when(c.rlike(CLEAN_NUMBER), c).otherwise(cleaned)


def month_of(c: Column) -> Column:
    return F.trunc(c, "month")
