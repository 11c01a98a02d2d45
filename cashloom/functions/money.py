"""Money in minor units: exact parsing, rounding and formatting, all in built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_minor(text: Column) -> Column:
    """Decimal text to bigint minor units without floating point; digits past two decimals are cut off.

    Null for null and for text that is no decimal number.
    """
    t = F.trim(text)
    whole = F.regexp_extract(t, r"^-?(\d*)", 1)
    cents = F.substring(F.rpad(F.regexp_extract(t, r"\.(\d*)", 1), 2, "0"), 1, 2)
    value = F.try_to_number(F.concat(F.when(whole == "", "0").otherwise(whole), cents), F.lit("9" * 18))
    signed = F.when(t.startswith("-"), -value).otherwise(value).cast("bigint")
    return F.when(t.rlike(r"^-?(\d+(\.\d*)?|\.\d+)$"), signed)


def number_to_minor(value: Column) -> Column:
    """A double with two decimals to minor units, halves up."""
    return F.floor(value * 100 + 0.5).cast("bigint")


def round_half_up(value: Column) -> Column:
    """Nearest integer, halves toward positive infinity."""
    return F.floor(value + 0.5).cast("bigint")


def round3(value: Column) -> Column:
    return F.floor(value * 1000 + 0.5) / 1000


def truncated(a: Column, b: Column) -> Column:
    """Integer quotient, cut toward zero; exact for any bigint."""
    size = (F.abs(a) - F.pmod(F.abs(a), F.abs(b))).cast("decimal(38,0)") / F.abs(b).cast("decimal(20,0)")
    return F.when((a < 0) != (b < 0), -size).otherwise(size).cast("bigint")


def format_minor(amount: Column, currency: Column) -> Column:
    """Two decimals and a sign; thousands in the Indian grouping for INR, in threes otherwise."""
    size = F.abs(amount)
    cents = F.lpad(F.pmod(size, F.lit(100)).cast("string"), 2, "0")
    whole = ((size - F.pmod(size, F.lit(100))) / 100).cast("bigint").cast("string")
    head = F.substring(whole, F.lit(1), F.greatest(F.length(whole) - 3, F.lit(0)))
    tail = F.right(whole, F.lit(3))
    indian = F.when(F.length(whole) <= 3, whole).otherwise(
        F.concat(F.regexp_replace(head, r"\B(?=(\d{2})+(?!\d))", ","), F.lit(","), tail)
    )
    western = F.regexp_replace(whole, r"\B(?=(\d{3})+(?!\d))", ",")
    return F.concat(F.when(amount < 0, "-").otherwise(""), F.when(currency == "INR", indian).otherwise(western), F.lit("."), cents)


def percent(value: Column) -> Column:
    return F.format_string("%.1f%%", value * 100)
