"""Dates and business days in closed form: no per-row sequences and no join."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

_MONDAY = dt.date(1969, 12, 29)


def _day(date: Column) -> Column:
    return F.datediff(date, F.lit(_MONDAY))


def is_weekend(date: Column) -> Column:
    return F.weekday(date) >= 5


def is_business_day(date: Column, holidays: Sequence[dt.date] = ()) -> Column:
    open_day = ~is_weekend(date)
    return open_day & ~date.isin(*holidays) if holidays else open_day


def business_ordinal(date: Column, holidays: Sequence[dt.date] = ()) -> Column:
    """Business days from a fixed Monday up to and including ``date``."""
    day = _day(date)
    total = F.floor(day / 7).cast("int") * 5 + F.least(F.pmod(day, F.lit(7)) + 1, F.lit(5))
    for h in sorted({h for h in holidays if h.weekday() < 5}):
        total = total - F.when(date >= F.lit(h), 1).otherwise(0)
    return total.cast("int")


def business_days_between(a: Column, b: Column, holidays: Sequence[dt.date] = ()) -> Column:
    """Business days after ``a`` up to ``b``; negative if ``b`` is earlier."""
    return business_ordinal(b, holidays) - business_ordinal(a, holidays)


def add_business_days(date: Column, n: Column, holidays: Sequence[dt.date] = ()) -> Column:
    """The ``n``-th business day after ``date``; ``date`` itself where ``n`` is not positive.

    The weekday is found in closed form; then each holiday on the way pushes the result on, in order.
    """
    target = business_ordinal(date) + n
    week = F.floor((target - 1) / 5)
    found = F.date_add(F.lit(_MONDAY), (week * 7 + F.pmod(target - 1, F.lit(5))).cast("int"))
    for h in sorted({h for h in holidays if h.weekday() < 5}):
        hit = (F.lit(h) > date) & (F.lit(h) <= found)
        next_day = F.date_add(found, F.when(F.weekday(found) >= 4, 7 - F.weekday(found)).otherwise(F.lit(1)))
        found = F.when(hit, next_day).otherwise(found)
    return F.when(n > 0, found).otherwise(date)


def week_bucket(as_of: Column, date: Column, weeks: int = 13) -> Column:
    """Whole weeks from ``as_of`` to ``date``, held between 0 and the last bucket."""
    return F.least(F.lit(weeks - 1), F.greatest(F.lit(0), F.floor(F.datediff(date, as_of) / 7))).cast("int")
