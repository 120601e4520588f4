"""Calendar helpers. All dates are UTC dates."""

from __future__ import annotations

import calendar
import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F


def add_months(day: dt.date, n: int) -> dt.date:
    """Month shift with month-end clamp, for literal bounds."""
    y, m = divmod(day.year * 12 + day.month - 1 + n, 12)
    return dt.date(y, m + 1, min(day.day, calendar.monthrange(y, m + 1)[1]))


def month_start(day: dt.date) -> dt.date:
    return day.replace(day=1)


def analytics_range(as_of: dt.date, preset: str) -> tuple[dt.date, dt.date, dt.date]:
    """(start, end, previous start) of a preset period; end is exclusive.

    The previous window ``[previous start, start)`` has as many months.
    """
    first = month_start(as_of)
    if preset == "LAST_MONTH":
        return add_months(first, -1), first, add_months(first, -2)
    n = {"THIS_MONTH": 1, "LAST_3_MONTHS": 3, "LAST_6_MONTHS": 6}[preset]
    start = add_months(first, 1 - n)
    return start, add_months(first, 1), add_months(start, -n)


def spending_range(as_of: dt.date, preset: str) -> tuple[dt.date | None, dt.date]:
    """(start or None, exclusive end) of an explorer period ending today."""
    start = {
        "THIS_MONTH": month_start(as_of),
        "THREE_MONTHS": add_months(as_of, -3),
        "ONE_YEAR": add_months(as_of, -12),
        "TOTAL": None,
    }[preset]
    return start, as_of + dt.timedelta(days=1)


def whole_months(start: Column, end: Column) -> Column:
    """Completed calendar months from start to end (31 Jan to 28 Feb is 0)."""
    return F.timestamp_diff("MONTH", start.cast("timestamp"), end.cast("timestamp"))


def month_of(day: Column) -> Column:
    return F.trunc(day, "month")


def utc_date(millis: Column) -> Column:
    """Epoch milliseconds to the UTC date."""
    return F.date_from_unix_date(F.floor(millis / F.lit(86400000).cast("decimal(10,0)")).cast("int"))


def day_start_millis(day: Column) -> Column:
    return F.unix_date(day).cast("long") * F.lit(86400000).cast("long")


def clamp_date(year: Column, month: Column, day: Column) -> Column:
    """Date with the day clamped to the month's length."""
    first = F.make_date(year, month, F.lit(1))
    return F.make_date(year, month, F.least(day, F.dayofmonth(F.last_day(first))))
