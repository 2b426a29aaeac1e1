"""UTC date helpers shared by usage, budget, filter and event operators."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

BUCKET_PATTERNS = {"hour": "yyyy-MM-dd HH:00", "day": "yyyy-MM-dd", "month": "yyyy-MM"}


def bucket_label(ts: str | Column, granularity: str) -> Column:
    return F.date_format(ts, BUCKET_PATTERNS[granularity])


def _step(unit: str, n: Column | int) -> Column:
    n = F.lit(n) if isinstance(n, int) else n
    return {
        "hour": lambda: F.make_interval(hours=n),
        "day": lambda: F.make_interval(days=n),
        "week": lambda: F.make_interval(weeks=n),
        "month": lambda: F.make_interval(months=n),
    }[unit]()


def lookback_start(as_of: Column, unit: str, value: int) -> Column:
    """Start of the bucket ``value - 1`` units before the one holding ``as_of``."""
    return F.date_trunc(unit, as_of) - _step(unit, value - 1)


def period_start(as_of: Column, period: str) -> Column:
    """Start of the running budget period: day, ISO week (Monday) or month."""
    return F.date_trunc(period, as_of)


def next_period_start(as_of: Column, period: str) -> Column:
    return F.date_trunc(period, as_of) + _step(period, 1)


def period_start_by(as_of: Column, period: Column) -> Column:
    """``period_start`` where the period is itself a column."""
    return (
        F.when(period == "day", F.date_trunc("day", as_of))
        .when(period == "week", F.date_trunc("week", as_of))
        .when(period == "month", F.date_trunc("month", as_of))
    )


def bucket_series_column(as_of: Column, unit: str, value: int, granularity: str) -> Column:
    """Array of bucket starts from the lookback start to ``as_of``."""
    first = F.date_trunc(granularity, lookback_start(as_of, unit, value))
    return F.sequence(first, F.date_trunc(granularity, as_of), _step(granularity, 1))


CHART_BUCKETS = {"hour": 24, "day": 30, "month": 24}
#: Buckets a chart may ask for unless its caller says otherwise.
CHART_MOST = 2000


def _truncate(when: dt.datetime, unit: str) -> dt.datetime:
    when = when.replace(minute=0, second=0, microsecond=0)
    if unit in ("day", "month"):
        when = when.replace(hour=0)
    return when.replace(day=1) if unit == "month" else when


def bucket_count(unit: str, value: int, granularity: str, as_of: dt.datetime) -> int:
    """How many buckets a lookback covers at a granularity."""
    if unit == granularity:
        return value
    start = _truncate(as_of, unit)
    if unit == "month":
        months = start.year * 12 + start.month - 1 - (value - 1)
        start = start.replace(year=months // 12, month=months % 12 + 1)
    else:
        start -= dt.timedelta(**{f"{unit}s": value - 1})
    first, last = _truncate(start, granularity), _truncate(as_of, granularity)
    if granularity == "month":
        return (last.year - first.year) * 12 + last.month - first.month + 1
    return (last - first) // dt.timedelta(**{f"{granularity}s": 1}) + 1


def chart_granularity(unit: str, value: int, as_of: dt.datetime) -> str:
    """Coarsen hours to days and days to months once a chart would hold too many buckets."""
    if unit == "hour" and value > CHART_BUCKETS["hour"]:
        return "month" if bucket_count(unit, value, "day", as_of) > CHART_BUCKETS["day"] else "day"
    if unit == "day" and value > CHART_BUCKETS["day"]:
        return "month"
    return unit


def check_bucket_count(unit: str, value: int, granularity: str, as_of: dt.datetime, most: int = CHART_MOST) -> int:
    count = bucket_count(unit, value, granularity, as_of)
    if count > most:
        raise ValueError(f"{count} {granularity} buckets asked for, at most {most} are allowed")
    return count
