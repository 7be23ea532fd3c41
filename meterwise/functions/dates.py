"""Periods: how they are written, the days and slices they hold, and windows that slide over them."""

from __future__ import annotations

import re
from calendar import monthrange
from datetime import UTC, date, datetime, timedelta

from dateutil import parser
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class UnparsableParameter(ValueError):
    """A date or a number of days that cannot be read."""


def _months_back(day: datetime, months: int) -> datetime:
    year, month = divmod(day.year * 12 + day.month - 1 - months, 12)
    return day.replace(year=year, month=month + 1, day=min(day.day, monthrange(year, month + 1)[1]))


def parse_date(text: str | None, now: datetime) -> datetime | None:
    """`Nd`: midnight N - 1 days ago, so 1d is today; `Nmo`, `Nmonth`, `Nmonths`: midnight N months ago; `Nm`: N minutes
    ago; else a date or time as people write it. A time with a zone is brought to UTC, one without is UTC."""
    if not text:
        return None
    midnight = now.replace(hour=0, minute=0, second=0, microsecond=0)
    if m := re.fullmatch(r"(-?\d+)(d|mo|months?|m)", text):
        n, unit = int(m[1]), m[2]
        return midnight - timedelta(days=n - 1) if unit == "d" else now - timedelta(minutes=n) if unit == "m" else _months_back(midnight, n)
    try:
        found = parser.parse(text, default=midnight)
    except (ValueError, OverflowError):
        raise UnparsableParameter(f"not a date: {text}") from None
    return found.astimezone(UTC).replace(tzinfo=None) if found.tzinfo else found


def parse_days(text: str | None) -> int:
    """`Nd`, `Nday`, `Ndays`, or months of 30 days: `Nmo`, `Nmonth`, `Nmonths`."""
    m = re.fullmatch(r"(-?\d+)(d|days?|mo|months?)", text or "")
    if not m:
        raise UnparsableParameter(f"not a number of days: {text}")
    return int(m[1]) * (30 if m[2].startswith("mo") else 1)


def parse_month(text: str | None, now: datetime) -> date:
    """The first day of `YYYY-MM`; of the month before this one if nothing is given."""
    if not text:
        return _months_back(now.replace(day=1), 1).date()
    try:
        return datetime.strptime(text, "%Y-%m").date()
    except ValueError:
        raise UnparsableParameter(f"not a month: {text}") from None


def period(month: date | None, since: date | None, until: date | None) -> tuple[date, date]:
    """The first and last day of a report."""
    if since is not None:
        return since, until or since
    if month is None:
        raise ValueError("give a month or a first day")
    return month.replace(day=1), month.replace(day=monthrange(month.year, month.month)[1])


def truncated(day: date, granularity: str) -> date:
    return day.replace(day=1) if granularity == "monthly" else day.replace(month=1, day=1) if granularity == "yearly" else day


def days_between(spark: SparkSession, start: date, end: date, granularity: str = "daily") -> DataFrame:
    """(day): the days, months or years from start to end, both included; only end if start isn't before it."""
    start, end = truncated(start, granularity), truncated(end, granularity)
    step = {"daily": "INTERVAL 1 DAY", "monthly": "INTERVAL 1 MONTH", "yearly": "INTERVAL 1 YEAR"}[granularity]
    start = min(start, end)
    return spark.range(1).select(F.explode(F.expr(f"sequence(DATE'{start}', DATE'{end}', {step})")).alias("day"))


def day_slices(spark: SparkSession, since: datetime | None, until: datetime, last: datetime | None = None, horizon: timedelta = timedelta(weeks=4)) -> DataFrame:
    """(slice_start, slice_end): up to the next midnight, then whole days, the last up to until.

    Without since the slices begin at the last gathered moment, but no longer ago than the horizon.
    """
    start = since if since is not None else max(last or until - horizon, until - horizon)
    if start >= until:
        return spark.range(0).select(F.lit(start).cast("timestamp_ntz").alias("slice_start"), F.lit(until).cast("timestamp_ntz").alias("slice_end"))
    first_day, last_moment = start.date(), until - timedelta(microseconds=1)
    midnights = F.explode(F.expr(f"sequence(TIMESTAMP_NTZ'{first_day} 00:00:00', TIMESTAMP_NTZ'{last_moment}', INTERVAL 1 DAY)")).alias("midnight")
    lower, upper = F.lit(start).cast("timestamp_ntz"), F.lit(until).cast("timestamp_ntz")
    return spark.range(1).select(midnights).select(F.greatest("midnight", lower).alias("slice_start"), F.least(F.expr("midnight + INTERVAL 1 DAY"), upper).alias("slice_end"))


def sliding_windows(spark: SparkSession, start: date, end: date, days: int) -> DataFrame:
    """(window_start, window_end): windows of so many days, one beginning on each day, that lie wholly within the days
    from start to end. A window ends a microsecond before the next day."""
    last = end - timedelta(days=days - 1)
    starts = f"sequence(TIMESTAMP_NTZ'{start} 00:00:00', TIMESTAMP_NTZ'{max(last, start)} 00:00:00', INTERVAL 1 DAY)"
    windows = spark.range(1 if last >= start else 0).select(F.explode(F.expr(starts)).alias("window_start"))
    return windows.select("window_start", F.expr(f"window_start + INTERVAL {days} DAY - INTERVAL 0.000001 SECOND").alias("window_end"))
