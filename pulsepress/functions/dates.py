"""Dates and timestamps. "Now" is always an explicit ``as_of`` value, never the clock of an executor."""

from __future__ import annotations

from datetime import date, datetime, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F


def now_utc() -> datetime:
    """Current UTC time without a zone, for callers who want the wall clock as ``as_of``."""
    return datetime.now(timezone.utc).replace(tzinfo=None)


def as_datetime(value: date | datetime | str) -> datetime:
    if isinstance(value, str):
        value = datetime.fromisoformat(value)
    if isinstance(value, datetime):
        return value.astimezone(timezone.utc).replace(tzinfo=None) if value.tzinfo else value
    return datetime(value.year, value.month, value.day)


def timestamp(value: date | datetime | str) -> Column:
    """A zone-free timestamp literal; zoned values are moved to UTC first.

    Built from text, because a Python datetime literal would pass through the session time zone.
    """
    return F.lit(as_datetime(value).isoformat(sep=" ")).cast("timestamp_ntz")


def day(value: date | datetime | str) -> Column:
    return F.lit(as_datetime(value).date())


def days_before(as_of: date | datetime | str, days: int) -> Column:
    """The moment ``days`` days before ``as_of``."""
    return timestamp(as_of) - F.expr(f"INTERVAL '{int(days)}' DAY")


def window_start(as_of: date | datetime | str, window: str) -> Column:
    """First day still inside a window such as ``'6 months'`` or ``'15 days'`` before ``as_of``."""
    amount, unit = window.split()
    unit = unit.lower().rstrip("s")
    steps = {"day": 1, "week": 7}
    if unit in steps:
        return F.date_sub(day(as_of), int(amount) * steps[unit])
    months = {"month": 1, "year": 12}
    return F.add_months(day(as_of), -int(amount) * months[unit])


def day_text(column) -> Column:
    return F.date_format(column, "yyyy-MM-dd")


# Fixed value: RFC 3339 text of a UTC timestamp, whole seconds, numeric offset.
RFC3339_PATTERN = "yyyy-MM-dd'T'HH:mm:ss'+00:00'"


def rfc3339(column) -> Column:
    return F.date_format(column, RFC3339_PATTERN)


def seconds(column) -> Column:
    """Zone-free seconds since 1970 of a timestamp, with its fraction, as a double."""
    column = F.col(column) if isinstance(column, str) else column
    whole_days = F.unix_date(F.to_date(column)) * F.lit(86400.0)
    within = F.hour(column) * 3600 + F.minute(column) * 60 + F.extract(F.lit("SECOND"), column).cast("double")
    return whole_days + within
