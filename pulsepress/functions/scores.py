"""Trend score, update date and min-max scaling."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pulsepress.functions.dates import day

# Weight of each signal in the trend score.
WEIGHTS = {"related": 100, "comments": 50, "shares": 10, "likes": 1}


def or_zero(column) -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(0))


def weighted_signals() -> Column:
    total = None
    for name, weight in WEIGHTS.items():
        term = F.col(name) * F.lit(weight)
        total = term if total is None else total + term
    return total


def trend_score(as_of, updated="updated", whole: bool = False) -> Column:
    """Weighted signals over the age in days, counted from two days after ``as_of``.

    NULL where the age would be zero. ``whole`` gives the integer-division form.
    """
    age = F.nullif(F.datediff(F.date_add(day(as_of), 2), F.col(updated)), F.lit(0))
    if whole:
        return F.call_function("div", weighted_signals(), age).cast("double")
    return weighted_signals().cast("double") / age


def has_signal() -> Column:
    """True where at least one scored signal is above zero."""
    return F.greatest(*[F.col(name) for name in WEIGHTS]) > 0


def updated_day(created, mentioned) -> Column:
    """The later of the creation day and the last mention day."""
    created_day = F.to_date(created)
    return F.greatest(created_day, F.coalesce(mentioned, created_day))


def min_max(value, low, high) -> Column:
    """Scaled to 0..1; all zeros when every value is equal."""
    spread = F.when(high == low, F.lit(1.0)).otherwise(high - low)
    return (value - low) / spread
