"""Row filters of the query functions. A filter that is not given keeps every row."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from datetime import date, datetime
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsepress.functions.dates import as_datetime, day, days_before, timestamp
from pulsepress.functions.text import tag_tokens, tokens
from pulsepress.operators.joins import small_or_shuffled
from pulsepress.schemas import DAY

Moment = date | datetime | str
IN_LIST_LIMIT = 1000


def all_of(conditions: Iterable[Column]) -> Column:
    return reduce(and_, conditions, F.lit(True))


def between(column: str, bounds: Moment | Sequence[Moment | None], dates: bool = False) -> list[Column]:
    """One moment means "from"; a pair is inclusive at both ends and either end may be open."""
    low, high = bounds if isinstance(bounds, (tuple, list)) else (bounds, None)
    literal = timestamp
    if dates:
        literal = lambda m: day(m) if as_datetime(m).time() == datetime.min.time() else timestamp(m)
    conditions = []
    if low is not None:
        conditions.append(F.col(column) >= literal(low))
    if high is not None:
        conditions.append(F.col(column) <= literal(high))
    return conditions


def overlaps(column: str, values: Sequence[str]) -> Column:
    return F.arrays_overlap(F.col(column), F.array(*[F.lit(v) for v in values]))


def tags_any(tags: Sequence[str]) -> Column:
    """A tag equals a region, an entity or a category."""
    return reduce(or_, [F.coalesce(overlaps(c, tags), F.lit(False)) for c in ("regions", "entities", "categories")])


def tags_all(tags: Sequence[str]) -> Column:
    """Every token of every tag occurs among the tag tokens, in any case."""
    wanted = tokens(F.lit(" ".join(tags)))
    return F.size(F.array_except(wanted, tag_tokens())) == 0


def article_filter(
    *,
    urls: Sequence[str] | None = None,
    kind: str | None = None,
    created=None,
    collected=None,
    updated=None,
    categories: Sequence[str] | None = None,
    regions: Sequence[str] | None = None,
    entities: Sequence[str] | None = None,
    tags: Sequence[str] | None = None,
    match: str = "any",
    sources: Sequence[str] | None = None,
    conditions: Sequence[str] | None = None,
) -> Column:
    """All given filters, ANDed. ``match`` chooses how tags compare: "any" element or "all" tokens."""
    parts: list[Column] = []
    if urls:
        parts.append(F.col("url").isin(list(urls)))
    if kind:
        parts.append(F.col("kind") == kind)
    if created:
        parts += between("created", created)
    if collected:
        parts += between("collected", collected)
    if updated:
        parts += between("updated", updated, dates=True)
    for column, values in (("categories", categories), ("regions", regions), ("entities", entities)):
        if values:
            parts.append(overlaps(column, values))
    if tags:
        parts.append(tags_all(tags) if match == "all" else tags_any(tags))
    if sources:
        parts.append(F.col("source").isin(list(sources)))
    parts += [F.expr(c) for c in conditions or () if c]
    return all_of(parts)


def in_days(days: Iterable[date | None]) -> Column:
    """Rows of the given days of a partitioned table, None being the rows without one."""
    days = set(days)
    condition = F.col(DAY).isin(sorted(d for d in days if d is not None))
    return condition | F.col(DAY).isNull() if None in days else condition


def keep_keys(df: DataFrame, column: str, values: Sequence[str]) -> DataFrame:
    """Rows whose column is in a list; a long list becomes a semi join instead of an expression."""
    values = list(dict.fromkeys(values))
    if len(values) <= IN_LIST_LIMIT:
        return df.filter(F.col(column).isin(values))
    wanted = df.sparkSession.createDataFrame([(v,) for v in values], f"{column} string")
    return df.join(small_or_shuffled(wanted), column, "left_semi")


def match_fields(**conditions) -> Column:
    """Filter from a field-to-value mapping: a value means equal, a list means any of.

    A mapping value may hold the tests ``ne``, ``lt``, ``gte`` and ``exists``, which must all hold.
    """
    tests = {
        # A missing field also differs from the value.
        "ne": lambda c, v: ~c.eqNullSafe(F.lit(v)),
        "lt": lambda c, v: c < _literal(v),
        "gte": lambda c, v: c >= _literal(v),
        "exists": lambda c, v: c.isNotNull() if v else c.isNull(),
    }
    parts = []
    for name, wanted in conditions.items():
        column = F.col(name)
        if isinstance(wanted, dict):
            parts += [tests[test](column, value) for test, value in wanted.items()]
        elif isinstance(wanted, (list, tuple)):
            parts.append(column.isin(list(wanted)))
        else:
            parts.append(column == _literal(wanted))
    return all_of(parts)


def _literal(value) -> Column:
    return timestamp(value) if isinstance(value, (date, datetime)) else F.lit(value)


def matches_any_pattern(column: str, patterns: str | Sequence[str]) -> Column:
    """Case-insensitive regular expression found anywhere; any of several."""
    patterns = [patterns] if isinstance(patterns, str) else patterns
    return reduce(or_, [F.col(column).rlike(f"(?i){p}") for p in patterns])


def lower_in(column: str, values: str | Sequence[str]) -> Column:
    """Equal to the lower-case form of a value, or of any of several."""
    values = [values] if isinstance(values, str) else values
    return F.col(column).isin([v.lower() for v in values if v])


def within_days(column: str, as_of: Moment, days: int) -> Column:
    return F.col(column) >= days_before(as_of, days)
