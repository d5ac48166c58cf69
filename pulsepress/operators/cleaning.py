"""Cleaning of incoming batches and checking them against the table layouts."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsepress import schemas
from pulsepress.functions.dates import timestamp
from pulsepress.functions.text import clean_author, count_words, strip
from pulsepress.operators.joins import first_per_key

# Texts that must not be empty when they are given.
NON_EMPTY = {"mentions": ["chatter_url", "url"], "publishers": ["source", "base_url"]}


def _stripped(batch: DataFrame, columns: Sequence[str]) -> DataFrame:
    return batch.withColumns({c: strip(c) for c in columns if c in batch.columns})


def _filled(batch: DataFrame, as_of, *columns: str) -> DataFrame:
    return batch.withColumns({c: F.coalesce(F.col(c), timestamp(as_of)) for c in columns})


def _given(*columns: str) -> Column:
    return reduce(and_, [F.col(c).isNotNull() for c in columns])


def clean_articles(batch: DataFrame, as_of, position: Column) -> DataFrame:
    """Stripped texts, word counts and default times; the last row of each url; required fields present.

    The last row by ``position`` counts even when an earlier one is complete.
    """
    texts = ["url", "kind", "source", "title", "summary", "content", "image_url"]
    rows = _stripped(batch.withColumn("__position", position), texts)
    rows = rows.withColumns(
        {
            "title_length": count_words("title"),
            "summary_length": count_words("summary"),
            "content_length": count_words("content"),
            "author": clean_author("author"),
        }
    )
    rows = _filled(rows, as_of, "created", "collected")
    lasts = first_per_key(rows, ["url"], [F.col("__position").desc()]).drop("__position")
    return lasts.filter(_given("title", "collected", "created", "source", "kind"))


def clean_publishers(batch: DataFrame, as_of, position: Column) -> DataFrame:
    texts = ["source", "base_url", "favicon", "rss_feed", "description", "site_name"]
    rows = _filled(_stripped(batch.withColumn("__position", position), texts), as_of, "collected")
    lasts = first_per_key(rows, ["source"], [F.col("__position").desc()]).drop("__position")
    return lasts.filter(_given("source", "base_url"))


def clean_mentions(batch: DataFrame) -> DataFrame:
    """Both addresses present and at least one of likes, comments and subscribers not zero."""
    rows = _stripped(batch, ["chatter_url", "url", "forum", "source"])
    signals = [F.coalesce(F.col(c), F.lit(0)) != 0 for c in ("likes", "comments", "subscribers")]
    return rows.filter(_given("chatter_url", "url") & reduce(or_, signals))


#: Text of a line that a reader could not parse; other rows have NULL there.
BROKEN = "__broken"


def checked(batch: DataFrame, table: str) -> DataFrame:
    """The batch with the table's columns by ``try_cast``, and ``problems`` naming the fields that do not fit.

    A field does not fit when a value cannot be cast, a required value is missing or empty, or a
    count is outside the unsigned 32-bit range. A line that could not be read is a problem of its own.
    Columns that the table lacks stay as they are, those that the batch lacks are NULL.
    """
    schema = schemas.TABLES[table]
    values, checks = [], []
    for field in schema:
        given = field.name in batch.columns
        raw = F.col(field.name) if given else F.lit(None)
        cast = raw.try_cast(field.dataType) if given else raw.cast(field.dataType)
        values.append(cast.alias(field.name))
        wrong = [raw.isNotNull() & cast.isNull()]
        if not field.nullable:
            wrong.append(cast.isNull())
        if field.name in NON_EMPTY.get(table, ()):
            wrong.append(F.coalesce(cast, F.lit("x")) == "")
        if isinstance(field.dataType, T.LongType):
            wrong.append(F.coalesce(cast, F.lit(0)).between(0, schemas.MAX_COUNT) == F.lit(False))
        checks.append(F.when(reduce(or_, wrong), F.lit(field.name)))
    if BROKEN in batch.columns:
        checks.append(F.when(F.col(BROKEN).isNotNull(), F.lit("broken line")))
    own = set(schema.fieldNames())
    extra = [F.col(f"`{f.name}`") for f in batch.schema if f.name not in own and f.dataType != T.NullType()]
    return batch.select(*values, *extra, F.array_compact(F.array(*checks)).alias("problems"))


def cast_to(batch: DataFrame, table: str) -> DataFrame:
    """The columns of the table and ``problems``, as ``checked`` has them."""
    return checked(batch, table).select(*schemas.TABLES[table].fieldNames(), "problems")


def rejects(bad: DataFrame, table: str, as_of) -> DataFrame:
    """Rows with problems in the layout of ``schemas.REJECTS``: what was given, as JSON, and why it was refused."""
    given = [c for c in bad.columns if c != "problems"]
    return bad.select(
        F.lit(table).alias("target"),
        timestamp(as_of).alias("at"),
        "problems",
        F.to_json(F.struct(*[F.col(f"`{c}`") for c in given])).alias("content"),
    )


def split_valid(batch: DataFrame, table: str) -> tuple[DataFrame, DataFrame]:
    """(rows that fit the table, rejected rows with their problems)."""
    checked = cast_to(batch, table)
    good = F.size("problems") == 0
    return checked.filter(good).drop("problems"), checked.filter(~good)
