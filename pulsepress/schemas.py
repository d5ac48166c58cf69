"""Table layouts, keys and the fixed values shared by the whole library."""

from __future__ import annotations

from pyspark.sql import types as T

_STRINGS = T.ArrayType(T.StringType())
_VECTOR = T.ArrayType(T.FloatType())


def _table(required: str, **columns: T.DataType) -> T.StructType:
    needed = set(required.split())
    return T.StructType([T.StructField(name, kind, name not in needed) for name, kind in columns.items()])


ARTICLES = _table(
    "url created collected",
    url=T.StringType(),
    kind=T.StringType(),
    title=T.StringType(),
    author=T.StringType(),
    source=T.StringType(),
    image_url=T.StringType(),
    created=T.TimestampNTZType(),
    collected=T.TimestampNTZType(),
    summary=T.StringType(),
    content=T.StringType(),
    restricted_content=T.BooleanType(),
    embedding=_VECTOR,
    categories=_STRINGS,
    sentiments=_STRINGS,
    regions=_STRINGS,
    entities=_STRINGS,
)

PUBLISHERS = _table(
    "source base_url",
    source=T.StringType(),
    base_url=T.StringType(),
    site_name=T.StringType(),
    description=T.StringType(),
    favicon=T.StringType(),
    rss_feed=T.StringType(),
    collected=T.TimestampNTZType(),
)

MENTIONS = _table(
    "chatter_url url",
    chatter_url=T.StringType(),
    url=T.StringType(),
    source=T.StringType(),
    forum=T.StringType(),
    collected=T.TimestampNTZType(),
    likes=T.LongType(),
    comments=T.LongType(),
    subscribers=T.LongType(),
    shares=T.LongType(),
)

RELATED = _table("url related_url", url=T.StringType(), related_url=T.StringType())

TRENDS = _table(
    "url",
    url=T.StringType(),
    likes=T.LongType(),
    comments=T.LongType(),
    subscribers=T.LongType(),
    shares=T.LongType(),
    related=T.LongType(),
    updated=T.DateType(),
    trend_score=T.DoubleType(),
)

CATEGORIES_REF = _table("category", category=T.StringType(), embedding=_VECTOR)
SENTIMENTS_REF = _table("sentiment", sentiment=T.StringType(), embedding=_VECTOR)


def vector_items(id_column: str = "id") -> T.StructType:
    """Layout of an id + embedding table stamped with its insert time."""
    return _table(id_column, **{id_column: T.StringType(), "embedding": _VECTOR, "ts": T.TimestampType()})


TABLES = {
    "articles": ARTICLES,
    "publishers": PUBLISHERS,
    "mentions": MENTIONS,
    "related": RELATED,
    "trends": TRENDS,
    "categories_ref": CATEGORIES_REF,
    "sentiments_ref": SENTIMENTS_REF,
}

#: Rows that did not fit their table: which one, when, the fields, and the row as JSON.
REJECTS = _table("", target=T.StringType(), at=T.TimestampNTZType(), problems=_STRINGS, content=T.StringType())

KEYS = {"articles": ["url"], "publishers": ["source"], "related": ["url", "related_url"]}

# Large tables are laid out by the day a row was collected, so that date filters and retention
# touch whole partitions.
DAY_PARTITIONED = ("articles", "mentions")
DAY = "collected_day"

DIGEST_COLUMNS = ["url", "created", "summary"]
CONTENT_COLUMNS = ["url", "created", "source", "title", "content"]
HEAVY_COLUMNS = ("content", "summary", "embedding")
COUNT_COLUMNS = ("likes", "comments", "subscribers", "shares")
TREND_COLUMNS = ["updated", "comments", "shares", "likes", "subscribers", "related", "trend_score"]
PUBLISHER_COLUMNS = ["base_url", "site_name", "description", "favicon", "rss_feed"]

# Defaults and limits that results depend on.
CLUSTER_EPS = 0.3
RETENTION_WINDOW = "6 months"
NEAREST_LABELS = 2
MAX_COUNT = 4294967295
MAX_WORDS = 32767
CLEANUP_DAYS = 7
GENERATED_KIND = "AI Generated"
BLOCKED_AUTHORS = ["[no-author]", "noreply", "hidden", "admin", "isbpostadmin", "unknown", "anonymous"]

#: A day's posts at their peaks: highest counts of the day, and sums by article at the peak's time.
POST_STATES = _table(
    "",
    chatter_url=T.StringType(),
    url=T.StringType(),
    collected=T.TimestampNTZType(),
    likes=T.LongType(),
    comments=T.LongType(),
    subscribers=T.LongType(),
    shares=T.LongType(),
    posts=T.LongType(),
    most_likes=T.LongType(),
    most_comments=T.LongType(),
    **{DAY: T.DateType()},
)
