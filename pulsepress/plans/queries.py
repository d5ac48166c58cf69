"""Query entry points over the article tables.

A query with a limit first finds its page from the columns that filters and order need, and reads
the large text and vector columns for the articles of that page only. Articles may carry the day
column of a partitioned table; it limits what is read and never appears in a result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsepress.functions.dates import as_datetime
from pulsepress.operators.filters import all_of, article_filter, between, in_days, keep_keys, match_fields
from pulsepress.operators.ordering import latest, nearest, page, range_page, trending
from pulsepress.operators.search import within_distance
from pulsepress.plans.trends import related_of
from pulsepress.plans.views import aggregated_view, trending_view
from pulsepress.schemas import DAY, HEAVY_COLUMNS, PUBLISHER_COLUMNS, TREND_COLUMNS

# Largest page whose urls are looked up; beyond it a query reads all its columns at once.
PAGE_ROWS = 1000


def query_latest(
    articles: DataFrame,
    embedding: Sequence[float] | None = None,
    distance: float | None = None,
    limit: int = 0,
    offset: int = 0,
    columns: Sequence[str] | None = None,
    **filters,
) -> DataFrame:
    """Filtered articles, newest first; with an embedding nearest first, with their distance."""
    wanted = list(columns or _columns_of(articles))
    order = _order(latest(), embedding)
    measured = _measure(_filtered(articles, filters), embedding, distance)
    if not 0 < limit <= PAGE_ROWS:
        return page(measured, order, limit, offset).select(*_output(wanted, embedding))
    rows = _add_large(_page(measured, wanted, order, limit, offset), articles, wanted)
    return rows.repartition(1).sortWithinPartitions(*order).select(*_output(wanted, embedding))


def query_trending(
    articles: DataFrame,
    trends: DataFrame,
    embedding: Sequence[float] | None = None,
    distance: float | None = None,
    limit: int = 0,
    offset: int = 0,
    columns: Sequence[str] | None = None,
    **filters,
) -> DataFrame:
    """Filtered articles with trend numbers, highest score first."""
    wanted = list(columns or [*_columns_of(articles), *TREND_COLUMNS])
    order = _order(trending(), embedding)
    measured = _measure(_filtered(trending_view(articles, trends), filters), embedding, distance)
    if not 0 < limit <= PAGE_ROWS:
        return page(measured, order, limit, offset).select(*_output(wanted, embedding))
    rows = _add_large(_page(measured, wanted, order, limit, offset), articles, wanted)
    return rows.repartition(1).sortWithinPartitions(*order).select(*_output(wanted, embedding))


def query_aggregated(
    articles: DataFrame,
    trends: DataFrame,
    related: DataFrame,
    publishers: DataFrame,
    embedding: Sequence[float] | None = None,
    distance: float | None = None,
    limit: int = 0,
    offset: int = 0,
    columns: Sequence[str] | None = None,
    **filters,
) -> DataFrame:
    """Filtered articles with trend numbers, related urls and publisher details, newest first, one row each."""
    wanted = list(columns or [*_columns_of(articles), *TREND_COLUMNS, "related_urls", *PUBLISHER_COLUMNS])
    order = _order(latest(), embedding)
    if not 0 < limit <= PAGE_ROWS or filters.get("conditions"):
        # Conditions may name any column of the view, so it is built in full before the filter.
        view = aggregated_view(articles, trends, related, publishers)
        measured = _measure(_filtered(view, filters), embedding, distance)
        return page(measured, order, limit, offset).select(*_output(wanted, embedding))
    base = articles.join(trends.select("url", *TREND_COLUMNS), "url", "left")
    top = _page(_measure(_filtered(base, filters), embedding, distance), wanted, order, limit, offset)
    rows = _add_large(top, articles, wanted)
    if any(c in PUBLISHER_COLUMNS for c in wanted):
        # The page asks for few publishers, so the table of publishers stays where it is.
        names = top.select("source").distinct()
        asked = publishers.join(F.broadcast(names), "source", "left_semi").select("source", *PUBLISHER_COLUMNS)
        rows = rows.join(asked, "source", "left")
    if "related_urls" in wanted:
        lists = related_of(related.join(F.broadcast(top.select("url")), "url", "left_semi"))
        rows = rows.join(lists, "url", "left")
    return rows.repartition(1).sortWithinPartitions(*order).select(*_output(wanted, embedding))


def query_publishers(publishers, collected=None, sources=None, conditions=None, limit=0, offset=0, columns=None):
    """Filtered publishers, by source."""
    rows = publishers.filter(article_filter(collected=collected, sources=sources, conditions=conditions))
    return _columns(page(rows, [F.col("source")], limit, offset, key="source"), columns)


def query_mentions(mentions, collected=None, sources=None, conditions=None, limit=0, offset=0, columns=None):
    """Filtered snapshots. Without a page they come in no order, as in the table."""
    rows = _filtered(mentions, {"collected": collected, "sources": sources, "conditions": conditions})
    plain = _columns_of(mentions)
    if limit or offset:
        # Snapshots have no key: all their columns order them, so that what is left alike is alike.
        first = ["collected", "chatter_url"]
        order = [F.col(c) for c in [*first, *(c for c in plain if c not in first)]]
        rows = range_page(rows.select(*plain), order, limit, offset)
    return rows.select(*(columns or plain))


def query_aggregated_mentions(trends, urls=None, updated=None, limit=0, offset=0, columns=None):
    """Trend numbers of articles, highest score first."""
    rows = keep_keys(trends, "url", urls) if urls else trends
    rows = rows.filter(article_filter(updated=updated))
    return _columns(page(rows, trending(), limit, offset), columns)


def distinct_labels(reference: DataFrame, column: str, limit: int = 0, offset: int = 0) -> DataFrame:
    """Labels of a reference table, sorted."""
    return page(reference.select(column), [F.col(column)], limit, offset, key=column)


def distinct_elements(articles: DataFrame, column: str, name: str, limit: int = 0, offset: int = 0) -> DataFrame:
    """Different elements of an array column, sorted, NULL last."""
    values = articles.select(F.explode(column).alias(name)).distinct()
    return page(values, [F.col(name).asc_nulls_last()], limit, offset, key=name)


def distinct_publishers(publishers: DataFrame, limit: int = 0, offset: int = 0) -> DataFrame:
    return page(publishers.select("source"), [F.col("source")], limit, offset, key="source")


def count_rows(table: DataFrame, conditions: Sequence[str] | None = None) -> DataFrame:
    """One row with the number of rows that meet all conditions."""
    return table.filter(article_filter(conditions=conditions)).agg(F.count(F.lit(1)).alias("count"))


def get_article(articles: DataFrame, columns: Sequence[str] | None = None, **fields) -> DataFrame:
    """The article with the given field values; the first url when there are several."""
    return _columns(page(articles.filter(match_fields(**fields)), [F.col("url")], limit=1), columns)


def _columns_of(articles: DataFrame) -> list[str]:
    return [c for c in articles.columns if c != DAY]


def _filtered(rows: DataFrame, filters: dict) -> DataFrame:
    """All filters; bounds on the collection time also bound the days that are read."""
    collected = filters.get("collected")
    if collected and DAY in rows.columns:
        low, high = collected if isinstance(collected, (tuple, list)) else (collected, None)
        days = [bound and as_datetime(bound).date() for bound in (low, high)]
        rows = rows.filter(all_of(between(DAY, days, dates=True)))
    return rows.filter(article_filter(**filters))


def _order(base: list[Column], embedding) -> list[Column]:
    return nearest(*base) if embedding else base


def _measure(rows: DataFrame, embedding, distance) -> DataFrame:
    return within_distance(rows, embedding, distance) if embedding else rows


def _output(columns: Sequence[str], embedding) -> list[str]:
    return [*columns, *(["distance"] if embedding and "distance" not in columns else [])]


def _columns(rows: DataFrame, columns: Sequence[str] | None) -> DataFrame:
    return rows.select(*columns) if columns else rows


# Columns that orders and later joins of a page need.
_PAGE_COLUMNS = ("url", "source", "created", "updated", "trend_score", "distance", DAY)


def _page(rows: DataFrame, wanted, order, limit, offset) -> DataFrame:
    """The page without large columns, found here and now, as a local table of at most ``limit`` rows.

    Its plan runs once, whatever is joined to the page later, and the page stays the one that was
    found when rows are stored afterwards. Nothing stays cached.
    """
    narrow = [c for c in rows.columns if c in _PAGE_COLUMNS or (c in wanted and c not in HEAVY_COLUMNS)]
    top = page(rows.select(*narrow), order, limit, offset)
    return rows.sparkSession.createDataFrame(top.toArrow(), top.schema)


def _add_large(rows: DataFrame, articles: DataFrame, wanted) -> DataFrame:
    """The page with its large columns.

    The urls of a page are few, so they become a filter that parquet applies to its statistics and
    pages; days limit the folders. A join alone would read the large columns of all articles.
    """
    large = [c for c in HEAVY_COLUMNS if c in wanted]
    if not large:
        return rows
    days = [DAY] if DAY in rows.columns else []
    keys = rows.select("url", *days).collect()
    found = articles.filter(F.col("url").isin([k["url"] for k in keys]))
    if days:
        found = found.filter(in_days({k[DAY] for k in keys}))
    return found.select("url", *large).join(F.broadcast(rows), "url")
