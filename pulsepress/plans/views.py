"""Joined views of articles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsepress.operators.joins import attach
from pulsepress.plans.trends import related_lists, related_of
from pulsepress.schemas import PUBLISHER_COLUMNS, TREND_COLUMNS


def trending_view(articles: DataFrame, trends: DataFrame) -> DataFrame:
    """Articles that have trend numbers, with those numbers."""
    return articles.join(trends.select("url", *TREND_COLUMNS), "url")


def aggregated_view(
    articles: DataFrame, trends: DataFrame, related: DataFrame, publishers: DataFrame, **list_options
) -> DataFrame:
    """All articles, one row each, with trend numbers, related urls and publisher details where there are any.

    Related urls that are too many for one row are NULL there; ``related`` still counts them, and
    ``related_lists`` has them in parts.
    """
    with_trends = articles.join(trends.select("url", *TREND_COLUMNS), "url", "left")
    with_related = with_trends.join(related_of(related, **list_options), "url", "left")
    return add_publishers(with_related, publishers)


def add_publishers(articles: DataFrame, publishers: DataFrame) -> DataFrame:
    return attach(articles, publishers.select("source", *PUBLISHER_COLUMNS), "source")


def related_articles(articles: DataFrame, ids: DataFrame) -> DataFrame:
    """Articles named by an array column of ids: (owner, articles' columns), by title per owner.

    ``ids`` holds ``owner`` and ``ids``; ids that are not stored are left out.
    """
    wanted = ids.select("owner", F.explode("ids").alias("url"))
    return wanted.join(articles, "url").orderBy("owner", "title", "url")


def register_views(spark, tables: dict[str, DataFrame]) -> None:
    """Temporary views of the given tables, of both joined views and of the related urls in parts, for ad-hoc SQL."""
    for name, table in tables.items():
        table.createOrReplaceTempView(name)
    if {"articles", "trends"} <= tables.keys():
        trending_view(tables["articles"], tables["trends"]).createOrReplaceTempView("trending_articles")
    if "related" in tables:
        related_lists(tables["related"]).createOrReplaceTempView("related_lists")
    if {"articles", "trends", "related", "publishers"} <= tables.keys():
        view = aggregated_view(*(tables[t] for t in ("articles", "trends", "related", "publishers")))
        view.createOrReplaceTempView("aggregated_articles")
