"""P: filters of the query functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import AS_OF, FAR, check, day, joined, moment, rounded
from checks.sources import trends_of
from pulsepress.functions.text import tag_tokens
from pulsepress.operators.filters import (
    article_filter,
    keep_keys,
    lower_in,
    match_fields,
    matches_any_pattern,
    within_days,
)
from pulsepress.operators.search import within_distance
from pulsepress.plans.views import trending_view

OUT = "SELECT url, kind, source, strftime(created, '%Y-%m-%d %H:%M:%S.%f') AS created FROM articles WHERE "


def out(df):
    return df.select("url", "kind", "source", moment("created"))


def filtered(name, where, **filters):
    check(name, OUT + where)(lambda fx: out(fx.articles.filter(article_filter(**filters))))


URLS = ["doc://3", "doc://70", "doc://150", "doc://no such"]

filtered("p2_kind", "kind = 'blog'", kind="blog")
filtered("p3_created_from", "created >= TIMESTAMP '2024-01-10 00:00:40'", created="2024-01-10 00:00:40")
filtered(
    "p3_created_between",
    "created >= TIMESTAMP '2024-01-05 00:00:04' AND created <= TIMESTAMP '2024-01-12 00:00:41'",
    created=("2024-01-05 00:00:04", "2024-01-12 00:00:41"),
)
filtered("p4_collected_until", "collected <= TIMESTAMP '2024-01-20 00:00:00'", collected=(None, "2024-01-20"))
filtered("p6_categories", "list_has_any(categories, ['cat1', 'cat7', 'CAT2'])", categories=["cat1", "cat7", "CAT2"])
filtered("p7_regions", "list_has_any(regions, ['en', 'fr'])", regions=["en", "fr"])
filtered("p8_entities", "list_has_any(entities, ['Ent 3', 'Ent 9'])", entities=["Ent 3", "Ent 9"])
filtered(
    "p9_tags_any",
    "list_has_any(regions, ['de', 'Ent 1', 'cat3']) OR list_has_any(entities, ['de', 'Ent 1', 'cat3']) OR list_has_any(categories, ['de', 'Ent 1', 'cat3'])",
    tags=["de", "Ent 1", "cat3"],
)
filtered("p12_sources", "source IN ('src0', 'src5', 'nobody')", sources=["src0", "src5", "nobody"])
filtered(
    "p14_conditions",
    "(length(content) > 900) AND (author IS NOT NULL)",
    conditions=["length(content) > 900", "", "author IS NOT NULL"],
)


@check("p1_urls", OUT + "url IN ('doc://3', 'doc://70', 'doc://150', 'doc://no such')")
def _(fx):
    return out(fx.articles.filter(article_filter(urls=URLS)))


@check("p1_urls_long_list", OUT + "CAST(substr(url, 7) AS INT) BETWEEN 0 AND 4999")
def _(fx):
    return out(keep_keys(fx.articles, "url", [f"doc://{i}" for i in range(5000)]))


@check(
    "p5_updated",
    """SELECT url, strftime(updated, '%Y-%m-%d') AS updated FROM trending
       WHERE updated >= DATE '2024-01-20' AND updated <= DATE '2024-01-28'""",
)
def _(fx):
    view = trending_view(fx.articles, trends_of(fx))
    return view.filter(article_filter(updated=("2024-01-20", "2024-01-28"))).select("url", day("updated"))


@check("p10_tags_all", "SELECT url FROM tagged WHERE list_has_all(tags, ['en', 'ent', '4'])")
def _(fx):
    return fx.articles.filter(article_filter(tags=["EN", "Ent 4"], match="all")).select("url")


@check("p11_tag_tokens", "SELECT url, array_to_string(tags, '|') AS tags FROM tagged")
def _(fx):
    return fx.articles.select("url", joined(tag_tokens(), "tags"))


@check("p13_distance", f"SELECT url, round(distance, 6) AS distance FROM measured WHERE distance <= {FAR}")
def _(fx):
    return within_distance(fx.articles, fx.query_vector, FAR).select("url", rounded("distance"))


@check(
    "p15_match_fields",
    OUT + """kind <> 'news' AND source IN ('src1', 'src2', 'src9') AND embedding IS NULL
             AND created >= TIMESTAMP '2024-01-03 00:00:00' AND collected < TIMESTAMP '2024-01-29 00:00:00'""",
)
def _(fx):
    from datetime import datetime

    condition = match_fields(
        kind={"ne": "news"},
        source=["src1", "src2", "src9"],
        embedding={"exists": False},
        created={"gte": datetime(2024, 1, 3)},
        collected={"lt": datetime(2024, 1, 29)},
    )
    return out(fx.articles.filter(condition))


@check(
    "p16_patterns",
    OUT + "(regexp_matches(title, '(?i)^the ') OR regexp_matches(title, '(?i)[aeiou]{4}')) AND kind IN ('news', 'post')",
)
def _(fx):
    return out(
        fx.articles.filter(matches_any_pattern("title", ["^the ", "[aeiou]{4}"]) & lower_in("kind", ["NEWS", "Post"]))
    )


@check("p17_last_days", OUT + "created >= TIMESTAMP '2024-02-01 00:00:00' - INTERVAL 9 DAY")
def _(fx):
    return out(fx.articles.filter(within_days("created", AS_OF, 9)))


@check(
    "p17_last_days_updated",
    "SELECT url, strftime(updated, '%Y-%m-%d') AS updated FROM trends WHERE updated >= TIMESTAMP '2024-02-01 00:00:00' - INTERVAL 9 DAY",
)
def _(fx):
    return trends_of(fx).filter(within_days("updated", AS_OF, 9)).select("url", day("updated"))


@check(
    "f6_overlap",
    "SELECT url, coalesce(list_has_any(categories, ['cat1', 'cat2']), false) AS hit FROM articles",
)
def _(fx):
    from pulsepress.operators.filters import overlaps

    return fx.articles.select("url", F.coalesce(overlaps("categories", ["cat1", "cat2"]), F.lit(False)).alias("hit"))
