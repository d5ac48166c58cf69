"""Vector search, text search, facets and sampling over articles."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsepress.functions.dates import seconds
from pulsepress.functions.scores import min_max
from pulsepress.functions.text import tag_tokens, tags_text
from pulsepress.functions.vectors import distance, distance_between
from pulsepress.operators.joins import first_per_key
from pulsepress.operators.ordering import nearest, page

# Weight of a term by the field it occurs in.
FIELD_WEIGHTS = {"tags": 3.0, "title": 2.0, "summary": 1.0}


def within_distance(
    df: DataFrame, query: Sequence[float], max_distance: float | None = None, metric: str = "cosine"
) -> DataFrame:
    """Rows with their ``distance`` to the query; rows without one are dropped by a threshold only."""
    measured = df.withColumn("distance", distance("embedding", query, metric))
    return measured if max_distance is None else measured.filter(F.col("distance") <= max_distance)


def nearest_rows(
    df: DataFrame,
    query: Sequence[float],
    limit: int = 0,
    offset: int = 0,
    max_distance: float | None = None,
    metric: str = "cosine",
    then: Sequence[Column] = (),
    key: str = "url",
) -> DataFrame:
    """Rows by distance. Filter the input first, so that only its rows are measured."""
    measured = within_distance(df, query, max_distance, metric)
    order = nearest(*(then or (F.col(key),)))
    return page(measured, order, limit, offset, key)


def search_items(
    items: DataFrame,
    query: Sequence[float],
    metric: str = "l2",
    max_distance: float | None = None,
    limit: int = 0,
    columns: Sequence[str] | None = None,
    id_column: str = "id",
) -> DataFrame:
    """Search of an id + embedding table; the distance comes last, as ``_distance``."""
    rows = nearest_rows(items, query, limit, 0, max_distance, metric, key=id_column)
    return rows.select(*(columns or items.columns), F.col("distance").alias("_distance"))


def rerank(top: DataFrame, column: str = "created", bounded: bool = True, key: str = "url") -> DataFrame:
    """Nearest rows re-ordered by a timestamp column scaled to 0..1, highest first.

    ``bounded`` says that ``top`` is the result of a limit, so one task can hold it; otherwise the
    range is aggregated first and used as a scalar subquery.
    """
    scored = top.withColumn("__value", seconds(column))
    if bounded:
        everything = Window.partitionBy()
        low, high = F.min("__value").over(everything), F.max("__value").over(everything)
        scored = scored.withColumn("relevance", min_max(F.col("__value"), low, high))
    else:
        span = scored.agg(F.struct(F.min("__value").alias("low"), F.max("__value").alias("high"))).scalar()
        scored = scored.withColumn("relevance", min_max(F.col("__value"), span["low"], span["high"]))
    return scored.drop("__value").orderBy(F.col("relevance").desc_nulls_last(), F.col(key))


def similar_to(
    articles: DataFrame,
    url: str,
    max_distance: float | None = None,
    limit: int = 0,
    offset: int = 0,
    condition: Column | None = None,
) -> DataFrame:
    """Articles near a stored one that share a tag with it; none when it has no embedding or tags.

    The stored row is one, as the url is the key of the table, so it goes to every task.
    """
    seed = (
        articles.filter((F.col("url") == url) & F.col("embedding").isNotNull())
        .select(F.col("embedding").alias("__seed"), tag_tokens().alias("__tags"))
        .limit(1)
    )
    others = articles.filter(F.col("url") != url)
    if condition is not None:
        others = others.filter(condition)
    shared = others.join(F.broadcast(seed), F.arrays_overlap(tag_tokens(), F.col("__tags")))
    measured = shared.withColumn("distance", distance_between("embedding", "__seed")).drop("__seed", "__tags")
    if max_distance is not None:
        measured = measured.filter(F.col("distance") <= max_distance)
    return page(measured, nearest(F.col("url")), limit, offset)


def query_terms(query: str | Sequence[str]) -> list[str]:
    """The different words of a query, lower-cased, in order."""
    text = query if isinstance(query, str) else " ".join(query)
    return list(dict.fromkeys(re.findall(r"[^\W_]+", text.lower())))


def text_search(articles: DataFrame, query: str | Sequence[str], rank_from: DataFrame | None = None) -> DataFrame:
    """Articles with any query term in tags, title or summary, with ``search_score``.

    The score adds, for each term, its rarity ``ln(1 + articles / articles with the term)`` times its
    weighted number of occurrences. Rarity is counted over ``rank_from`` (default: the articles
    given). Each article is scored where it is read; only the counts per term are shuffled.
    """
    terms = query_terms(query)
    if not terms:
        return articles.filter(F.lit(False)).withColumn("search_score", F.lit(0.0))
    alone = r"(?<![\p{L}\p{N}])(?:%s)(?![\p{L}\p{N}])" % "|".join(terms)
    corpus = _term_weights(articles if rank_from is None else rank_from, terms, alone)
    rarity = corpus.agg(
        F.array(
            *[
                F.log(1 + F.count(F.lit(1)) / F.nullif(F.count_if(F.col("__weights")[i] > 0), F.lit(0)))
                for i in range(len(terms))
            ]
        )
    ).scalar()
    # The test for any term stops at the first one; only its hits are counted in full.
    hits = articles.filter(reduce(or_, [F.coalesce(t.rlike(alone), F.lit(False)) for t in _texts().values()]))
    score = F.lit(0.0)
    for i in range(len(terms)):
        score = score + F.col("__weights")[i] * F.coalesce(rarity[i], F.lit(0.0))
    scored = _term_weights(hits, terms, alone).withColumn("search_score", score)
    return scored.select(*articles.columns, "search_score")


def _texts() -> dict[str, Column]:
    tags = tags_text("regions", "entities", "categories")
    return {"tags": F.lower(tags), "title": F.lower("title"), "summary": F.lower("summary")}


def _term_weights(articles: DataFrame, terms: Sequence[str], alone: str) -> DataFrame:
    """Articles with ``__weights``: the weighted number of occurrences of every term.

    One pass over a field keeps only the wanted terms that stand alone in it.
    """
    none = F.array().cast("array<string>")
    found = {
        f"__{name}": F.coalesce(F.regexp_extract_all(text, F.lit(alone), F.lit(0)), none)
        for name, text in _texts().items()
    }

    def weight(term: str) -> Column:
        counts = [
            F.size(F.filter(f"__{name}", lambda t: t == F.lit(term))) * F.lit(share)
            for name, share in FIELD_WEIGHTS.items()
        ]
        return counts[0] + counts[1] + counts[2]

    weights = F.array(*[weight(t) for t in terms])
    return articles.withColumns(found).withColumn("__weights", weights).drop(*found)


def by_search_score() -> list[Column]:
    return [F.col("search_score").desc(), F.col("url")]


def tag_counts(
    articles: DataFrame, field: str | Column, exclude: Sequence[str] = (), limit: int = 0, offset: int = 0
) -> DataFrame:
    """How many articles carry each tag of an array field, most frequent first."""
    tags = articles.select(F.explode(field).alias("tag"))
    if exclude:
        tags = tags.filter(~F.col("tag").isin(list(exclude)) | F.col("tag").isNull())
    counts = tags.groupBy("tag").agg(F.count(F.lit(1)).alias("articles"))
    return page(counts, [F.col("articles").desc(), F.col("tag")], limit, offset, key="tag")


def sample(df: DataFrame, size: int, seed: int = 0, key: str = "url") -> DataFrame:
    """A random sample of fixed size. Rows are drawn by a hash of key and seed, so a rerun of a lost
    task draws the same rows."""
    return df.orderBy(F.md5(F.concat_ws("#", F.col(key), F.lit(str(seed)))), F.col(key)).limit(size)


def first_of_each(df: DataFrame, groups: str | Sequence[str], order: Sequence[Column]) -> DataFrame:
    """For each field in turn, one row per value: the first by the order."""
    for field in [groups] if isinstance(groups, str) else groups:
        df = first_per_key(df, [field], list(order))
    return df


def match_and_page(
    df: DataFrame,
    condition: Column | None = None,
    groups: str | Sequence[str] | None = None,
    order: Sequence[Column] = (),
    offset: int = 0,
    limit: int = 0,
    columns: Sequence[str] | None = None,
    count: bool = False,
) -> DataFrame:
    """Filter, sort, first row per group, page, projection, and optionally the count of it all."""
    order = list(order) or [F.col("url")]
    rows = df if condition is None else df.filter(condition)
    if groups:
        rows = first_of_each(rows, groups, order)
    if count and not (limit or offset):
        return rows.agg(F.count(F.lit(1)).alias("total_count"))
    rows = page(rows, order, limit, offset)
    if count:
        return rows.agg(F.count(F.lit(1)).alias("total_count"))
    return rows.select(*columns) if columns else rows
