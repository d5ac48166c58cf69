"""Trend numbers of articles from snapshots of social posts and from related pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsepress.functions.dates import days_before
from pulsepress.functions.scores import has_signal, or_zero, trend_score, updated_day
from pulsepress.operators.joins import lists_in_parts, lists_per_key
from pulsepress.schemas import COUNT_COLUMNS, DAY, POST_STATES, TRENDS


def post_maxima(mentions: DataFrame) -> DataFrame:
    """Highest likes and highest comments of every post, over all articles it names."""
    return mentions.groupBy("chatter_url").agg(F.max("likes").alias("likes"), F.max("comments").alias("comments"))


def snapshots_at_maxima(mentions: DataFrame) -> DataFrame:
    """Snapshots that hold both maxima of their post."""
    return mentions.join(post_maxima(mentions), ["chatter_url", "likes", "comments"]).select(*mentions.columns)


def first_at_maxima(mentions: DataFrame) -> DataFrame:
    """(chatter_url, collected): the earliest snapshot of a post that holds both maxima.

    A snapshot holds both maxima exactly when its likes plus comments equal the sum of the maxima.
    So one aggregation finds the earliest snapshot with the largest sum, and the snapshots need no
    join with the maxima. Posts whose maxima never meet in one snapshot are dropped, and so are
    those without a time there.
    """
    both = F.col("likes") + F.col("comments")
    snapshot = F.struct((-both).alias("minus_both"), "collected")
    # The least of these structs has the largest sum and, among equal sums, the earliest time.
    per_post = mentions.groupBy("chatter_url").agg(
        (F.max("likes") + F.max("comments")).alias("wanted"),
        F.min(F.when(both.isNotNull() & F.col("collected").isNotNull(), snapshot)).alias("first"),
    )
    reached = per_post.filter(-F.col("first.minus_both") == F.col("wanted"))
    return reached.select("chatter_url", "first.collected")


def counted_snapshots(mentions: DataFrame) -> DataFrame:
    """Snapshots taken at the moment their post first held both maxima.

    The join is on post and time, so the snapshots of a busy post spread over all tasks.
    """
    return mentions.join(first_at_maxima(mentions), ["chatter_url", "collected"]).select(*mentions.columns)


def mention_totals(mentions: DataFrame, shares: str = "count") -> DataFrame:
    """Sums over the counted snapshots of every article; ``shares`` counts posts or sums the column."""
    counted = counted_snapshots(mentions)
    how = {"count": F.count("chatter_url"), "sum": F.sum("shares")}[shares]
    return counted.groupBy("url").agg(
        F.to_date(F.max("collected")).alias("updated"),
        F.sum("likes").alias("likes"),
        F.sum("comments").alias("comments"),
        F.sum("subscribers").alias("subscribers"),
        how.alias("shares"),
    )


def related_counts(related: DataFrame) -> DataFrame:
    return related.groupBy("url").agg(F.count(F.lit(1)).alias("related"))


def related_lists(related: DataFrame, **options) -> DataFrame:
    """Sorted related urls of every article, in parts for articles with very many."""
    return lists_in_parts(related, "url", "related_url", "related_urls", part="related_part", **options)


def related_of(related: DataFrame, **options) -> DataFrame:
    """One row for every article: its sorted related urls, NULL where they are too many for one row."""
    return lists_per_key(related, "url", "related_url", "related_urls", **options)


def active_urls(mentions: DataFrame, related: DataFrame, shares: str = "count") -> DataFrame:
    """Urls with counted posts or related articles, each once."""
    return mention_totals(mentions, shares).select("url").union(related_counts(related).select("url")).distinct()


def _share(shares: str) -> Column:
    return {"count": F.when(F.col("chatter_url").isNotNull(), 1).otherwise(0), "sum": F.col("shares")}[shares]


def trend_stats(articles: DataFrame, mentions: DataFrame, related: DataFrame, shares: str = "count") -> DataFrame:
    """Trend numbers before scoring, for stored articles that are active.

    Snapshots and related pairs are summed per url in one aggregation, which also finds the active
    urls, and the join with the articles reuses its partitioning.
    """
    posts = counted_snapshots(mentions).withColumn("shares", _share(shares))
    return _stats(articles, posts, related)


def _stats(articles: DataFrame, posts: DataFrame, related: DataFrame) -> DataFrame:
    none = F.lit(0).cast("bigint")
    posts = posts.select("url", "collected", "likes", "comments", "subscribers", "shares", none.alias("related"))
    pairs = related.select(
        "url",
        F.lit(None).cast("timestamp_ntz").alias("collected"),
        *[none.alias(c) for c in ("likes", "comments", "subscribers", "shares")],
        F.lit(1).alias("related"),
    )
    numbers = ["likes", "comments", "subscribers", "shares", "related"]
    active = posts.unionByName(pairs).groupBy("url").agg(
        F.to_date(F.max("collected")).alias("mentioned"), *[or_zero(F.sum(c)).alias(c) for c in numbers]
    )
    return active.join(articles.select("url", "created"), "url").select(
        "url", *numbers, updated_day(F.col("created"), F.col("mentioned")).alias("updated")
    )


def post_states(mentions: DataFrame) -> DataFrame:
    """What the trend numbers need of every day's snapshots, so that days can be merged; see ``POST_STATES``.

    For each day and post: its highest counts of the day and, where one snapshot holds both, the sums by
    article of the snapshots taken when that first was so. Higher counts on another day undo a peak, but no
    earlier snapshot can become one, so nothing else of a day is ever needed. Each day has a row without
    a post for the number of its snapshots.
    """
    rows = mentions.withColumn(DAY, F.to_date("collected")) if DAY not in mentions.columns else mentions
    both = F.col("likes") + F.col("comments")
    snapshot = F.struct((-both).alias("minus_both"), "collected")
    per_post = rows.groupBy(DAY, "chatter_url").agg(
        F.max("likes").alias("most_likes"),
        F.max("comments").alias("most_comments"),
        F.min(F.when(both.isNotNull() & F.col("collected").isNotNull(), snapshot)).alias("first"),
        F.count(F.lit(1)).alias("snapshots"),
    )
    wanted = F.col("most_likes") + F.col("most_comments")
    peak = F.when(-F.col("first.minus_both") == wanted, F.col("first.collected")).alias("collected")
    posts = per_post.select(DAY, "chatter_url", "most_likes", "most_comments", "snapshots", peak)
    # On post and time, like the counted snapshots, so that a busy post spreads.
    there = rows.groupBy("chatter_url", "collected", "url").agg(
        *[F.sum(c).alias(c) for c in COUNT_COLUMNS], F.count("chatter_url").alias("posts")
    )
    states = posts.join(there, ["chatter_url", "collected"], "left").drop("snapshots")
    per_day = posts.groupBy(DAY).agg(F.sum("snapshots").alias("posts"))
    return states.unionByName(per_day, allowMissingColumns=True).select(*POST_STATES.fieldNames())


def snapshots_per_day(states: DataFrame) -> DataFrame:
    """How many snapshots the states of every day were made from."""
    return states.filter(F.col("chatter_url").isNull() & F.col("most_likes").isNull()).groupBy(DAY).agg(
        F.sum("posts").alias("snapshots")
    )


def counted_posts(states: DataFrame, shares: str = "count") -> DataFrame:
    """Sums by article of the snapshots at the peaks that all days together leave, like ``counted_snapshots``."""
    of_posts = states.filter(F.col("chatter_url").isNotNull())
    both = F.col("most_likes") + F.col("most_comments")
    peak = F.when(both.isNotNull() & F.col("collected").isNotNull(), F.struct((-both).alias("minus_both"), "collected"))
    merged = of_posts.groupBy("chatter_url").agg(
        (F.max("most_likes") + F.max("most_comments")).alias("wanted"), F.min(peak).alias("first")
    )
    first = merged.filter(-F.col("first.minus_both") == F.col("wanted")).select("chatter_url", "first.collected")
    posts = of_posts.filter(F.col("url").isNotNull()).join(first, ["chatter_url", "collected"])
    return posts.withColumn("shares", F.col("posts") if shares == "count" else F.col("shares"))


def trends_from_states(
    articles: DataFrame, states: DataFrame, related: DataFrame, as_of, shares: str = "count", whole_scores: bool = False
) -> DataFrame:
    """The trend table from the states of days instead of the snapshots; the same rows as ``trend_aggregate``."""
    return _scored(_stats(articles, counted_posts(states, shares), related), as_of, whole_scores)


def trend_aggregate(
    articles: DataFrame,
    mentions: DataFrame,
    related: DataFrame,
    as_of,
    shares: str = "count",
    whole_scores: bool = False,
) -> DataFrame:
    """The trend table: one row per stored article with at least one scored signal."""
    return _scored(trend_stats(articles, mentions, related, shares), as_of, whole_scores)


def _scored(stats: DataFrame, as_of, whole_scores: bool) -> DataFrame:
    scored = stats.filter(has_signal()).withColumn("trend_score", trend_score(as_of, "updated", whole_scores))
    return scored.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in TRENDS])


def mention_rollup(mentions: DataFrame, as_of=None, days_ago: int = 0, urls=None) -> DataFrame:
    """Totals of the highest counts of each post, per article.

    ``days_ago`` leaves out snapshots taken later than that many days before ``as_of``. Every post
    counts as one share. The posts themselves are listed by ``shared_in``.
    """
    posts = _per_post(mentions, as_of, days_ago, urls)
    return posts.groupBy("url").agg(
        F.sum("likes").alias("likes"),
        F.sum("comments").alias("comments"),
        F.count(F.lit(1)).alias("shares"),
        F.max("collected").alias("collected"),
    )


def shared_in(mentions: DataFrame, as_of=None, days_ago: int = 0, urls=None, **options) -> DataFrame:
    """Sorted post urls of every article, in parts for articles with very many."""
    posts = _per_post(mentions, as_of, days_ago, urls)
    return lists_in_parts(posts, "url", "chatter_url", "shared_in", part="shared_part", **options)


def _per_post(mentions: DataFrame, as_of, days_ago: int, urls) -> DataFrame:
    if urls:
        mentions = mentions.filter(F.col("url").isin([urls] if isinstance(urls, str) else list(urls)))
    if days_ago:
        mentions = mentions.filter(F.col("collected") < days_before(as_of, days_ago))
    return mentions.groupBy("url", "chatter_url").agg(
        F.max("likes").alias("likes"), F.max("comments").alias("comments"), F.max("collected").alias("collected")
    )


def mention_change(mentions: DataFrame, as_of, days: int = 1) -> DataFrame:
    """Current totals and how much they grew over the last ``days`` days."""
    counts = ["likes", "comments", "shares"]
    before = mention_rollup(mentions, as_of, days).select("url", *[F.col(c).alias(f"{c}_before") for c in counts])
    joined = mention_rollup(mentions).join(before, "url", "left")
    changes = [(F.col(c) - or_zero(f"{c}_before")).alias(f"{c}_change") for c in counts]
    return joined.select("url", *counts, "collected", *changes)
