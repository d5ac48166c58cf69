"""Trend numbers from the merged states of days, against all snapshots at once."""

import os
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from pulsepress import ArticleStore
from pulsepress.plans import trends

AS_OF = "2024-02-01"
SCHEMA = "chatter_url string, url string, collected timestamp_ntz, likes long, comments long, subscribers long, shares long"


def _snapshots(seed, n=400):
    """Few posts, days and counts, so that ties, equal times, missing counts and times all occur."""
    draw = random.Random(seed)
    start = datetime(2024, 1, 1)
    return [
        (
            f"p{draw.randrange(25)}", f"doc://{draw.randrange(12)}",
            None if draw.random() < 0.05 else start + timedelta(days=draw.randrange(5), hours=draw.randrange(3)),
            draw.choice([None, 0, 1, 2, 3]), draw.choice([None, 0, 1, 2]), draw.randrange(5), draw.choice([None, 0, 2]),
        )
        for _ in range(n)
    ]


def _sums(df):
    return sorted(
        (r["url"], r["n"], r["likes"], r["comments"], r["subscribers"], str(r["collected"]))
        for r in df.groupBy("url").agg(
            F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in ("likes", "comments", "subscribers")], F.max("collected").alias("collected")
        ).collect()
    )


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_merged_states_equal_all_snapshots(rows, seed):
    data = _snapshots(seed)
    mentions = rows(SCHEMA, *data)
    whole = trends.counted_snapshots(mentions).withColumn("n", F.lit(1))
    days = sorted({x[2] and x[2].date() for x in data}, key=str)
    states = None
    for day in days:
        own = trends.post_states(rows(SCHEMA, *[x for x in data if (x[2] and x[2].date()) == day]))
        states = own if states is None else states.unionByName(own)
    merged = trends.counted_posts(states).withColumn("n", F.col("posts"))
    assert _sums(merged) == _sums(whole)
    counts = {r["collected_day"]: r["snapshots"] for r in trends.snapshots_per_day(states).collect()}
    assert counts == {d: sum((x[2] and x[2].date()) == d for x in data) for d in days}
    assert trends.post_states(mentions.limit(0)).count() == 0


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_optimize_reads_changed_days_only(spark, fx, tmp_path, monkeypatch):
    store = ArticleStore(spark, f"states_{os.path.basename(tmp_path).replace('-', '_')}", str(tmp_path))
    store.store_articles(fx.articles, AS_OF)
    store.store_related(fx.related)
    late = F.col("collected") >= F.expr("TIMESTAMP_NTZ '2024-01-20 00:00:00'")

    def whole():
        return trends.trend_aggregate(store.table("articles"), store.table("mentions"), store.table("related"), AS_OF)

    store.store_mentions(fx.mentions.filter(~late), AS_OF)
    store.optimize(AS_OF)
    assert _rows(store.table("trends")) == _rows(whole())
    read = []
    own = ArticleStore.refresh_states
    monkeypatch.setattr(ArticleStore, "refresh_states", lambda self: read.append(own(self)))
    # A new day and a late snapshot of an old one.
    store.store_mentions(fx.mentions.filter(late & F.expr("to_date(collected) = DATE '2024-01-21'")), AS_OF)
    store.store_mentions(fx.mentions.filter("to_date(collected) = DATE '2024-01-05'").limit(1).withColumn("likes", F.lit(999)), AS_OF)
    store.optimize(AS_OF)
    assert _rows(store.table("trends")) == _rows(whole())
    store.optimize(AS_OF, "20 days")
    assert _rows(store.table("trends")) == _rows(whole())
    assert read[0] == 2 and store.tables.days("post_states") == store.tables.days("mentions")
