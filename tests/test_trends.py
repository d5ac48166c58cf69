"""Trend numbers on small hand-written tables."""

from datetime import date, datetime

from pyspark.sql import functions as F

from pulsepress.plans import trends

MENTIONS = (
    "chatter_url string, url string, source string, forum string, collected timestamp_ntz,"
    " likes bigint, comments bigint, subscribers bigint, shares bigint"
)
ARTICLES = "url string, created timestamp_ntz"


def at(day, hour=0):
    return datetime(2024, 1, day, hour)


def post(name, url, when, likes, comments, subscribers=1, shares=0):
    return (name, url, "site", "forum", when, likes, comments, subscribers, shares)


def totals(df):
    return {r["url"]: (r["likes"], r["comments"], r["shares"], r["updated"]) for r in trends.mention_totals(df).collect()}


def test_post_counts_once_at_its_first_maximum(rows):
    m = rows(MENTIONS, post("p", "a", at(1), 1, 1), post("p", "a", at(2), 5, 3), post("p", "a", at(3), 5, 3))
    assert totals(m) == {"a": (5, 3, 1, date(2024, 1, 2))}


def test_post_whose_maxima_never_meet_is_dropped(rows):
    m = rows(MENTIONS, post("p", "a", at(1), 9, 1), post("p", "a", at(2), 5, 3), post("q", "a", at(1), 0, 0))
    assert totals(m) == {"a": (0, 0, 1, date(2024, 1, 1))}


def test_ties_in_time_count_twice_even_below_the_maximum(rows):
    m = rows(MENTIONS, post("p", "a", at(1), 5, 3), post("p", "a", at(1), 2, 1))
    assert totals(m) == {"a": (7, 4, 2, date(2024, 1, 1))}


def test_maxima_are_taken_over_all_articles_of_a_post(rows):
    m = rows(MENTIONS, post("p", "a", at(1), 5, 3), post("p", "b", at(2), 7, 4))
    assert totals(m) == {"b": (7, 4, 1, date(2024, 1, 2))}


def test_snapshots_without_time_or_counts(rows):
    m = rows(
        MENTIONS,
        post("p", "a", None, 5, 3),
        post("p", "a", at(4), 5, 3),
        post("q", "a", None, 2, 2),
        post("r", "a", at(1), None, 2),
        post("s", "b", at(1), 4, None),
        post("s", "b", at(2), 4, 4),
    )
    assert totals(m) == {"a": (5, 3, 1, date(2024, 1, 4)), "b": (4, 4, 1, date(2024, 1, 2))}


def test_first_at_maxima_equals_the_join_with_the_maxima(fx):
    joined = trends.snapshots_at_maxima(fx.mentions).groupBy("chatter_url").agg(F.min("collected").alias("collected"))
    direct = trends.first_at_maxima(fx.mentions)
    assert sorted(map(tuple, direct.collect())) == sorted(map(tuple, joined.collect()))


def test_score_needs_a_signal_and_a_known_age(rows):
    articles = rows(ARTICLES, ("a", at(1)), ("b", datetime(2024, 2, 3)), ("c", at(1)), ("late", datetime(2024, 2, 4)))
    m = rows(MENTIONS, post("p", "a", at(11), 4, 2), post("q", "c", at(5), 0, 0, 9), post("x", "gone", at(1), 3, 3))
    related = rows("url string, related_url string", ("b", "a"), ("late", "a"))
    result = {r["url"]: r for r in trends.trend_aggregate(articles, m, related, "2024-02-01").collect()}
    assert result.keys() == {"a", "b", "c", "late"}
    assert result["a"]["trend_score"] == (50 * 2 + 10 + 4) / 23
    assert result["a"]["updated"] == date(2024, 1, 11)
    assert result["b"]["trend_score"] is None
    assert result["c"]["shares"] == 1 and result["c"]["likes"] == 0
    assert result["late"]["trend_score"] == -100.0
    summed = trends.trend_aggregate(articles, m, related, "2024-02-01", shares="sum").collect()
    assert {r["url"] for r in summed} == {"a", "b", "late"}
    whole = trends.trend_aggregate(articles, m, related, "2024-02-01", whole_scores=True)
    assert {r["url"]: r["trend_score"] for r in whole.collect()}["a"] == 4.0


def test_one_post_with_most_of_the_rows(spark, rows):
    busy = spark.range(30000).selectExpr(
        "'hot' AS chatter_url", "concat('u', id % 7) AS url", "'s' AS source", "'f' AS forum",
        "TIMESTAMP_NTZ '2024-01-01' + INTERVAL '1' SECOND * CAST(id AS INT) AS collected",
        "id div 2 AS likes", "id div 2 AS comments", "1L AS subscribers", "0L AS shares",
    )
    rest = rows(MENTIONS, post("p", "u1", at(2), 3, 1))
    m = busy.unionByName(rest)
    got = totals(m)
    # The first snapshot with both maxima is row 29998, which names u3.
    assert got == {"u3": (14999, 14999, 1, date(2024, 1, 1)), "u1": (3, 1, 1, date(2024, 1, 2))}


def test_long_lists_come_in_parts(spark):
    pairs = spark.range(1000).selectExpr(
        "CASE WHEN id < 700 THEN 'hot' ELSE concat('u', id % 30) END AS url", "concat('r', id) AS related_url"
    )
    parts = trends.related_lists(pairs, limit=100).collect()
    hot = [r for r in parts if r["url"] == "hot"]
    assert len(hot) > 5 and max(len(r["related_urls"]) for r in hot) <= 100
    assert sorted(u for r in hot for u in r["related_urls"]) == sorted(f"r{i}" for i in range(700))
    rest = [r for r in parts if r["url"] != "hot"]
    assert len(rest) == 30 and all(r["related_part"] == 0 and len(r["related_urls"]) == 10 for r in rest)


def test_rollup_and_change(rows):
    m = rows(
        MENTIONS, post("p", "a", at(1), 1, 5), post("p", "a", at(9), 4, 2), post("q", "a", at(8), 2, 0), post("z", "b", at(9), 1, 1)
    )
    change = {r["url"]: r.asDict() for r in trends.mention_change(m, at(10), 2).collect()}
    assert change["a"]["likes"] == 6 and change["a"]["likes_change"] == 5
    assert change["a"]["comments_change"] == 0 and change["a"]["shares_change"] == 1
    assert change["b"]["shares_change"] == 1
    lists = {r["url"]: r["shared_in"] for r in trends.shared_in(m).collect()}
    assert lists == {"a": ["p", "q"], "b": ["z"]}


def test_parts_do_not_depend_on_the_join(spark, monkeypatch):
    from pulsepress.operators import joins

    pairs = spark.range(600).selectExpr(
        "CASE WHEN id < 400 THEN 'hot' ELSE concat('u', id % 20) END AS url", "concat('r', id) AS related_url"
    )
    once = {(r["url"], r["related_part"], tuple(r["related_urls"])) for r in trends.related_lists(pairs, limit=50).collect()}
    monkeypatch.setattr(joins, "fits_broadcast", lambda *a, **k: False)
    again = {(r["url"], r["related_part"], tuple(r["related_urls"])) for r in trends.related_lists(pairs, limit=50).collect()}
    assert once == again
