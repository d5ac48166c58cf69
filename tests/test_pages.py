"""Pages of the query functions against the same rows read at once."""

import pytest
from pyspark.sql import functions as F

from pulsepress.operators import ordering
from pulsepress.plans import queries, trends, views
from pulsepress.plans.trends import trend_aggregate


@pytest.fixture(scope="module")
def tables(spark, fx, tmp_path_factory):
    root = tmp_path_factory.mktemp("pages")
    made = {}
    for name in ("articles", "mentions", "related", "publishers"):
        getattr(fx, name).write.parquet(f"{root}/{name}")
        made[name] = spark.read.parquet(f"{root}/{name}")
    trend_aggregate(made["articles"], made["mentions"], made["related"], "2024-02-01").write.parquet(f"{root}/trends")
    made["trends"] = spark.read.parquet(f"{root}/trends")
    return made


CALLS = {
    "latest": lambda t, **o: queries.query_latest(t["articles"], **o),
    "trending": lambda t, **o: queries.query_trending(t["articles"], t["trends"], **o),
    "aggregated": lambda t, **o: queries.query_aggregated(t["articles"], t["trends"], t["related"], t["publishers"], **o),
}


@pytest.mark.parametrize("name", CALLS)
@pytest.mark.parametrize("columns", [None, ["url", "title"], ["url", "content", "embedding"]])
def test_page_is_a_slice_of_the_whole(tables, fx, name, columns):
    call = CALLS[name]
    for options in ({}, {"embedding": fx.query_vector, "kind": "news"}):
        whole = call(tables, columns=columns, **options)
        page = call(tables, columns=columns, limit=7, offset=5, **options)
        assert page.columns == whole.columns
        assert page.collect() == whole.collect()[5:12]


@pytest.mark.parametrize("conditions", [None, ["kind = 'news'"]])
def test_every_article_has_one_row(tables, fx, monkeypatch, conditions):
    for module in (queries, views):
        monkeypatch.setattr(module, "related_of", lambda related: trends.related_of(related, limit=4))
    columns = ["url", "related_urls", "related"]
    for more in ({}, {"embedding": fx.query_vector}):
        options = {"columns": columns, "conditions": conditions, **more}
        whole = CALLS["aggregated"](tables, **options).collect()
        assert len({r["url"] for r in whole}) == len(whole)
        for rows in (1000, 3):  # the page is looked up, or all is read at once
            monkeypatch.setattr(queries, "PAGE_ROWS", rows)
            assert CALLS["aggregated"](tables, limit=12, offset=5, **options).collect() == whole[5:17]
        assert CALLS["aggregated"](tables, offset=5, **options).collect() == whole[5:]
    # What does not fit a row is counted there and whole in the parts.
    parts = {}
    for r in trends.related_lists(tables["related"], limit=4).collect():
        parts.setdefault(r["url"], []).extend(r["related_urls"])
    long = [r for r in whole if r["related"] and r["related_urls"] is None]
    assert long and all(r["related"] == len(parts[r["url"]]) > 4 for r in long)
    assert all(sorted(parts[r["url"]]) == r["related_urls"] for r in whole if r["related_urls"] is not None)


def test_large_columns_are_read_for_the_page_only(tables):
    page = queries.query_trending(tables["articles"], tables["trends"], limit=4, columns=["url", "content"])
    plan = page._jdf.queryExecution().executedPlan().toString()
    reads = [line for line in plan.splitlines() if "FileScan" in line and "content" in line]
    assert len(reads) == 1 and "In(url" in reads[0]


def test_distance_is_part_of_the_result_only_with_a_vector(tables, fx):
    assert "distance" not in queries.query_latest(tables["articles"], limit=1).columns
    near = queries.query_latest(tables["articles"], fx.query_vector, 0.95, columns=["url"])
    assert near.columns == ["url", "distance"] and all(r["distance"] <= 0.95 for r in near.collect())


def test_conditions_see_every_column_of_the_view(tables):
    rows = CALLS["aggregated"](tables, conditions=["size(related_urls) > 3", "site_name = 'SRC9'"], limit=3)
    got = rows.collect()
    assert got and all(len(r["related_urls"]) > 3 and r["site_name"] == "SRC9" for r in got)


@pytest.mark.parametrize(("limit", "offset"), [(0, 180), (30, 175), (150, 20), (0, 1), (500, 0), (10, 500), (1, 199)])
def test_large_pages_are_cut_from_ranges(spark, fx, monkeypatch, limit, offset):
    monkeypatch.setattr(ordering, "TOP_ROWS", 10)
    rows = fx.articles.select("url", "created")
    whole = [r["url"] for r in rows.orderBy(*ordering.latest()).collect()]
    cut = ordering.page(rows, ordering.latest(), limit, offset)
    assert [r["url"] for r in cut.collect()] == whole[offset : offset + limit if limit else None]
    plan = cut._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan
    if offset < len(whole):
        assert "__range" in plan.split("PartitionFilters")[1]


def test_equal_rows_count_one_by_one(rows, monkeypatch):
    monkeypatch.setattr(ordering, "TOP_ROWS", 0)
    schema = "chatter_url string, url string, source string, collected timestamp_ntz, likes long"
    same = [("p", "u", None, None, 1)] * 30 + [("q", "u", "s", None, None)] * 3
    df = rows(schema, *same)
    for limit, offset in ((0, 5), (4, 28), (100, 0), (0, 33)):
        got = [tuple(r) for r in queries.query_mentions(df, limit=limit, offset=offset).collect()]
        assert got == same[offset : offset + limit if limit else None]
    assert ordering.range_page(df.limit(0), [F.col("url")], 0, 1).count() == 0


def test_a_page_keeps_its_rows_when_articles_are_added(spark, fx, tmp_path):
    path = str(tmp_path / "articles")
    fx.articles.filter("kind = 'news'").write.parquet(path)
    stored = spark.read.parquet(path)
    first = queries.query_latest(stored, limit=6, columns=["url", "content"])
    before = [r["url"] for r in stored.orderBy(*ordering.latest()).limit(6).select("url").collect()]
    fx.articles.filter("kind = 'blog'").write.mode("append").parquet(path)
    assert [r["url"] for r in first.collect()] == before
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == 0
