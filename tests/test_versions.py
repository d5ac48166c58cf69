"""Changes of stored tables that end early, the word index beside the articles."""

import os

import pytest
from pyspark.sql import functions as F

from pulsepress import ArticleStore, schemas
from pulsepress.operators import text_index
from pulsepress.operators.search import text_search
from pulsepress.sources import folders

AS_OF = "2024-02-01"


@pytest.fixture
def store(spark, fx, tmp_path):
    store = ArticleStore(spark, f"kept_{os.path.basename(tmp_path).replace('-', '_')}", str(tmp_path))
    store.store_articles(fx.articles.limit(40), AS_OF)
    return store


class Ended(Exception):
    pass


def _ends(monkeypatch, tables, step, after=False):
    """The named step of the tables ends the run, before or after it is done."""
    own = getattr(tables, step)

    def end(*args, **options):
        if after:
            own(*args, **options)
        raise Ended

    monkeypatch.setattr(tables, step, end)


def _keys(store, table, *columns):
    return sorted(tuple(r) for r in store.table(table).select(*columns).collect())


@pytest.mark.parametrize(("step", "after", "new"), [("_write", True, False), ("_point", False, False), ("_point", True, True)])
def test_replace_ended_early(store, rows, monkeypatch, step, after, new):
    old = [("a", "b"), ("a", "c"), ("b", "a")]
    store.store_related(rows("url string, related_url string", *old))
    before = store.tables.read("related")
    _ends(monkeypatch, store.tables, step, after)
    with pytest.raises(Ended):
        store.tables.replace("related", rows("url string, related_url string", ("x", "y")))
    monkeypatch.undo()
    want = [("x", "y")] if new else old
    again = ArticleStore(store.spark, store.tables.database)
    assert _keys(again, "related", "url", "related_url") == want
    # Who read the old version goes on; then everything left over goes, and no row with it.
    assert before.count() == 3
    assert again.tables.vacuum(hours=0) == (0 if new else 1)
    assert again.tables.vacuum(hours=24) == 0
    assert _keys(again, "related", "url", "related_url") == want
    assert again.tables.replace("related", again.tables.read("related").limit(1)) == 1
    assert again.store_related(rows("url string, related_url string", ("n", "m"))) == 1
    assert len(_keys(again, "related", "url", "related_url")) == 2


@pytest.mark.parametrize(
    ("step", "after", "moved"),
    [("_write", True, False), ("_note", False, False), ("_note", True, True), ("overwrite_days", True, True), ("_drop_day", False, True)],
)
def test_moved_rows_after_an_early_end(store, monkeypatch, step, after, moved):
    urls = _keys(store, "articles", "url")
    news = store.table("articles").filter("kind = 'news'").select("url")
    n = news.count()
    batch = news.withColumn("collected", F.expr("TIMESTAMP_NTZ '2024-01-20 00:00:00'"))
    target = store.table("articles").filter("to_date(collected) = DATE '2024-01-20'").count()
    already = store.table("articles").filter("kind = 'news' AND to_date(collected) = DATE '2024-01-20'").count()
    _ends(monkeypatch, store.tables, step, after)
    with pytest.raises(Ended):
        store.update_articles(batch)
    monkeypatch.undo()
    again = ArticleStore(store.spark, store.tables.database)
    again.tables.vacuum(hours=0)
    assert _keys(again, "articles", "url") == urls
    there = again.table("articles").filter("to_date(collected) = DATE '2024-01-20'").count()
    assert there == (target + n - already if moved else target)
    assert again.tables.recover() == 0


def test_vacuum_leaves_no_folder_but_the_live_ones(store, rows):
    for i in range(3):
        store.tables.replace("publishers", rows("source string, base_url string", (f"s{i}", "b")).select(
            *[F.col(f.name) if f.name in ("source", "base_url") else F.lit(None).cast(f.dataType).alias(f.name) for f in schemas.PUBLISHERS]
        ))
    store.update_articles(store.table("articles").select("url", F.lit("t").alias("title")))
    store.tables.vacuum(hours=0)
    left = [p for group, _ in folders.children(store.spark, store.tables._folder) if group.endswith(".versions") for p, _ in folders.children(store.spark, group)]
    assert len(left) == 1 and folders.same(store.spark, left[0], store.tables._location("publishers"))
    assert _keys(store, "publishers", "source") == [("s2",)]


QUERY = "anea the retion"


def _found(df):
    return sorted((r["url"], round(r["search_score"], 9)) for r in df.select("url", "search_score").collect())


def test_word_index_follows_the_articles(store, fx, spark):
    def check():
        articles = store.tables.read("articles")
        got = store.search_text(QUERY, limit=0)
        assert _found(got) == _found(text_search(store.table("articles"), QUERY))
        assert store.refresh_text_index() == 0
        return articles

    assert store.build_text_index() > 0
    check()
    assert store.store_articles(fx.articles.limit(60), AS_OF) == 20
    check()
    changes = store.table("articles").limit(3).select("url", F.lit("retion retion other").alias("title"))
    assert store.update_articles(changes) == 3
    check()
    moved = store.table("articles").filter("kind = 'news'").select("url", F.expr("TIMESTAMP_NTZ '2024-01-20 00:00:00'").alias("collected"))
    store.update_articles(moved)
    check()
    store.optimize(AS_OF, "20 days")
    check()
    best = store.search_text(QUERY, limit=2, columns=["url", "title"], kind="news")
    assert best.columns == ["url", "title", "search_score"]
    want = text_search(store.table("articles").filter("kind = 'news'"), QUERY, rank_from=store.table("articles"))
    want = want.orderBy(F.desc("search_score"), "url").limit(2)
    assert [r["url"] for r in best.collect()] == [r["url"] for r in want.collect()]


def test_word_index_catches_up(store, fx, monkeypatch):
    store.build_text_index()
    append = store.tables.append

    def ends(table, *args, **options):
        if table == "postings":
            raise Ended
        return append(table, *args, **options)

    monkeypatch.setattr(store.tables, "append", ends)
    with pytest.raises(Ended):
        store.store_articles(fx.articles.limit(60), AS_OF)
    monkeypatch.undo()
    assert store.refresh_text_index() > 0
    assert _found(store.search_text(QUERY, limit=0)) == _found(text_search(store.table("articles"), QUERY))


def test_search_opens_the_folders_of_its_words_only(fx):
    scores = text_index.search_scores(fx.text_index, ["anea", "retion"])
    plan = scores._jdf.queryExecution().executedPlan().toString()
    assert "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "term" in plan.split("PushedFilters: [")[1].split("]")[0]
    one = text_index.bucket_of(F.lit("anea"))
    files = fx.text_index.filter(F.col("bucket") == one).select("_metadata.file_path").distinct().count()
    assert files < fx.text_index.select("_metadata.file_path").distinct().count() / 4
    assert text_index.search_scores(fx.text_index, " ,").count() == 0


def test_postings_of_odd_articles(rows):
    schema = "url string, title string, summary string, regions array<string>, entities array<string>, categories array<string>, collected timestamp_ntz"
    moment = __import__("datetime").datetime(2024, 1, 2)
    df = rows(
        schema, ("a", "One one", None, None, ["Two", None], [], moment), ("b", None, "", None, None, None, moment),
        (None, "one", "one", None, None, None, moment), ("c", "ÜBER-one", "x", ["one"], None, None, None),
    )
    got = text_index.postings(df, buckets=4).collect()
    words = {(r["term"], r["url"]): r["weight"] for r in got if r["term"]}
    assert words == {
        ("one", "a"): 4.0, ("two", "a"): 3.0, ("über", "c"): 2.0, ("one", "c"): 5.0, ("x", "c"): 1.0,
    }
    totals = sorted((str(r[schemas.DAY]), r["bucket"], r["weight"]) for r in got if not r["term"])
    assert totals == [*[("2024-01-02", i, 2.0) for i in range(4)], *[("None", i, 1.0) for i in range(4)]]
    assert text_index.postings(df.limit(0)).count() == 0


def test_postings_of_many_articles_a_day_and_of_repeated_urls(rows, monkeypatch):
    monkeypatch.setattr(text_index, "ARTICLES", 3, raising=False)
    monkeypatch.setattr(text_index, "ROWS", 4, raising=False)
    schema = "url string, title string, summary string, regions array<string>, entities array<string>, categories array<string>, collected timestamp_ntz"
    day = __import__("datetime").datetime
    words = ["one", "two", "three", "four", "fünf"]
    articles = [
        (f"u{i % 29}", " ".join(words[: i % 4]), " ".join(words[j % 5] for j in range(i % 13)), [words[i % 5]], None, None, (day(2024, 1, 2 + i % 2), None)[i % 7 == 0])
        for i in range(80)
    ]
    want, days = {}, {}
    for url, title, summary, regions, _, _, at in articles:
        days[at and at.date()] = days.get(at and at.date(), 0) + 1
        for weight, found in ((3.0, regions), (2.0, title.split()), (1.0, summary.split())):
            for term in found:
                key = (term, url, at and at.date())
                want[key] = want.get(key, 0.0) + weight
    index = text_index.postings(rows(schema, *articles), buckets=4)
    plan = index._jdf.queryExecution().executedPlan().toString()
    got = index.collect()
    assert index.columns == text_index.POSTINGS.names
    assert sorted(map(str, ((r["term"], r["url"], r[schemas.DAY], r["weight"]) for r in got if r["term"]))) == sorted(map(str, ((*k, v) for k, v in want.items())))
    assert sorted(map(str, ((r[schemas.DAY], r["bucket"], r["weight"]) for r in got if not r["term"]))) == sorted(
        str((d, b, float(n))) for d, n in days.items() for b in range(4)
    )
    # Postings are shuffled once, and no table of all words of a task is held.
    heads = [line.strip(" :+-") for line in plan.splitlines()]
    assert sum(x.startswith("Exchange") and ("term" in x or "bucket" in x) for x in heads) == 1
    assert not any(x.startswith("HashAggregate") and "term" in x for x in heads)
