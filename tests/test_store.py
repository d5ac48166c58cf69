"""The stores over catalog tables, and files."""

import os
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from pulsepress import ArticleStore, VectorItemStore, schemas
from pulsepress.operators.ingest import align
from pulsepress.sources import files, objects
from pulsepress.sources.scratch import scratch_folder

AS_OF = "2024-02-01"


@pytest.fixture
def store(spark, fx, tmp_path):
    store = ArticleStore(spark, f"press_{os.path.basename(tmp_path).replace('-', '_')}", str(tmp_path))
    store.set_labels(fx.categories_ref, fx.sentiments_ref)
    assert store.store_articles(fx.articles, AS_OF) == 200
    assert store.store_mentions(fx.mentions, AS_OF) == 1000
    assert store.store_publishers(fx.publishers, AS_OF) == 19
    assert store.store_related(fx.related) == fx.related.count()
    return store


def test_store_and_query(store, fx):
    assert store.store_articles(fx.articles, AS_OF) == 0
    assert store.deduplicate("articles", fx.articles).count() == 0
    assert store.count_rows("articles") == 200 and store.count_rows("articles", ["kind = 'news'"]) == 67
    latest = store.query_latest(limit=5, columns=["url", "title", "kind"])
    assert latest.columns == ["url", "title", "kind"]
    expected = fx.articles.orderBy(F.col("created").desc()).limit(5).select("url").collect()
    assert [r["url"] for r in latest.collect()] == [r["url"] for r in expected]
    whole = store.query_latest(limit=3)
    assert whole.columns == schemas.ARTICLES.fieldNames() and all(r["content"] for r in whole.collect())
    assert store.query_publishers(limit=5, columns=["source", "site_name"]).count() == 5
    assert store.query_mentions(collected="2024-01-20", limit=7, offset=2).count() == 7
    assert store.query_mentions(offset=990).count() == 10
    assert store.distinct_categories(limit=3).count() == 3 and store.distinct_sentiments().count() == 5
    assert store.distinct_regions().count() == 4 and store.distinct_publishers().count() == 19
    assert store.distinct_entities().count() == 11


def test_days_are_skipped(store):
    rows = store.query_latest(collected=("2024-01-05", "2024-01-06"), columns=["url"])
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "collected_day" in plan.split("PartitionFilters")[1][:120]
    assert store.query_latest(collected=("2024-01-05 12:00:00", "2024-01-06 12:00:00"), columns=["collected"]).count() == 7


def test_updates(store, fx):
    two = store.query_latest(limit=2, columns=["url"])
    urls = [r["url"] for r in two.collect()]
    changes = two.select("url", F.array(F.lit("[UPDATED]")).alias("entities"), F.array(F.lit("X")).alias("regions"))
    assert store.update_articles(changes, ["entities", "regions"]) == 2
    assert {r["url"] for r in store.query_latest(entities=["[UPDATED]"], regions=["X"]).collect()} == set(urls)
    assert store.count_rows("articles") == 200
    moved = fx.articles.filter("kind = 'news'").select("url", F.lit(None).cast("timestamp_ntz").alias("created"))
    moved = moved.withColumn("collected", F.expr("TIMESTAMP_NTZ '2024-01-20 00:00:00'")).drop("created")
    assert store.update_articles(moved) == 67
    assert store.count_rows("articles") == 200 and len(store.tables.days("articles")) == 20
    assert store.update_articles(moved.withColumn("url", F.lit("unknown"))) == 0
    names = fx.publishers.select("source", F.lit("new").alias("site_name"))
    assert store.update_publishers(names) == 19
    assert {r["site_name"] for r in store.query_publishers().collect()} == {"new"}
    assert {r["base_url"] for r in store.query_publishers().collect()} == {r["base_url"] for r in fx.publishers.collect()}


def test_a_moved_row_rewrites_two_days(store):
    url = store.query_latest(limit=1, columns=["url"]).first()["url"]
    where = "regexp_extract(_metadata.file_path, '^(.*)$', 1) AS file"
    before = {r["file"] for r in store.tables.read("articles").selectExpr(where).distinct().collect()}
    moved = store.query_latest(urls=[url], columns=["url"])
    moved = moved.withColumn("collected", F.expr("TIMESTAMP_NTZ '2024-01-03 05:00:00'"))
    assert store.update_articles(moved) == 1 and store.count_rows("articles") == 200
    after = {r["file"] for r in store.tables.read("articles").selectExpr(where).distinct().collect()}
    days = {f.split("collected_day=")[1].split("/")[0] for f in before ^ after}
    assert len(days) == 2 and "2024-01-03" in days
    assert store.query_latest(collected=("2024-01-03 04:59:00", "2024-01-03 05:01:00"), urls=[url]).count() == 1


@pytest.mark.parametrize("stop", [1, 2, 3])
def test_replace_keeps_all_rows_when_it_ends_early(store, fx, monkeypatch, stop):
    """Ended before either change of the catalog or before the old rows go, a replace loses nothing."""
    tables, stored, calls = store.tables, fx.related.count(), []
    point = tables._point

    def ends(name, location):
        calls.append(name)
        if len(calls) == stop:
            raise RuntimeError("ended")
        point(name, location)

    monkeypatch.setattr(tables, "_point", ends)
    half = tables.read("related").limit(5)
    try:
        tables.replace("related", half)
    except RuntimeError:
        pass
    monkeypatch.undo()
    again = ArticleStore(store.spark, tables.database)
    assert again.count_rows("related") == (stored if stop == 1 else 5)
    assert again.tables.replace("related", fx.related) == stored and again.count_rows("related") == stored
    assert again.tables.replace("related", again.tables.read("related").limit(3)) == 3
    assert again.store_related(fx.related) == stored - 3


def test_embeddings_and_similar(store, fx):
    vectors = fx.articles.filter("embedding IS NOT NULL").select("url", "embedding")
    assert store.update_embeddings(vectors) == 200
    labelled = store.query_latest(columns=["url", "categories", "sentiments"]).collect()
    assert all(len(r["categories"]) == 2 and len(r["sentiments"]) == 2 for r in labelled)
    first = store.link_similar(1.15)
    assert first > 0 and store.link_similar(1.15) == 0


def test_optimize_and_trends(store):
    before = store.count_rows("mentions")
    store.optimize(AS_OF, "15 days")
    assert store.count_rows("articles", ["collected < TIMESTAMP_NTZ '2024-01-17'"]) == 0
    assert 0 < store.count_rows("mentions") < before
    assert store.query("SELECT count(*) AS n FROM related r LEFT ANTI JOIN articles a ON a.url = r.url").first()["n"] == 0
    top = store.query_trending(limit=5, columns=["url", "trend_score", "likes", "related", "content"]).collect()
    assert len(top) == 5 and [r["trend_score"] for r in top] == sorted((r["trend_score"] for r in top), reverse=True)
    rows = store.query_aggregated(kind="news", embedding=[0.1] * 64, distance=10, limit=5, columns=["url", "related_urls", "site_name"])
    assert rows.columns == ["url", "related_urls", "site_name", "distance"]
    got = [r["distance"] for r in rows.collect()]
    assert len(got) == 5 and got == sorted(got)
    assert store.query_aggregated(limit=3).columns[-6:] == ["related_urls", *schemas.PUBLISHER_COLUMNS]
    assert store.query_aggregated_mentions(limit=2).count() == 2
    counted = store.query("SELECT count(*) AS n FROM trending_articles WHERE kind = ?", ["news"]).first()["n"]
    assert counted == store.query_trending(kind="news").count()


def test_rows_without_a_day_survive(store, spark):
    odd = spark.createDataFrame([("p", "u", 1)], "chatter_url string, url string, likes bigint")
    rows = align(odd, schemas.MENTIONS).withColumn(schemas.DAY, F.lit(None).cast("date"))
    store.tables.append("mentions", rows)
    store.optimize(AS_OF, "15 days")
    assert store.count_rows("mentions", ["collected IS NULL"]) == 1


def test_cleanup_keeps_all_rows(store, spark, fx):
    for _ in range(3):
        store.store_mentions(fx.mentions.limit(50).repartition(4), AS_OF)
    assert store.cleanup(min_files=3) >= 1
    assert store.count_rows("mentions") == 1150 and store.count_rows("articles") == 200


def test_files_into_tables(spark, fx, tmp_path):
    store = ArticleStore(spark, "load_test", str(tmp_path / "db"))
    fx.articles.write.parquet(str(tmp_path / "a"))
    files.save_json(fx.mentions, str(tmp_path / "m"))
    files.save_csv(fx.publishers, str(tmp_path / "p"))
    fx.related.write.parquet(str(tmp_path / "r"))
    assert store.load("articles", str(tmp_path / "a"), as_of=AS_OF) == 200
    assert store.load("mentions", str(tmp_path / "m"), "json", AS_OF) == 1000
    assert store.load("publishers", str(tmp_path / "p"), "csv", AS_OF) == 19
    assert store.load("related", str(tmp_path / "r")) == fx.related.count()
    assert store.load("articles", str(tmp_path / "a"), as_of=AS_OF) == 0
    moments = [r["collected"] for r in store.query_mentions().collect()]
    assert sorted(moments) == sorted(r["collected"] for r in fx.mentions.select("collected").collect())


def test_vector_items(spark, fx, tmp_path):
    items = fx.raw("embeddings").select(F.col("vec_id").cast("string").alias("name"), "embedding")
    store = VectorItemStore(spark, "vector_items_test", {"points": "name"}, str(tmp_path), side=fx.categories_ref)
    assert store.store("points", items.union(items), "2024-02-01 10:00:00.5") == 500
    assert store.store("points", items) == 0
    moments = store.tables.read("points").select(F.unix_seconds("ts").alias("t")).distinct().collect()
    assert [m["t"] for m in moments] == [int(datetime(2024, 2, 1, 10).timestamp()) if os.environ.get("TZ") else 1706781600]
    found = store.search("points", fx.query_vector, limit=3, columns=["name"])
    assert found.columns == ["name", "_distance"] and found.first()["name"] == "0"
    again = VectorItemStore(spark, "vector_items_test", {"points": "name"}, str(tmp_path), side=fx.sentiments_ref)
    assert again.tables.read("side").columns == ["category", "embedding"]
    again.set_table("side", fx.sentiments_ref)
    assert again.tables.read("side").count() == 5


def test_export_writes_every_text(spark, fx, tmp_path):
    texts = fx.articles.select(F.concat(F.lit("a/b/"), F.substring("url", 7, 9), F.lit(".txt")).alias("path"), "content")
    urls = objects.export_objects(texts, str(tmp_path), "https://cdn.example.com/")
    assert urls.count() == 200
    for row in texts.collect():
        with open(tmp_path / row["path"], encoding="utf-8", newline="") as handle:
            assert handle.read() == row["content"]
    bare = objects.export_objects(texts.limit(1), str(tmp_path)).first()
    assert bare["path"] == bare["url"]


def test_text_files_round_trip(spark, fx):
    path = scratch_folder(spark)
    files.save_csv(fx.articles.drop("embedding"), path + "/csv")
    back = files.load_csv(spark, path + "/csv", align(fx.articles, schemas.ARTICLES).drop("embedding").schema)
    columns = ["url", "title", "content", "regions", "entities", "created"]
    assert {repr(r) for r in back.select(columns).collect()} == {repr(r) for r in fx.articles.select(columns).collect()}


def test_compaction(spark, fx):
    source, target = scratch_folder(spark), scratch_folder(spark)
    fx.articles.repartition(20).write.parquet(source)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    assert files.compact(spark, source, target) == 20
    assert len(spark.read.parquet(target).inputFiles()) < 5 and spark.read.parquet(target).count() == 200
    assert spark.conf.get("spark.sql.files.maxPartitionBytes") == before
