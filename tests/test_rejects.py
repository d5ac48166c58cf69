"""Rows that do not fit their table go to the rejects, and nowhere else."""

import json
import os

import pytest
from pyspark.sql import functions as F

from pulsepress import ArticleStore, schemas
from pulsepress.sources import files, folders

AS_OF = "2024-02-01"


@pytest.fixture
def store(spark, tmp_path):
    return ArticleStore(spark, f"checked_{os.path.basename(tmp_path).replace('-', '_')}", str(tmp_path / "db"))


def _refused(store, name):
    return sorted((tuple(r["problems"]), json.loads(r["content"]).get("url")) for r in store.rejects(name).collect())


def test_null_keys_are_refused_each_time_and_never_stored(store, rows):
    batch = rows("url string, title string, extra int", ("a", "t", 1), (None, "t", 2), ("a", "t", 1))
    assert store.store_articles(batch, AS_OF) == 1 and store.store_articles(batch, AS_OF) == 0
    assert _refused(store, "articles") == [(("url",), None)] * 2
    assert json.loads(store.rejects().first()["content"])["extra"] == 2
    assert store.count_rows("articles") == 1
    pairs = rows("url string, related_url string", ("a", None), ("a", "b"), (None, None))
    assert store.store_related(pairs) == 1 and store.store_related(pairs) == 0
    assert [p for p, _ in _refused(store, "related")] == [("related_url",), ("related_url",), ("url", "related_url"), ("url", "related_url")]
    # What a batch was written to is gone.
    assert folders.children(store.spark, f"{store.tables._folder}/batches.versions") == []


def test_short_texts_and_counts_out_of_range(store, rows):
    batch = rows(
        "chatter_url string, url string, likes string, comments long",
        ("p", "u", "3", 1), ("", "u", "3", 1), ("p", None, "3", 1), ("p", "u", "many", 1), ("p", "u", "3", -1), ("p", "u", None, None),
        ("p", "u", str(2**32), 1),
    )
    assert store.store_mentions(batch, AS_OF) == 2
    assert [p for p, _ in _refused(store, "mentions")] == [("chatter_url",), ("comments",), ("likes",), ("likes",), ("url",)]
    kept = store.table("mentions").select("likes", "comments", "subscribers", "shares").collect()
    assert sorted(tuple(r) for r in kept if r["likes"]) == [(3, 1, 0, 0)]
    assert store.store_publishers(rows("source string, base_url string", ("s", None), ("t", "b")), AS_OF) == 1


def test_broken_lines(store, spark, tmp_path):
    good = [{"chatter_url": f"p{i}", "url": "u", "likes": i, "collected": "2024-01-05T00:00:00"} for i in range(5)]
    lines = [*map(json.dumps, good), '{"chatter_url": "x", "url"', "no json", '{"chatter_url": "y", "url": "u", "likes": "many"}']
    (tmp_path / "m.json").write_text("\n".join(lines))
    assert store.load("mentions", str(tmp_path / "m.json"), "json", AS_OF) == 5
    refused = store.rejects("mentions").collect()
    assert len(refused) == 3 and all("broken line" in r["problems"] for r in refused)
    assert {json.loads(r["content"])["__broken"] for r in refused} == set(lines[5:])
    (tmp_path / "p.csv").write_text('source,base_url\ns,"b ""q"", c"\nt,b,too,many\nv,\n')
    layout = schemas.T.StructType([schemas.PUBLISHERS["source"], schemas.PUBLISHERS["base_url"]])
    got = files.load_csv(spark, str(tmp_path / "p.csv"), layout, "__broken", multi_line=False).collect()
    assert [(r["source"], r["base_url"], r["__broken"]) for r in got] == [
        ("s", 'b "q", c', None), ("t", "b", "t,b,too,many"), ("v", None, None)
    ]


def test_lists_come_back_from_csv_as_they_were(spark, rows, tmp_path):
    schema = "url string, regions array<string>, entities array<string>"
    data = [("a", ["x|y", 'q"', "", None, "ü\nz"], []), ("b", None, ["["]), ("c", [], None)]
    files.save_csv(rows(schema, *data), str(tmp_path / "c"))
    layout = schemas.T.StructType([schemas.ARTICLES[c] for c in ("url", "regions", "entities")])
    got = files.load_csv(spark, str(tmp_path / "c"), layout)
    assert sorted((r["url"], r["regions"], r["entities"]) for r in got.collect()) == data
    # Files written with bars between elements are still read.
    (tmp_path / "old.csv").write_text("url,regions,entities\na,x|y,z\n")
    assert tuple(files.load_csv(spark, str(tmp_path / "old.csv"), layout).first()) == ("a", ["x", "y"], ["z"])


def test_a_full_batch_has_no_rejects(store, fx):
    assert store.store_articles(fx.articles, AS_OF) == 200
    assert store.store_articles(fx.articles.withColumn("position", F.lit(1)), AS_OF, order=[F.col("position")]) == 0
    assert store.rejects().count() == 0
