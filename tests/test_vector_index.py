"""Vector index in cells: recall against brute force, folders read, stored form."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsepress import VectorItemStore
from pulsepress.operators import search, vector_index

BIG = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def given(spark):
    df = spark.read.parquet(f"{BIG}/embeddings.parquet").select(F.col("vec_id").cast("string").alias("url"), "embedding")
    rows = df.orderBy(F.col("url").cast("long")).collect()
    return df, [r["url"] for r in rows], np.array([r["embedding"] for r in rows], "float64")


def _recall(points, urls, cells, queries, k=10, probe=None):
    """Mean recall and share of rows read, over many queries, by the same cells in numpy."""
    of = vector_index._nearest_centre(points, cells.centres)
    hits, read = [], []
    for q in queries:
        inside = np.isin(of, cells.near(points[q], probe=probe, limit=k + 1))
        gaps = np.sqrt(((points - points[q]) ** 2).sum(1))
        true = [i for i in np.lexsort((np.arange(len(points)), gaps)) if i != q][:k]
        hits.append(inside[true].mean())
        read.append(inside.mean())
    return np.mean(hits), np.mean(read)


def test_recall_where_probing_binds(given):
    df, urls, points = given
    cells = vector_index.train_cells(df)
    assert 1 < cells.probe < len(cells.centres) == 45
    found, read = _recall(points, urls, cells, range(0, len(points), 20))
    # These vectors are spread evenly, so much has to be read; half of the cells give less.
    assert found >= 0.9 and read < 0.9
    assert _recall(points, urls, cells, range(0, len(points), 20), probe=4)[0] < 0.6


def test_gathered_vectors_need_few_cells(spark):
    draw = np.random.default_rng(4)
    points = draw.normal(size=(40, 16))[draw.integers(0, 40, 3000)] + 0.05 * draw.normal(size=(3000, 16))
    df = spark.createDataFrame([(str(i), x.tolist()) for i, x in enumerate(points)], "url string, embedding array<float>")
    cells = vector_index.train_cells(df)
    found, read = _recall(points, None, cells, range(0, 3000, 50))
    assert found >= 0.9 and read < 0.2


def test_search_reads_its_cells_only(given, spark, tmp_path):
    df, urls, points = given
    cells = vector_index.train_cells(df, cells=30)
    vector_index.indexed(df, cells).write.partitionBy(vector_index.CELL).parquet(str(tmp_path / "index"))
    index = spark.read.parquet(str(tmp_path / "index"))
    cells = vector_index.cell_rows(index, cells)
    assert sum(cells.rows) == len(points)
    query = points[7].tolist()
    near = vector_index.nearest_in_cells(index, cells, query, 10, probe=6)
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "cell" in plan.split("PartitionFilters: [")[1].split("]")[0]
    wanted = cells.near(query, probe=6)
    assert len(wanted) == 6
    held = index.filter(F.col("cell").isin(wanted)).drop("cell")
    want = search.nearest_rows(held, query, 10, metric="l2").collect()
    assert near.collect() == want and want[0]["url"] == "7"
    assert near.columns == ["url", "embedding", "distance"]
    # All cells: the exact result.
    whole = vector_index.nearest_in_cells(index, cells, query, 10, probe=30).collect()
    assert whole == search.nearest_rows(df, query, 10, metric="l2").collect()


def test_cells_are_added_until_the_limit_is_met(spark):
    points = np.random.default_rng(5).normal(size=(60, 4))
    df = spark.createDataFrame([(str(i), x.tolist()) for i, x in enumerate(points)], "url string, embedding array<float>")
    cells = vector_index.train_cells(df, cells=20)
    index = vector_index.indexed(df, cells)
    cells = vector_index.cell_rows(index, cells)
    for limit in (1, 25, 60, 100):
        assert vector_index.nearest_in_cells(index, cells, points[0].tolist(), limit, probe=1).count() == min(limit, 60)


def test_odd_vectors(rows):
    schema = "url string, embedding array<float>"
    df = rows(schema, ("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("c", None), ("d", [1.0]), ("e", []), ("f", [float("nan"), 1.0]), ("g", [None, 1.0]), ("a", [1.0, 0.0]))
    cells = vector_index.train_cells(df, cells=2)
    placed = vector_index.indexed(df, cells).select("url", "cell").collect()
    assert sorted(r["url"] for r in placed) == ["a", "a", "b"]
    nothing = vector_index.train_cells(df.limit(0))
    assert len(nothing.centres) == 0 and vector_index.indexed(df, nothing).count() == 0


def test_stored_index_takes_new_items(spark, fx, tmp_path):
    items = fx.raw("embeddings").select(F.col("vec_id").cast("string").alias("name"), "embedding")
    store = VectorItemStore(spark, "cells_test", {"points": "name"}, str(tmp_path))
    first = items.filter("CAST(name AS INT) < 300")
    assert store.store("points", first) == 300
    cells = store.build_index("points", cells=12)
    assert sum(cells.rows) == 300
    assert store.store("points", items) == 200 and sum(store.cells("points").rows) == 500
    exact = [r["name"] for r in store.search("points", fx.query_vector, limit=10, columns=["name"]).collect()]
    got = store.search_cells("points", fx.query_vector, 10, probe=12)
    assert [r["name"] for r in got.collect()] == exact and got.columns == ["name", "embedding", "_distance"]
    assert store.search_cells("points", fx.query_vector, 10).first()["name"] == exact[0]
    assert store.build_index("points", cells=5).rows and store.search_cells("points", fx.query_vector, 3).count() == 3
