"""Vector operators against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsepress.functions.vectors import distance
from pulsepress.operators import labels, search, similarity

SCHEMA = "url string, embedding array<float>, categories array<string>"


def vectors(count, length=8, seed=0, spread=0.15, groups=12):
    random = np.random.default_rng(seed)
    centres = random.normal(size=(groups, length))
    return [centres[i % groups] + spread * random.normal(size=length) for i in range(count)]


def table(spark, points, categories=lambda i: [f"c{i % 2}"]):
    rows = [(f"u{i}", [float(x) for x in p], categories(i)) for i, p in enumerate(points)]
    return spark.createDataFrame(rows, SCHEMA)


def brute(points, eps, same=lambda i, j: True):
    points = np.asarray(points, dtype="float32").astype("float64")
    gaps = np.sqrt(((points[:, None] - points[None]) ** 2).sum(-1))
    return {
        (f"u{i}", f"u{j}") for i, j in zip(*np.nonzero(gaps <= eps)) if i != j and same(i, j)
    }


def pairs(df):
    return sorted((r["url"], r["related_url"]) for r in df.collect())


def test_distances_and_missing_vectors(rows):
    df = rows("k string, e array<float>", ("a", [1.0, 0.0]), ("zero", [0.0, 0.0]), ("none", None), ("long", [1.0, 0.0, 0.0]))
    for metric, expected in (("cosine", 1.0), ("l2", 2.0**0.5), ("dot", 1.0)):
        got = {r["k"]: r["d"] for r in df.select("k", distance("e", [0.0, 1.0], metric).alias("d")).collect()}
        assert got["a"] == pytest.approx(expected) and got["none"] is None and got["long"] is None
        assert (got["zero"] is None) == (metric == "cosine")
    with pytest.raises(ValueError):
        distance("e", [1.0], "other")


def test_equal_vectors_have_no_distance(rows):
    df = rows("e array<float>", ([0.1, 0.2, 0.3],))
    query = df.first()["e"]
    assert df.select(distance("e", query, "l2")).first()[0] == 0.0


def test_ties_go_by_key(rows):
    df = rows("url string, embedding array<float>", *[(f"u{i}", [1.0, float(i % 2)]) for i in range(10)], ("x", None))
    top = search.nearest_rows(df, [1.0, 0.0], 3)
    assert [r["url"] for r in top.collect()] == ["u0", "u2", "u4"]
    assert search.nearest_rows(df, [1.0, 0.0]).collect()[-1]["url"] == "x"
    assert search.nearest_rows(df, [1.0, 0.0], max_distance=0.0).count() == 5


def test_threshold_measures_once(rows):
    df = rows("url string, embedding array<float>", ("a", [1.0, 0.0]))
    plan = search.within_distance(df, [1.0, 0.0], 0.5)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


@pytest.mark.parametrize("eps", [0.3, 0.6, 1.5])
@pytest.mark.parametrize("cells, tile_rows", [(None, 1000), (7, 1000), (7, 7), (30, 3), (1, 11)])
def test_similar_pairs_equal_brute_force(spark, eps, cells, tile_rows):
    points = vectors(150)
    df = table(spark, points)
    both = pairs(similarity.vector_pairs(df, eps, cells=cells, tile_rows=tile_rows))
    assert len(both) == len(set(both))
    assert set(both) == brute(points, eps, lambda i, j: i % 2 == j % 2)


@pytest.mark.parametrize("cells, tile_rows", [(None, 1000), (7, 9)])
def test_pairs_of_fresh_articles_only(spark, cells, tile_rows):
    points = vectors(120, seed=8)
    df = table(spark, points)
    fresh = {f"u{i}" for i in range(0, 120, 9)}
    wanted = df.filter(F.col("url").isin(list(fresh))).select("url")
    found = pairs(similarity.vector_pairs(df, 0.6, cells=cells, tile_rows=tile_rows, fresh=wanted))
    everything = brute(points, 0.6, lambda i, j: i % 2 == j % 2)
    assert len(found) == len(set(found)) and set(found) == {p for p in everything if fresh & set(p)}


@pytest.mark.parametrize("eps, leaf_rows, cells", [(0.3, 30, 1), (0.6, 40, 3), (1.5, 40, 2)])
def test_cells_that_are_split_again_equal_brute_force(spark, monkeypatch, eps, leaf_rows, cells):
    monkeypatch.setattr(similarity, "BRANCHES", 16)
    points = np.round(vectors(400, groups=30, seed=5), 2)
    points[7::40] = points[7]  # copies
    df = table(spark, points)
    links = similarity.copies(df)
    firsts = {f"u{i}" for i in range(400)} - {r["url"] for r in links.collect()}
    both = pairs(similarity.vector_pairs(df, eps, cells=cells, tile_rows=20, leaf_rows=leaf_rows))
    assert len(both) == len(set(both))
    assert set(both) == {p for p in brute(points, eps, lambda i, j: i % 2 == j % 2) if firsts.issuperset(p)}
    fresh = {f"u{i}" for i in range(0, 400, 31)} & firsts
    wanted = df.filter(F.col("url").isin(list(fresh))).select("url")
    found = pairs(similarity.vector_pairs(df, eps, cells=cells, tile_rows=20, leaf_rows=leaf_rows, fresh=wanted))
    assert len(found) == len(set(found)) and set(found) == {p for p in both if fresh & set(p)}


def test_only_cells_that_can_be_told_apart_are_split(spark):
    def leaves(points, eps):
        placed = table(spark, points, lambda i: None).select(
            F.lit("").alias("group"), "url", "embedding", F.lit("0").alias("cell"), F.lit(True).alias("home")
        )
        return similarity._split(placed, eps, 8, 50, 100).groupBy("cell").agg(F.count_if("home").alias("h"), F.count("*").alias("n"))

    compared = []
    for count in (3000, 12000):
        far = leaves(vectors(count, groups=count // 30, spread=0.01), 0.1).collect()
        # At home once; cells stay above the limit only where parts of them would overlap too much.
        assert sum(x["h"] for x in far) == count and max(x["n"] for x in far) < 200
        compared.append(sum(x["h"] * x["n"] for x in far))
    # In one cell it would be 16 times as much.
    assert compared[0] < 100 * 3000 and compared[1] < 5 * compared[0]
    # Every vector within reach of every other: one cell, cut into tiles.
    assert [tuple(x) for x in leaves(vectors(500, groups=1, spread=0.01), 1.0).collect()] == [("0", 500, 500)]


def test_similar_pairs_without_categories(spark):
    points = vectors(90, seed=4)
    df = table(spark, points, lambda i: None)
    assert set(pairs(similarity.vector_pairs(df, 0.6, same_categories=False, cells=9, tile_rows=8))) == brute(points, 0.6)
    assert similarity.vector_pairs(df, 0.6).count() == 0


def test_category_order_matters(spark):
    df = spark.createDataFrame([("a", [1.0], ["x", "y"]), ("b", [1.1], ["y", "x"]), ("c", [1.2], ["x", "y"])], SCHEMA)
    assert pairs(similarity.similar_pairs(df, 0.5)) == [("a", "c"), ("c", "a")]


def test_copies_are_linked_to_the_first_and_unfold_on_demand(spark):
    points = vectors(40, seed=2)
    points += [points[3]] * 60
    df = table(spark, points, lambda i: ["c"])
    eps = 0.6
    everything = brute(points, eps)
    compact = similarity.similar_pairs(df, eps)
    links = similarity.copies(df)
    first = min([f"u{i}" for i in (3, *range(40, 100))])
    assert {r["first_url"] for r in links.collect()} == {first} and links.count() == 60
    found = pairs(compact)
    assert len(found) == len(set(found)) and set(found) <= everything and len(found) < len(everything) / 4
    base = similarity.vector_pairs(df, eps)
    unfolded = similarity.related_to(df, base, links)
    assert set(pairs(unfolded)) == everything
    some = df.filter(F.col("url").isin("u3", "u50", "u7"))
    assert set(pairs(similarity.related_to(some, base, links))) == {p for p in everything if p[0] in ("u3", "u50", "u7")}


def test_copies_count_in_stored_pairs_and_clusters(spark, rows):
    points = vectors(30, seed=2)
    points += [points[3]] * 6 + [points[15]] * 3
    df = table(spark, points, lambda i: ["c"])
    everything = brute(points, 0.6)
    none = rows("url string, related_url string")
    assert pairs(similarity.new_related(none, df, 0.6, all_pairs=True)) == sorted(everything)
    kept = rows("url string, related_url string", *[(f"u{i}", "x") for i in range(len(points)) if i not in (3, 33, 7)])
    some = {p for p in everything if {"u3", "u33", "u7"} & set(p)}
    assert pairs(similarity.new_related(kept, df, 0.6)) == sorted(some)
    at = np.asarray(points, dtype="float32").astype("float64")
    gaps = [(a, b, float(np.sqrt(((at[int(a[1:])] - at[int(b[1:])]) ** 2).sum()))) for a, b in everything]
    whole = similarity.assign_clusters(rows("url string, related_url string, distance double", *gaps))
    assert sorted(similarity.similar_clusters(df, 0.6).collect()) == sorted(whole.collect())


def test_clusters(rows):
    links = rows(
        "url string, related_url string, distance double",
        ("a", "b", 0.2), ("b", "a", 0.2), ("a", "c", 0.2), ("c", "a", 0.2), ("b", "c", 0.5), ("c", "b", 0.5), ("d", "c", 0.6), ("c", "d", 0.6),
    )
    clusters = {r["url"]: (r["cluster_id"], r["related"]) for r in similarity.assign_clusters(links).collect()}
    assert clusters == {"a": ("b", 2), "b": ("a", 2), "c": ("a", 2), "d": ("c", 3)}
    members = rows("url string, cluster_id string", ("x", "1"), ("y", "1"), ("z", None), ("w", None))
    assert [r["url"] for r in similarity.in_cluster(members, "x").collect()] == ["y"]
    assert similarity.in_cluster(members, "z").count() == 0
    sizes = {r["url"]: r["cluster_size"] for r in similarity.cluster_sizes(members, ["x", "z"]).collect()}
    assert sizes == {"x": 2, "z": 2}


def test_large_lookups_give_the_same_pairs(spark, monkeypatch):
    from pulsepress.operators import joins

    points = vectors(60, seed=3) + [vectors(1, seed=3)[0]] * 20
    df = table(spark, points, lambda i: ["c"])
    pairs_once, links = pairs(similarity.vector_pairs(df, 0.6, cells=5, tile_rows=6)), similarity.copies(df).count()
    monkeypatch.setattr(joins, "fits_broadcast", lambda *a, **k: False)
    assert pairs(similarity.vector_pairs(df, 0.6, cells=5, tile_rows=6)) == pairs_once
    assert similarity.copies(df).count() == links == 20


def test_labels_in_blocks_equal_labels_at_once(spark):
    articles = table(spark, vectors(60, seed=5)).unionByName(spark.createDataFrame([("none", None, None)], SCHEMA))
    reference = spark.createDataFrame([(f"l{i:02}", [float(x) for x in p]) for i, p in enumerate(vectors(30, seed=6))], "label string, embedding array<float>")
    reference = reference.union(reference.withColumn("label", F.concat("label", F.lit("again"))))

    def found(**options):
        rows = labels.add_nearest_labels(articles, reference, "label", n=3, **options).collect()
        return {r["url"]: [(n["label"], round(n["distance"], 9)) for n in r["nearest"] or []] for r in rows}

    at_once = found()
    assert found(block=7, article_block=11) == at_once
    assert at_once["none"] == [] and all(len(v) == 3 for k, v in at_once.items() if k != "none")
    points = np.asarray([r["embedding"] for r in articles.orderBy("url").filter("embedding IS NOT NULL").collect()])
    names = [r["url"] for r in articles.orderBy("url").filter("embedding IS NOT NULL").collect()]
    marks = reference.orderBy("label").collect()
    other = np.asarray([m["embedding"] for m in marks])
    gaps = 1 - points @ other.T / np.sqrt((points**2).sum(1)[:, None] * (other**2).sum(1)[None])
    for i, name in enumerate(names):
        best = [marks[j]["label"] for j in np.lexsort((np.arange(len(marks)), np.round(gaps[i], 12)))[:3]]
        assert [label for label, _ in at_once[name]] == best


def test_labels_do_not_depend_on_the_size_of_their_table(rows, fx):
    articles = rows(
        SCHEMA, ("same", [1.0, 0.0], None), ("same", [0.0, 1.0], None), ("same", [1.0, 0.0], None),
        ("zero", [0.0, 0.0], None), ("none", None, None), ("long", [1.0, 0.0, 0.0], None),
    )
    reference = rows("label string, embedding array<float>", ("x", [2.0, 0.1]), ("y", [0.1, 2.0]), ("z", [1.0, 1.0]), ("0", [0.0, 0.0]))

    def found(df, reference, label, block):
        got = labels.add_nearest_labels(df, reference, label, n=2, block=block).collect()
        return sorted((r["url"], str(r["nearest"] and [(n["label"], round(n["distance"], 9)) for n in r["nearest"]])) for r in got)

    names = {r["url"]: r["nearest"] for r in labels.add_nearest_labels(articles, reference, "label", n=2, block=1).collect()}
    assert names["zero"] == [] and names["none"] is None and names["long"] is None
    at_once = found(articles, reference, "label", 4096)
    assert len(at_once) == 6 and [x.count("(") for _, x in at_once if _ == "same"] == [2, 2, 2]
    assert found(articles, reference, "label", 1) == found(articles, reference, "label", 3) == at_once
    articles = fx.articles.select("url", "embedding")
    assert found(articles, fx.categories_ref, "category", 1) == found(articles, fx.categories_ref, "category", 4096)


def test_approximate_search_finds_most_neighbours(fx):
    exact = [r["url"] for r in search.nearest_rows(fx.articles, fx.query_vector, 20, metric="l2").collect()]
    near = similarity.approximate_nearest(fx.articles, fx.query_vector, 20, bucket=1.0, tables=6)
    found = [r["url"] for r in near.collect()]
    assert found[0] == exact[0] and len(set(found) & set(exact)) >= 18


@pytest.mark.parametrize("count, limit", [(50, 10), (400, 10), (5, 10), (400, 0)])
def test_approximate_search_fills_the_limit(spark, count, limit):
    points = vectors(count, seed=9, spread=1.0)
    df = table(spark, points)
    query = [float(x) for x in points[0] + 0.1]
    exact = [r["url"] for r in search.nearest_rows(df, query, limit, metric="l2").collect()]
    found = [r["url"] for r in similarity.approximate_nearest(df, query, limit, bucket=0.2, tables=2).collect()]
    assert len(found) == len(set(found)) == min(limit or count, count)
    assert len(set(found) & set(exact)) >= 0.5 * len(exact) and found[0] == exact[0]


def test_similar_to_needs_an_embedding(fx):
    assert search.similar_to(fx.articles, "doc://none").count() == 0
