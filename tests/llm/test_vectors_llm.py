"""Exact top-k search and the permutation index against brute force."""

import numpy as np
from pyspark.sql import functions as F

from pulsepress.llm import permutations, topk

SCHEMA = "vec_id long, embedding array<float>, rank string, score string"


def _vectors(n, seed=1, size=6):
    return np.random.default_rng(seed).integers(-4, 5, (n, size)).astype(float) / 4


def _table(rows, n=90):
    values = _vectors(n)
    odd = [(None, [0.5] * 6), (901, None), (902, [None] * 6), (903, [float("nan")] * 6), (904, [float("inf")] * 6)]
    more = [(i, v.tolist()) for i, v in enumerate(values)] + [(3, values[3].tolist())] + odd
    return values, rows(SCHEMA, *[(i, v, "x", "y") for i, v in more])


def test_top_k_equals_brute_force_with_ties_and_repeats(rows):
    values, df = _table(rows)
    whole = topk.scaled_vectors(df)
    small = dict(tile_queries=4, tile_rows=8)
    for options in ({}, small):
        found = topk.top_k(whole, whole.filter("vec_id % 10 = 0"), k=5, **options)
        got = {(x.query_id, x["rank"]): (x.vec_id, x.score) for x in found.collect()}
        q = np.floor(values * 256).astype(int)
        want = {}
        for i in range(0, 90, 10):
            order = sorted((j for j in range(90) if j != i), key=lambda j: (-int(q[i] @ q[j]), j))[:5]
            want |= {(i, r + 1): (j, int(q[i] @ q[j])) for r, j in enumerate(order)}
        assert got == want


def test_top_k_of_large_numbers_is_exact_and_empty_tables_have_no_rows(rows):
    df = rows("vec_id long, embedding array<long>", (1, [2**40, 1]), (2, [2**20, 3]), (3, [2**20, 2]), (4, [1]))
    found = topk.top_k(df, df.filter("vec_id = 1"), k=5).orderBy("rank").collect()
    assert [(x.vec_id, x.score) for x in found] == [(2, 2**60 + 3), (3, 2**60 + 2)]
    assert topk.top_k(df.limit(0), df.limit(0)).count() == 0


def test_permutation_index_finds_nearly_all_and_scores_exactly(rows):
    values = np.random.default_rng(5).normal(size=(600, 16))
    values[300:400] = values[0]
    table = [(i, v.tolist()) for i, v in enumerate(values)] + [(700, [0.0] * 16), (701, None)]
    df = rows("vec_id long, embedding array<double>", *table)
    found = permutations.nearest(df, df.filter("vec_id % 20 = 0"), k=20, pivots=64, shard_rows=200).collect()
    hits = total = 0
    for i in range(0, 600, 20):
        score = np.array([(v * values[i]).sum() for v in values])
        order = [j for j in np.lexsort((np.arange(600), -score)) if j != i][:20]
        mine = sorted((x["rank"], x.vec_id, x.score) for x in found if x.query_id == i)
        assert [r for r, _, _ in mine] == list(range(1, 21))
        assert all(s == score[j] for _, j, s in mine)
        hits, total = hits + len({j for _, j, _ in mine} & set(order)), total + 20
    assert hits >= 0.9 * total
    assert permutations.nearest(df.limit(0), df.limit(0)).count() == 0


def test_copies_of_a_vector_are_found_by_smaller_id(rows):
    df = rows("vec_id long, embedding array<double>", *[(i, [1.0, 2.0]) for i in range(50)])
    found = permutations.nearest(df, df.filter(F.col("vec_id") == 40), k=3).orderBy("rank").collect()
    assert [x.vec_id for x in found] == [0, 1, 2]


def test_permutations_of_several_lengths(rows):
    draw = np.random.default_rng(5)
    points = [(i, [float(x) for x in draw.normal(size=4)]) for i in range(40)] + [(40, [1.0] * 5), (41, [2.0] * 5)]
    df = rows("vec_id long, embedding array<float>", *points)
    found = permutations.nearest(df, df, k=3).collect()
    assert {x.query_id for x in found} == set(range(42)) and len(found) == 40 * 3 + 2
    assert sorted((x.query_id, x.vec_id) for x in found if x.query_id >= 40) == [(40, 41), (41, 40)]


def test_recall_where_the_share_binds(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    got = {}
    for x in permutations.nearest(df, df.filter("vec_id % 10 = 0"), k=20).collect():
        got.setdefault(x.query_id, set()).add(x.vec_id)
    rows = df.collect()
    ids, vectors, recall = np.array([x.vec_id for x in rows]), np.array([x.embedding for x in rows], np.float64), []
    for id, found in got.items():
        score = np.where(ids == id, -np.inf, vectors @ vectors[ids == id][0])
        recall.append(len(found & set(ids[np.lexsort((ids, -score))[:20]].tolist())) / 20)
    assert len(ids) * permutations.SHARE > 200 and len(recall) == 200
    assert np.mean(recall) > 0.94 and min(recall) >= 0.7
