"""Approximate nearest neighbours by a permutation index.

A vector is represented by the order of its nearest pivots. Every shard of rows keeps one inverted
file per pivot: the rows that have the pivot, with its place in their order. A query adds up, list
by list, how far the places of its pivots differ (footrule distance), and the closest rows of
the shard are ranked again by the measure itself.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsepress.llm.common import copied, new_folder, stored, top_by_tree, usable_vector
from pulsepress.llm.topk import matrix

#: Number of pivots, all of them part of every order; at most 256, places are kept in one byte.
PIVOTS = 128
#: Share of a shard's rows that are ranked again.
SHARE = 0.15
SHARD_ROWS = 8192
TILE_QUERIES = 4096


def pivot_sample(vectors: DataFrame, id: str, vector: str, pivots: int = PIVOTS) -> np.ndarray:
    """Pivots: the vectors with the smallest hashes, at most ``pivots`` different ones.

    This bounded sample (``pivots`` vectors) is all that the index is fitted on.
    """
    sample = vectors.select(vector).distinct().orderBy(F.xxhash64(vector), vector).limit(pivots)
    rows = [x[0] for x in sample.collect()]
    size = max((len(x) for x in rows), default=0)
    same = [x for x in rows if len(x) == size]
    return np.array(same, np.float64).reshape(len(same), size)


def places(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Place of every pivot in each vector's order of nearest pivots (ties to the smaller number)."""
    near = np.argsort(-(vectors @ pivots.T), axis=1, kind="stable")
    out = np.empty(near.shape, np.uint8)
    np.put_along_axis(out, near, np.arange(near.shape[1], dtype=np.uint8)[None, :], axis=1)
    return out


def build_index(vectors: DataFrame, pivots: np.ndarray, shards: int) -> DataFrame:
    """One row per shard and pivot: ``places`` of the pivot over the shard's rows by id, as bytes.

    Pivot -1 holds the shard's ids and vectors. ``vectors`` has id and vector.
    """

    def post(key, rows):
        rows = rows.sort_by("id")
        kept = matrix(rows["vector"], np.float64)
        posted = np.ascontiguousarray(places(kept, pivots).T)
        ids = rows["id"].to_numpy().astype("<i8")
        names = ["shard", "pivot", "ids", "data"]
        lists = [x.tobytes() for x in posted]
        return pa.table(
            [
                pa.array([key[0].as_py()] * (len(lists) + 1), pa.int64()),
                pa.array([-1, *range(len(lists))], pa.int32()),
                pa.array([ids.tobytes()] + [None] * len(lists), pa.binary()),
                pa.array([kept.astype("<f8").tobytes(), *lists], pa.binary()),
            ],
            names=names,
        )

    dealt = vectors.withColumn("shard", F.pmod(F.xxhash64("id", "vector"), F.lit(shards)))
    return dealt.groupBy("shard").applyInArrow(post, "shard long, pivot int, ids binary, data binary")


def footrule(lists: list[np.ndarray], own: np.ndarray) -> np.ndarray:
    """Footrule distance of one query from all rows of a shard, from the lists of its pivots."""
    total = np.zeros(len(lists[0]), np.uint16 if len(lists) < 256 else np.uint32)
    for posted, place in zip(lists, own, strict=True):
        total += np.maximum(posted, place) - np.minimum(posted, place)
    return total


def _search(pivots: np.ndarray, k: int, share: float):
    def search(key, queries, index):
        names = ["query", "query_id", "vec_id", "score", "shard"]
        found: list[tuple] = []
        index = index.sort_by("pivot")
        if len(index) and len(queries):
            ids = np.frombuffer(index["ids"][0].as_py(), "<i8")
            rows = np.frombuffer(index["data"][0].as_py(), "<f8").reshape(len(ids), -1)
            lists = [np.frombuffer(x.as_py(), np.uint8) for x in index["data"][1:]]
            asked = matrix(queries["vector"], np.float64)
            numbers, own = queries["query"].to_numpy(), queries["id"].to_numpy()
            for number, id, vector, order in zip(numbers, own, asked, places(asked, pivots), strict=True):
                far = footrule(lists, order)
                wanted = min(len(ids), max(10 * k, int(np.ceil(share * len(ids)))))
                if wanted < len(ids):
                    least = np.partition(far, wanted - 1)[wanted - 1]
                    near = np.flatnonzero(far <= least)  # ties stay, so equal vectors stay together
                else:
                    near = np.arange(len(ids))
                near = near[ids[near] != id]
                score = (rows[near] * vector).sum(axis=1)
                best = np.lexsort((ids[near], -score))[:k]
                found.append((np.full(len(best), number), np.full(len(best), id), ids[near][best], score[best]))
        merged = [np.concatenate(x) for x in zip(*found, strict=True)] if found else [np.empty(0)] * 4
        types = [pa.int64(), pa.int64(), pa.int64(), pa.float64()]
        columns = [pa.array(x, t, safe=False) for x, t in zip(merged, types, strict=True)]
        return pa.table([*columns, pa.array([key[1].as_py()] * len(merged[0]), pa.int64())], names=names)

    return search


def nearest(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 20,
    id: str = "vec_id",
    vector: str = "embedding",
    pivots: int = PIVOTS,
    share: float = SHARE,
    shard_rows: int = SHARD_ROWS,
    tile_queries: int = TILE_QUERIES,
) -> DataFrame:
    """The ``k`` nearest rows found for every query: query, query_id, rank, vec_id, score.

    Nearness is the inner product of the original vectors in double precision. Every usable row is
    indexed; in each shard the ``share`` of rows with the least footrule distance (ties included)
    is ranked again. Vectors that are NULL, all zero, or hold NULL or non-finite components take no
    part, nor do NULL ids; vectors meet those of their own length. Repeated rows (same id
    and vector) count once; rows with the query's id count as its own. Ties go to the smaller id.
    """
    folder = new_folder(vectors)

    def plain(df: DataFrame) -> DataFrame:
        df = df.select(F.col(id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector"))
        return df.filter(F.col("id").isNotNull() & usable_vector(F.col("vector"), zero=False)).dropDuplicates()

    rows = stored(plain(vectors), folder, "rows")
    size = F.size("vector")
    asked = stored(plain(queries).withColumn("query", F.monotonically_increasing_id()), folder, "queries")
    lists, most = None, 1
    # An index for each length of vectors.
    for length in sorted(x[0] for x in rows.select(size).distinct().collect()) or [0]:
        own, like = rows.filter(size == length), asked.filter(size == length)
        fitted = pivot_sample(own, "id", "vector", min(pivots, 256))
        shards = max(1, -(-own.count() // shard_rows))
        tiles = max(1, -(-like.count() // tile_queries))
        index = stored(build_index(own, fitted, shards), folder, f"index{length}")
        left = like.withColumn("tile", F.pmod(F.xxhash64("query"), F.lit(tiles))).select("*", copied(shards).alias("shard"))
        right = index.select("*", copied(tiles).alias("tile"))
        found = (
            left.groupBy("tile", "shard")
            .cogroup(right.groupBy("tile", "shard"))
            .applyInArrow(_search(fitted, k, share), "query long, query_id long, vec_id long, score double, shard long")
        )
        lists, most = (found if lists is None else lists.unionByName(found)), max(most, shards)
    order = [F.col("score").desc(), F.col("vec_id")]
    best = top_by_tree(lists, ["query"], order, k, "shard", most)
    return best.select("query", "query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
