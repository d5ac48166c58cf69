"""Exact top-k search: tiles of queries and shards, a partial selection per tile, merged in a tree."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsepress.llm.common import copied, new_folder, stored, top_by_tree, usable_vector

TILE_QUERIES = 4096
TILE_ROWS = 8192
#: Queries multiplied with a shard at once, which bounds the score matrix of a task.
STEP = 256
#: Whole numbers up to this size multiply and add up exactly in double precision.
EXACT = 2.0**53


def scaled(vector: Column, scale: int = 256) -> Column:
    """Whole-number vector of floor(scale * x) for every component x, taken as double."""
    return F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))


def matrix(column: pa.ChunkedArray, dtype) -> np.ndarray:
    """The vectors of an Arrow list column of one length as a matrix."""
    rows = len(column)
    flat = [chunk.flatten().to_numpy(zero_copy_only=False) for chunk in column.chunks]
    flat = np.concatenate(flat).astype(dtype) if flat else np.empty(0, dtype)
    return flat.reshape(rows, -1) if rows else np.empty((0, 0), dtype)


def best_columns(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column numbers of the ``k`` largest scores of each row, ties to smaller columns."""
    rows, columns = scores.shape
    if columns > k:
        least = np.partition(scores, columns - k, axis=1)[:, columns - k]
    else:
        least = scores.min(axis=1, initial=np.inf if scores.dtype.kind == "f" else np.iinfo(scores.dtype).max)
    row, column = np.nonzero(scores >= least[:, None])
    order = np.lexsort((column, ~scores[row, column] if scores.dtype.kind == "i" else -scores[row, column], row))
    row, column = row[order], column[order]
    place = np.arange(len(row)) - np.searchsorted(row, np.arange(rows))[row]
    keep = place < k
    return row[keep], column[keep]


def _products(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    bound = np.abs(queries).max(initial=0).astype(float) * np.abs(rows).max(initial=0).astype(float)
    if bound * max(1, rows.shape[1]) < EXACT:
        return queries.astype(np.float64) @ rows.astype(np.float64).T
    return queries @ rows.T


def _tile(k: int):
    def select(key, queries, rows):
        rows = rows.sort_by("id")
        ids = rows["id"].to_numpy()
        numbers, own = queries["query"].to_numpy(), queries["id"].to_numpy()
        left, right = matrix(queries["vector"], np.int64), matrix(rows["vector"], np.int64)
        parts: list[tuple[np.ndarray, ...]] = []
        for start in range(0, len(own) if len(ids) else 0, STEP):
            scores = _products(left[start : start + STEP], right)
            taken = own[start : start + STEP][:, None] == ids[None, :]
            ranked = np.where(taken, np.iinfo(np.int64).min if scores.dtype == np.int64 else -np.inf, scores)
            row, column = best_columns(ranked, k)
            keep = ~taken[row, column]
            row, column = row[keep], column[keep]
            found = scores[row, column].astype(np.int64)
            parts.append((numbers[start + row], own[start + row], ids[column], found))
        merged = [np.concatenate(x) for x in zip(*parts, strict=True)] if parts else [np.empty(0, np.int64)] * 4
        shard = np.full(len(merged[0]), key[1].as_py(), np.int64)
        names = ["query", "query_id", "vec_id", "score", "shard"]
        return pa.table([pa.array(x, pa.int64()) for x in (*merged, shard)], names=names)

    return select


def top_k(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 5,
    id: str = "vec_id",
    vector: str = "embedding",
    tile_queries: int = TILE_QUERIES,
    tile_rows: int = TILE_ROWS,
) -> DataFrame:
    """The ``k`` rows of ``vectors`` with the largest inner product for every row of ``queries``.

    Both hold a long ``id`` and an array of whole numbers (see ``scaled``). Queries and rows are
    dealt by hash into tiles of bounded size; one task multiplies a tile of queries with a shard
    of rows and sends on at most ``k`` rows of each query; the lists are merged in a tree.

    A row with the query's id counts as the query's own and is never found. Repeated rows (same id
    and vector) count once; an id with several vectors keeps each, as queries they are answered
    one by one (``query`` numbers them). Vectors match vectors of their own length only. NULL
    ids and NULL vectors take no part; a query without any candidate has no rows. Ties go to the
    smaller id. Scores are 64-bit whole numbers. Returns query, query_id, rank, vec_id, score.
    """
    folder = new_folder(vectors)

    def plain(df: DataFrame) -> DataFrame:
        df = df.select(F.col(id).cast("long").alias("id"), F.col(vector).cast("array<long>").alias("vector"))
        return df.filter(F.col("id").isNotNull() & F.col("vector").isNotNull()).dropDuplicates()

    asked = plain(queries).withColumn("query", F.monotonically_increasing_id())
    asked = stored(asked, folder, "queries").withColumn("size", F.size("vector"))
    rows = stored(plain(vectors), folder, "rows").withColumn("size", F.size("vector"))
    tiles = max(1, -(-asked.count() // tile_queries))
    shards = max(1, -(-rows.count() // tile_rows))

    def dealt(df: DataFrame, own: str, parts: int, other: str, copies: int) -> DataFrame:
        hashed = F.xxhash64("id", "vector")
        df = df.withColumn(own, F.pmod(hashed, F.lit(parts)))
        return df.withColumn(other, copied(copies))

    left = dealt(asked, "tile", tiles, "shard", shards).select("tile", "shard", "size", "query", "id", "vector")
    right = dealt(rows, "shard", shards, "tile", tiles).select("tile", "shard", "size", "id", "vector")
    keys = ["tile", "shard", "size"]
    lists = (
        left.groupBy(*keys)
        .cogroup(right.groupBy(*keys))
        .applyInArrow(_tile(k), "query long, query_id long, vec_id long, score long, shard long")
    )
    order = [F.col("score").desc(), F.col("vec_id")]
    best = top_by_tree(lists, ["query"], order, k, "shard", shards)
    return best.select("query", "query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def scaled_vectors(embeddings: DataFrame, id: str = "vec_id", vector: str = "embedding", scale: int = 256) -> DataFrame:
    """Rows whose vector is usable, as whole numbers.

    A vector whose scaled components leave the range of 62 bits takes no part either.
    """
    narrow = embeddings.select(F.col(id).cast("long").alias(id), F.col(vector).alias(vector))
    narrow = narrow.filter(usable_vector(F.col(vector)))
    narrow = narrow.filter(~F.exists(vector, lambda x: F.abs(x.cast("double")) * scale >= 2.0**62))
    return narrow.withColumn(vector, scaled(F.col(vector), scale))
