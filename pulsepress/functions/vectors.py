"""Distances between an embedding column and a query vector.

The arithmetic runs on whole Arrow batches: for 384 numbers per row that measured about ten times
faster than ``aggregate(zip_with(...))``, which Spark interprets element by element.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

METRICS = ("cosine", "l2", "dot")


def as_matrix(vectors: pa.Array, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(row numbers, matrix in double) of the vectors that have the wanted length."""
    fits = pc.fill_null(pc.equal(pc.list_value_length(vectors), length), False)
    rows = np.flatnonzero(fits.to_numpy(zero_copy_only=False))
    values = vectors.filter(fits).flatten().to_numpy(zero_copy_only=False)
    return rows, values.astype("float64").reshape(len(rows), length)


def distances(matrix: np.ndarray, queries: np.ndarray, metric: str) -> np.ndarray:
    """Distance of every row of ``matrix`` to every row of ``queries``; NaN where undefined."""
    dots = matrix @ queries.T
    if metric == "dot":
        return 1.0 - dots
    own = np.einsum("ij,ij->i", matrix, matrix)[:, None]
    other = np.einsum("ij,ij->i", queries, queries)[None, :]
    if metric == "cosine":
        with np.errstate(divide="ignore", invalid="ignore"):
            return 1.0 - dots / np.sqrt(own * other)
    squared = own + other - 2.0 * dots
    near = np.argwhere(squared < 1e-4 * (own + other))
    for i, j in near:
        gap = matrix[i] - queries[j]
        squared[i, j] = gap @ gap
    return np.sqrt(np.maximum(squared, 0.0))


def distance(embedding, query: Sequence[float], metric: str = "cosine") -> Column:
    """Distance of each embedding to one query vector, in double precision.

    cosine is one minus the cosine, l2 is Euclidean, dot is one minus the dot product. NULL where
    the embedding is missing, has another length or the distance is not defined.
    """
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}, got {metric!r}")
    target = np.asarray(query, dtype="float64")[None, :]

    @F.arrow_udf("double")
    def to_query(vectors: pa.Array) -> pa.Array:
        rows, matrix = as_matrix(vectors, target.shape[1])
        result = np.full(len(vectors), np.nan)
        result[rows] = distances(matrix, target, metric)[:, 0]
        return pa.array(result, mask=np.isnan(result))

    # Otherwise a filter on the distance would be moved below it and measure every vector twice.
    return to_query.asNondeterministic()(F.col(embedding) if isinstance(embedding, str) else embedding)


def distance_between(left, right, metric: str = "cosine") -> Column:
    """Distance of two embedding columns, row by row, in double precision; NULL as in ``distance``."""
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}, got {metric!r}")

    @F.arrow_udf("double")
    def of_rows(a: pa.Array, b: pa.Array) -> pa.Array:
        size = pc.list_value_length(a)
        fits = pc.fill_null(pc.equal(size, pc.list_value_length(b)), False).to_numpy(zero_copy_only=False)
        result = np.full(len(a), np.nan)
        sizes = size.to_numpy(zero_copy_only=False)
        for length in np.unique(sizes[fits]).astype(int).tolist():
            rows = np.flatnonzero(fits & (sizes == length))
            x, y = (as_matrix(v.take(pa.array(rows)), length)[1] for v in (a, b))
            dots, own, other = ((p * q).sum(1) for p, q in ((x, y), (x, x), (y, y)))
            with np.errstate(divide="ignore", invalid="ignore"):
                result[rows] = {
                    "dot": lambda: 1.0 - dots,
                    "cosine": lambda: 1.0 - dots / np.sqrt(own * other),
                    "l2": lambda: np.sqrt(((x - y) ** 2).sum(1)),
                }[metric]()
        return pa.array(result, mask=np.isnan(result))

    def column(x) -> Column:
        return F.col(x) if isinstance(x, str) else x

    return of_rows.asNondeterministic()(column(left), column(right))
