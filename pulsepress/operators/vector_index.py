"""Stored vector index: vectors lie in folders by cell, and a search reads the cells near its query.

Cells are the regions around centres that k-means finds on a bounded sample. The sample also tells how
many cells a search has to read: so many that its own rows find the wanted share of their exact
neighbours. Rows of a sample lie further apart than all rows do, so this errs towards reading more.
What is read is ranked by the exact distance.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsepress.functions.vectors import as_matrix, distances
from pulsepress.operators.search import nearest_rows

CELL = "cell"
#: Rows that cells are trained on, most cells, rows of the sample that ask, and the neighbours they want.
SAMPLE_ROWS, MOST_CELLS, ASKING, WANTED = 8192, 4096, 256, 10
#: Share of the exact neighbours that a search should find.
RECALL = 0.95
ROUNDS = 12
#: Vectors measured against all centres at a time.
TILE = 2048


@dataclass(frozen=True)
class Cells:
    """Centres, how many of the nearest ones a search reads, and the rows of each cell."""

    centres: np.ndarray
    probe: int
    rows: tuple[int, ...] = ()

    def near(self, query: Sequence[float], metric: str = "l2", probe: int | None = None, limit: int = 0) -> list[int]:
        """The cells to read, nearest centre first: ``probe`` of them, and more until they hold ``limit`` rows."""
        gaps = distances(self.centres, np.asarray(query, "float64")[None, :], metric)[:, 0]
        order = np.argsort(np.nan_to_num(gaps, nan=np.inf), kind="stable")
        taken = min(len(order), probe or self.probe)
        if self.rows:
            held = np.cumsum(np.asarray(self.rows)[order])
            taken = max(taken, int(np.searchsorted(held, limit)) + 1)
        return order[:taken].tolist()


def _nearest_centre(vectors: np.ndarray, centres: np.ndarray) -> np.ndarray:
    own = np.einsum("ij,ij->i", centres, centres)
    tiles = [vectors[i : i + TILE] for i in range(0, len(vectors), TILE)]
    return np.concatenate([np.argmin(own - 2.0 * (x @ centres.T), axis=1) for x in tiles]) if tiles else np.empty(0, np.int64)


def _k_means(points: np.ndarray, cells: int, seed: int) -> np.ndarray:
    draw = np.random.default_rng(seed)
    centres = points[draw.choice(len(points), cells, replace=False)]
    for _ in range(ROUNDS):
        of = _nearest_centre(points, centres)
        sizes = np.bincount(of, minlength=cells)
        sums = np.zeros_like(centres)
        np.add.at(sums, of, points)
        # A cell that lost its points starts again at one drawn anew.
        lost = np.flatnonzero(sizes == 0)
        centres = sums / np.maximum(sizes, 1)[:, None]
        centres[lost] = points[draw.choice(len(points), len(lost))]
    return centres


def _probe(points: np.ndarray, centres: np.ndarray, recall: float, metric: str) -> int:
    """Cells that rows of the sample have to read to find the wanted share of their neighbours in it."""
    asking = points[:ASKING]
    of = _nearest_centre(points, centres)
    wanted = min(WANTED, len(points) - 1)
    if wanted < 1:
        return 1
    gaps = np.nan_to_num(distances(points, asking, metric).T, nan=np.inf)
    gaps[np.arange(len(asking)), np.arange(len(asking))] = np.inf
    nearest = np.argpartition(gaps, wanted - 1, axis=1)[:, :wanted]
    order = np.argsort(np.nan_to_num(distances(centres, asking, metric).T, nan=np.inf), axis=1, kind="stable")
    rank = np.empty_like(order)
    np.put_along_axis(rank, order, np.broadcast_to(np.arange(len(centres)), order.shape), axis=1)
    needed = np.sort(np.take_along_axis(rank, of[nearest], axis=1).ravel()) + 1
    return int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))) - 1)])


def train_cells(
    vectors: DataFrame,
    key: str = "url",
    cells: int | None = None,
    recall: float = RECALL,
    metric: str = "l2",
    sample: int = SAMPLE_ROWS,
    seed: int = 1,
) -> Cells:
    """Cells for the vectors of a table (``embedding``), from at most ``sample`` of them.

    The sample is drawn by a hash of the key. Its most common length of vector counts; others are
    left out of the index. There are about as many cells as the root of the number of rows.
    """
    usable = vectors.filter(F.col("embedding").isNotNull() & (F.size("embedding") > 0))
    count = usable.count()
    drawn = usable.select("embedding", F.xxhash64(F.col(key).cast("string"), F.lit(seed)).alias("__at"))
    rows = [r["embedding"] for r in drawn.orderBy("__at").limit(sample).select("embedding").collect()]
    rows = [r for r in rows if all(x is not None and np.isfinite(x) for x in r)]
    if not rows:
        return Cells(np.empty((0, 0)), 0)
    sizes = [len(r) for r in rows]
    length = max(set(sizes), key=sizes.count)
    points = np.array([r for r in rows if len(r) == length], "float64")
    number = cells or max(1, min(MOST_CELLS, round(count**0.5)))
    centres = _k_means(points, min(number, len(points)), seed)
    return Cells(centres, _probe(points, centres, recall, metric))


def cell_of(embedding: str | Column, cells: Cells) -> Column:
    """The cell of the nearest centre, the first of equal ones; NULL for other lengths and missing numbers."""
    centres = cells.centres

    @F.arrow_udf("int")
    def nearest(vectors: pa.Array) -> pa.Array:
        found = np.full(len(vectors), -1)
        if len(centres):
            rows, matrix = as_matrix(vectors, centres.shape[1])
            whole = np.isfinite(matrix).all(axis=1)
            found[rows[whole]] = _nearest_centre(matrix[whole], centres)
        return pa.array(found, pa.int32(), mask=found < 0)

    return nearest(F.col(embedding) if isinstance(embedding, str) else embedding)


def indexed(vectors: DataFrame, cells: Cells) -> DataFrame:
    """The rows that the index holds, with their ``cell``, gathered to few files a cell."""
    placed = vectors.withColumn(CELL, cell_of("embedding", cells)).filter(F.col(CELL).isNotNull())
    return placed.hint("rebalance", F.col(CELL))


def cell_rows(index: DataFrame, cells: Cells) -> Cells:
    """The cells with the number of rows that each holds in the index."""
    counts = {r[CELL]: r["n"] for r in index.groupBy(CELL).agg(F.count(F.lit(1)).alias("n")).collect()}
    return Cells(cells.centres, cells.probe, tuple(counts.get(i, 0) for i in range(len(cells.centres))))


def nearest_in_cells(
    index: DataFrame,
    cells: Cells,
    query: Sequence[float],
    limit: int,
    metric: str = "l2",
    probe: int | None = None,
    key: str = "url",
) -> DataFrame:
    """The nearest rows of the cells near the query, with their exact ``distance``.

    The cells are constants in the filter, so other folders are not opened. Where the rows of cells are
    known, cells are added until they hold ``limit`` rows; a filter put on ``index`` may leave fewer.
    """
    read = index.filter(F.col(CELL).isin(cells.near(query, metric, probe, limit)))
    return nearest_rows(read.drop(CELL), query, limit, metric=metric, key=key)
