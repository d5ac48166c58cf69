"""Labelling articles with the reference labels nearest to their embedding."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsepress.functions.vectors import as_matrix, distances
from pulsepress.operators.ingest import one_per_key, update
from pulsepress.operators.joins import attach
from pulsepress.schemas import NEAREST_LABELS

# Labels that travel with every task, and articles that meet one block of a larger label table.
LABEL_BLOCK = 4096
ARTICLE_BLOCK = 20_000

_NEAREST = "array<struct<distance:double,label:string>>"


def add_nearest_labels(
    articles: DataFrame,
    labels: DataFrame,
    label: str,
    name: str = "nearest",
    n: int = NEAREST_LABELS,
    block: int = LABEL_BLOCK,
    article_block: int = ARTICLE_BLOCK,
) -> DataFrame:
    """Articles with their ``n`` closest labels by cosine distance, closest first, ties by label.

    A label table of at most ``block`` rows travels with the tasks, and no row is shuffled. A
    larger one is cut into blocks; every block meets blocks of different embeddings in tasks of fixed
    size, and the best of each are merged per embedding, so that every row gets its own labels. NULL
    without an embedding of the labels' length, no labels where no distance is defined.
    """
    reference = labels.filter(F.col("embedding").isNotNull()).select(F.col(label).alias("label"), "embedding")
    some = reference.orderBy("label").limit(block + 1).collect()
    if len(some) <= block:
        return articles.withColumn(name, _label_column(some, n)(F.col("embedding")))
    length = len(some[0]["embedding"])
    keyed = articles.withColumn("__key", _key())
    found = _labels_in_blocks(keyed, reference, length, n, block, article_block)
    joined = attach(keyed, found.withColumnRenamed("nearest", "__nearest"), "__key")
    nearest = F.coalesce("__nearest", F.array().cast(_NEAREST))
    return joined.withColumn(name, F.when(F.size("embedding") == length, nearest)).drop("__key", "__nearest")


def _key() -> Column:
    """Stands for an embedding; rows may share a url, so labels are merged by what they follow from."""
    return F.sha2(F.col("embedding").cast("string"), 256)


def _nearest(measured: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, distance) of the n smallest entries of every row, ties by column number."""
    # Products of different shapes differ in their last bits, which must not decide between labels.
    measured = np.where(np.isnan(measured), np.inf, np.round(measured, 12) + 0.0)
    last = min(n, measured.shape[1]) - 1
    cut = np.partition(measured, last, axis=1)[:, last]
    rows, columns = np.nonzero((measured <= cut[:, None]) & np.isfinite(measured))
    values = measured[rows, columns]
    order = np.lexsort((columns, values, rows))
    rows, columns, values = rows[order], columns[order], values[order]
    keep = np.arange(len(rows)) - np.searchsorted(rows, rows) < n
    return rows[keep], columns[keep], values[keep]


def _label_column(some: list, n: int):
    names = np.array([row["label"] for row in some], dtype=object)
    matrix = np.array([row["embedding"] for row in some], dtype="float64")

    @F.arrow_udf(_NEAREST)
    def pick(vectors: pa.Array) -> pa.Array:
        result = [None] * len(vectors)
        if len(names):
            positions, own = as_matrix(vectors, matrix.shape[1])
            for position in positions:
                result[position] = []
            for row, column, value in zip(*_nearest(distances(own, matrix, "cosine"), n)):
                result[positions[row]].append({"distance": value, "label": names[column]})
        kind = pa.list_(pa.struct([("distance", pa.float64()), ("label", pa.string())]))
        return pa.array(result, type=kind)

    return pick


def _labels_in_blocks(
    keyed: DataFrame, reference: DataFrame, length: int, n: int, block: int, article_block: int
) -> DataFrame:
    vectors = keyed.filter(F.size("embedding") == length).select("__key", "embedding").dropDuplicates(["__key"])
    label_blocks = 2 * -(-reference.count() // block)
    article_blocks = max(1, -(-vectors.count() // article_block))

    def every(count: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(count - 1)))

    left = vectors.withColumn("ab", F.pmod(F.xxhash64("__key"), F.lit(article_blocks)).cast("int"))
    right = reference.withColumn("lb", F.pmod(F.xxhash64("label"), F.lit(label_blocks)).cast("int"))
    left, right = left.withColumn("lb", every(label_blocks)), right.withColumn("ab", every(article_blocks))

    def compare(some: pa.Table, block_labels: pa.Table) -> pa.Table:
        block_labels = block_labels.sort_by("label")
        keys, names, gaps = [], [], []
        if some.num_rows and block_labels.num_rows:
            reference_vectors = block_labels["embedding"].combine_chunks()
            which, matrix = as_matrix(reference_vectors, length)
            positions, own = as_matrix(some["embedding"].combine_chunks(), length)
            rows, columns, gaps = _nearest(distances(own, matrix, "cosine"), n)
            keys = some["__key"].take(pa.array(positions[rows]))
            names = block_labels["label"].take(pa.array(which[columns]))
        return pa.table(
            {"__key": _text(keys), "label": _text(names), "distance": pa.array(gaps, pa.float64())}
        )

    best = (
        left.groupBy("ab", "lb")
        .cogroup(right.groupBy("ab", "lb"))
        .applyInArrow(compare, "__key string, label string, distance double")
    )
    # At most n rows per embedding and label block reach this merge.
    merged = best.groupBy("__key").agg(F.array_sort(F.collect_list(F.struct("distance", "label"))).alias("nearest"))
    return merged.select("__key", F.slice("nearest", 1, n).alias("nearest"))


def _text(values) -> pa.Array:
    return values.combine_chunks().cast(pa.string()) if isinstance(values, pa.ChunkedArray) else pa.array(values, pa.string())


def label_sets(vectors: DataFrame, categories: DataFrame, sentiments: DataFrame, n: int = NEAREST_LABELS) -> DataFrame:
    """(url, embedding, categories, sentiments) with sorted sets of the nearest labels."""

    def names(column: str) -> Column:
        return F.array_sort(F.array_distinct(F.transform(column, lambda x: x["label"])))

    found = add_nearest_labels(vectors.select("url", "embedding"), categories, "category", "__c", n)
    found = add_nearest_labels(found, sentiments, "sentiment", "__s", n)
    return found.select("url", "embedding", names("__c").alias("categories"), names("__s").alias("sentiments"))


def update_embeddings(
    articles: DataFrame,
    batch: DataFrame,
    categories: DataFrame,
    sentiments: DataFrame,
    order: Sequence[Column] | None = None,
) -> DataFrame:
    """Set embeddings of stored articles and the labels that follow from them."""
    found = label_sets(one_per_key(batch, ["url"], order), categories, sentiments)
    return update(articles, found, ["url"], unique=True)


def backfill_labels(articles: DataFrame, categories: DataFrame, sentiments: DataFrame) -> DataFrame:
    """Label the articles that have an embedding but no categories."""
    waiting = articles.filter(F.col("embedding").isNotNull() & F.col("categories").isNull())
    return update(articles, label_sets(waiting, categories, sentiments), ["url"], ["categories", "sentiments"], unique=True)
