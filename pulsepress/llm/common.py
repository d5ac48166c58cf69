"""Helpers shared by the operators of this folder."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pulsepress.sources.folders import children, remove
from pulsepress.sources.scratch import scratch_folder


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def stored(df: DataFrame, folder: str, name: str) -> DataFrame:
    """Write a DataFrame below ``folder`` and read it back.

    The copy cuts the lineage: what builds on it sees the same rows however often it is evaluated,
    also after an executor is lost.
    """
    path = f"{folder}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Lists that note the folders made while they are in force.
_NOTED: ContextVar[tuple[list[str], ...]] = ContextVar("_NOTED", default=())


def new_folder(df: DataFrame) -> str:
    folder = scratch_folder(df.sparkSession)
    for made in _NOTED.get():
        made.append(folder)
    return folder


@contextmanager
def folders_made() -> Iterator[list[str]]:
    """The folders that operators make within the block, to be removed once their result is stored elsewhere."""
    made: list[str] = []
    token = _NOTED.set((*_NOTED.get(), made))
    try:
        yield made
    finally:
        _NOTED.reset(token)


def drop(spark: SparkSession, folder: str, *names: str) -> None:
    """Remove tables that ``stored`` wrote below ``folder``, without names the folder.

    What is still to be read of them must be stored elsewhere by then.
    """
    for path in [f"{folder}/{name}" for name in names] or [folder]:
        remove(spark, path)


def drop_others(spark: SparkSession, folder: str, *names: str) -> None:
    """Remove everything below ``folder`` but the tables named."""
    for path, _ in children(spark, folder):
        if path.rstrip("/").rsplit("/", 1)[-1] not in names:
            remove(spark, path)


def numbered(df: DataFrame, folder: str, name: str, row: str = "row") -> DataFrame:
    """A stored copy of ``df`` with a number for every row, the same at each evaluation."""
    return stored(df.withColumn(row, F.monotonically_increasing_id()), folder, name)


def copied(n: int) -> Column:
    """A generator of the long numbers below ``n``, to copy a row to ``n`` parts."""
    return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))


def shuffle_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def top_by_tree(
    lists: DataFrame, keys: list[str], order: Iterable[Column], k: int, group: str, groups: int, fan_in: int = 16
) -> DataFrame:
    """Merge the partial lists of every key, ``fan_in`` groups at a time, keeping ``k`` rows.

    Each level ranks within (key, group // fan_in); the rank filter is planned as a group limit, so
    a task sends no more than ``k`` rows of a key and group. Adds ``rank`` from 1.
    """
    order = list(order)
    while True:
        groups = -(-groups // fan_in)
        lists = lists.withColumn(group, F.floor(F.col(group) / fan_in))
        within = Window.partitionBy(*keys, group) if groups > 1 else Window.partitionBy(*keys)
        lists = lists.withColumn("rank", F.row_number().over(within.orderBy(*order))).filter(F.col("rank") <= k)
        if groups <= 1:
            return lists.drop(group)


def usable_vector(vector: Column, zero: bool = True) -> Column:
    """Not NULL, no NULL or non-finite component; with ``zero=False`` also not all zero."""

    def bad(x: Column) -> Column:
        x = x.cast("double")
        return x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))

    usable = vector.isNotNull() & ~F.exists(vector, bad)
    if not zero:
        usable = usable & F.exists(vector, lambda x: x != 0)
    return F.coalesce(usable, F.lit(False))
