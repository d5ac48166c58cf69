"""Join helpers that stay safe when a side is large or one key holds a large share of the rows."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BROADCAST_LIMIT = 32 * 1024 * 1024
# Pieces of a heavy key to a task's share of rows.
FINE = 8
LIST_LIMIT = 100_000


def estimated_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of a DataFrame, taken from its optimized plan."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def fits_broadcast(df: DataFrame, limit: int = BROADCAST_LIMIT) -> bool:
    return estimated_bytes(df) <= limit


def small_or_shuffled(df: DataFrame, limit: int = BROADCAST_LIMIT) -> DataFrame:
    """The DataFrame with a broadcast hint when its size estimate allows it, else unchanged."""
    return F.broadcast(df) if fits_broadcast(df, limit) else df


def matching_keys(table: DataFrame, batch: DataFrame, keys: list[str]) -> DataFrame:
    """The distinct keys of ``batch`` that occur in ``table``.

    Only the key columns of the table are read. A batch of checked size goes to every executor,
    so that the table is not shuffled. Otherwise both sides are reduced to distinct keys, before
    and after one shuffle each, and joined where they are.
    """
    wanted = batch.select(*keys).distinct()
    if fits_broadcast(wanted):
        # No more rows than the batch has keys, so the result may be broadcast as well.
        return F.broadcast(table.select(*keys).join(F.broadcast(wanted), keys, "left_semi").distinct())
    return table.select(*keys).distinct().join(wanted, keys, "left_semi")


def heavy_keys(facts: DataFrame, keys: list[str], parts: int | None = None) -> DataFrame:
    """Keys with more rows than a task should read, with ``__salts``, the pieces to cut them into.

    A task's share is the number of rows over ``parts`` (default: the shuffle partitions), so no more
    than ``parts`` keys are heavy. Pieces are ``FINE`` to a share, as their places are drawn by hash and
    several may meet. NULL counts as a key. Rows are counted before the shuffle.
    """
    parts = parts or int(facts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = facts.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    share = facts.agg(F.ceil(F.count(F.lit(1)) / F.lit(parts))).scalar()
    return counts.filter(F.col("__n") > share).select(*keys, F.ceil(FINE * F.col("__n") / share).cast("int").alias("__salts"))


def attach(
    facts: DataFrame,
    lookup: DataFrame,
    keys: str | list[str],
    spread: str | list[str] = "url",
    how: str = "left",
    salts: int = 16,
    limit: int = BROADCAST_LIMIT,
    measured: bool = False,
    parts: int | None = None,
) -> DataFrame:
    """Join a lookup table with one row per key to facts whose keys may be very uneven.

    A lookup of checked size is broadcast. A larger one is copied ``salts`` times and each fact row
    takes one copy by the hash of its ``spread`` columns, so a hot key is shared by that many tasks.
    The copies need a shuffle of their own, which also lets Spark split what is still uneven; a
    lookup that comes straight from an aggregation would not.

    With ``measured``, for facts that are stored and cheap to read, the rows of every key are counted
    first, from the key columns alone. Heavy keys, fewer than there are partitions, get as many salts as
    their rows need, all other keys are joined as they are. Computed facts would be computed again.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    if fits_broadcast(lookup, limit):
        return facts.join(F.broadcast(lookup), keys, how)
    spread = [spread] if isinstance(spread, str) else list(spread)
    if not measured:
        salted = facts.withColumn("__salt", F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int"))
        copies = lookup.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        return salted.join(copies, [*keys, "__salt"], how).drop("__salt")
    heavy = heavy_keys(facts, keys, parts)

    def with_salts(rows: DataFrame) -> DataFrame:
        marked = heavy.select(*[F.col(k).alias(f"__{k}") for k in keys], "__salts")
        same = reduce(and_, [rows[k].eqNullSafe(marked[f"__{k}"]) for k in keys])
        return rows.join(F.broadcast(marked), same, "left").drop(*[f"__{k}" for k in keys])

    own = F.pmod(F.xxhash64(*spread), F.col("__salts")).cast("int")
    salted = with_salts(facts).withColumn("__salt", F.coalesce(own, F.lit(0))).drop("__salts")
    every = F.explode(F.sequence(F.lit(0), F.coalesce(F.col("__salts"), F.lit(1)) - 1))
    copies = with_salts(lookup).withColumn("__salt", every).drop("__salts")
    return salted.join(copies, [*keys, "__salt"], how).drop("__salt")


def lists_in_parts(
    df: DataFrame, key: str, value: str, name: str, part: str = "part", limit: int = LIST_LIMIT
) -> DataFrame:
    """Sorted list of values per key, cut into parts so that no list grows without bound.

    A key with at most ``limit`` values gives one row with part 0. A larger one gives several rows,
    its values spread over them by hash; together they hold every value. The parts are built in
    separate tasks, so one key with a large share of the rows does not end in one task.
    """
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > limit)
    parts = counts.select(key, F.ceil(F.col("__n") * 2 / limit).cast("int").alias("__parts"))
    numbered = attach(df.select(key, value), parts, key, spread=value)
    numbered = numbered.select(
        key,
        value,
        F.when(F.col("__parts").isNull(), 0)
        .otherwise(F.pmod(F.xxhash64(value), F.col("__parts")).cast("int"))
        .alias(part),
    )
    # Without the explicit exchange Spark would keep the partitioning by the key alone.
    return (
        numbered.repartition(key, part)
        .groupBy(key, part)
        .agg(F.array_sort(F.collect_list(value)).alias(name))
    )


def lists_per_key(df: DataFrame, key: str, value: str, name: str, limit: int = LIST_LIMIT) -> DataFrame:
    """One row per key with the sorted list of its values, NULL where there are more than ``limit``.

    Keys with so many values are found first, by counts that are combined before the shuffle, and
    their values never come together; ``lists_in_parts`` has them.
    """
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("__n"))
    many = counts.filter(F.col("__n") > limit).select(key)
    few = df.select(key, value).join(small_or_shuffled(many), key, "left_anti")
    lists = few.groupBy(key).agg(F.array_sort(F.collect_list(value)).alias(name))
    return lists.unionByName(many.withColumn(name, F.lit(None).cast(lists.schema[name].dataType)))


def first_per_key(df: DataFrame, keys: list, order: list[Column]) -> DataFrame:
    """The first row of every key by the given order, NULL keys forming one key.

    The rank filter is planned as a per-task group limit before the shuffle, so each task sends at
    most one row per key, however often a key is repeated.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rank", F.row_number().over(window)).filter("__rank = 1").drop("__rank")
