"""Keyed inserts, updates and deletes as functions from a stored table and a batch to rows.

Plain parquet tables have no row-level changes, so every function returns the rows to write:
``new_*`` and ``append`` give rows to add, the others give the new content of the table. The
writers in ``pulsepress.sources`` decide which files or partitions that replaces.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsepress import schemas
from pulsepress.functions.dates import as_datetime, days_before, timestamp, window_start
from pulsepress.operators.joins import attach, first_per_key, fits_broadcast, matching_keys, small_or_shuffled


def deduplicate(table: DataFrame, batch: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Batch rows whose key is not stored. Repeats inside the batch stay; no key, no change."""
    keys = list(keys)
    if not keys:
        return batch
    stored = matching_keys(table, batch, keys)
    if fits_broadcast(batch.select(*keys).distinct()):
        return batch.join(stored, keys, "left_anti")
    rest = [c for c in batch.columns if c not in keys]
    return attach(batch, stored, keys, rest or keys, "left_anti")


def new_keys(table: DataFrame, batch: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct batch keys that are not stored."""
    keys = list(keys)
    return batch.select(*keys).subtract(matching_keys(table, batch, keys))


def new_rows(
    table: DataFrame, batch: DataFrame, keys: Sequence[str], order: Sequence[Column] | None = None
) -> DataFrame:
    """The first batch row of every key that is not stored.

    ``order`` says which row comes first; without it the least by all other columns, NULLs last.
    """
    return one_per_key(batch, keys, order).join(matching_keys(table, batch, keys), keys, "left_anti")


def one_per_key(batch: DataFrame, keys: Sequence[str], order: Sequence[Column] | None) -> DataFrame:
    """The first row of every key; without an order by all other columns in turn, NULLs last."""
    if not order:
        others = [f for f in batch.schema if f.name not in keys and "map<" not in f.dataType.simpleString()]
        order = [F.col(f"`{f.name}`").asc_nulls_last() for f in others]
    return first_per_key(batch, list(keys), list(order)) if order else batch.dropDuplicates(list(keys))


def align(batch: DataFrame, schema: T.StructType) -> DataFrame:
    """The columns of a table in its order and types; columns the batch lacks become NULL."""
    present = set(batch.columns)
    return batch.select(
        *[(F.col(f.name) if f.name in present else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema]
    )


def insert_if_absent(
    table: DataFrame, batch: DataFrame, keys: Sequence[str], order: Sequence[Column] | None = None
) -> DataFrame:
    """The table with the new batch rows added."""
    return table.unionByName(new_rows(table, batch, keys, order), allowMissingColumns=True)


def insert_articles(articles, batch, as_of, order=None) -> DataFrame:
    return insert_if_absent(articles, stamp(batch, as_of, "created", "collected"), ["url"], order)


def insert_publishers(publishers, batch, as_of, order=None) -> DataFrame:
    return insert_if_absent(publishers, stamp(batch, as_of, "collected"), ["source"], order)


def insert_related(related, batch, order=None) -> DataFrame:
    return insert_if_absent(related, batch, ["url", "related_url"], order)


def append_mentions(mentions, batch, as_of) -> DataFrame:
    """Snapshots are never matched; every batch row is added. Missing counts start at 0."""
    return mentions.unionByName(mention_rows(batch, as_of))


def mention_rows(batch: DataFrame, as_of) -> DataFrame:
    rows = align(stamp(batch, as_of, "collected"), schemas.MENTIONS)
    missing = [c for c in schemas.COUNT_COLUMNS if c not in batch.columns]
    return rows.fillna(0, subset=missing) if missing else rows


def insert_vector_items(items, batch, as_of, id_column: str = "id", order=None) -> DataFrame:
    """Items with a new id, all stamped with the moment of the batch in whole seconds (UTC)."""
    moment = as_datetime(as_of).replace(microsecond=0).isoformat(sep=" ") + "+00:00"
    return insert_if_absent(items, batch.withColumn("ts", F.lit(moment).cast("timestamp")), [id_column], order)


def stamp(batch: DataFrame, as_of, *columns: str) -> DataFrame:
    """Missing or NULL timestamps become ``as_of``."""
    for name in columns:
        filled = F.coalesce(F.col(name), timestamp(as_of)) if name in batch.columns else timestamp(as_of)
        batch = batch.withColumn(name, filled)
    return batch


def columns_with_values(batch: DataFrame) -> list[str]:
    """Columns that hold at least one non-NULL value. Runs one aggregation over the batch."""
    found = batch.agg(*[F.max(F.col(c).isNotNull()).alias(c) for c in batch.columns]).first()
    return [c for c in batch.columns if found[c]]


def non_null_columns(batch: DataFrame) -> DataFrame:
    return batch.select(*columns_with_values(batch))


def update(
    table: DataFrame,
    batch: DataFrame,
    keys: Sequence[str],
    columns: Sequence[str] | None = None,
    nulls: str = "set",
    order: Sequence[Column] | None = None,
    unique: bool = False,
) -> DataFrame:
    """The table with columns of matching rows replaced; batch keys that are not stored are ignored.

    ``columns`` defaults to all batch columns but the keys. ``nulls="set"`` writes NULLs of the
    batch, ``nulls="keep"`` keeps the stored value instead. ``order`` picks the batch row when a
    key is repeated: the first one counts. ``unique`` says that the batch repeats no key.
    """
    keys = list(keys)
    changed = [c for c in (columns or batch.columns) if c not in keys]
    firsts = batch if unique else one_per_key(batch, keys, order)
    pack = firsts.select(*keys, F.struct(*[F.col(c) for c in changed]).alias("__new"))
    joined = table.join(small_or_shuffled(pack), keys, "left")

    def value(name: str) -> Column:
        if name not in changed:
            return F.col(name)
        new = F.col("__new")[name].cast(_with_null_elements(table.schema[name].dataType))
        if nulls == "keep":
            return F.coalesce(new, F.col(name)).alias(name)
        return F.when(F.col("__new").isNotNull(), new).otherwise(F.col(name)).alias(name)

    return joined.select(*[value(c) for c in table.columns])


def _with_null_elements(kind: T.DataType) -> T.DataType:
    return T.ArrayType(kind.elementType) if isinstance(kind, T.ArrayType) else kind


def update_present_columns(table: DataFrame, batch: DataFrame, keys: Sequence[str], order=None) -> DataFrame:
    """Whole-row update limited to columns with a value somewhere in the batch (found eagerly)."""
    columns = [c for c in columns_with_values(batch) if c not in keys]
    return update(table, batch, keys, columns, order=order) if columns else table


def add_to_sets(table: DataFrame, batch: DataFrame, keys: Sequence[str], sets: Sequence[str], order=None) -> DataFrame:
    """Set columns gain the batch elements; other batch columns replace the stored value when truthy."""
    empty = F.array().cast("array<string>")
    keys = list(keys)
    changed = [c for c in batch.columns if c not in keys]
    pack = one_per_key(batch, keys, order).select(*keys, F.struct(*changed).alias("__new"))
    joined = table.join(small_or_shuffled(pack), keys, "left")

    def truthy(name: str) -> Column:
        new, kind = F.col("__new")[name], table.schema[name].dataType
        if isinstance(kind, T.StringType):
            return F.nullif(new, F.lit(""))
        if isinstance(kind, T.ArrayType):
            return F.when(F.size(new) > 0, new)
        if isinstance(kind, (T.NumericType, T.BooleanType)):
            return F.nullif(new, F.lit(0).cast(kind))
        return new

    def value(name: str) -> Column:
        if name not in changed:
            return F.col(name)
        if name in sets:
            new = F.coalesce(F.col("__new")[name], empty)
            union = F.array_distinct(F.concat(F.coalesce(F.col(name), empty), new))
            return F.when(F.size(new) > 0, union).otherwise(F.col(name)).alias(name)
        return F.coalesce(truthy(name), F.col(name)).alias(name)

    return joined.select(*[value(c) for c in table.columns])


def keep_recent(table: DataFrame, as_of, window: str = schemas.RETENTION_WINDOW) -> DataFrame:
    """Rows collected inside the retention window; rows without a collection time are kept."""
    start = window_start(as_of, window).cast("timestamp_ntz")
    return table.filter(F.col("collected").isNull() | (F.col("collected") >= start))


def drop_orphans(related: DataFrame, articles: DataFrame) -> DataFrame:
    """Pairs whose ``url`` is a stored article; the other side is not checked."""
    return related.join(articles.select("url"), "url", "left_semi")


def drop_older(table: DataFrame, as_of, days: int, column: str = "updated") -> DataFrame:
    """Without rows last updated more than ``days`` days ago; rows without a date are kept."""
    return table.filter(F.col(column).isNull() | (F.col(column) >= days_before(as_of, days)))


def drop_unprocessed(articles: DataFrame, as_of, days: int = schemas.CLEANUP_DAYS) -> DataFrame:
    """Without articles collected ``days`` ago that have neither cluster nor gist and are not generated."""
    stale = (
        (F.col("collected") < days_before(as_of, days))
        & F.col("cluster_id").isNull()
        & F.col("gist").isNull()
        & ~F.col("kind").eqNullSafe(F.lit(schemas.GENERATED_KIND))
    )
    return articles.filter(~F.coalesce(stale, F.lit(False)))
