"""Orders with a unique last key, and pages of ordered rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsepress.sources.scratch import scratch_folder


def latest() -> list[Column]:
    return [F.col("created").desc(), F.col("url")]


def trending() -> list[Column]:
    return [F.col("trend_score").desc_nulls_last(), F.col("url")]


def nearest(*then: Column) -> list[Column]:
    """By distance, then by the base order."""
    return [F.col("distance").asc_nulls_last(), *(then or (F.col("url"),))]


def latest_trending() -> list[Column]:
    return [F.col("created").desc(), F.col("trend_score").desc_nulls_last(), F.col("url")]


def recently_trending() -> list[Column]:
    return [F.col("updated").desc_nulls_last(), F.col("trend_score").desc_nulls_last(), F.col("url")]


#: Rows up to which a page is kept as a top list by every task.
TOP_ROWS = 10_000


def page(df: DataFrame, order: list[Column], limit: int = 0, offset: int = 0, key: str = "url") -> DataFrame:
    """Ordered rows after ``offset``, at most ``limit`` of them; 0 means no bound.

    With a small limit and offset Spark keeps only the top rows of each task. Other pages are cut from the
    ranges of a sort. ``key`` names the last column of the order.
    """
    if not (limit or offset):
        return df.orderBy(*order)
    if limit and limit + offset <= TOP_ROWS:
        ordered = df.orderBy(*order)
        return (ordered.offset(offset) if offset else ordered).limit(limit)
    return range_page(df, order, limit, offset)


def range_page(df: DataFrame, order: list[Column], limit: int = 0, offset: int = 0) -> DataFrame:
    """A page of any size, by the place of each row in the ranges of a sort.

    The rows are sorted by ranges and written once below ``spark.checkpoint.dir``; a range's place is
    its partition number. Counts of the ranges, as many as there are partitions, give the place of each
    range's first row, and only rows of the ranges that the page touches are read again. No task sees
    more than its own range, and no key has to tell rows apart: equal rows count one by one.
    """
    small = limit and limit + offset <= TOP_ROWS
    if small:
        ordered = df.orderBy(*order)
        return (ordered.offset(offset) if offset else ordered).limit(limit)
    spark, path = df.sparkSession, scratch_folder(df.sparkSession)
    # The number has the partition above 33 bits and the row below, in the order of the sort.
    numbered = df.orderBy(*order).withColumn("__at", F.monotonically_increasing_id())
    numbered = numbered.withColumn("__range", F.shiftright("__at", 33).cast("int"))
    numbered.write.partitionBy("__range").parquet(path)
    kept = spark.read.schema(numbered.schema).parquet(path)
    counts = {r["__range"]: r["n"] for r in kept.groupBy("__range").agg(F.count(F.lit(1)).alias("n")).collect()}
    place, parts = 0, []
    for number in sorted(counts):
        low, high = offset - place, (offset + limit - place) if limit else counts[number]
        if low < counts[number] and high > 0:
            inside = F.col("__range") == number
            if low > 0:
                inside = inside & (F.expr("__at & 8589934591") >= low)
            if high < counts[number]:
                inside = inside & (F.expr("__at & 8589934591") < high)
            parts.append(inside)
        place += counts[number]
    # Neighbouring whole ranges need no condition of their own.
    found = kept.filter(_either(parts)) if parts else kept.filter(F.lit(False))
    return found.orderBy("__at").drop("__at", "__range")


def _either(parts: list[Column]) -> Column:
    """Any of the conditions, joined as a balanced tree, so that many of them do not nest deeply."""
    while len(parts) > 1:
        parts = [a | b for a, b in zip(parts[::2], parts[1::2], strict=False)] + (parts[-1:] if len(parts) % 2 else [])
    return parts[0]
