"""Connected components of links by minimum labels and pointer jumping, all in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsepress.llm.common import drop, drop_others, stored


def components(links: DataFrame, folder: str, a: str = "a", b: str = "b") -> DataFrame:
    """``id`` and ``root`` of everything that is linked; the root is the smallest id reachable.

    Every round points each node to the least root among its neighbours', then shortens the
    pointers; a path of n links takes about log n rounds. The state is stored after each round, and
    the round before is removed; of ``folder`` only the last state stays.
    """
    spark = links.sparkSession
    pairs = links.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a <> b")
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = stored(both, folder, "links")
    roots = both.groupBy("a").agg(F.min("b").alias("least"))
    roots = stored(roots.select(F.col("a").alias("id"), F.least("a", "least").alias("root")), folder, "roots0")
    turn = 0
    while True:
        turn += 1
        of = roots.select(F.col("id").alias("b"), F.col("root").alias("near"))
        near = both.join(of, "b").groupBy(F.col("a").alias("id")).agg(F.min("near").alias("near"))
        # The root of a node hears of what its members have seen.
        heard = roots.join(near, "id").select("root", F.least("root", "near").alias("near"))
        heard = heard.groupBy(F.col("root").alias("id")).agg(F.min("near").alias("far"))
        seen = roots.join(near, "id").join(heard, "id", "left")
        seen = seen.select("id", F.least("root", "near", F.coalesce("far", "root")).alias("root"), F.col("root").alias("was"))
        seen = stored(seen, folder, f"seen{turn}")
        jump = seen.select(F.col("id").alias("root"), F.col("root").alias("next"))
        moved = seen.join(jump, "root").select("id", F.col("next").alias("root"), (F.col("next") != F.col("was")).alias("new"))
        moved = stored(moved, folder, f"roots{turn}")
        roots = moved.select("id", "root")
        drop(spark, folder, f"seen{turn}", f"roots{turn - 1}")
        if not moved.filter("new").limit(1).count():
            drop_others(spark, folder, f"roots{turn}")
            return roots
