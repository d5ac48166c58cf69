"""Joins whose keys are very uneven."""

import pytest
from pyspark.sql import functions as F

from pulsepress.operators.joins import attach, heavy_keys
from pulsepress.sources.scratch import session_settings


@pytest.fixture(scope="module")
def facts(spark):
    """A third of all rows in one key, a sixth without a key, the rest in 900 keys."""
    n = F.col("id")
    key = F.when(n % 6 < 2, "hot").when(n % 6 == 2, None).otherwise(F.concat(F.lit("k"), (F.floor(n / 6) % 900).cast("string")))
    return spark.range(60_000).select(F.concat(F.lit("u"), n.cast("string")).alias("url"), key.alias("source"))


@pytest.fixture(scope="module")
def lookup(spark):
    few = spark.range(800).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("source"), F.col("id").alias("value"))
    return few.unionByName(spark.sql("SELECT 'hot' AS source, 7000L AS value"))


def test_heavy_keys_are_few_and_counted(facts):
    got = {r["source"]: r["__salts"] for r in heavy_keys(facts, ["source"], 16).collect()}
    assert got == {"hot": 43, None: 22}
    assert heavy_keys(facts.limit(0), ["source"], 16).count() == 0


@pytest.mark.parametrize("how", ["left", "inner", "left_anti"])
def test_salted_join_equals_the_plain_one(facts, lookup, how):
    got = attach(facts, lookup, "source", how=how, limit=0, measured=True, parts=16)
    want = facts.join(lookup, "source", how)
    columns = [c for c in want.columns]
    assert sorted(got.columns) == sorted(columns)
    assert sorted(map(repr, got.select(columns).collect())) == sorted(map(repr, want.collect()))


def test_no_task_reads_over_three_times_the_median(spark, facts, lookup):
    settings = {
        "spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "16", "spark.sql.autoBroadcastJoinThreshold": "-1",
    }
    with session_settings(spark, settings):
        def largest(df):
            counts = sorted(r["count"] for r in df.groupBy(F.spark_partition_id().alias("p")).count().collect())
            return counts[-1] / counts[len(counts) // 2]

        assert largest(facts.join(lookup, "source", "left")) > 5
        assert largest(attach(facts, lookup, "source", limit=0, measured=True)) <= 3
