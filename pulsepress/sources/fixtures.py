"""Article tables derived from the generic test tables; FIXTURES.md describes them."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsepress.functions.dates import timestamp
from pulsepress.operators.text_index import BUCKET, POSTINGS, postings
from pulsepress.schemas import DAY
from pulsepress.sources.scratch import scratch_folder

RAW = {
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "labels": "doc_id bigint, quality int, toxic int",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
}

#: Word indexes by application and folder.
_indexes: dict[tuple[str, str], str] = {}


class Fixtures:
    """Lazy article tables over one folder of test tables."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

    def raw(self, name: str) -> DataFrame:
        # With the layout given, Spark does not open the files to plan a query.
        return self.spark.read.schema(RAW[name]).parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def articles(self) -> DataFrame:
        d, e, marks = self.raw("documents"), self.raw("embeddings"), self.raw("labels")
        joined = (
            d.join(e.select(F.col("vec_id").alias("doc_id"), "embedding", "label"), "doc_id", "left")
            .join(marks, "doc_id", "left")
        )
        number = F.col("doc_id")
        offset = F.expr("INTERVAL '1' DAY * CAST(doc_id % 30 AS INT) + INTERVAL '1' SECOND * CAST(doc_id AS INT)")
        return joined.select(
            _document_url(number).alias("url"),
            F.when(number % 3 == 0, "news").when(number % 3 == 1, "blog").otherwise("post").alias("kind"),
            F.regexp_extract("text", r"^[^.\n]*", 0).alias("title"),
            F.when(number % 5 != 0, F.concat(F.lit("author"), (number % 11).cast("string"))).alias("author"),
            "source",
            F.lit(None).cast("string").alias("image_url"),
            (timestamp("2024-01-01 00:00:00") + offset).alias("created"),
            (timestamp("2024-01-01 01:00:00") + offset).alias("collected"),
            F.col("text").alias("summary"),
            F.col("text").alias("content"),
            (F.col("toxic") == 1).alias("restricted_content"),
            "embedding",
            F.when(F.col("label").isNotNull(), F.array(F.concat(F.lit("cat"), F.col("label").cast("string")))).alias(
                "categories"
            ),
            F.when(F.col("quality") == 1, F.array(F.lit("good")))
            .when(F.col("quality").isNotNull(), F.array(F.lit("bad")))
            .alias("sentiments"),
            F.array("lang").alias("regions"),
            F.array(
                F.concat(F.lit("Ent "), (number % 7).cast("string")),
                F.concat(F.lit("Ent "), (number % 11).cast("string")),
            ).alias("entities"),
        )

    @cached_property
    def publishers(self) -> DataFrame:
        sources = self.raw("documents").filter("source <> 'src0'").select("source").distinct()
        address = F.concat(F.lit("https://"), F.col("source"), F.lit(".example.com"))
        return sources.select(
            "source",
            address.alias("base_url"),
            F.when(~F.col("source").endswith("5"), F.upper("source")).alias("site_name"),
            F.concat(F.lit("feed of "), F.col("source")).alias("description"),
            F.lit(None).cast("string").alias("favicon"),
            F.concat(address, F.lit("/rss")).alias("rss_feed"),
            timestamp("2024-01-01 00:00:00").alias("collected"),
        )

    @cached_property
    def mentions(self) -> DataFrame:
        user, likes = F.col("user_id"), F.floor("value")
        return self.raw("events").select(
            F.concat(F.lit("post://"), user.cast("string"), F.lit("/"), F.col("event_type")).alias("chatter_url"),
            _document_url(user * 3 + F.length("event_type")).alias("url"),
            F.col("event_type").alias("source"),
            F.concat(F.lit("forum"), (user % 10).cast("string")).alias("forum"),
            F.col("ts").alias("collected"),
            likes.alias("likes"),
            F.when(user % 2 == 0, F.floor(likes / 2))
            .otherwise(F.regexp_extract("props", "([0-9]+)", 1).cast("bigint"))
            .alias("comments"),
            (user + 100).alias("subscribers"),
            F.lit(0).cast("bigint").alias("shares"),
        )

    @cached_property
    def related(self) -> DataFrame:
        """Vectors of one label with numbers at most 20 apart, found by number and not by pairing the label."""
        e = self.raw("embeddings").select("vec_id", "label")
        steps = F.explode(F.sequence(F.col("vec_id") - 20, F.col("vec_id") + 20))
        near = e.select("vec_id", "label", steps.alias("other")).filter("vec_id <> other")
        return near.join(e.withColumnRenamed("vec_id", "other"), ["other", "label"]).select(
            _document_url(F.col("vec_id")).alias("url"), _document_url(F.col("other")).alias("related_url")
        )

    @property
    def text_index(self) -> DataFrame:
        """The word index of the articles, written once for a folder and session, as on ingest."""
        key = (self.spark.sparkContext.applicationId, self.folder)
        if key not in _indexes:
            path = scratch_folder(self.spark)
            postings(self.articles).write.partitionBy(DAY, BUCKET).parquet(path)
            _indexes[key] = path
        return self.spark.read.schema(POSTINGS).parquet(_indexes[key])

    @cached_property
    def categories_ref(self) -> DataFrame:
        return self._label_vectors(F.min_by("embedding", "vec_id"), "cat", "category")

    @cached_property
    def sentiments_ref(self) -> DataFrame:
        return self._label_vectors(F.max_by("embedding", "vec_id"), "sent", "sentiment", F.col("label") < 5)

    def _label_vectors(self, pick, prefix: str, name: str, condition=None) -> DataFrame:
        e = self.raw("embeddings")
        e = e if condition is None else e.filter(condition)
        return e.groupBy("label").agg(pick.alias("embedding")).select(
            F.concat(F.lit(prefix), F.col("label").cast("string")).alias(name), "embedding"
        )

    @cached_property
    def query_vector(self) -> list[float]:
        """The embedding of the first vector."""
        return list(self.raw("embeddings").orderBy("vec_id").select("embedding").first()["embedding"])


def _document_url(number):
    return F.concat(F.lit("doc://"), number.cast("string"))
