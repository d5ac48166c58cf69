"""Inverted index over the words of articles.

A posting says with what weight an article holds a word: the word's occurrences in tags, title and
summary times the weights of those fields. Postings lie in folders by day and by a hash of the word, sorted
by word, so that a search reads the folders of its words only, and in them only the blocks that hold
them. Each folder also has a row for the empty word with the number of articles of its day, from which
the rarity of words follows. Days are indexed, replaced and dropped like the articles' own.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsepress.functions.text import tags_text, tokens
from pulsepress.operators.search import FIELD_WEIGHTS, query_terms
from pulsepress.schemas import DAY

#: Folders that the words of a day are dealt to.
BUCKETS = 16
BUCKET = "bucket"
#: Stands for all articles of a day; no token is empty.
ALL = ""
#: Articles of a day whose postings make one file of a folder; more are dealt to several.
ARTICLES = 16_384
#: Articles whose words are summed at a time.
ROWS = 256

POSTINGS = T.StructType(
    [
        T.StructField("term", T.StringType()),
        T.StructField("url", T.StringType()),
        T.StructField("weight", T.DoubleType()),
        T.StructField(DAY, T.DateType()),
        T.StructField(BUCKET, T.IntegerType()),
    ]
)


def bucket_of(term: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def _summed(texts: DataFrame, weights: dict[str, float]) -> DataFrame:
    """A row for every word of every article: ``term`` and ``weight`` instead of the columns of tokens.

    The weight is the sum of those of the columns that a word occurs in, once per occurrence.
    """
    kept = [f for f in texts.schema if f.name not in weights]
    schema = T.StructType([*kept, T.StructField("term", T.StringType()), T.StructField("weight", T.DoubleType())])
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                piece = batch.slice(start, ROWS)
                lists = [piece.column(field) for field in weights]
                lengths = [x.value_lengths().to_numpy(zero_copy_only=False) for x in lists]
                row = np.concatenate([np.repeat(np.arange(piece.num_rows), n) for n in lengths])
                weight = np.concatenate([np.full(n.sum(), w) for n, w in zip(lengths, weights.values(), strict=True)])
                term = pa.chunked_array([x.flatten() for x in lists])
                words = pa.table({"row": row, "term": term, "weight": weight}).group_by(["row", "term"], use_threads=False)
                for found in words.aggregate([("weight", "sum")]).to_batches():
                    same = [piece.column(name).take(found.column("row")) for name in names]
                    columns = [*same, found.column("term"), found.column("weight_sum")]
                    yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return texts.mapInArrow(run, schema)


def postings(articles: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Rows of ``POSTINGS`` for the given articles; an article without a url has none.

    The words of an article are summed where it is read, in bounded memory, and one shuffle deals them to
    folders; a day of many articles is split by url. What several rows of one url and day hold is summed
    there. Every bucket of a day gets a row, so replacing the folders of a day replaces all of them.
    """
    day = F.col(DAY) if DAY in articles.columns else F.to_date("collected")
    known = articles.filter(F.col("url").isNotNull()).withColumn(DAY, day)
    texts = {"tags": tags_text("regions", "entities", "categories"), "title": F.col("title"), "summary": F.col("summary")}

    none = F.array().cast("array<string>")
    words = [F.coalesce(tokens(text), none).alias(f"__{field}") for field, text in texts.items()]
    days = known.groupBy(DAY).agg(F.count(F.lit(1)).cast("double").alias("weight"))
    every = F.explode(F.sequence(F.lit(0), F.lit(buckets - 1)))
    totals = days.select(F.lit(ALL).alias("term"), F.lit(None).cast("string").alias("url"), "weight", DAY, every.alias(BUCKET))
    # One row per day.
    parts = days.select(F.col(DAY).alias("__day"), F.ceil(F.col("weight") / ARTICLES).alias("__parts"))
    part = F.pmod(F.xxhash64("url"), F.col("__parts")).alias("__part")
    found = known.select("url", DAY, *words).join(F.broadcast(parts), F.col(DAY).eqNullSafe(F.col("__day")))
    found = found.select("url", DAY, part, *[f"__{field}" for field in texts])
    found = _summed(found, {f"__{field}": weight for field, weight in FIELD_WEIGHTS.items()})
    rows = found.withColumn(BUCKET, bucket_of(F.col("term"), buckets))
    rows = rows.unionByName(totals.withColumn("__part", F.lit(0).cast("long")))
    # As many partitions as are set: rows are sorted in memory, where they are several times as large as shuffled.
    rows = rows.repartition(_partitions(rows), DAY, BUCKET, "__part")
    key = [DAY, BUCKET, "term", "url", "__part"]
    # A string among the values keeps Spark from hashing: rows are summed as they come, in the order they leave in.
    same = rows.sortWithinPartitions(*key).withColumn("same", F.col("url")).groupBy(*key)
    summed = same.agg(F.sum("weight").alias("weight"), F.first("same").alias("same"))
    return summed.select("term", F.col("same").alias("url"), "weight", DAY, BUCKET).sortWithinPartitions(DAY, BUCKET, "term")


def _partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _of_terms(index: DataFrame, terms: Sequence[str], buckets: int) -> DataFrame:
    """Postings of some words. The buckets are constants, so folders of other words are not opened."""
    place = reduce(or_, [F.col(BUCKET) == bucket_of(F.lit(t), buckets) for t in terms])
    return index.filter(place & F.col("term").isin(list(terms)))


def articles_per_day(index: DataFrame) -> DataFrame:
    """How many articles of every day are indexed."""
    totals = index.filter((F.col("term") == ALL) & (F.col(BUCKET) == 0))
    return totals.groupBy(DAY).agg(F.sum("weight").cast("bigint").alias("articles"))


def search_scores(index: DataFrame, query: str | Sequence[str], buckets: int = BUCKETS) -> DataFrame:
    """``url`` and ``search_score`` of the articles that hold any word of the query.

    The score adds, for each word, its rarity ``ln(1 + articles / articles with the word)`` times its
    weight in the article, over all articles indexed.
    """
    terms = query_terms(query)
    if not terms:
        return index.filter(F.lit(False)).select("url", F.lit(0.0).alias("search_score"))
    found = _of_terms(index, terms, buckets)
    total = index.filter((F.col("term") == ALL) & (F.col(BUCKET) == bucket_of(F.lit(terms[0]), buckets)))
    total = total.agg(F.sum("weight")).scalar()
    holding = found.agg(F.array(*[F.nullif(F.count_if(F.col("term") == t), F.lit(0)) for t in terms])).scalar()
    weights = [F.sum(F.when(F.col("term") == t, F.col("weight")).otherwise(0.0)).alias(f"w{i}") for i, t in enumerate(terms)]
    score = F.lit(0.0)
    for i in range(len(terms)):
        score = score + F.col(f"w{i}") * F.coalesce(F.log(1 + total / holding[i]), F.lit(0.0))
    return found.groupBy("url").agg(*weights).select("url", score.alias("search_score"))


def indexed_search(index: DataFrame, articles: DataFrame, query: str | Sequence[str], buckets: int = BUCKETS) -> DataFrame:
    """The given articles that hold any word of the query, with ``search_score``.

    The same rows as ``text_search(articles, query, rank_from=...)`` over the articles indexed.
    """
    return articles.join(search_scores(index, query, buckets), "url").select(*articles.columns, "search_score")
