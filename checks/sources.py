"""S: scans, loads, sinks."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from checks.registry import AS_OF, check, day, joined, moment, rounded
from pulsepress import schemas
from pulsepress.operators.ingest import align, insert_if_absent
from pulsepress.plans.trends import trend_aggregate
from pulsepress.plans.views import register_views
from pulsepress.sources.files import compact, json_rows, load_csv, load_json, load_parquet, save_csv, save_json
from pulsepress.sources.objects import export_objects, read_objects
from pulsepress.sources.scratch import scratch_folder


def trends_of(fx):
    return trend_aggregate(fx.articles, fx.mentions, fx.related, AS_OF)


def plain_mentions(df):
    return df.select("chatter_url", "url", "source", "forum", moment("collected"), "likes", "comments", "subscribers", "shares")


MENTIONS_SQL = """SELECT chatter_url, url, source, forum, strftime(collected, '%Y-%m-%d %H:%M:%S.%f') AS collected,
  likes, comments, subscribers, shares FROM mentions"""


@check(
    "s1_scan_digest",
    "SELECT url, strftime(created, '%Y-%m-%d %H:%M:%S.%f') AS created, summary FROM articles",
)
def _(fx):
    return fx.articles.select(*schemas.DIGEST_COLUMNS).withColumn("created", moment("created"))


@check(
    "s1_scan_content",
    "SELECT url, strftime(created, '%Y-%m-%d %H:%M:%S.%f') AS created, source, title, content FROM articles",
)
def _(fx):
    return fx.articles.select(*schemas.CONTENT_COLUMNS).withColumn("created", moment("created"))


@check(
    "s2_load_parquet",
    """SELECT url, kind, length(content) AS letters, len(embedding) AS numbers, array_to_string(categories, '|') AS categories
       FROM articles""",
)
def _(fx):
    path = scratch_folder(fx.spark)
    fx.articles.write.parquet(path)
    batch = load_parquet(fx.spark, path, schemas.ARTICLES)
    stored = batch.filter("kind = 'news'")
    loaded = insert_if_absent(stored, batch, ["url"])
    return loaded.select(
        "url", "kind", F.length("content").cast("bigint").alias("letters"),
        F.when(F.col("embedding").isNotNull(), F.size("embedding")).cast("bigint").alias("numbers"),
        joined("categories"),
    )


@check(
    "s3_load_json",
    """SELECT url, title, strftime(created, '%Y-%m-%d %H:%M:%S.%f') AS created, restricted_content,
       array_to_string(entities, '|') AS entities, content FROM articles""",
)
def _(fx):
    path = scratch_folder(fx.spark)
    save_json(fx.articles, path)
    batch = load_json(fx.spark, path, schemas.ARTICLES)
    return batch.select("url", "title", moment("created"), "restricted_content", joined("entities"), "content")


@check("s3_load_csv", MENTIONS_SQL)
def _(fx):
    path = scratch_folder(fx.spark)
    save_csv(fx.mentions, path)
    return plain_mentions(load_csv(fx.spark, path, schemas.MENTIONS))


@check(
    "s3_load_csv_lists",
    """SELECT url, array_to_string(list_transform(entities, lambda x: concat('<', x, '|">')), ';') AS entities, len(categories) AS n_categories,
       CASE WHEN sentiments IS NULL THEN -1 ELSE 0 END AS n_sentiments FROM articles""",
)
def _(fx):
    marked = F.transform("entities", lambda x: F.concat(F.lit("<"), x, F.lit('|">')))
    none = F.array().cast("array<string>")
    rows = fx.articles.withColumn("entities", marked).withColumn("sentiments", F.when(F.col("sentiments").isNotNull(), none))
    path, columns = scratch_folder(fx.spark), ["url", "entities", "categories", "sentiments"]
    save_csv(rows.select(*columns), path)
    layout = T.StructType([schemas.ARTICLES[c] for c in columns])
    back = load_csv(fx.spark, path, layout)
    size = F.when(F.col("sentiments").isNull(), -1).otherwise(F.size("sentiments")).alias("n_sentiments")
    known = F.when(F.col("categories").isNotNull(), F.size("categories").cast("bigint")).alias("n_categories")
    return back.select("url", F.array_join("entities", ";").alias("entities"), known, size)


@check(
    "i22_store_rejects",
    """WITH lines AS (SELECT CAST(substr(url, 7) AS BIGINT) AS id FROM articles),
       told AS (SELECT CASE WHEN id % 7 = 0 THEN 'url|broken line' WHEN id % 7 = 1 THEN 'url' ELSE 'stored' END AS what FROM lines)
       SELECT what, count(*) AS n FROM told GROUP BY what""",
)
def _(fx):
    import uuid

    from pulsepress import ArticleStore

    lines = fx.articles.select(F.expr("CAST(substr(url, 7) AS BIGINT) % 7").alias("k"), "url", "title", "created", "regions")
    whole = F.to_json(F.struct(F.when(F.col("k") != 1, F.col("url")).alias("url"), "title", "regions"))
    path = scratch_folder(fx.spark)
    lines.select(F.when(F.col("k") == 0, F.lit('{"url": "doc://cut", "ti')).otherwise(whole).alias("value")).write.text(path)
    store = ArticleStore(fx.spark, f"press_{uuid.uuid4().hex[:8]}", scratch_folder(fx.spark))
    store.load("articles", path, "json", AS_OF)
    refused = store.rejects("articles").select(joined("problems", "what"))
    kept = store.table("articles").select(F.lit("stored").alias("what"))
    return refused.unionByName(kept).groupBy("what").agg(F.count(F.lit(1)).alias("n"))


@check(
    "s4_lake_table",
    """SELECT url, likes, comments, subscribers, shares, related, strftime(updated, '%Y-%m-%d') AS updated,
       round(trend_score, 6) AS trend_score FROM trends""",
)
def _(fx):
    path = scratch_folder(fx.spark)
    trends_of(fx).write.parquet(path)
    fx.spark.sql(f"CREATE DATABASE IF NOT EXISTS press_checks LOCATION '{scratch_folder(fx.spark)}'")
    fx.spark.sql("DROP TABLE IF EXISTS press_checks.trends")
    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schemas.TRENDS)
    fx.spark.sql(f"CREATE TABLE press_checks.trends ({columns}) USING parquet LOCATION '{path}'")
    return fx.spark.table("press_checks.trends").withColumns({"updated": day("updated"), "trend_score": rounded("trend_score")})


@check(
    "s5_sql",
    """SELECT source, count(*) AS articles, CAST(sum(length(content)) AS BIGINT) AS letters FROM articles
       WHERE kind = 'news' AND created >= TIMESTAMP '2024-01-05 00:00:00' GROUP BY source""",
)
def _(fx):
    register_views(fx.spark, {"articles": fx.articles})
    return fx.spark.sql(
        """SELECT source, count(*) AS articles, sum(length(content)) AS letters FROM articles
           WHERE kind = :kind AND created >= CAST(:start AS TIMESTAMP_NTZ) GROUP BY source""",
        args={"kind": "news", "start": "2024-01-05 00:00:00"},
    )


@check("s6_append_mentions", MENTIONS_SQL)
def _(fx):
    path = scratch_folder(fx.spark)
    early = F.col("collected") < "2024-01-16"
    for part in (fx.mentions.filter(early), fx.mentions.filter(~early)):
        align(part, schemas.MENTIONS).write.mode("append").parquet(path)
    return plain_mentions(load_parquet(fx.spark, path, schemas.MENTIONS))


@check(
    "s7_views",
    """SELECT a.kind, count(*) AS articles, count(t.url) AS trending, CAST(sum(len(a.related_urls)) AS BIGINT) AS related
       FROM aggregated a LEFT JOIN trending t ON a.url = t.url GROUP BY a.kind""",
)
def _(fx):
    register_views(
        fx.spark,
        {"articles": fx.articles, "trends": trends_of(fx), "related": fx.related, "publishers": fx.publishers},
    )
    return fx.spark.sql(
        """SELECT a.kind, count(*) AS articles, count(t.url) AS trending, sum(size(a.related_urls)) AS related
           FROM aggregated_articles a LEFT JOIN trending_articles t ON a.url = t.url GROUP BY a.kind"""
    )


@check(
    "s8_reference_table",
    """SELECT e.label, count(*) AS vectors, min(c.category) AS category FROM embeddings e
       JOIN categories_ref c ON c.category = concat('cat', CAST(e.label AS VARCHAR)) GROUP BY e.label""",
)
def _(fx):
    path = scratch_folder(fx.spark)
    fx.sentiments_ref.select(F.col("sentiment").alias("category"), "embedding").write.mode("ignore").parquet(path)
    fx.categories_ref.write.mode("overwrite").parquet(path)
    fx.categories_ref.limit(1).write.mode("ignore").parquet(path)
    stored = load_parquet(fx.spark, path, schemas.CATEGORIES_REF)
    names = fx.raw("embeddings").withColumn("category", F.concat(F.lit("cat"), F.col("label").cast("string")))
    return names.join(stored, "category").groupBy("label").agg(
        F.count(F.lit(1)).alias("vectors"), F.min("category").alias("category")
    )


@check(
    "s9_export_texts",
    """SELECT concat(source, '/', substr(url, 7), '.txt') AS path,
       concat('https://cdn.example.com/', source, '/', substr(url, 7), '.txt') AS url FROM articles""",
)
def _(fx):
    texts = fx.articles.select(
        F.concat("source", F.lit("/"), F.substring("url", 7, 20), F.lit(".txt")).alias("path"), "content"
    )
    return export_objects(texts, scratch_folder(fx.spark), "https://cdn.example.com/")


@check(
    "s9_objects_read_back",
    """SELECT concat(source, '/', substr(url, 7), '.txt') AS path, md5(coalesce(content, '')) AS digest,
       strlen(coalesce(content, '')) AS bytes FROM articles""",
)
def _(fx):
    root = scratch_folder(fx.spark)
    key = F.concat("source", F.lit("/"), F.substring("url", 7, 20), F.lit(".txt"))
    export_objects(fx.articles.select(key.alias("path"), F.col("content").cast("binary").alias("content")), root)
    return read_objects(fx.spark, root).select("path", F.md5("content").alias("digest"), F.col("length").alias("bytes"))


@check(
    "s10_json_rows",
    """SELECT CAST(json_merge_patch('{}', json_object('url', url, 'kind', kind, 'author', author, 'image_url', image_url,
         'created', strftime(created, '%Y-%m-%dT%H:%M:%S+00:00'), 'restricted_content', restricted_content,
         'categories', categories, 'entities', entities)) AS VARCHAR) AS json FROM articles""",
)
def _(fx):
    columns = ["url", "kind", "author", "image_url", "created", "restricted_content", "categories", "entities"]
    return json_rows(fx.articles, columns)


@check("s11_compact", MENTIONS_SQL)
def _(fx):
    many, few = scratch_folder(fx.spark), scratch_folder(fx.spark)
    align(fx.mentions, schemas.MENTIONS).repartition(24).write.parquet(many)
    compact(fx.spark, many, few)
    return plain_mentions(load_parquet(fx.spark, few, schemas.MENTIONS))


@check(
    "s7_store_trending",
    """WITH kept_articles AS (SELECT * FROM articles WHERE collected >= DATE '2024-01-10'),
       kept_mentions AS (SELECT * FROM mentions WHERE collected >= DATE '2024-01-10'),
       ranked AS (SELECT *, max(likes) OVER post AS l, max(comments) OVER post AS c FROM kept_mentions WINDOW post AS (PARTITION BY chatter_url)),
       timed AS (SELECT *, min(collected) FILTER (likes = l AND comments = c) OVER (PARTITION BY chatter_url) AS full_at FROM ranked),
       sums AS (SELECT url, sum(likes)::BIGINT AS likes, sum(comments)::BIGINT AS comments, count(*) AS shares FROM timed WHERE collected = full_at GROUP BY url),
       pairs_of AS (SELECT url, count(*) AS related FROM related GROUP BY url)
       SELECT url, ifnull(likes, 0) AS likes, ifnull(comments, 0) AS comments, ifnull(shares, 0) AS shares, ifnull(related, 0) AS related, site_name
       FROM kept_articles LEFT JOIN sums USING (url) LEFT JOIN pairs_of USING (url) LEFT JOIN publishers USING (source)
       WHERE likes > 0 OR comments > 0 OR shares > 0 OR related > 0""",
)
def _(fx):
    import uuid

    from pulsepress import ArticleStore

    store = ArticleStore(fx.spark, f"press_{uuid.uuid4().hex[:8]}", scratch_folder(fx.spark))
    store.store_articles(fx.articles, AS_OF)
    store.store_publishers(fx.publishers, AS_OF)
    store.store_mentions(fx.mentions, AS_OF)
    store.store_related(fx.related)
    store.optimize(AS_OF, "22 days")
    columns = ["url", "likes", "comments", "shares", "related", "site_name"]
    return store.query_aggregated(columns=columns, conditions=["related IS NOT NULL"])
