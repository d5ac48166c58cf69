"""I, U: keyed inserts, updates, deletes, cleaning and set operations.

Stored tables and batches are made from whole tables: news and blog articles are stored, and the
batch holds every article twice, the second time with a changed title.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import AS_OF, EPS, WINDOW, check, day, joined, moment
from checks.sources import trends_of
from pulsepress import schemas
from pulsepress.operators import cleaning, ingest
from pulsepress.operators.labels import backfill_labels, update_embeddings
from pulsepress.operators.similarity import closure, similar_clusters, unmapped
from pulsepress.plans.trends import mention_totals, related_counts

STORED_SQL = "stored AS (SELECT * FROM articles WHERE kind <> 'post')"
BATCH_SQL = """batch AS (SELECT *, 1 AS copy FROM articles
  UNION ALL SELECT * REPLACE (concat('again ', title) AS title), 2 AS copy FROM articles)"""


def stored(fx):
    return fx.articles.filter("kind <> 'post'")


def batch(fx):
    again = fx.articles.withColumn("title", F.concat(F.lit("again "), F.col("title")))
    return fx.articles.withColumn("copy", F.lit(1)).union(again.withColumn("copy", F.lit(2)))


@check(
    "i1_deduplicate",
    f"WITH {STORED_SQL}, {BATCH_SQL} SELECT url, copy, title FROM batch b WHERE NOT EXISTS (SELECT 1 FROM stored s WHERE s.url = b.url)",
)
def _(fx):
    return ingest.deduplicate(stored(fx), batch(fx), ["url"]).select("url", "copy", "title")


RELATED_SPLIT = "stored AS (SELECT * FROM related WHERE url < related_url)"


@check(
    "i2_deduplicate_pairs",
    f"WITH {RELATED_SPLIT} SELECT url, related_url FROM related r WHERE (url, related_url) NOT IN (SELECT url, related_url FROM stored)",
)
def _(fx):
    kept = fx.related.filter("url < related_url")
    return ingest.deduplicate(kept, fx.related, schemas.KEYS["related"])


@check(
    "i3_insert_articles",
    f"""WITH {STORED_SQL}, {BATCH_SQL}
    SELECT url, title, kind FROM stored UNION ALL
    SELECT url, title, kind FROM batch b WHERE copy = 1 AND NOT EXISTS (SELECT 1 FROM stored s WHERE s.url = b.url)""",
)
def _(fx):
    rows = ingest.insert_articles(stored(fx), batch(fx), AS_OF, order=[F.col("copy")])
    return rows.select("url", "title", "kind")


@check(
    "i4_insert_related",
    "WITH old AS (SELECT * FROM related WHERE url < related_url) SELECT url, related_url FROM old UNION SELECT related_url, url FROM related",
)
def _(fx):
    kept = fx.related.filter("url < related_url")
    more = fx.related.union(fx.related).select(F.col("related_url").alias("url"), F.col("url").alias("related_url"))
    return ingest.insert_related(kept, more)


@check(
    "i5_insert_publishers",
    """WITH old AS (SELECT * FROM publishers WHERE site_name IS NOT NULL)
    SELECT source, base_url, site_name, strftime(collected, '%Y-%m-%d %H:%M:%S.%f') AS collected FROM old UNION ALL
    SELECT source, base_url, site_name, '2024-02-01 00:00:00.000000' FROM publishers WHERE source NOT IN (SELECT source FROM old)""",
)
def _(fx):
    old = fx.publishers.filter("site_name IS NOT NULL")
    rows = ingest.insert_publishers(old, fx.publishers.drop("collected"), AS_OF)
    return rows.select("source", "base_url", "site_name", moment("collected"))


@check(
    "i6_append_mentions",
    """SELECT chatter_url, url, strftime(collected, '%Y-%m-%d %H:%M:%S.%f') AS collected, likes, shares FROM mentions UNION ALL
       SELECT chatter_url, url, '2024-02-01 00:00:00.000000', likes, 0 FROM mentions""",
)
def _(fx):
    rows = ingest.append_mentions(fx.mentions, fx.mentions.drop("collected", "shares"), AS_OF)
    return rows.select("chatter_url", "url", moment("collected"), "likes", "shares")


@check(
    "i7_update_columns",
    """SELECT url, kind, title, CASE WHEN sentiments IS NOT NULL THEN array_to_string(categories, '|') ELSE author END AS author,
       CASE WHEN sentiments IS NOT NULL THEN array_to_string(sentiments, '|') ELSE array_to_string(entities, '|') END AS entities
       FROM articles""",
)
def _(fx):
    # The articles with a sentiment get their category (or NULL) as author and the sentiments as entities.
    changes = fx.articles.filter("sentiments IS NOT NULL").select(
        "url", joined("categories", "author"), F.col("sentiments").alias("entities"), F.lit("ignored").alias("title")
    )
    missing = changes.withColumn("url", F.concat(F.lit("no "), "url"))
    rows = ingest.update(fx.articles, changes.union(missing), ["url"], ["author", "entities"])
    return rows.select("url", "kind", "title", "author", joined("entities"))


UPDATE_SQL = """batch AS (SELECT url, CASE WHEN kind = 'news' THEN NULL ELSE upper(kind) END AS author,
   CAST(NULL AS VARCHAR) AS image_url, upper(source) AS source FROM articles WHERE embedding IS NOT NULL)"""


def update_batch(fx):
    return fx.articles.filter("embedding IS NOT NULL").select(
        "url", F.when(F.col("kind") != "news", F.upper("kind")).alias("author"),
        F.lit(None).cast("string").alias("image_url"), F.upper("source").alias("source"),
    )


def with_address(fx):
    return fx.articles.withColumn("image_url", F.lit("img"))


@check(
    "i8_update_all_fields",
    f"""WITH {UPDATE_SQL} SELECT a.url, CASE WHEN b.url IS NULL THEN a.author ELSE b.author END AS author,
     CASE WHEN b.url IS NULL THEN 'img' ELSE b.image_url END AS image_url, coalesce(b.source, a.source) AS source
     FROM articles a LEFT JOIN batch b ON a.url = b.url""",
)
def _(fx):
    return ingest.update(with_address(fx), update_batch(fx), ["url"]).select("url", "author", "image_url", "source")


@check(
    "i8_update_present_columns",
    f"""WITH {UPDATE_SQL} SELECT a.url, CASE WHEN b.url IS NULL THEN a.author ELSE b.author END AS author,
     'img' AS image_url, coalesce(b.source, a.source) AS source FROM articles a LEFT JOIN batch b ON a.url = b.url""",
)
def _(fx):
    rows = ingest.update_present_columns(with_address(fx), update_batch(fx), ["url"])
    return rows.select("url", "author", "image_url", "source")


@check(
    "i8_update_keep_nulls",
    f"""WITH {UPDATE_SQL} SELECT a.url, coalesce(b.author, a.author) AS author, 'img' AS image_url,
     coalesce(b.source, a.source) AS source FROM articles a LEFT JOIN batch b ON a.url = b.url""",
)
def _(fx):
    rows = ingest.update(with_address(fx), update_batch(fx), ["url"], nulls="keep")
    return rows.select("url", "author", "image_url", "source")


@check(
    "i9_update_publishers",
    """SELECT p.source, p.base_url, coalesce(d.langs, p.description) AS description, p.site_name FROM publishers p
       LEFT JOIN (SELECT source, CAST(count(DISTINCT lang) AS VARCHAR) AS langs FROM documents GROUP BY source) d ON d.source = p.source""",
)
def _(fx):
    langs = fx.raw("documents").groupBy("source").agg(F.count_distinct("lang").cast("string").alias("description"))
    rows = ingest.update(fx.publishers, langs, schemas.KEYS["publishers"])
    return rows.select("source", "base_url", "description", "site_name")


@check(
    "i10_update_embeddings",
    """SELECT a.url, round(list_sum(a.embedding::DOUBLE[]), 6) AS total,
       array_to_string(CASE WHEN a.embedding IS NULL THEN a.categories ELSE l.categories END, '|') AS categories,
       array_to_string(CASE WHEN a.embedding IS NULL THEN a.sentiments ELSE l.sentiments END, '|') AS sentiments
       FROM articles a LEFT JOIN label_sets l ON l.url = a.url""",
)
def _(fx):
    # Stored articles have lost their embedding; the batch brings it back.
    bare = fx.articles.withColumn("embedding", F.lit(None).cast("array<float>"))
    changes = fx.articles.filter("embedding IS NOT NULL").select("url", "embedding")
    rows = update_embeddings(bare, changes, fx.categories_ref, fx.sentiments_ref)
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return rows.select("url", F.round(total, 6).alias("total"), joined("categories"), joined("sentiments"))


@check(
    "i11_backfill_labels",
    """SELECT a.url, array_to_string(CASE WHEN a.kind = 'blog' AND a.embedding IS NOT NULL THEN l.categories
         WHEN a.kind = 'blog' THEN NULL ELSE a.categories END, '|') AS categories,
       array_to_string(CASE WHEN a.kind = 'blog' AND a.embedding IS NOT NULL THEN l.sentiments ELSE a.sentiments END, '|') AS sentiments
       FROM articles a LEFT JOIN label_sets l ON l.url = a.url""",
)
def _(fx):
    some = fx.articles.withColumn("categories", F.when(F.col("kind") != "blog", F.col("categories")))
    rows = backfill_labels(some, fx.categories_ref, fx.sentiments_ref)
    return rows.select("url", joined("categories"), joined("sentiments"))


@check(
    "i12_fill_timestamps",
    """SELECT url, strftime(CASE WHEN author IS NULL THEN TIMESTAMP '2024-02-01 00:00:00' ELSE created END, '%Y-%m-%d %H:%M:%S.%f') AS created,
       '2024-02-01 00:00:00.000000' AS collected FROM articles""",
)
def _(fx):
    rows = fx.articles.drop("collected").withColumn("created", F.when(F.col("author").isNotNull(), F.col("created")))
    return ingest.stamp(rows, AS_OF, "created", "collected").select("url", moment("created"), moment("collected"))


@check("i13_columns_with_values", "SELECT source, base_url, site_name, description, rss_feed FROM publishers")
def _(fx):
    return ingest.non_null_columns(fx.publishers.drop("collected"))


@check(
    "i14_retention",
    """SELECT url, 'article' AS kind, strftime(collected, '%Y-%m-%d %H:%M:%S.%f') AS collected FROM articles
       WHERE NOT coalesce(collected < DATE '2024-02-01' - INTERVAL 15 DAY, false) UNION ALL
       SELECT chatter_url, 'mention', strftime(collected, '%Y-%m-%d %H:%M:%S.%f') FROM mentions
       WHERE NOT coalesce(collected < DATE '2024-02-01' - INTERVAL 15 DAY, false)""",
)
def _(fx):
    a = ingest.keep_recent(fx.articles, AS_OF, WINDOW).select("url", F.lit("article").alias("kind"), moment("collected"))
    m = ingest.keep_recent(fx.mentions, AS_OF, WINDOW)
    return a.union(m.select("chatter_url", F.lit("mention"), moment("collected")))


@check(
    "i15_drop_orphans",
    """SELECT url, related_url FROM related r WHERE EXISTS
       (SELECT 1 FROM articles a WHERE a.url = r.url AND collected >= DATE '2024-02-01' - INTERVAL 15 DAY)""",
)
def _(fx):
    return ingest.drop_orphans(fx.related, ingest.keep_recent(fx.articles, AS_OF, WINDOW))


@check(
    "i16_drop_older",
    "SELECT url, strftime(updated, '%Y-%m-%d') AS updated FROM trends WHERE updated >= TIMESTAMP '2024-02-01 00:00:00' - INTERVAL 12 DAY",
)
def _(fx):
    return ingest.drop_older(trends_of(fx), AS_OF, 12).select("url", day("updated"))


CLUSTERED_SQL = """clustered AS (SELECT a.url, a.kind, a.collected, c.cluster_id,
  CASE WHEN a.restricted_content THEN 'gist' END AS gist FROM articles a LEFT JOIN clusters c ON c.url = a.url)"""


def clustered(fx):
    clusters = similar_clusters(fx.articles, EPS).select("url", "cluster_id")
    rows = fx.articles.join(clusters, "url", "left")
    return rows.withColumn("gist", F.when(F.col("restricted_content"), F.lit("gist")))


@check(
    "i17_drop_unprocessed",
    f"""WITH {CLUSTERED_SQL} SELECT url, kind, cluster_id, gist FROM clustered WHERE NOT (collected < TIMESTAMP '2024-02-01' - INTERVAL 7 DAY
        AND cluster_id IS NULL AND gist IS NULL AND kind <> 'AI Generated')""",
)
def _(fx):
    return ingest.drop_unprocessed(clustered(fx), AS_OF).select("url", "kind", "cluster_id", "gist")


@check(
    "i18_vector_items",
    """SELECT concat('v', CAST(vec_id AS VARCHAR)) AS id, len(embedding) AS numbers,
       CAST(CASE WHEN label < 5 THEN 1704067200 ELSE 1706745600 END AS BIGINT) AS ts FROM embeddings""",
)
def _(fx):
    items = fx.raw("embeddings").select(F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("id"), "embedding", "label")
    kept = items.filter("label < 5").select("id", "embedding", F.lit("2024-01-01 00:00:00+00:00").cast("timestamp").alias("ts"))
    rows = ingest.insert_vector_items(kept, items.drop("label").union(items.drop("label")), "2024-02-01 00:00:00")
    return rows.select("id", F.size("embedding").cast("bigint").alias("numbers"), F.unix_seconds("ts").alias("ts"))


@check(
    "i19_clean_articles",
    """WITH raw AS (SELECT url, concat('  ', source, chr(9)) AS source, kind, 1 AS n, concat(chr(10), title, ' ') AS title, content AS content,
         CASE WHEN author IS NULL THEN 'NoReply' ELSE author END AS author, created, CAST(NULL AS TIMESTAMP) AS collected FROM articles
       UNION ALL SELECT url, source, CASE WHEN author IS NULL THEN ' ' ELSE kind END, 2, title, ' ', 'Admin ', created, collected FROM articles WHERE kind = 'news'),
     last AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY n DESC) AS rn FROM raw),
     clean AS (SELECT url, nullif(regexp_replace(source, '^\\s+|\\s+$', '', 'g'), '') AS source, nullif(trim(kind), '') AS kind,
       nullif(regexp_replace(title, '^\\s+|\\s+$', '', 'g'), '') AS title,
       nullif(regexp_replace(content, '^\\s+|\\s+$', '', 'g'), '') AS content,
       CASE WHEN lower(trim(author)) IN ('noreply', 'admin') THEN NULL ELSE author END AS author,
       coalesce(collected, TIMESTAMP '2024-02-01') AS collected FROM last WHERE rn = 1)
     SELECT url, source, kind, title, author, strftime(collected, '%Y-%m-%d %H:%M:%S.%f') AS collected,
       coalesce(len(regexp_extract_all(title, '\\S+')), 0) AS title_length,
       coalesce(len(regexp_extract_all(content, '\\S+')), 0) AS content_length
     FROM clean WHERE title IS NOT NULL AND source IS NOT NULL AND kind IS NOT NULL""",
)
def _(fx):
    a = fx.articles
    first = a.withColumns(
        {
            "source": F.concat(F.lit("  "), "source", F.lit("\t")),
            "title": F.concat(F.lit("\n"), "title", F.lit(" ")),
            "author": F.coalesce("author", F.lit("NoReply")),
            "collected": F.lit(None).cast("timestamp_ntz"),
            "n": F.lit(1),
        }
    )
    second = a.filter("kind = 'news'").withColumns(
        {
            "kind": F.when(F.col("author").isNull(), F.lit(" ")).otherwise(F.col("kind")),
            "content": F.lit(" "),
            "author": F.lit("Admin "),
            "n": F.lit(2),
        }
    )
    rows = cleaning.clean_articles(first.union(second), AS_OF, F.col("n"))
    return rows.select(
        "url", "source", "kind", "title", "author", moment("collected"),
        F.col("title_length").cast("bigint").alias("title_length"),
        F.col("content_length").cast("bigint").alias("content_length"),
    )


@check(
    "i20_clean_publishers",
    """SELECT source, CASE WHEN source = 'src3' THEN 'x' ELSE min(lang) END AS base_url, '2024-02-01 00:00:00.000000' AS collected
       FROM documents WHERE source <> 'src4' GROUP BY source""",
)
def _(fx):
    # Every document names its publisher; the last language counts, and src4 has no address.
    address = F.when(F.col("source") == "src4", F.lit(" ")).when(F.col("source") == "src3", F.lit(" x ")).otherwise(F.col("lang"))
    rows = fx.raw("documents").select(
        F.concat(F.lit(" "), "source").alias("source"), address.alias("base_url"), F.lit(None).cast("timestamp_ntz").alias("collected"),
        *[F.lit("").alias(c) for c in ("favicon", "rss_feed", "description", "site_name")], "lang",
    )
    descending = F.struct(*[-F.ascii(F.substring("lang", i, 1)) for i in (1, 2)])
    return cleaning.clean_publishers(rows, AS_OF, descending).select("source", "base_url", moment("collected"))


@check(
    "i21_clean_mentions",
    """SELECT chatter_url, url, nullif(trim(forum), '') AS forum, likes, comments FROM
       (SELECT chatter_url, CASE WHEN source = 'error' THEN '' ELSE url END AS url, replace(forum, 'forum3', ' ') AS forum, likes, comments,
        CASE WHEN source = 'view' THEN 0 ELSE subscribers END AS subscribers FROM mentions)
       WHERE url <> '' AND (likes <> 0 OR comments <> 0 OR subscribers <> 0)""",
)
def _(fx):
    raw = fx.mentions.withColumns(
        {
            "url": F.when(F.col("source") == "error", F.lit(" ")).otherwise(F.col("url")),
            "forum": F.concat(F.lit(" "), F.regexp_replace("forum", "forum3", " ")),
            "subscribers": F.when(F.col("source") == "view", 0).otherwise(F.col("subscribers")),
        }
    )
    return cleaning.clean_mentions(raw).select("chatter_url", "url", "forum", "likes", "comments")


RAW_MENTIONS = """raw AS (SELECT CASE WHEN event_type = 'error' THEN '' ELSE event_type END AS chatter_url,
   CASE WHEN event_type <> 'view' THEN concat('doc://', user_id) END AS url, CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) AS likes,
   CASE WHEN event_type = 'click' THEN props ELSE CAST(user_id AS VARCHAR) END AS comments, user_id * 50000000 AS subscribers FROM events)"""


def raw_mentions(fx):
    kind = F.col("event_type")
    return fx.raw("events").select(
        F.when(kind == "error", F.lit("")).otherwise(kind).alias("chatter_url"),
        F.when(kind != "view", F.concat(F.lit("doc://"), F.col("user_id").cast("string"))).alias("url"),
        F.floor("value").cast("string").alias("likes"),
        F.when(kind == "click", F.col("props")).otherwise(F.col("user_id").cast("string")).alias("comments"),
        (F.col("user_id") * 50000000).alias("subscribers"),
    )


@check(
    "i22_validate_accepted",
    f"""WITH {RAW_MENTIONS} SELECT chatter_url, url, CAST(likes AS BIGINT) AS likes, CAST(comments AS BIGINT) AS comments, subscribers
        FROM raw WHERE chatter_url <> '' AND url IS NOT NULL AND TRY_CAST(comments AS BIGINT) IS NOT NULL AND subscribers <= 4294967295""",
)
def _(fx):
    good, _ = cleaning.split_valid(raw_mentions(fx), "mentions")
    return good.select("chatter_url", "url", "likes", "comments", "subscribers")


@check(
    "i22_validate_rejected",
    f"""WITH {RAW_MENTIONS}, marked AS (SELECT concat_ws('|', CASE WHEN chatter_url = '' THEN 'chatter_url' END,
          CASE WHEN url IS NULL THEN 'url' END, CASE WHEN TRY_CAST(comments AS BIGINT) IS NULL THEN 'comments' END,
          CASE WHEN subscribers > 4294967295 THEN 'subscribers' END) AS problems FROM raw)
        SELECT problems, count(*) AS rows FROM marked WHERE problems <> '' GROUP BY problems""",
)
def _(fx):
    _, bad = cleaning.split_valid(raw_mentions(fx), "mentions")
    return bad.groupBy(joined("problems")).agg(F.count(F.lit(1)).alias("rows"))


@check(
    "i23_add_to_sets",
    """SELECT a.url, CASE WHEN a.kind = 'news' THEN a.source ELSE coalesce(a.author, 'nobody') END AS author,
       array_to_string(list_sort(list_distinct(list_concat(entities, list_value('Ent 1', source)))), '|') AS entities FROM articles a""",
)
def _(fx):
    base = fx.articles.withColumn("author", F.coalesce("author", F.lit("nobody")))
    changes = fx.articles.select(
        "url", F.when(F.col("kind") == "news", F.col("source")).otherwise("").alias("author"),
        F.array(F.lit("Ent 1"), F.col("source")).alias("entities"),
    )
    rows = ingest.add_to_sets(base, changes, ["url"], ["entities"])
    return rows.select("url", "author", joined(F.array_sort("entities"), "entities"))


@check("u1_union_active", "SELECT DISTINCT url FROM signals")
def _(fx):
    return mention_totals(fx.mentions).select("url").union(related_counts(fx.related).select("url")).distinct()


@check("u2_except_keys", f"WITH {STORED_SQL}, {BATCH_SQL} SELECT url FROM batch EXCEPT SELECT url FROM stored")
def _(fx):
    return ingest.new_keys(stored(fx), batch(fx), ["url"])


@check(
    "u3_closure",
    "WITH half AS (SELECT * FROM related WHERE url < related_url) SELECT url, related_url FROM half UNION SELECT related_url, url FROM half",
)
def _(fx):
    return closure(fx.related.filter("url < related_url"))


@check(
    "j9_unmapped",
    "SELECT url FROM articles a WHERE embedding IS NOT NULL AND NOT EXISTS (SELECT 1 FROM related r WHERE r.url = a.url)",
)
def _(fx):
    return unmapped(fx.articles, fx.related).select("url")
