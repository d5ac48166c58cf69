"""J, A, F: joins, aggregations and functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.ingest import CLUSTERED_SQL, clustered
from checks.registry import AS_OF, EPS, FAR, check, day, joined, moment, rounded
from checks.sources import trends_of
from pulsepress.functions import dates, scores, text
from pulsepress.operators import search, similarity
from pulsepress.operators.ingest import deduplicate, drop_orphans
from pulsepress.operators.labels import add_nearest_labels, label_sets
from pulsepress.operators.search import within_distance
from pulsepress.plans import trends as tr
from pulsepress.plans.queries import count_rows
from pulsepress.plans.views import aggregated_view, related_articles, trending_view

TREND_OUT = """url, likes, comments, subscribers, shares, related, strftime(updated, '%Y-%m-%d') AS updated,
  round(trend_score, 6) AS trend_score"""


def trend_rows(df):
    return df.withColumns({"updated": day("updated"), "trend_score": rounded("trend_score")})


@check(
    "j1_trending_view",
    "SELECT url, title, source, likes, comments, shares, subscribers, related, round(trend_score, 6) AS trend_score FROM trending",
)
def _(fx):
    view = trending_view(fx.articles, trends_of(fx))
    return view.select("url", "title", "source", "likes", "comments", "shares", "subscribers", "related", rounded("trend_score"))


@check(
    "j2_aggregated_view",
    """SELECT url, title, likes, comments, round(trend_score, 6) AS trend_score, array_to_string(related_urls, '|') AS related_urls,
       base_url, site_name, description, favicon, rss_feed FROM aggregated""",
)
def _(fx):
    view = aggregated_view(fx.articles, trends_of(fx), fx.related, fx.publishers)
    return view.select(
        "url", "title", "likes", "comments", rounded("trend_score"), joined("related_urls"),
        "base_url", "site_name", "description", "favicon", "rss_feed",
    )


@check("j3_not_stored", "SELECT url, related_url FROM related r WHERE NOT EXISTS (SELECT 1 FROM mentions m WHERE m.url = r.url)")
def _(fx):
    return deduplicate(fx.mentions, fx.related, ["url"]).select("url", "related_url")


@check("j4_semi", "SELECT url, related_url FROM related r WHERE EXISTS (SELECT 1 FROM articles a WHERE a.url = r.url AND a.kind = 'news')")
def _(fx):
    return drop_orphans(fx.related, fx.articles.filter("kind = 'news'"))


SNAPSHOT_OUT = "chatter_url, url, strftime(collected, '%Y-%m-%d %H:%M:%S.%f') AS collected, likes, comments"


@check(
    "j5_snapshots_at_maxima",
    f"SELECT {SNAPSHOT_OUT} FROM snapshots WHERE likes = most_likes AND comments = most_comments",
)
def _(fx):
    return tr.snapshots_at_maxima(fx.mentions).select("chatter_url", "url", moment("collected"), "likes", "comments")


@check(
    "j6_counted_snapshots",
    f"SELECT {SNAPSHOT_OUT} FROM peaks WHERE collected = peak",
)
def _(fx):
    return tr.counted_snapshots(fx.mentions).select("chatter_url", "url", moment("collected"), "likes", "comments")


@check(
    "j7_trend_stats",
    "SELECT url, likes, comments, subscribers, shares, related, strftime(updated, '%Y-%m-%d') AS updated FROM article_numbers",
)
def _(fx):
    return tr.trend_stats(fx.articles, fx.mentions, fx.related).withColumn("updated", day("updated"))


@check("j8_nearest_labels", "SELECT url, category AS label, rn AS rank FROM near_categories")
def _(fx):
    rows = add_nearest_labels(fx.articles.select("url", "embedding"), fx.categories_ref, "category")
    exploded = rows.select("url", F.posexplode("nearest").alias("at", "n"))
    return exploded.select("url", F.col("n")["label"].alias("label"), (F.col("at") + 1).cast("bigint").alias("rank"))


PAIR_OUT = "SELECT url, related_url, round(distance, 6) AS distance FROM pairs"


@check("j9_similar_pairs", PAIR_OUT)
def _(fx):
    return similarity.similar_pairs(fx.articles, EPS).withColumn("distance", rounded("distance"))


@check(
    "j9_similar_pairs_any_category",
    f"""SELECT a.url, b.url AS related_url, round(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS distance
        FROM articles a JOIN articles b ON a.url <> b.url WHERE list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) <= {EPS}""",
)
def _(fx):
    pairs = similarity.similar_pairs(fx.articles, EPS, same_categories=False)
    return pairs.withColumn("distance", rounded("distance"))


@check("j9_new_related", "SELECT url, related_url FROM pairs EXCEPT SELECT url, related_url FROM related")
def _(fx):
    return similarity.new_related(fx.related, fx.articles, EPS, all_pairs=True)


@check(
    "j9_new_related_of_unmapped",
    """WITH kept AS (SELECT r.* FROM related r JOIN articles a ON a.url = r.url WHERE a.kind = 'news'),
       fresh AS (SELECT url FROM articles a WHERE embedding IS NOT NULL AND NOT EXISTS (SELECT 1 FROM kept k WHERE k.url = a.url))
       SELECT url, related_url FROM pairs WHERE url IN (SELECT url FROM fresh) OR related_url IN (SELECT url FROM fresh)
       EXCEPT SELECT url, related_url FROM kept""",
)
def _(fx):
    kept = drop_orphans(fx.related, fx.articles.filter("kind = 'news'"))
    return similarity.new_related(kept, fx.articles, EPS)


@check(
    "j10_same_cluster",
    f"""WITH {CLUSTERED_SQL}, own AS (SELECT cluster_id FROM clustered WHERE url = (SELECT min(url) FROM clusters))
        SELECT url, cluster_id FROM clustered WHERE cluster_id IN (SELECT cluster_id FROM own) AND url <> (SELECT min(url) FROM clusters)""",
)
def _(fx):
    clusters = clustered(fx).select("url", "cluster_id").persist()
    first = clusters.filter("cluster_id IS NOT NULL").agg(F.min("url").alias("url")).first()["url"]
    return similarity.in_cluster(clusters, first).select("url", "cluster_id")


@check(
    "j11_id_list_lookup",
    """SELECT r.url AS owner, a.url, a.title FROM (SELECT url, unnest(related_urls) AS id FROM related_lists) r JOIN articles a ON a.url = r.id""",
)
def _(fx):
    lists = tr.related_lists(fx.related).select(F.col("url").alias("owner"), F.col("related_urls").alias("ids"))
    return related_articles(fx.articles, lists).select("owner", "url", "title")


@check("a1_count_rows", "SELECT count(*) AS count FROM articles WHERE kind = 'news' AND created > TIMESTAMP '2024-01-10 00:00:00'")
def _(fx):
    return count_rows(fx.articles, ["kind = 'news'", "created > TIMESTAMP_NTZ '2024-01-10 00:00:00'"])


@check("a2_post_maxima", "SELECT DISTINCT chatter_url, most_likes AS likes, most_comments AS comments FROM snapshots")
def _(fx):
    return tr.post_maxima(fx.mentions)


@check(
    "a3_first_at_maxima",
    "SELECT DISTINCT chatter_url, strftime(peak, '%Y-%m-%d %H:%M:%S.%f') AS collected FROM peaks WHERE peak IS NOT NULL",
)
def _(fx):
    return tr.first_at_maxima(fx.mentions).select("chatter_url", moment("collected"))


@check(
    "a4_mention_totals",
    "SELECT url, strftime(updated, '%Y-%m-%d') AS updated, likes, comments, subscribers, shares FROM url_signals WHERE shares > 0",
)
def _(fx):
    return tr.mention_totals(fx.mentions).withColumn("updated", day("updated"))


@check("a4_mention_totals_summed", "SELECT url, likes, comments, subscribers, summed_shares AS shares FROM url_signals WHERE shares > 0")
def _(fx):
    return tr.mention_totals(fx.mentions, shares="sum").drop("updated")


@check("a5_related_counts", "SELECT url, related FROM url_signals WHERE related > 0")
def _(fx):
    return tr.related_counts(fx.related)


@check("a6_related_lists", "SELECT url, CAST(0 AS BIGINT) AS part, array_to_string(related_urls, '|') AS related_urls FROM related_lists")
def _(fx):
    rows = tr.related_lists(fx.related)
    return rows.select("url", F.col("related_part").cast("bigint").alias("part"), joined("related_urls"))


LABEL_OUT = "SELECT url, array_to_string(categories, '|') AS categories, array_to_string(sentiments, '|') AS sentiments FROM label_sets"


@check("a7_label_sets", LABEL_OUT)
def _(fx):
    rows = label_sets(fx.articles.filter("embedding IS NOT NULL"), fx.categories_ref, fx.sentiments_ref)
    return rows.select("url", joined("categories"), joined("sentiments"))


@check("a8_trend_aggregate", f"SELECT {TREND_OUT} FROM trends")
def _(fx):
    return trend_rows(trends_of(fx))


@check("a8_trends_from_states", f"SELECT {TREND_OUT} FROM trends")
def _(fx):
    # Each day's state is made from that day alone; states are then merged.
    late = F.col("collected") >= F.expr("TIMESTAMP_NTZ '2024-01-20 00:00:00'")
    states = tr.post_states(fx.mentions.filter(~late)).unionByName(tr.post_states(fx.mentions.filter(late)))
    return trend_rows(tr.trends_from_states(fx.articles, states, fx.related, AS_OF))


@check(
    "a8_trend_aggregate_summed_shares",
    """SELECT url, likes, comments, summed_shares AS shares, related, round((likes + 10 * summed_shares + 50 * comments + 100 * related)::DOUBLE
       / date_diff('day', updated, DATE '2024-02-03'), 6) AS trend_score FROM article_numbers
       WHERE likes > 0 OR comments > 0 OR summed_shares > 0 OR related > 0""",
)
def _(fx):
    rows = tr.trend_aggregate(fx.articles, fx.mentions, fx.related, AS_OF, shares="sum")
    return rows.select("url", "likes", "comments", "shares", "related", rounded("trend_score"))


@check("a9_tag_facets", "SELECT tag, count(*) AS articles FROM (SELECT unnest(entities) AS tag FROM articles WHERE kind = 'news') WHERE tag NOT IN ('Ent 2') GROUP BY tag")
def _(fx):
    return search.tag_counts(fx.articles.filter("kind = 'news'"), "entities", exclude=["Ent 2"])


@check(
    "a9_token_facets_page",
    "SELECT tag, count(*) AS articles FROM (SELECT unnest(tags) AS tag FROM tagged) GROUP BY tag ORDER BY articles DESC, tag LIMIT 8 OFFSET 2",
)
def _(fx):
    return search.tag_counts(fx.articles, text.tag_tokens(), limit=8, offset=2)


@check(
    "a10_facets_near_vector",
    f"SELECT tag, count(*) AS articles FROM (SELECT unnest(entities) AS tag FROM measured WHERE distance <= {FAR}) GROUP BY tag",
)
def _(fx):
    return search.tag_counts(within_distance(fx.articles, fx.query_vector, FAR), "entities")


@check(
    "a11_cluster_sizes",
    f"""WITH {CLUSTERED_SQL}, sizes AS (SELECT cluster_id, count(*) AS n FROM clustered GROUP BY cluster_id)
        SELECT s.cluster_id, c.url, s.n AS cluster_size FROM clustered c JOIN sizes s ON s.cluster_id IS NOT DISTINCT FROM c.cluster_id
        WHERE c.kind = 'news'""",
)
def _(fx):
    rows = clustered(fx)
    return similarity.cluster_sizes(rows, fx.articles.filter("kind = 'news'"))


ROLLUP_SQL = """(SELECT url, CAST(sum(likes) AS BIGINT) AS likes, CAST(sum(comments) AS BIGINT) AS comments, count(*) AS shares,
  max(collected) AS collected, list_sort(list(chatter_url)) AS shared_in
  FROM (SELECT url, chatter_url, max(likes) AS likes, max(comments) AS comments, max(collected) AS collected FROM mentions
  WHERE {where} GROUP BY url, chatter_url) GROUP BY url)"""


@check(
    "a12_mention_rollup",
    f"SELECT url, likes, comments, shares, strftime(collected, '%Y-%m-%d %H:%M:%S.%f') AS collected FROM {ROLLUP_SQL.format(where='true')}",
)
def _(fx):
    return tr.mention_rollup(fx.mentions).withColumn("collected", moment("collected"))


@check("a12_shared_in", f"SELECT url, CAST(0 AS BIGINT) AS part, array_to_string(shared_in, '|') AS shared_in FROM {ROLLUP_SQL.format(where='true')}")
def _(fx):
    rows = tr.shared_in(fx.mentions)
    return rows.select("url", F.col("shared_part").cast("bigint").alias("part"), joined("shared_in"))


BEFORE = "collected < TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 3 DAY"


@check(
    "a13_mention_change",
    f"""SELECT n.url, n.likes, n.comments, n.shares, n.likes - coalesce(b.likes, 0) AS likes_change,
        n.comments - coalesce(b.comments, 0) AS comments_change, n.shares - coalesce(b.shares, 0) AS shares_change
        FROM {ROLLUP_SQL.format(where='true')} n LEFT JOIN {ROLLUP_SQL.format(where=BEFORE)} b ON n.url = b.url""",
)
def _(fx):
    return tr.mention_change(fx.mentions, "2024-01-20", 3).drop("collected")


@check(
    "a14_first_per_source",
    "SELECT url, source, kind FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY created DESC, url) AS rn FROM articles) WHERE rn = 1",
)
def _(fx):
    rows = search.first_of_each(fx.articles, "source", [F.col("created").desc(), F.col("url")])
    return rows.select("url", "source", "kind")


@check(
    "a14_first_per_cluster_and_source",
    f"""WITH {CLUSTERED_SQL}, a AS (SELECT c.*, x.source, x.created FROM clustered c JOIN articles x ON x.url = c.url),
        b AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY created DESC, url) AS rn FROM a),
        d AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY created DESC, url) AS rs FROM b WHERE rn = 1)
        SELECT url, cluster_id, source FROM d WHERE rs = 1""",
)
def _(fx):
    rows = search.first_of_each(clustered(fx), ["cluster_id", "source"], [F.col("created").desc(), F.col("url")])
    return rows.select("url", "cluster_id", "source")


@check(
    "a15_counts",
    f"""SELECT 'sources' AS what, count(DISTINCT source) AS total_count FROM articles WHERE kind = 'news' UNION ALL
        SELECT 'near', count(*) FROM measured WHERE distance <= {FAR} UNION ALL
        SELECT 'text', count(*) FROM tagged WHERE list_contains(list_concat(tags, list_concat(regexp_extract_all(lower(title), '[\\p{{L}}\\p{{N}}]+'),
          regexp_extract_all(lower(summary), '[\\p{{L}}\\p{{N}}]+'))), 'anea')""",
)
def _(fx):
    sources = search.match_and_page(fx.articles, F.col("kind") == "news", "source", count=True)
    near = search.match_and_page(within_distance(fx.articles, fx.query_vector, FAR), count=True)
    hits = search.match_and_page(search.text_search(fx.articles, "Anea"), count=True)
    named = [df.select(F.lit(n).alias("what"), "total_count") for n, df in (("sources", sources), ("near", near), ("text", hits))]
    return named[0].union(named[1]).union(named[2])


@check("a16_assign_clusters", "SELECT url, cluster_id, related FROM clusters")
def _(fx):
    return similarity.similar_clusters(fx.articles, EPS)


@check(
    "f1_trend_score_whole",
    """SELECT url, ((likes + 10 * shares + 50 * comments + 100 * related) // date_diff('day', updated, DATE '2024-02-03'))::DOUBLE AS trend_score
       FROM trends""",
)
def _(fx):
    return tr.trend_aggregate(fx.articles, fx.mentions, fx.related, AS_OF, whole_scores=True).select("url", "trend_score")


@check(
    "f2_updated_day",
    """SELECT url, strftime(max(CASE WHEN s.updated > created::DATE THEN s.updated ELSE created::DATE END), '%Y-%m-%d') AS updated,
       max(ifnull(likes, 0)) AS likes FROM articles LEFT JOIN url_signals s USING (url) GROUP BY url""",
)
def _(fx):
    rows = fx.articles.select("url", "created").join(tr.mention_totals(fx.mentions), "url", "left")
    later = scores.updated_day(F.col("created"), F.col("updated"))
    return rows.select("url", F.date_format(later, "yyyy-MM-dd").alias("updated"), scores.or_zero("likes").alias("likes"))


@check("f3_or_zero", "SELECT d.doc_id, coalesce(l.quality, 0) AS quality FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
def _(fx):
    return fx.raw("documents").join(fx.raw("labels"), "doc_id", "left").select("doc_id", scores.or_zero("quality").alias("quality"))


@check(
    "f4_dates",
    """SELECT url, strftime(CAST(created AS DATE), '%Y-%m-%d') AS day, DATE '2024-02-01' + 2 - CAST(created AS DATE) AS age,
       created >= DATE '2024-02-01' - INTERVAL 6 MONTH AS recent, collected >= DATE '2024-02-01' - INTERVAL 2 WEEK AS fresh FROM articles""",
)
def _(fx):
    created = F.to_date("created")
    return fx.articles.select(
        "url", dates.day_text(created).alias("day"),
        F.datediff(F.date_add(dates.day(AS_OF), 2), created).cast("bigint").alias("age"),
        (F.col("created") >= dates.window_start(AS_OF, "6 months").cast("timestamp_ntz")).alias("recent"),
        (F.col("collected") >= dates.window_start(AS_OF, "2 weeks").cast("timestamp_ntz")).alias("fresh"),
    )


@check(
    "f5_tags_text",
    "SELECT url, array_to_string(list_concat(coalesce(regions, []), coalesce(entities, []), coalesce(categories, [])), ' ') AS tags FROM articles",
)
def _(fx):
    return fx.articles.select("url", text.tags_text("regions", "entities", "categories").alias("tags"))


@check("f7_unnest", "SELECT url, unnest(categories) AS category FROM articles")
def _(fx):
    return fx.articles.select("url", F.explode("categories").alias("category"))


@check(
    "f8_text_cleaning",
    """SELECT doc_id, lower(source) AS source, nullif(regexp_replace(text, '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g'), '') AS body,
       least(len(regexp_extract_all(text, '[^\\s\\p{Z}]+')), 32767) AS words,
       CASE WHEN doc_id % 3 <> 0 THEN concat('a', doc_id) END AS author FROM documents""",
)
def _(fx):
    author = F.when(F.col("doc_id") % 3 == 0, " Anonymous ").otherwise(F.concat(F.lit(" a"), F.col("doc_id").cast("string")))
    return fx.raw("documents").select(
        "doc_id", F.lower("source").alias("source"), text.strip("text").alias("body"),
        text.count_words("text").cast("bigint").alias("words"), text.clean_author(author).alias("author"),
    )


@check(
    "f9_days_ago",
    """SELECT url, strftime(TIMESTAMP '2024-02-01' - INTERVAL 20 DAY, '%Y-%m-%d') AS start, created >= TIMESTAMP '2024-02-01' - INTERVAL 20 DAY AS inside
       FROM articles""",
)
def _(fx):
    start = dates.days_before(AS_OF, 20)
    return fx.articles.select("url", dates.day_text(start).alias("start"), (F.col("created") >= start).alias("inside"))


@check("f10_rfc3339", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S+00:00') AS ts FROM events")
def _(fx):
    return fx.raw("events").select("event_id", dates.rfc3339("ts").alias("ts"))


@check(
    "f11_urls_and_types",
    """SELECT concat('https://cdn.example.com/', source, '/', doc_id, CASE doc_id % 4 WHEN 0 THEN '.txt' WHEN 1 THEN '.JSON' WHEN 2 THEN '.zzz' ELSE '' END) AS url,
       CASE doc_id % 4 WHEN 0 THEN 'text/plain' WHEN 1 THEN 'application/json' ELSE 'application/octet-stream' END AS type FROM documents""",
)
def _(fx):
    which = F.col("doc_id") % 4
    ending = F.when(which == 0, ".txt").when(which == 1, ".JSON").when(which == 2, ".zzz").otherwise("")
    key = F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), ending)
    return fx.raw("documents").select(
        text.public_url(key, "https://cdn.example.com/").alias("url"), text.content_type(key).alias("type")
    )


@check(
    "f12_min_max",
    """SELECT doc_id, round((n_chars - (SELECT min(n_chars) FROM documents)) / ((SELECT max(n_chars) FROM documents) - (SELECT min(n_chars) FROM documents))::DOUBLE, 6) AS scaled
       FROM documents""",
)
def _(fx):
    d = fx.raw("documents").select("doc_id", F.col("n_chars").cast("double").alias("n"))
    span = d.agg(F.struct(F.min("n").alias("low"), F.max("n").alias("high"))).scalar()
    return d.select("doc_id", rounded(scores.min_max(F.col("n"), span["low"], span["high"]), "scaled"))
