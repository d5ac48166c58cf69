"""V, X, O, Q: vector and text search, orders and query entry points."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from checks.registry import FAR, check, day, joined, moment, rounded
from checks.sources import trends_of
from pulsepress.functions.vectors import distance
from pulsepress.operators import ordering, search, similarity, vector_index
from pulsepress.operators.labels import add_nearest_labels
from pulsepress.operators.text_index import indexed_search, search_scores
from pulsepress.plans import queries as q
from pulsepress.sources.scratch import scratch_folder

Q = "(SELECT q FROM query_vector)"


def measure(metric):
    return lambda fx: fx.articles.select("url", rounded(distance("embedding", fx.query_vector, metric), "distance"))


check("v1_cosine", "SELECT url, round(distance, 6) AS distance FROM measured")(measure("cosine"))
check("v2_l2", f"SELECT url, round(list_distance(embedding::DOUBLE[], {Q}), 6) AS distance FROM articles")(measure("l2"))
check("v3_dot", f"SELECT url, round(1 - list_inner_product(embedding::DOUBLE[], {Q}), 6) AS distance FROM articles")(measure("dot"))


@check(
    "v4_filtered_top_k",
    """SELECT url, kind, round(distance, 6) AS distance FROM measured WHERE kind = 'news' AND list_has_any(regions, ['en', 'de'])
       ORDER BY measured.distance NULLS LAST, created DESC, url LIMIT 10 OFFSET 3""",
)
def _(fx):
    rows = fx.articles.filter((F.col("kind") == "news") & F.col("regions")[0].isin("en", "de"))
    top = search.nearest_rows(rows, fx.query_vector, 10, 3, then=ordering.latest())
    return top.select("url", "kind", rounded("distance"))


@check("v5_threshold", f"SELECT url, round(distance, 6) AS distance FROM measured WHERE distance <= {FAR}")
def _(fx):
    return search.nearest_rows(fx.articles, fx.query_vector, max_distance=FAR).select("url", rounded("distance"))


@check(
    "v5_threshold_per_source",
    f"""SELECT url, source FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY distance, url) AS rn FROM measured
        WHERE distance <= {FAR}) WHERE rn = 1""",
)
def _(fx):
    hits = search.within_distance(fx.articles, fx.query_vector, FAR)
    return search.match_and_page(hits, groups="source", order=ordering.nearest(), columns=["url", "source"])


def items(fx):
    return fx.raw("embeddings").select(F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("id"), "embedding")


def search_sql(measure):
    return f"""SELECT concat('v', CAST(vec_id AS VARCHAR)) AS id, round(d, 6) AS _distance FROM
      (SELECT vec_id, {measure} AS d FROM embeddings) WHERE d <= {{most}} ORDER BY d, id LIMIT 12"""


@check("v6_search_items_l2", search_sql(f"list_distance(embedding::DOUBLE[], {Q})").format(most=1.3))
def _(fx):
    rows = search.search_items(items(fx), fx.query_vector, "l2", 1.3, 12, ["id"])
    return rows.withColumn("_distance", rounded("_distance"))


@check("v6_search_items_cosine", search_sql(f"list_cosine_distance(embedding::DOUBLE[], {Q})").format(most=0.95))
def _(fx):
    rows = search.search_items(items(fx), fx.query_vector, "cosine", 0.95, 12, ["id"])
    return rows.withColumn("_distance", rounded("_distance"))


@check("v6_search_items_dot", search_sql(f"(1 - list_inner_product(embedding::DOUBLE[], {Q}))").format(most=0.95))
def _(fx):
    rows = search.search_items(items(fx), fx.query_vector, "dot", 0.95, 12, ["id"])
    return rows.withColumn("_distance", rounded("_distance"))


RERANK = """SELECT url, round((epoch(created) - min(epoch(created)) OVER ()) / CASE WHEN max(epoch(created)) OVER () = min(epoch(created)) OVER ()
  THEN 1 ELSE max(epoch(created)) OVER () - min(epoch(created)) OVER () END, 6) AS relevance FROM """


@check("v7_rerank", RERANK + "(SELECT url, created FROM measured ORDER BY distance NULLS LAST, url LIMIT 20)")
def _(fx):
    return search.rerank(search.nearest_rows(fx.articles, fx.query_vector, 20)).select("url", rounded("relevance"))


@check("v7_rerank_unbounded", RERANK + f"(SELECT url, created FROM measured WHERE distance <= {FAR})")
def _(fx):
    near = search.within_distance(fx.articles, fx.query_vector, FAR)
    return search.rerank(near, bounded=False).select("url", rounded("relevance"))


@check(
    "v8_three_nearest",
    """SELECT url, string_agg(sentiment, '|' ORDER BY d, sentiment) AS sentiments FROM (SELECT a.url, s.sentiment,
       list_cosine_distance(a.embedding::DOUBLE[], s.embedding::DOUBLE[]) AS d, row_number() OVER (PARTITION BY a.url ORDER BY
       list_cosine_distance(a.embedding::DOUBLE[], s.embedding::DOUBLE[]), s.sentiment) AS rn
       FROM articles a CROSS JOIN sentiments_ref s WHERE a.embedding IS NOT NULL) WHERE rn <= 3 GROUP BY url""",
)
def _(fx):
    vectors = fx.articles.filter("embedding IS NOT NULL").select("url", "embedding")
    rows = add_nearest_labels(vectors, fx.sentiments_ref, "sentiment", n=3)
    return rows.select("url", joined(F.transform("nearest", lambda n: n["label"]), "sentiments"))


@check(
    "v9_similar_to",
    """WITH seed AS (SELECT embedding::DOUBLE[] AS e, tags FROM tagged WHERE url = 'doc://7')
       SELECT url, round(list_cosine_distance(embedding::DOUBLE[], (SELECT e FROM seed)), 6) AS distance FROM tagged
       WHERE url <> 'doc://7' AND kind <> 'post' AND list_has_any(tags, (SELECT tags FROM seed))
         AND list_cosine_distance(embedding::DOUBLE[], (SELECT e FROM seed)) <= 0.95""",
)
def _(fx):
    rows = search.similar_to(fx.articles, "doc://7", 0.95, condition=F.col("kind") != "post")
    return rows.select("url", rounded("distance"))


@check("v10_approximate_nearest")
def _(fx):
    near = similarity.approximate_nearest(fx.articles, fx.query_vector, 10)
    return near.select("url", rounded("distance"))


@check(
    "v10_nearest_in_cells",
    f"""WITH centres AS (SELECT embedding::DOUBLE[] AS centre, row_number() OVER (ORDER BY category) - 1 AS cell FROM categories_ref),
       placed AS (SELECT a.url, a.embedding::DOUBLE[] AS e, (SELECT cell FROM centres ORDER BY list_distance(centre, a.embedding::DOUBLE[]), cell LIMIT 1) AS cell
         FROM articles a WHERE a.embedding IS NOT NULL),
       near AS (SELECT cell FROM centres ORDER BY list_distance(centre, {Q}), cell LIMIT 4)
       SELECT url, round(list_distance(e, {Q}), 6) AS distance FROM placed WHERE cell IN (SELECT cell FROM near)
       ORDER BY list_distance(e, {Q}), url LIMIT 15""",
)
def _(fx):
    centres = [r["embedding"] for r in fx.categories_ref.orderBy("category").collect()]
    cells = vector_index.Cells(np.array(centres, "float64"), probe=4)
    path = scratch_folder(fx.spark)
    vector_index.indexed(fx.articles.select("url", "embedding"), cells).write.partitionBy(vector_index.CELL).parquet(path)
    near = vector_index.nearest_in_cells(fx.spark.read.parquet(path), cells, fx.query_vector, 15)
    return near.select("url", rounded("distance"))


TERMS = "anea the retion 4"
WORDS = "regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}]+')"
WEIGHT = " + ".join(
    f"{w} * len(list_filter({c}, lambda x: x = '{{t}}'))"
    for w, c in (("3.0", "tags"), ("2.0", WORDS.format("title")), ("1.0", WORDS.format("summary")))
)
TEXT_SQL = f"""weights AS (SELECT *, {', '.join(f"CAST({WEIGHT.replace('{t}', t)} AS DOUBLE) AS w{i}" for i, t in enumerate(TERMS.split()))} FROM tagged),
 rarity AS (SELECT {', '.join(f'coalesce(ln(1 + count(*) / nullif(CAST(count(*) FILTER (w{i} > 0) AS DOUBLE), 0)), 0) AS r{i}' for i in range(4))} FROM weights),
 found AS (SELECT w.*, 0.0::DOUBLE + w0 * r0 + w1 * r1 + w2 * r2 + w3 * r3 AS search_score FROM weights w, rarity WHERE w0 + w1 + w2 + w3 > 0)"""


@check("x1_text_search", f"WITH {TEXT_SQL} SELECT url, round(search_score, 6) AS search_score FROM found")
def _(fx):
    return search_scores(fx.text_index, TERMS).select("url", rounded("search_score"))


@check("x1_text_search_scan", f"WITH {TEXT_SQL} SELECT url, round(search_score, 6) AS search_score FROM found")
def _(fx):
    rows = search.text_search(fx.articles, TERMS)
    return rows.select("url", rounded("search_score"))


@check(
    "x1_postings",
    """WITH words AS (SELECT url, unnest(tags) AS term, 3.0 AS w FROM tagged
         UNION ALL SELECT url, unnest(regexp_extract_all(lower(title), '[\\p{L}\\p{N}]+')), 2.0 FROM articles
         UNION ALL SELECT url, unnest(regexp_extract_all(lower(summary), '[\\p{L}\\p{N}]+')), 1.0 FROM articles)
       SELECT term, count(DISTINCT url) AS articles, sum(w)::DOUBLE AS weight FROM words GROUP BY term""",
)
def _(fx):
    rows = fx.text_index.filter("term <> ''").groupBy("term")
    return rows.agg(F.count("url").alias("articles"), F.sum("weight").alias("weight"))


@check(
    "x1_text_search_filtered",
    f"""WITH {TEXT_SQL} SELECT url, source, round(search_score, 6) AS search_score FROM (SELECT *, row_number() OVER (PARTITION BY source
        ORDER BY search_score DESC, url) AS rn FROM found WHERE kind = 'news') WHERE rn = 1""",
)
def _(fx):
    hits = indexed_search(fx.text_index, fx.articles.filter("kind = 'news'"), TERMS)
    rows = search.first_of_each(hits, "source", search.by_search_score())
    return rows.select("url", "source", rounded("search_score"))


@check(
    "x2_text_search_top",
    f"""WITH {TEXT_SQL} SELECT url, title, content, round(search_score, 6) AS search_score FROM found
        ORDER BY found.search_score DESC, url LIMIT 10""",
)
def _(fx):
    # The ten are found among scores alone; no more than ten articles are read in full.
    top = ordering.page(search_scores(fx.text_index, TERMS.split()), search.by_search_score(), limit=10)
    rows = fx.articles.join(F.broadcast(top), "url").orderBy(*search.by_search_score())
    return rows.select("url", "title", "content", rounded("search_score"))


@check("x3_sample", "SELECT url, kind FROM articles WHERE kind <> 'news' ORDER BY md5(concat_ws('#', url, '7')), url LIMIT 25")
def _(fx):
    return search.sample(fx.articles.filter("kind <> 'news'"), 25, seed=7).select("url", "kind")


PAGE = "SELECT url, strftime(created, '%Y-%m-%d %H:%M:%S.%f') AS created FROM "


@check("o1_latest", PAGE + "articles ORDER BY articles.created DESC, url LIMIT 15")
def _(fx):
    return ordering.page(fx.articles, ordering.latest(), limit=15).select("url", moment("created"))


@check("o2_trending", "SELECT url, round(trend_score, 6) AS trend_score FROM trends ORDER BY trends.trend_score DESC, url LIMIT 15")
def _(fx):
    return ordering.page(trends_of(fx), ordering.trending(), limit=15).select("url", rounded("trend_score"))


@check("o3_distance", "SELECT url, round(distance, 6) AS distance FROM measured ORDER BY measured.distance NULLS LAST, created DESC, url LIMIT 15")
def _(fx):
    rows = search.within_distance(fx.articles, fx.query_vector)
    return ordering.page(rows, ordering.nearest(*ordering.latest()), limit=15).select("url", rounded("distance"))


@check("o4_latest_trending", "SELECT url FROM trending ORDER BY created DESC, trend_score DESC, url LIMIT 15")
def _(fx):
    view = fx.articles.select("url", "created").join(trends_of(fx), "url")
    return ordering.page(view, ordering.latest_trending(), limit=15).select("url")


@check("o4_recently_trending", "SELECT url, strftime(updated, '%Y-%m-%d') AS updated FROM trends ORDER BY trends.updated DESC, trend_score DESC, url LIMIT 15")
def _(fx):
    return ordering.page(trends_of(fx), ordering.recently_trending(), limit=15).select("url", day("updated"))


@check("o5_offset_only", PAGE + "articles ORDER BY articles.created DESC, url OFFSET 40")
def _(fx):
    return ordering.page(fx.articles, ordering.latest(), offset=40).select("url", moment("created"))


@check(
    "o5_deep_page",
    """WITH placed AS (SELECT url, row_number() OVER (ORDER BY created DESC, url) AS n, count(*) OVER () AS total FROM articles)
       SELECT url FROM placed WHERE n > total * 9 // 10""",
)
def _(fx):
    rows = fx.articles.select("url", "created")
    return ordering.range_page(rows, ordering.latest(), offset=rows.count() * 9 // 10).select("url")


@check("o5_limit_and_offset", PAGE + "articles ORDER BY articles.created DESC, url LIMIT 20 OFFSET 40")
def _(fx):
    return ordering.page(fx.articles, ordering.latest(), limit=20, offset=40).select("url", moment("created"))


@check(
    "q1_query_latest",
    """SELECT url, title, content FROM articles WHERE kind = 'news' AND created >= TIMESTAMP '2024-01-04' AND created <= TIMESTAMP '2024-01-25'
       AND list_has_any(regions, ['en', 'es']) AND source IN ('src1', 'src2', 'src3', 'src4', 'src6') ORDER BY created DESC, url LIMIT 20 OFFSET 1""",
)
def _(fx):
    return q.query_latest(
        fx.articles, kind="news", created=("2024-01-04", "2024-01-25"), regions=["en", "es"],
        sources=["src1", "src2", "src3", "src4", "src6"], limit=20, offset=1, columns=["url", "title", "content"],
    )


@check(
    "q1_query_latest_by_vector",
    f"""SELECT url, title, round(distance, 6) AS distance FROM measured WHERE distance <= {FAR} AND (list_has_any(entities, ['Ent 1', 'cat2'])
        OR list_has_any(categories, ['Ent 1', 'cat2'])) ORDER BY measured.distance, created DESC, url LIMIT 10""",
)
def _(fx):
    rows = q.query_latest(
        fx.articles, fx.query_vector, FAR, tags=["Ent 1", "cat2"], limit=10, columns=["url", "title"]
    )
    return rows.withColumn("distance", rounded("distance"))


@check(
    "q2_query_trending",
    """SELECT url, title, content, strftime(updated, '%Y-%m-%d') AS updated, likes, comments, shares, subscribers, related,
       round(trend_score, 6) AS trend_score FROM trending WHERE trending.updated >= DATE '2024-01-15' AND list_has_any(entities, ['Ent 1', 'Ent 2', 'Ent 3'])
       ORDER BY trending.trend_score DESC, url LIMIT 10""",
)
def _(fx):
    columns = ["url", "title", "content", "updated", "likes", "comments", "shares", "subscribers", "related", "trend_score"]
    rows = q.query_trending(
        fx.articles, trends_of(fx), updated="2024-01-15", entities=["Ent 1", "Ent 2", "Ent 3"], limit=10, columns=columns
    )
    return rows.withColumns({"updated": day("updated"), "trend_score": rounded("trend_score")})


@check(
    "q2_query_trending_all",
    """SELECT url, likes, round(trend_score, 6) AS trend_score FROM trending WHERE collected >= TIMESTAMP '2024-01-08'""",
)
def _(fx):
    rows = q.query_trending(fx.articles, trends_of(fx), collected="2024-01-08", columns=["url", "likes", "trend_score"])
    return rows.withColumn("trend_score", rounded("trend_score"))


AGGREGATED = ["url", "content", "likes", "related_urls", "base_url", "site_name"]
AGGREGATED_SQL = "SELECT url, content, likes, array_to_string(related_urls, '|') AS related_urls, base_url, site_name FROM aggregated "


@check("q3_query_aggregated", AGGREGATED_SQL + "WHERE kind = 'blog' AND list_has_any(categories, ['cat1', 'cat2', 'cat3', 'cat4']) ORDER BY created DESC, url LIMIT 12 OFFSET 2")
def _(fx):
    rows = q.query_aggregated(
        fx.articles, trends_of(fx), fx.related, fx.publishers, kind="blog", categories=["cat1", "cat2", "cat3", "cat4"],
        limit=12, offset=2, columns=AGGREGATED,
    )
    return rows.withColumn("related_urls", joined("related_urls"))


@check("q3_query_aggregated_all", AGGREGATED_SQL + "WHERE created >= TIMESTAMP '2024-01-10'")
def _(fx):
    rows = q.query_aggregated(
        fx.articles, trends_of(fx), fx.related, fx.publishers, created="2024-01-10", columns=AGGREGATED
    )
    return rows.withColumn("related_urls", joined("related_urls"))


@check(
    "q3_query_aggregated_conditions",
    "SELECT url, round(distance, 6) AS distance, site_name, likes FROM (SELECT a.*, m.distance FROM aggregated a JOIN measured m ON a.url = m.url) WHERE likes > 5 AND site_name IS NOT NULL ORDER BY distance, created DESC, url LIMIT 10",
)
def _(fx):
    rows = q.query_aggregated(
        fx.articles, trends_of(fx), fx.related, fx.publishers, fx.query_vector, conditions=["likes > 5", "site_name IS NOT NULL"],
        limit=10, columns=["url", "site_name", "likes"],
    )
    return rows.withColumn("distance", rounded("distance"))


@check("q4_query_publishers", "SELECT source, base_url, site_name FROM publishers WHERE collected >= TIMESTAMP '2024-01-01' AND source IN ('src1', 'src5', 'src9') AND rss_feed IS NOT NULL")
def _(fx):
    return q.query_publishers(
        fx.publishers, "2024-01-01", ["src1", "src5", "src9"], ["rss_feed IS NOT NULL"], columns=["source", "base_url", "site_name"]
    )


@check("q5_query_mentions", "SELECT chatter_url, url, likes FROM mentions WHERE collected >= TIMESTAMP '2024-01-12' AND source IN ('view', 'click') AND likes > 20")
def _(fx):
    return q.query_mentions(fx.mentions, "2024-01-12", ["view", "click"], ["likes > 20"], columns=["chatter_url", "url", "likes"])


@check(
    "q6_query_aggregated_mentions",
    "SELECT url, likes, shares, round(trend_score, 6) AS trend_score FROM trends WHERE trends.updated >= DATE '2024-01-10' ORDER BY trends.trend_score DESC, url LIMIT 30",
)
def _(fx):
    rows = q.query_aggregated_mentions(trends_of(fx), updated="2024-01-10", limit=30, columns=["url", "likes", "shares", "trend_score"])
    return rows.withColumn("trend_score", rounded("trend_score"))


@check("q7_distinct_categories", "SELECT category FROM categories_ref ORDER BY category")
def _(fx):
    return q.distinct_labels(fx.categories_ref, "category")


@check("q8_distinct_sentiments", "SELECT sentiment FROM sentiments_ref ORDER BY sentiment LIMIT 3 OFFSET 1")
def _(fx):
    return q.distinct_labels(fx.sentiments_ref, "sentiment", limit=3, offset=1)


@check("q9_distinct_entities", "SELECT DISTINCT unnest(entities) AS entity FROM articles ORDER BY entity")
def _(fx):
    return q.distinct_elements(fx.articles, "entities", "entity")


@check("q10_distinct_regions", "SELECT DISTINCT unnest(regions) AS region FROM articles ORDER BY region OFFSET 1")
def _(fx):
    return q.distinct_elements(fx.articles, "regions", "region", offset=1)


@check("q11_distinct_publishers", "SELECT source FROM publishers ORDER BY source LIMIT 12")
def _(fx):
    return q.distinct_publishers(fx.publishers, limit=12)


@check("q12_get_article", "SELECT url, title, kind FROM articles WHERE source = 'src3' AND kind = 'news' ORDER BY url LIMIT 1")
def _(fx):
    return q.get_article(fx.articles, ["url", "title", "kind"], source="src3", kind="news")


@check(
    "q13_match_group_page",
    """SELECT url, source, author FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY created DESC, url) AS rn FROM articles
       WHERE author IS NOT NULL) WHERE rn = 1 ORDER BY created DESC, url LIMIT 8 OFFSET 3""",
)
def _(fx):
    return search.match_and_page(
        fx.articles, F.col("author").isNotNull(), "source", ordering.latest(), offset=3, limit=8, columns=["url", "source", "author"]
    )
