"""The article tables as DuckDB SQL over the generic test tables."""

# Order matters: a table may use those before it.
TABLES = {
    "articles": """
SELECT concat('doc://', CAST(d.doc_id AS VARCHAR)) AS url,
  CASE d.doc_id % 3 WHEN 0 THEN 'news' WHEN 1 THEN 'blog' ELSE 'post' END AS kind,
  regexp_extract(d.text, '^[^.\\n]*') AS title,
  CASE WHEN d.doc_id % 5 = 0 THEN NULL ELSE concat('author', CAST(d.doc_id % 11 AS VARCHAR)) END AS author,
  d.source AS source, CAST(NULL AS VARCHAR) AS image_url,
  TIMESTAMP '2024-01-01 00:00:00' + INTERVAL 1 DAY * CAST(d.doc_id % 30 AS INT) + INTERVAL 1 SECOND * CAST(d.doc_id AS INT) AS created,
  TIMESTAMP '2024-01-01 01:00:00' + INTERVAL 1 DAY * CAST(d.doc_id % 30 AS INT) + INTERVAL 1 SECOND * CAST(d.doc_id AS INT) AS collected,
  d.text AS summary, d.text AS content,
  (l.toxic = 1) AS restricted_content, e.embedding AS embedding,
  CASE WHEN e.label IS NULL THEN NULL ELSE list_value(concat('cat', CAST(e.label AS VARCHAR))) END AS categories,
  CASE WHEN l.quality IS NULL THEN NULL WHEN l.quality = 1 THEN list_value('good') ELSE list_value('bad') END AS sentiments,
  list_value(d.lang) AS regions,
  list_value(concat('Ent ', CAST(d.doc_id % 7 AS VARCHAR)), concat('Ent ', CAST(d.doc_id % 11 AS VARCHAR))) AS entities
FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id LEFT JOIN labels l ON l.doc_id = d.doc_id""",
    "publishers": """
SELECT DISTINCT source, concat('https://', source, '.example.com') AS base_url,
  CASE WHEN source LIKE '%5' THEN NULL ELSE upper(source) END AS site_name,
  concat('feed of ', source) AS description, CAST(NULL AS VARCHAR) AS favicon,
  concat('https://', source, '.example.com/rss') AS rss_feed, TIMESTAMP '2024-01-01 00:00:00' AS collected
FROM documents WHERE source <> 'src0'""",
    "mentions": """
SELECT concat('post://', CAST(user_id AS VARCHAR), '/', event_type) AS chatter_url,
  concat('doc://', CAST(user_id * 3 + length(event_type) AS VARCHAR)) AS url,
  event_type AS source, concat('forum', CAST(user_id % 10 AS VARCHAR)) AS forum, ts AS collected,
  CAST(floor(value) AS BIGINT) AS likes,
  CASE WHEN user_id % 2 = 0 THEN CAST(floor(floor(value) / 2) AS BIGINT)
       ELSE CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) END AS comments,
  100 + user_id AS subscribers, CAST(0 AS BIGINT) AS shares
FROM events""",
    "related": """
SELECT concat('doc://', CAST(a.vec_id AS VARCHAR)) AS url, concat('doc://', CAST(b.vec_id AS VARCHAR)) AS related_url
FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id AND abs(a.vec_id - b.vec_id) <= 20""",
    "categories_ref": """
SELECT concat('cat', CAST(e.label AS VARCHAR)) AS category, e.embedding
FROM embeddings e JOIN (SELECT label, min(vec_id) AS vec_id FROM embeddings GROUP BY label) m ON m.vec_id = e.vec_id""",
    "sentiments_ref": """
SELECT concat('sent', CAST(e.label AS VARCHAR)) AS sentiment, e.embedding
FROM embeddings e JOIN (SELECT label, max(vec_id) AS vec_id FROM embeddings WHERE label < 5 GROUP BY label) m ON m.vec_id = e.vec_id""",
    "query_vector": """
SELECT embedding::DOUBLE[] AS q FROM embeddings ORDER BY vec_id LIMIT 1""",
    # A snapshot beside the highest counts that its post ever has.
    "snapshots": """
SELECT m.*, max(likes) OVER post AS most_likes, max(comments) OVER post AS most_comments
FROM mentions m WINDOW post AS (PARTITION BY chatter_url)""",
    # When a post first had both, beside each of its snapshots.
    "peaks": """
SELECT s.*, min(collected) FILTER (WHERE likes = most_likes AND comments = most_comments) OVER (PARTITION BY chatter_url) AS peak
FROM snapshots s""",
    # What speaks for an article: a post at its peak, or a related article.
    "signals": """
SELECT url, 'post' AS signal, collected, likes, comments, subscribers, shares FROM peaks WHERE collected = peak
UNION ALL SELECT url, 'pair', NULL, NULL, NULL, NULL, NULL FROM related""",
    "url_signals": """
SELECT url, max(collected)::DATE AS updated, count(*) FILTER (signal = 'post') AS shares, count(*) FILTER (signal = 'pair') AS related,
  sum(likes)::BIGINT AS likes, sum(comments)::BIGINT AS comments, sum(subscribers)::BIGINT AS subscribers,
  sum(shares)::BIGINT AS summed_shares
FROM signals GROUP BY url""",
    "article_numbers": """
SELECT url, ifnull(likes, 0) AS likes, ifnull(comments, 0) AS comments, ifnull(subscribers, 0) AS subscribers, shares,
  ifnull(summed_shares, 0) AS summed_shares, related,
  CASE WHEN updated > created::DATE THEN updated ELSE created::DATE END AS updated
FROM url_signals JOIN articles USING (url)""",
    "trends": """
SELECT * EXCLUDE (summed_shares, age), (likes + 10 * shares + 50 * comments + 100 * related)::DOUBLE / age AS trend_score
FROM (SELECT *, date_diff('day', updated, DATE '2024-02-03') AS age FROM article_numbers)
WHERE likes > 0 OR comments > 0 OR shares > 0 OR related > 0""",
    "related_lists": """
SELECT url, list_sort(array_agg(related_url)) AS related_urls FROM related GROUP BY url""",
    "trending": """
SELECT a.*, t.updated, t.comments, t.shares, t.likes, t.subscribers, t.related, t.trend_score
FROM articles a JOIN trends t ON a.url = t.url""",
    "aggregated": """
SELECT a.*, t.updated, t.comments, t.shares, t.likes, t.subscribers, t.related, t.trend_score,
  r.related_urls, p.base_url, p.site_name, p.description, p.favicon, p.rss_feed
FROM articles a LEFT JOIN trends t ON a.url = t.url LEFT JOIN related_lists r ON a.url = r.url
LEFT JOIN publishers p ON a.source = p.source""",
    "measured": """
SELECT a.*, list_cosine_distance(a.embedding::DOUBLE[], (SELECT q FROM query_vector)) AS distance FROM articles a""",
    "pairs": """
SELECT a.url, b.url AS related_url, list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS distance
FROM articles a JOIN articles b ON a.url <> b.url AND a.categories = b.categories
WHERE list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) <= 1.15""",
    "clusters": """
SELECT m.url, m.cluster_id, s.related
FROM (SELECT url, related_url AS cluster_id,
        row_number() OVER (PARTITION BY url ORDER BY round(distance, 6), related_url) AS rn FROM pairs) m
JOIN (SELECT url, count(*) AS related FROM pairs GROUP BY url) s ON s.url = m.cluster_id WHERE m.rn = 1""",
    "tagged": """
SELECT a.*, regexp_extract_all(lower(array_to_string(list_concat(coalesce(regions, []), coalesce(entities, []), coalesce(categories, [])), ' ')), '[\\p{L}\\p{N}]+') AS tags
FROM articles a""",
    "near_categories": """
SELECT url, category, rn FROM (SELECT a.url, c.category,
  row_number() OVER (PARTITION BY a.url ORDER BY list_cosine_distance(a.embedding::DOUBLE[], c.embedding::DOUBLE[]), c.category) AS rn
  FROM articles a CROSS JOIN categories_ref c WHERE a.embedding IS NOT NULL) WHERE rn <= 2""",
    "near_sentiments": """
SELECT url, sentiment, rn FROM (SELECT a.url, c.sentiment,
  row_number() OVER (PARTITION BY a.url ORDER BY list_cosine_distance(a.embedding::DOUBLE[], c.embedding::DOUBLE[]), c.sentiment) AS rn
  FROM articles a CROSS JOIN sentiments_ref c WHERE a.embedding IS NOT NULL) WHERE rn <= 2""",
    "label_sets": """
SELECT c.url, c.categories, s.sentiments
FROM (SELECT url, list_sort(list(DISTINCT category)) AS categories FROM near_categories GROUP BY url) c
JOIN (SELECT url, list_sort(list(DISTINCT sentiment)) AS sentiments FROM near_sentiments GROUP BY url) s ON s.url = c.url""",
}
