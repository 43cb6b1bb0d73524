"""Shared table expressions of the checking SQL: the same projections as ``plans.tables``."""

STAMP = "strftime({0}, '%Y-%m-%d %H:%M:%S.%f')"
AS_OF = "TIMESTAMP '2024-01-31 00:00:00'"
MID = "TIMESTAMP '2024-01-20 12:00:00'"

SOURCES = """
sources AS (
  SELECT source AS source_id, source AS name,
         CASE WHEN n % 5 = 1 THEN 'hackernews' ELSE 'rss' END AS type,
         (['research','community','company','press','policy'])[n % 5 + 1] AS category,
         n % 10 + 1 AS authority_score, n % 7 <> 6 AS is_active, n % 4 = 0 AS ai_filter
  FROM (SELECT DISTINCT source, CAST(regexp_extract(source, '(\\d+)', 1) AS INTEGER) AS n
        FROM documents))"""
ARTICLES = """
articles AS (
  SELECT doc_id AS article_id, source AS source_id, substr(text, 1, 80) AS title, text AS body,
         'https://' || source || '.example.com/a/' || doc_id AS canonical_url,
         source || '.example.com' AS host,
         TIMESTAMP '2024-01-01' + to_hours(CAST(doc_id % 720 AS INTEGER)) AS published_at,
         TIMESTAMP '2024-01-01' + to_hours(CAST(doc_id % 720 + 1 AS INTEGER)) AS fetched_at,
         len(regexp_extract_all(text, '\\S+')) AS words
  FROM documents)"""
MEMBERS = """
members AS (
  SELECT min(doc_id) OVER (PARTITION BY md5(text)) AS cluster_id, doc_id AS article_id
  FROM documents)"""
OBSERVATIONS = """
obs AS (
  SELECT event_id AS observation_id, event_id % (SELECT count(*) FROM documents) AS article_id,
         'src' || (user_id % 20) AS source_id, 'x' || k AS external_id,
         'https://obs.example.com/' || event_id AS url, ts AS seen_at,
         CASE WHEN user_id % 2 = 0 AND k <> 0 THEN CAST(k AS VARCHAR) ELSE 'x' || k END AS story,
         least(greatest(value, 0), 1500) AS points,
         CAST(user_id % 100 AS DOUBLE) AS comments
  FROM (SELECT *, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events))"""
AUTHORITY = """
authority AS (
  SELECT article_id, max(authority_score) AS authority
  FROM obs JOIN sources USING (source_id) GROUP BY article_id)"""
QUALITY = """
quality AS (
  SELECT m.cluster_id, a.article_id, a.title, a.canonical_url, a.published_at, a.words,
         coalesce(u.authority, 1) AS authority,
         row_number() OVER (PARTITION BY m.cluster_id
           ORDER BY coalesce(u.authority, 1) DESC, least(a.words, 3000) DESC,
                    a.canonical_url DESC) AS place
  FROM members m JOIN articles a USING (article_id) LEFT JOIN authority u USING (article_id))"""
CLUSTERS = """
clusters AS (
  SELECT c.*, 
         CASE WHEN l.quality IS NOT NULL THEN 'Research summary of ' || topic END AS summary,
         CASE WHEN l.quality IS NOT NULL THEN 'why it matters: ' || cluster_id END AS analysis,
         CASE WHEN l.quality = 1 THEN 8 WHEN l.quality = 0 THEN 3 END AS significance_score,
         (['model_release','paper','funding','regulation','research_breakthrough',
           'tool_release','other'])[cluster_id % 7 + 1] AS event_type,
         CASE WHEN l.quality IS NOT NULL THEN 'ready' ELSE 'pending' END AS analysis_status,
         p.title AS primary_title, p.canonical_url AS primary_link
  FROM (SELECT cluster_id, max(CASE WHEN place = 1 THEN title END) AS topic,
               max(CASE WHEN place = 1 THEN article_id END) AS primary_article_id,
               count(*) AS cluster_size, max(published_at) AS latest_published_at
        FROM quality GROUP BY cluster_id) c
  LEFT JOIN labels l ON l.doc_id = c.cluster_id
  JOIN articles p ON p.article_id = c.primary_article_id)"""
SIGNALS = """
stories AS (
  SELECT cluster_id, story, arg_max(points, (seen_at, CAST(observation_id AS VARCHAR))) AS points,
         arg_max(comments, (seen_at, CAST(observation_id AS VARCHAR))) AS comments
  FROM obs JOIN members USING (article_id) JOIN sources USING (source_id)
  WHERE type = 'hackernews' GROUP BY cluster_id, story),
engagement AS (
  SELECT cluster_id, count(*) AS hn_stories, sum(points) AS hn_points, sum(comments) AS hn_comments,
         least(sum(points) + 2 * sum(comments), 1500) AS engagement
  FROM stories GROUP BY cluster_id),
diversity AS (
  SELECT cluster_id, count(DISTINCT article_id) AS articles,
         least(count(DISTINCT article_id), count(DISTINCT host)) AS publishers,
         least(count(DISTINCT article_id), count(DISTINCT category)) AS categories
  FROM (SELECT m.cluster_id, a.article_id, a.host, s.category
        FROM members m JOIN articles a USING (article_id)
        LEFT JOIN obs o ON o.article_id = a.article_id
        LEFT JOIN sources s ON s.source_id = o.source_id) GROUP BY cluster_id)"""


def ranked(as_of: str) -> str:
    return f"""
scored AS (
  SELECT c.*, d.articles, d.publishers, d.categories,
         coalesce(e.hn_stories, 0) AS hn_stories, coalesce(e.hn_points, 0) AS hn_points,
         coalesce(e.hn_comments, 0) AS hn_comments, coalesce(e.engagement, 0) AS engagement,
         pow(2.0, -greatest(0.0, date_diff('microsecond', latest_published_at, {as_of}) / 3600e6)
             / 36) AS recency,
         CASE WHEN significance_score BETWEEN 1 AND 10 THEN significance_score / 10.0
              ELSE 0.5 END AS significance,
         (least(greatest(d.publishers - 1, 0) / 4.0, 1) +
          least(greatest(d.categories - 1, 0) / 4.0, 1)) / 2 AS diversity,
         ln(1 + coalesce(e.engagement, 0)) / ln(1501) AS reach
  FROM clusters c JOIN diversity d USING (cluster_id) LEFT JOIN engagement e USING (cluster_id)),
ranked AS (
  SELECT *, round(100 * recency * 0.30 * diversity, 6) AS diversity_points,
         round(100 * recency * 0.25 * reach, 6) AS engagement_points,
         round(100 * recency * 0.45 * significance, 6) AS significance_points,
         round(diversity_points + engagement_points + significance_points, 6) AS rank_score
  FROM scored)"""


def prelude(*parts: str) -> str:
    return "WITH " + ",".join(parts)


MODEL = (SOURCES, ARTICLES, MEMBERS, OBSERVATIONS, AUTHORITY, QUALITY, CLUSTERS)
BASE = prelude(*MODEL)
RANKED = prelude(*MODEL, SIGNALS, ranked(AS_OF))
RANKED_MID = prelude(*MODEL, SIGNALS, ranked(MID))
