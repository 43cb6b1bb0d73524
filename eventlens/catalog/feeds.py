"""Ranking, feed, detail and status queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventlens.catalog import big, listed, query, stamp
from eventlens.catalog import sql as s
from eventlens.functions import numbers as nm
from eventlens.operators import coverage as cv
from eventlens.operators import events, feed, topics
from eventlens.operators import ranking as rk
from eventlens.plans import feed_queries as fq
from eventlens.plans import tables as tb

MID = "2024-01-20 12:00:00"
SCORES = ["rank_score", "hn_points", "hn_comments", "engagement"]
LATEST = s.STAMP.format("latest_published_at") + " AS latest_published_at"


def _rounded(*names: str):
    """Four digits; the small shift keeps exact halves from depending on binary rounding."""
    return [F.round(F.col(n) + 1e-9, 4).alias(n) for n in names]


def _ranked(spark, d, as_of=tb.AS_OF):
    t = tb.load(spark, d)
    return rk.rank_clusters(t.clusters, t.members, t.articles, t.observations, t.sources, as_of)


@query(
    "ranked_clusters",
    s.RANKED
    + f"""SELECT cluster_id, topic, primary_article_id, cluster_size, {LATEST}, articles, publishers,
      CAST(categories AS BIGINT) AS categories, hn_stories, round(hn_points + 1e-9, 4) AS hn_points,
      round(hn_comments + 1e-9, 4) AS hn_comments, round(engagement + 1e-9, 4) AS engagement,
      round(rank_score + 1e-9, 4) AS rank_score, round(diversity_points + 1e-9, 4) AS diversity_points,
      round(engagement_points + 1e-9, 4) AS engagement_points, round(significance_points + 1e-9, 4) AS significance_points, round(recency + 1e-9, 4) AS recency,
      significance_score IS NOT NULL AS significance_available FROM ranked""",
)
def ranked_clusters(spark, d):
    part = lambda n: F.round(F.col(f"rank.{n}.points") + 1e-9, 4)
    return rk.order_ranked(_ranked(spark, d)).select(
        "cluster_id", "topic", "primary_article_id", "cluster_size", stamp("latest_published_at"),
        *big("articles", "publishers", "categories", "hn_stories"), *_rounded(*SCORES),
        part("diversity").alias("diversity_points"), part("engagement").alias("engagement_points"),
        part("technical_significance").alias("significance_points"),
        F.round(F.col("rank.recency") + 1e-9, 4).alias("recency"), "significance_available",
    )


def _page(df):
    return df.select(
        "cluster_id", "topic", "primary_title", "summary", "event_type", stamp("latest_published_at"),
        *_rounded("rank_score"), *big("total"),
    )


def _feed_sql(where: str, order: str, limit: int, offset: int, ranked: str = s.RANKED) -> str:
    return (
        ranked
        + f""", matching AS (SELECT * FROM ranked WHERE {where})
        SELECT cluster_id, topic, primary_title, summary, event_type, {LATEST},
        round(rank_score + 1e-9, 4) AS rank_score, (SELECT count(*) FROM matching) AS total
        FROM matching ORDER BY {order} LIMIT {limit} OFFSET {offset}"""
    )


BY_RANK = "round(rank_score, 6) DESC, latest_published_at DESC, CAST(cluster_id AS VARCHAR)"
BY_TIME = "latest_published_at DESC, cluster_id"
WEEK = "latest_published_at >= {0} - INTERVAL 7 DAY AND latest_published_at <= {0}"


@query("feed_ranked_page", _feed_sql(WEEK.format(s.AS_OF), BY_RANK, 12, 12))
def feed_ranked_page(spark, d):
    t = tb.load(spark, d)
    return _page(fq.customer_feed(t, fq.FeedQuery(offset=12), 3, tb.AS_OF))


@query("feed_latest_page", _feed_sql(WEEK.format(s.MID), BY_TIME, 10, 20, s.RANKED_MID))
def feed_latest_page(spark, d):
    t = tb.load(spark, d)
    return _page(fq.customer_feed(t, fq.FeedQuery(sort="latest", limit=10, offset=20), 3, MID))


@query(
    "feed_search_literal",
    _feed_sql(
        f"latest_published_at <= {s.MID} AND (contains(lower(topic), lower('the')) OR "
        "coalesce(contains(lower(summary), lower('the')), false) OR "
        "contains(lower(primary_title), lower('the')))",
        BY_RANK, 100, 0, s.RANKED_MID,
    ),
)
def feed_search_literal(spark, d):
    t = tb.load(spark, d)
    return _page(fq.customer_feed(t, fq.FeedQuery(window="all", q="The", limit=100), 4, MID))


@query(
    "event_type_filter",
    _feed_sql(f"{WEEK.format(s.AS_OF)} AND event_type = 'funding'", BY_RANK, 50, 0),
)
def event_type_filter(spark, d):
    t = tb.load(spark, d)
    return _page(fq.customer_feed(t, fq.FeedQuery(event_type="funding", limit=50), 3, tb.AS_OF))


_KEYWORDS = {
    "llm": ("language model", "llm", "fine-tun", "inference"),
    "agents": ("agent", "tool use", "tool-use"),
    "vision": ("vision", "image", "video", "multimodal"),
    "open_source": ("open source", "open-source", "open weight", "open-weight"),
    "research": ("research", "paper", "benchmark", "arxiv"),
    "policy": ("policy", "regulat", "governance", "safety"),
    "robotics": ("robot", "embodied", "autonomous"),
    "infrastructure": ("infrastructure", "gpu", "serving", "deployment"),
}


def _match_sql(topic: str) -> str:
    tests = [
        f"coalesce(contains(lower({column}), '{word}'), false)"
        for word in _KEYWORDS[topic]
        for column in ("topic", "summary", "primary_title")
    ]
    return "(" + " OR ".join(tests) + ")"


_TAGS = ", tags AS (" + " UNION ALL ".join(
    f"SELECT cluster_id, '{topic}' AS topic_id FROM clusters WHERE {_match_sql(topic)}" for topic in _KEYWORDS
) + ")"


@query("topic_tags", s.BASE + _TAGS + " SELECT cluster_id, topic_id FROM tags")
def topic_tags(spark, d):
    t = tb.load(spark, d)
    rows = feed.with_primary(t.clusters, t.articles)
    return topics.topic_rows(rows).select("cluster_id", F.col("topic").alias("topic_id"))


_USER_TOPICS = """, names AS (SELECT ['llm','agents','vision','open_source','research','policy','robotics','infrastructure'] AS n),
user_topics AS (SELECT DISTINCT user_id, topic_id FROM (
  SELECT c_custkey AS user_id, unnest([n[c_custkey % 8 + 1], n[(c_custkey + c_custkey % 5) % 8 + 1]]) AS topic_id
  FROM customer, names WHERE c_custkey % 9 <> 0))"""


@query(
    "following_totals",
    s.BASE + _TAGS + _USER_TOPICS + """ SELECT u.user_id, count(DISTINCT t.cluster_id) AS followed_events
    FROM user_topics u LEFT JOIN tags t USING (topic_id) GROUP BY u.user_id""",
)
def following_totals(spark, d):
    t = tb.load(spark, d)
    rows = feed.with_primary(t.clusters, t.articles)
    return topics.following_totals(rows, t.user_topics).select("user_id", *big("followed_events"))


@query(
    "following_feed",
    s.RANKED + _TAGS + _USER_TOPICS + f""", matching AS (SELECT * FROM ranked WHERE {WEEK.format(s.AS_OF)}
      AND cluster_id IN (SELECT cluster_id FROM tags JOIN user_topics USING (topic_id) WHERE user_id = 4))
      SELECT cluster_id, topic, primary_title, summary, event_type, {LATEST},
      round(rank_score + 1e-9, 4) AS rank_score, (SELECT count(*) FROM matching) AS total
      FROM matching ORDER BY {BY_RANK} LIMIT 20""",
)
def following_feed(spark, d):
    t = tb.load(spark, d)
    return _page(fq.customer_feed(t, fq.FeedQuery(following=True, limit=20), 4, tb.AS_OF))


_TODAY = f"latest_published_at >= date_trunc('day', {s.MID}) AND latest_published_at < date_trunc('day', {s.MID}) + INTERVAL 1 DAY"
_BRIEF = f"SELECT cluster_id, topic, {LATEST}, round(rank_score + 1e-9, 4) AS rank_score FROM ranked"


def _brief(df):
    return df.select("cluster_id", "topic", stamp("latest_published_at"), *_rounded("rank_score"))


@query("today_top", s.RANKED_MID + f"{_BRIEF} WHERE {_TODAY} ORDER BY {BY_RANK} LIMIT 20")
def today_top(spark, d):
    return _brief(fq.today_top(tb.load(spark, d), MID))


@query(
    "all_clusters_page",
    s.RANKED_MID + f"{_BRIEF} WHERE contains(lower(topic), 'an') ORDER BY {BY_TIME} LIMIT 50 OFFSET 5",
)
def all_clusters_page(spark, d):
    return _brief(fq.all_clusters(tb.load(spark, d), MID, topic="AN", sort="latest", limit=50, offset=5))


_PUBLIC = (
    "cluster_id AS id, primary_title AS title, summary, significance_score, event_type, "
    + s.STAMP.format("latest_published_at") + " AS published_at, primary_link, cluster_size AS source_count"
)


@query(
    "public_feed",
    s.BASE + f"""SELECT {_PUBLIC}, (SELECT count(*) FROM clusters WHERE latest_published_at <= {s.MID}) AS total
    FROM clusters WHERE latest_published_at <= {s.MID} ORDER BY {BY_TIME} LIMIT 50 OFFSET 10""",
)
def public_feed(spark, d):
    rows = fq.public_feed(tb.load(spark, d), 50, 10, MID)
    return rows.withColumn("published_at", stamp("published_at"))


_COVERAGE = """, coverage AS (
  SELECT m.cluster_id, a.article_id, o.observation_id, a.title, s.name AS source, s.category AS source_category,
         s.authority_score, o.url,
         row_number() OVER (PARTITION BY m.cluster_id ORDER BY s.authority_score DESC, s.name, a.article_id,
                            o.observation_id) AS place
  FROM members m JOIN articles a USING (article_id) JOIN obs o ON o.article_id = a.article_id
  JOIN sources s ON s.source_id = o.source_id)"""


@query(
    "public_event",
    s.BASE + _COVERAGE + f""" SELECT {_PUBLIC.replace("cluster_id AS id", "c.cluster_id AS id")}, v.coverage
    FROM clusters c LEFT JOIN (
      SELECT cluster_id, string_agg(source || ' ' || url, '|' ORDER BY place) AS coverage
      FROM coverage WHERE place <= 10 GROUP BY cluster_id) v USING (cluster_id)
    WHERE latest_published_at <= {s.AS_OF} AND cluster_id = (SELECT min(cluster_id) FROM clusters)""",
)
def public_event(spark, d):
    t = tb.load(spark, d)
    first = t.clusters.agg(F.min("cluster_id")).scalar()
    text = F.transform("coverage", lambda c: F.concat_ws(" ", c["source"], c["url"]))
    return fq.public_event(t, first, tb.AS_OF).select(
        "id", "title", "summary", "significance_score", "event_type", stamp("published_at"), "primary_link",
        "source_count", listed(text, "coverage"),
    )


_DETAIL_USERS = """, users AS (
  SELECT c_custkey AS user_id, c_custkey % 4 = 0 AND (c_custkey % 8 <> 0 OR c_custkey % 3 - 1 > 0) AS paid
  FROM customer)"""


def _detail_sql(user: int) -> str:
    return s.RANKED + _DETAIL_USERS + f""" SELECT cluster_id, topic, primary_title, primary_link, {LATEST},
      round(rank_score + 1e-9, 4) AS rank_score, CASE WHEN paid THEN analysis END AS analysis,
      NOT paid AND analysis_status = 'ready' AS analysis_locked
    FROM ranked, (SELECT coalesce(bool_or(paid), false) AS paid FROM users WHERE user_id = {user})
    WHERE cluster_id = (SELECT min(doc_id) FROM labels JOIN clusters ON cluster_id = doc_id)"""


def _detail(spark, d, user: int):
    t = tb.load(spark, d)
    marked = tb.read(spark, d, "labels").select(F.col("doc_id").alias("cluster_id"))
    one = t.clusters.join(marked, "cluster_id", "left_semi").agg(F.min("cluster_id")).scalar()
    return fq.customer_detail(t, one, user, tb.AS_OF)


def _detail_event(spark, d, user: int):
    event, _ = _detail(spark, d, user)
    return event.select(
        "cluster_id", "topic", "primary_title", "primary_link", stamp("latest_published_at"), *_rounded("rank_score"),
        "analysis", "analysis_locked",
    )


@query("customer_detail", _detail_sql(4))
def customer_detail(spark, d):
    """One event for a customer with full access."""
    return _detail_event(spark, d, 4)


@query("customer_detail_locked", _detail_sql(3))
def customer_detail_locked(spark, d):
    """The same event for a customer without."""
    return _detail_event(spark, d, 3)


@query(
    "customer_detail_coverage",
    s.BASE + _COVERAGE + """ SELECT article_id, observation_id, source, url FROM coverage
    WHERE cluster_id = (SELECT min(doc_id) FROM labels JOIN clusters ON cluster_id = doc_id)""",
)
def customer_detail_coverage(spark, d):
    _, rows = _detail(spark, d, 4)
    return rows.select("article_id", "observation_id", "source", "url")


@query(
    "public_event_coverage",
    s.BASE + _COVERAGE + """ SELECT cluster_id, string_agg(source || ' ' || url, '|' ORDER BY place) AS coverage,
    count(*) AS entries FROM coverage WHERE place <= 10 GROUP BY cluster_id""",
)
def public_event_coverage(spark, d):
    entries = cv.public_coverage(fq.event_coverage(tb.load(spark, d)))
    text = F.transform("coverage", lambda c: F.concat_ws(" ", c["source"], c["url"]))
    return entries.select(
        "cluster_id", listed(text, "coverage"), F.size("coverage").cast("bigint").alias("entries")
    )


@query(
    "cluster_coverage",
    s.BASE + _COVERAGE + """ SELECT cluster_id, article_id, observation_id, title, source, source_category, url
    FROM coverage""",
)
def cluster_coverage(spark, d):
    rows = feed.customer_view(fq.event_coverage(tb.load(spark, d)))
    return rows.select(
        "cluster_id", "article_id", "observation_id", "title", "source", "source_category", "url"
    )


@query(
    "gated_detail",
    s.BASE + """, users AS (
      SELECT c_custkey AS user_id, c_custkey % 4 = 0 AND (c_custkey % 8 <> 0 OR c_custkey % 3 - 1 > 0) AS paid
      FROM customer)
    SELECT user_id, cluster_id, CASE WHEN paid THEN analysis END AS analysis,
           NOT paid AND analysis_status = 'ready' AS analysis_locked
    FROM users JOIN clusters ON cluster_id = user_id""",
)
def gated_detail(spark, d):
    t = tb.load(spark, d)
    visits = t.clusters.withColumn("user_id", F.col("cluster_id"))
    rows = feed.with_entitlements(visits, t.users, tb.AS_OF)
    gated = feed.customer_view(feed.gate_analysis(rows, F.col("features")))
    return gated.select("user_id", "cluster_id", "analysis", "analysis_locked")


@query(
    "latest_story_signals",
    s.prelude(s.SOURCES, s.ARTICLES, s.MEMBERS, s.OBSERVATIONS, s.SIGNALS)
    + " SELECT cluster_id, story AS story_id, round(points + 1e-9, 4) AS points, comments FROM stories",
)
def latest_story_signals(spark, d):
    rows = rk.latest_story(tb.members(spark, d), tb.observations(spark, d), tb.sources(spark, d))
    return rows.select("cluster_id", "story_id", *_rounded("points"), "comments")


@query(
    "engagement_by_cluster",
    s.prelude(s.SOURCES, s.ARTICLES, s.MEMBERS, s.OBSERVATIONS, s.SIGNALS)
    + """ SELECT cluster_id, hn_stories, round(hn_points + 1e-9, 4) AS hn_points, hn_comments,
    round(engagement + 1e-9, 4) AS engagement FROM engagement""",
)
def engagement_by_cluster(spark, d):
    rows = rk.engagement(tb.members(spark, d), tb.observations(spark, d), tb.sources(spark, d))
    return rows.select("cluster_id", "hn_stories", *_rounded("hn_points"), "hn_comments", *_rounded("engagement"))


@query(
    "diversity_by_cluster",
    s.prelude(s.SOURCES, s.ARTICLES, s.MEMBERS, s.OBSERVATIONS, s.SIGNALS)
    + " SELECT cluster_id, articles, publishers, categories FROM diversity",
)
def diversity_by_cluster(spark, d):
    rows = rk.diversity_counts(
        tb.members(spark, d), tb.articles(spark, d), tb.observations(spark, d), tb.sources(spark, d)
    )
    return rows.select("cluster_id", *big("articles", "publishers", "categories"))


@query(
    "representative_articles",
    s.BASE + """ SELECT cluster_id, article_id, CAST(authority AS BIGINT) AS authority, words, canonical_url
    FROM quality WHERE place = 1""",
)
def representative_articles(spark, d):
    seen, registry = tb.observations(spark, d), tb.sources(spark, d)
    rows = events.representatives(
        tb.members(spark, d), tb.articles(spark, d), events.source_authority(seen, registry)
    )
    return rows.select("cluster_id", "article_id", *big("authority", "words"), "canonical_url")


@query(
    "refreshed_clusters",
    s.BASE + f"SELECT cluster_id, topic, primary_article_id, cluster_size, {LATEST} FROM clusters",
)
def refreshed_clusters(spark, d):
    seen, registry = tb.observations(spark, d), tb.sources(spark, d)
    rows = events.refresh_clusters(
        tb.members(spark, d), tb.articles(spark, d), events.source_authority(seen, registry)
    )
    return rows.select("cluster_id", "topic", "primary_article_id", "cluster_size", stamp("latest_published_at"))


@query(
    "primary_flags",
    s.BASE + """ SELECT cluster_id, article_id, article_id = primary_article_id AS is_primary
    FROM members JOIN clusters USING (cluster_id)""",
)
def primary_flags(spark, d):
    t = tb.load(spark, d)
    return events.mark_primary(t.members, t.clusters)


@query(
    "invalidated_analysis",
    s.BASE + """, changed AS (SELECT DISTINCT cluster_id FROM members JOIN obs USING (article_id)
      WHERE obs.seen_at >= TIMESTAMP '2024-01-25')
    SELECT c.cluster_id, CASE WHEN x.cluster_id IS NULL THEN summary END AS summary,
      CASE WHEN x.cluster_id IS NULL THEN significance_score END AS significance_score,
      CASE WHEN x.cluster_id IS NULL THEN analysis_status ELSE 'pending' END AS analysis_status
    FROM clusters c LEFT JOIN changed x USING (cluster_id)""",
)
def invalidated_analysis(spark, d):
    t = tb.load(spark, d)
    recent = t.observations.where(F.col("seen_at") >= "2024-01-25").select("article_id").distinct()
    changed = t.members.join(recent, "article_id", "left_semi")
    rows = events.invalidate(t.clusters, changed)
    return rows.select("cluster_id", "summary", "significance_score", "analysis_status")


_REQUESTS = """
  SELECT c_custkey AS request_id, '  ' || repeat(c_name, 1 + CAST(c_custkey % 15 AS INTEGER)) || ' ' AS q,
    CASE c_custkey % 3 WHEN 0 THEN 'week' WHEN 1 THEN 'today' ELSE c_mktsegment END AS win,
    CASE c_custkey % 4 WHEN 0 THEN 'latest' ELSE 'x' END AS sort,
    CASE c_custkey % 5 WHEN 0 THEN 'paper' WHEN 1 THEN 'Paper' ELSE '' END AS event_type,
    CASE c_custkey % 2 WHEN 0 THEN 'true' ELSE 'yes' END AS following,
    CASE c_custkey % 6 WHEN 0 THEN CAST(c_custkey * 10 AS VARCHAR) WHEN 1 THEN '2.0' WHEN 2 THEN '1.5'
         WHEN 3 THEN '-1' WHEN 4 THEN 'abc' ELSE CAST(c_custkey AS VARCHAR) END AS page
  FROM customer"""


@query(
    "normalized_requests",
    f"""SELECT request_id, substr(trim(q), 1, 200) AS q, CASE WHEN win IN ('today', 'all') THEN win ELSE 'week' END AS win,
    CASE WHEN sort = 'latest' THEN 'latest' ELSE 'ranked' END AS sort,
    CASE WHEN event_type = 'paper' THEN 'paper' ELSE '' END AS event_type, following = 'true' AS following,
    CAST(CASE WHEN try_cast(page AS DOUBLE) BETWEEN 1 AND 8334 AND try_cast(page AS DOUBLE) = floor(try_cast(page AS DOUBLE))
         THEN try_cast(page AS DOUBLE) ELSE 1 END AS INTEGER) AS page FROM ({_REQUESTS})""",
)
def normalized_requests(spark, d):
    key = F.col("c_custkey")
    pick = lambda n, options, other: F.coalesce(*[F.when(key % n == i, v) for i, v in options.items()], other)
    requests = tb.read(spark, d, "customer").select(
        key.alias("request_id"),
        F.concat(F.lit("  "), F.repeat("c_name", (key % 15 + 1).cast("int")), F.lit(" ")).alias("q"),
        F.lit("").alias("topic"),
        pick(2, {0: F.lit("true")}, F.lit("yes")).alias("following"),
        pick(3, {0: F.lit("week"), 1: F.lit("today")}, F.col("c_mktsegment")).alias("window"),
        pick(4, {0: F.lit("latest")}, F.lit("x")).alias("sort"),
        pick(5, {0: F.lit("paper"), 1: F.lit("Paper")}, F.lit("")).alias("event_type"),
        pick(
            6,
            {0: (key * 10).cast("string"), 1: F.lit("2.0"), 2: F.lit("1.5"), 3: F.lit("-1"), 4: F.lit("abc")},
            key.cast("string"),
        ).alias("page"),
    )
    rows = feed.normalize_requests(requests)
    return rows.select("request_id", "q", F.col("window").alias("win"), "sort", "event_type", "following", "page")


@query(
    "display_labels",
    s.BASE + f""" SELECT cluster_id, upper(substr(replace(event_type, '_', ' '), 1, 1)) || substr(replace(event_type, '_', ' '), 2) AS label,
    CASE WHEN h < 1 THEN 'Just now' WHEN h < 24 THEN h || 'h ago' ELSE (h // 24) || 'd ago' END AS age FROM (
      SELECT *, greatest(0, CAST(floor(date_diff('second', latest_published_at, {s.MID}) / 3600) AS BIGINT)) AS h FROM clusters)""",
)
def display_labels(spark, d):
    t = tb.load(spark, d)
    return t.clusters.select(
        "cluster_id", nm.label("event_type").alias("label"),
        nm.relative_time("latest_published_at", MID).alias("age"),
    )
