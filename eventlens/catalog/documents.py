"""URL, text, duplicate, vector, ingest and evidence queries."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from eventlens.catalog import big, listed, query, stamp
from eventlens.catalog import sql as s
from eventlens.config import DEFAULTS
from eventlens.functions import simhash, urls, vectors
from eventlens.functions import text as tx
from eventlens.operators import admission, assignment, events, evidence, identity, near_dup
from eventlens.operators import quality, resolve, similarity
from eventlens.plans import ingest
from eventlens.plans import tables as tb
from eventlens.sources import batches, discussions, feeds, pages, registry

MID = "2024-01-20 12:00:00"

# The test URLs need lower casing, tracking and fragment removal, sorting and a path.
_CANONICAL = """regexp_replace(regexp_replace(regexp_replace(url, '#.*$', ''), 'utm_source=[^&]*&?', ''), '[?&]$', '')"""
_HOST = "regexp_extract(url, '^https?://([^/?#]+)', 1)"


@query(
    "canonical_url_groups",
    f"""SELECT canonical_url, sha256(canonical_url) AS url_hash, count(*) AS copies, min(page_id) AS first_id
    FROM (SELECT page_id, {_CANONICAL} AS canonical_url FROM pages) GROUP BY canonical_url""",
)
def canonical_url_groups(spark, d):
    rows = tb.read(spark, d, "pages").select("page_id", urls.canonical_url("url").alias("canonical_url"))
    return rows.groupBy("canonical_url").agg(
        urls.hash_of(F.col("canonical_url")).alias("url_hash"),
        F.count(F.lit(1)).alias("copies"),
        F.min("page_id").alias("first_id"),
    )


@query(
    "publisher_hosts",
    f"""SELECT publisher, count(*) AS pages, count(safe) AS safe_links FROM (
      SELECT regexp_replace({_HOST}, '^www\\.', '') AS publisher,
             CASE WHEN url LIKE 'http%' THEN url END AS safe FROM pages) GROUP BY publisher""",
)
def publisher_hosts(spark, d):
    rows = tb.read(spark, d, "pages").select(
        urls.publisher("url", "page_id").alias("publisher"), urls.safe_url("url").alias("safe")
    )
    return rows.groupBy("publisher").agg(
        F.count(F.lit(1)).alias("pages"), F.count("safe").alias("safe_links")
    )


_VISIBLE = r"""regexp_replace(regexp_replace(html, '(?is)<(script|style)\b[^>]*>.*?</(script|style)\s*>|<!--.*?-->', '', 'g'), '<[^>]*>', ' ', 'g')"""
_UNESCAPED = "replace(replace(replace(replace(replace(replace(replace({0}, '&copy;', '©'), '&middot;', '·'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&amp;', '&')"
_SQUEEZED = r"trim(regexp_replace({0}, '\s+', ' ', 'g'))"


@query(
    "page_text",
    f"SELECT page_id, {_SQUEEZED.format(_UNESCAPED.format(_VISIBLE))} AS text FROM pages",
)
def page_text(spark, d):
    return pages.page_text(tb.read(spark, d, "pages"))


@query(
    "main_text",
    r"""WITH blocks AS (
      SELECT page_id, unnest(b) AS block, generate_subscripts(b, 1) AS place FROM (
        SELECT page_id, regexp_split_to_array(
          regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', ' ', 'g'),
            '(?is)<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>|<table\b[^>]*>.*?</table\s*>|<nav\b[^>]*>.*?</nav\s*>|<footer\b[^>]*>.*?</footer\s*>|<aside\b[^>]*>.*?</aside\s*>|<form\b[^>]*>.*?</form\s*>|<head\b[^>]*>.*?</head\s*>|<svg\b[^>]*>.*?</svg\s*>|<noscript\b[^>]*>.*?</noscript\s*>|<template\b[^>]*>.*?</template\s*>',
            chr(10) || '<p>', 'g'),
          '(?i)</?(?:p|div|article|section|main|header|footer|nav|aside|ul|ol|li|h[1-6]|blockquote|pre|figure|figcaption|form|title|body|head|html|br|hr|dl|dt|dd)\b[^>]*>') AS b
        FROM pages)),
    scored AS (
      SELECT page_id, place, trim(regexp_replace(regexp_replace(block, '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS text,
        len(regexp_extract_all(regexp_replace(array_to_string(regexp_extract_all(block, '(?is)<a\b[^>]*>(.*?)</a\s*>', 1), ' '), '<[^>]*>', ' ', 'g'), '\S+')) AS linked
      FROM blocks),
    counted AS (SELECT *, len(regexp_extract_all(text, '\S+')) AS words FROM scored)
    SELECT p.page_id, coalesce(string_agg(c.text, chr(10) ORDER BY c.place), '') AS main_text
    FROM pages p LEFT JOIN counted c ON c.page_id = p.page_id AND c.words >= 12 AND c.linked <= c.words * 0.3
    GROUP BY p.page_id""",
)
def main_text(spark, d):
    rows = pages.extract_main_text(tb.read(spark, d, "pages"))
    return rows.select("page_id", F.col("text").alias("main_text"))


@query(
    "exact_duplicates",
    """SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS first_id FROM documents
    QUALIFY doc_id <> first_id""",
)
def exact_duplicates(spark, d):
    rows = tb.members(spark, d).where(F.col("article_id") != F.col("cluster_id"))
    return rows.select(F.col("article_id").alias("doc_id"), F.col("cluster_id").alias("first_id"))


@query(
    "first_per_url",
    f"""SELECT canonical_url, arg_min(page_id, page_id) AS page_id, count(*) AS copies
    FROM (SELECT page_id, {_CANONICAL} AS canonical_url FROM pages) GROUP BY canonical_url""",
)
def first_per_url(spark, d):
    rows = tb.read(spark, d, "pages").select("page_id", urls.canonical_url("url").alias("canonical_url"))
    return feeds.first_by_url(rows, "canonical_url", "page_id")


_WORDS = r"""regexp_extract_all(translate(replace(lower(text), 'ß', 'ss'), 'ςſµ', 'σsμ'), '[\p{L}\p{N}_]+')"""


@query(
    "word_statistics",
    f"SELECT doc_id, len({_WORDS}) AS words, len(regexp_extract_all(text, '\\S+')) AS tokens FROM documents",
)
def word_statistics(spark, d):
    return tb.read(spark, d, "documents").select(
        "doc_id",
        F.size(tx.words("text")).cast("bigint").alias("words"),
        tx.word_count("text").cast("bigint").alias("tokens"),
    )


_PRINTS = f"""
split AS (SELECT doc_id, {_WORDS} AS w FROM documents),
grams AS (SELECT doc_id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i+1] || ' ' || w[i+2])) AS g
          FROM split WHERE len(w) >= 80),
hashed AS (SELECT doc_id, ('0x' || substr(md5(g), 1, 16))::UBIGINT AS h FROM grams),
bits AS (SELECT unnest(range(0, 64)) AS b),
votes AS (SELECT doc_id, b, sum(CASE WHEN (h >> b) & 1 = 1 THEN 1 ELSE -1 END) AS v
          FROM hashed, bits GROUP BY doc_id, b),
prints AS (SELECT doc_id, CAST(sum(CASE WHEN v > 0 THEN CAST(pow(2, b) AS HUGEINT) ELSE 0 END) AS UBIGINT) AS fp
           FROM votes GROUP BY doc_id)"""


@query(
    "simhash_fingerprints",
    f"WITH {_PRINTS} SELECT doc_id, lower(lpad(hex(fp), 16, '0')) AS fingerprint FROM prints",
)
def simhash_fingerprints(spark, d):
    rows = simhash.fingerprints(tb.read(spark, d, "documents"), "doc_id", "text", hash_name="md5")
    return rows.select("doc_id", simhash.to_hex("fingerprint").alias("fingerprint"))


@query("simhash_stored_format")
def simhash_stored_format(spark, d):
    rows = simhash.fingerprints(tb.read(spark, d, "documents"), "doc_id", "text", hash_name="blake2b")
    return rows.select("doc_id", simhash.to_hex("fingerprint").alias("content_hash"))


def _printed(spark, d, hash_name="md5"):
    printed = simhash.with_fingerprint(tb.articles(spark, d), "body", hash_name=hash_name)
    return printed.select(
        "article_id", "published_at", "fetched_at", tx.word_count("body").alias("words"), "fingerprint"
    ).where(F.col("fingerprint").isNotNull())


@query(
    "near_duplicate_pairs",
    s.prelude(s.ARTICLES, _PRINTS) + """, rows AS (
      SELECT article_id, fp, words, published_at, fetched_at FROM articles JOIN prints ON doc_id = article_id),
    found AS (
      SELECT x.article_id, arg_min(y.article_id, (y.fetched_at, y.article_id)) AS match_id
      FROM rows x JOIN rows y ON bit_count(xor(x.fp, y.fp)) <= 3
        AND x.words / greatest(1, y.words) BETWEEN 0.8 AND 1.25
        AND abs(date_diff('second', x.published_at, y.published_at)) <= 7 * 86400
        AND (y.fetched_at, y.article_id) < (x.fetched_at, x.article_id)
      GROUP BY x.article_id)
    SELECT r.article_id, f.match_id FROM rows r LEFT JOIN found f USING (article_id)""",
)
def near_duplicate_pairs(spark, d):
    rows = _printed(spark, d).withColumn("event_time", F.col("published_at"))
    return near_dup.near_duplicates(rows)


@query(
    "unit_vectors",
    """SELECT vec_id, round(sqrt(list_dot_product(u, u)), 4) AS length, round(u[1], 5) AS first FROM (
      SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE) / sqrt(list_dot_product(embedding, embedding))) AS u
      FROM embeddings)""",
)
def unit_vectors(spark, d):
    rows = tb.read(spark, d, "embeddings")
    unit = rows.select("vec_id", vectors.unit_vector("embedding", 64).alias("u")).where(F.col("u").isNotNull())
    return unit.select(
        "vec_id", F.round(vectors.norm("u"), 4).alias("length"), F.round(F.get("u", F.lit(0)).cast("double"), 5).alias("first")
    )


@query(
    "similar_pairs_window",
    """WITH v AS (SELECT vec_id, vec_id % 720 AS h, embedding::DOUBLE[] AS e FROM embeddings)
    SELECT a.vec_id, arg_max(b.vec_id, (round(list_cosine_similarity(a.e, b.e), 9), b.vec_id)) AS match_id,
      round(max(list_cosine_similarity(a.e, b.e)) + 1e-8, 4) AS similarity
    FROM v a JOIN v b ON abs(a.h - b.h) <= 72 AND b.vec_id < a.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.3
    GROUP BY a.vec_id""",
)
def similar_pairs_window(spark, d):
    rows = tb.read(spark, d, "embeddings").select(
        F.col("vec_id").alias("id"),
        (F.col("vec_id") % 720 * 3_600_000_000).alias("at"),
        F.col("vec_id").alias("rank"),
        F.col("embedding").alias("vector"),
    )
    best = similarity.best_matches(rows, 0.3, 72)
    return best.select(
        F.col("left_id").alias("vec_id"), F.col("right_id").alias("match_id"),
        F.round(F.col("similarity") + 1e-8, 4).alias("similarity"),
    )


def _embedded(spark, d):
    rows = vectors.embed(tb.articles(spark, d)).where(F.col("embedding").isNotNull())
    authority = events.source_authority(tb.observations(spark, d), tb.sources(spark, d))
    return (
        rows.select("article_id", "published_at", "fetched_at", "canonical_url", "embedding",
                    tx.word_count("body").alias("words"))
        .join(authority, "article_id", "left")
        .withColumn("authority", F.coalesce("authority", F.lit(1)))
    )


@query("event_clusters")
def event_clusters(spark, d):
    return assignment.assign_events(_embedded(spark, d))


# Candidates in processing order; one that meets a near-equal text whose candidate made an article
# joins the earliest such article. Only candidates with an earlier near-equal text are walked.
_REPLAYED = s.prelude(s.SOURCES, s.ARTICLES, _PRINTS).replace("WITH", "WITH RECURSIVE", 1) + """,
    placed AS (
      SELECT a.*, fp, row_number() OVER (ORDER BY authority_score DESC, name, article_id) AS pos
      FROM articles a JOIN sources USING (source_id) LEFT JOIN prints ON doc_id = article_id),
    near AS (
      SELECT x.pos, list(y.pos ORDER BY y.pos) AS earlier FROM placed x JOIN placed y
        ON y.pos < x.pos AND bit_count(xor(x.fp, y.fp)) <= 3
        AND x.words / greatest(1, y.words) BETWEEN 0.8 AND 1.25
        AND abs(date_diff('second', x.published_at, y.published_at)) <= 7 * 86400
      GROUP BY x.pos),
    steps AS (SELECT *, row_number() OVER (ORDER BY pos) AS step FROM near),
    walk AS (
      SELECT CAST(0 AS BIGINT) AS step, CAST([] AS BIGINT[]) AS joined
      UNION ALL
      SELECT s.step, CASE WHEN list_has_all(w.joined, s.earlier) THEN w.joined ELSE list_append(w.joined, s.pos) END
      FROM walk w JOIN steps s ON s.step = w.step + 1),
    met AS (
      SELECT pos, list_filter(earlier, lambda x: NOT list_contains(w.joined, x))[1] AS first
      FROM steps, (SELECT joined FROM walk ORDER BY step DESC LIMIT 1) w)
    SELECT p.source_id, CAST(p.article_id AS VARCHAR) AS external_id,
      substr(sha256(coalesce(f.source_id, p.source_id) || '|' || coalesce(f.article_id, p.article_id)), 1, 32) AS article_id,
      f.pos IS NULL AS created
    FROM placed p LEFT JOIN met USING (pos) LEFT JOIN placed f ON f.pos = met.first"""


@query("replayed_articles", _REPLAYED)
def replayed_articles(spark, d):
    """Every document as a candidate of its source, resolved in one batch."""
    docs = tb.articles(spark, d).select(
        "source_id",
        F.col("canonical_url").alias("url"),
        F.col("article_id").cast("string").alias("external_id"),
        "title",
        "body",
        F.lit("feed_full").alias("body_kind"),
        F.lit(None).cast("string").alias("author"),
        "published_at",
        F.to_variant_object(F.struct("article_id")).alias("metadata"),
        F.col("article_id").alias("position"),
    )
    article, seen = resolve.empty_state(spark)
    settings = replace(DEFAULTS, simhash_hash="md5")  # a hash that the checking SQL has too
    done = resolve.resolve_articles(docs, tb.sources(spark, d), article, seen, tb.AS_OF, settings)
    return done.outcomes.select("source_id", "external_id", "article_id", "created")


@query(
    "unclustered_articles",
    s.prelude(s.ARTICLES, s.MEMBERS) + """ SELECT article_id FROM articles
    WHERE article_id NOT IN (SELECT article_id FROM members WHERE cluster_id % 3 <> 0)""",
)
def unclustered_articles(spark, d):
    member = tb.members(spark, d).where(F.col("cluster_id") % 3 != 0)
    return events.unclustered(tb.articles(spark, d), member).select("article_id")


@query(
    "invariant_violations",
    s.prelude(s.MEMBERS) + """, skewed AS (
      SELECT cluster_id, article_id FROM members
      UNION ALL SELECT cluster_id + 1, article_id FROM members WHERE article_id % 50 = 0)
    SELECT 'article_in_one_cluster' AS rule, CAST(article_id AS VARCHAR) AS key FROM skewed
    GROUP BY article_id HAVING count(*) > 1""",
)
def invariant_violations(spark, d):
    member = tb.members(spark, d)
    extra = member.where(F.col("article_id") % 50 == 0).withColumn("cluster_id", F.col("cluster_id") + 1)
    return quality.violations(member.unionByName(extra))


@query(
    "consistent_tables",
    "SELECT '' AS rule, '' AS key WHERE false",
)
def consistent_tables(spark, d):
    t = tb.load(spark, d)
    return quality.violations(events.mark_primary(t.members, t.clusters), t.clusters, t.articles)


@query(
    "inventory",
    s.prelude(s.MEMBERS) + """ SELECT 'articles' AS "table", count(*) AS rows FROM documents
    UNION ALL SELECT 'memberships', count(*) FROM members UNION ALL SELECT 'observations', count(*) FROM events
    UNION ALL SELECT 'vectors', count(*) FROM embeddings""",
)
def inventory(spark, d):
    return quality.inventory(
        {
            "articles": tb.articles(spark, d),
            "memberships": tb.members(spark, d),
            "observations": tb.observations(spark, d),
            "vectors": tb.read(spark, d, "embeddings"),
        }
    )


_SUBJECT = r"""regexp_matches(title || ' ' || body, '(?i)(^|[^\p{L}\p{N}_])(ai|artificial intelligence|machine learning|deep learning|llms?|gpt[\w.-]*|openai|anthropic|claude|gemini|llama|mistral|qwen|deepseek|neural|diffusion|transformers?|pytorch|tensorflow|hugging\s?face|computer vision|reinforcement learning|fine.tun\w*)($|[^\p{L}\p{N}_])')"""
_ADMITTED = f"""admitted AS (
  SELECT a.*, s.ai_filter, CASE
    WHEN published_at < {s.MID} - INTERVAL 7 DAY OR published_at > {s.MID} + INTERVAL 1 HOUR THEN 'outside_window'
    WHEN ai_filter AND NOT {_SUBJECT} THEN 'off_subject' ELSE 'admitted' END AS admission
  FROM articles a JOIN sources s USING (source_id))"""


def _admission(spark, d):
    flags = tb.sources(spark, d).select("source_id", "ai_filter")
    return admission.admission(tb.articles(spark, d).join(flags, "source_id"), MID)


@query(
    "admitted_candidates",
    s.prelude(s.SOURCES, s.ARTICLES, _ADMITTED) + " SELECT article_id, admission FROM admitted",
)
def admitted_candidates(spark, d):
    return _admission(spark, d).select("article_id", "admission")


@query(
    "run_metrics",
    s.prelude(s.SOURCES, s.ARTICLES, _ADMITTED, s.MEMBERS) + """ SELECT count(*) AS fetched,
      count(*) FILTER (admission = 'admitted' AND cluster_id = article_id) AS created,
      count(*) FILTER (admission = 'admitted' AND cluster_id <> article_id) AS deduplicated,
      count(*) FILTER (admission <> 'admitted') AS filtered,
      count(*) FILTER (words > 5) AS embedded, count(*) FILTER (words > 9) AS clustered,
      count(*) FILTER (words < 300) AS extraction_fallbacks,
      CASE WHEN (SELECT count(*) FROM articles WHERE article_id % 9 = 0) > 0 THEN 'partial' ELSE 'succeeded' END AS status
    FROM admitted JOIN members USING (article_id)""",
)
def run_metrics(spark, d):
    words = tx.word_count("body")
    rows = _admission(spark, d).join(tb.members(spark, d), "article_id").select(
        "admission",
        (F.col("cluster_id") == F.col("article_id")).alias("created"),
        (words > 5).alias("embedded"),
        (words > 9).alias("clustered"),
        (words < 300).alias("extraction_fallback"),
    )
    errors = tb.read(spark, d, "documents").where(F.col("doc_id") % 9 == 0).select(
        F.col("source").alias("source_id"), F.concat(F.lit("e"), "doc_id").alias("error")
    )
    return admission.run_metrics(rows, errors)


@query(
    "enriched_candidates",
    s.prelude(s.ARTICLES) + """, pairs AS (
      SELECT a.article_id, a.words, p.n AS page_words FROM articles a LEFT JOIN (
        SELECT doc_id + 1 AS doc_id, len(regexp_extract_all(text, '\\S+')) AS n FROM documents WHERE doc_id % 3 = 0) p
      ON p.doc_id = a.article_id)
    SELECT article_id, CASE WHEN words < 300 AND coalesce(page_words, 0) > words THEN 'extracted' ELSE 'feed_summary' END AS body_kind,
      CASE WHEN words < 300 AND coalesce(page_words, 0) > words THEN page_words ELSE words END AS words,
      words < 300 AND coalesce(page_words, 0) <= words AS extraction_fallback FROM pairs""",
)
def enriched_candidates(spark, d):
    article = tb.articles(spark, d).select(
        "article_id", F.col("article_id").alias("url"), "body",
        F.lit("feed_summary").alias("body_kind"), F.lit("rss").alias("type"),
    )
    found = tb.read(spark, d, "documents").where(F.col("doc_id") % 3 == 0).select(
        (F.col("doc_id") + 1).alias("url"), "text"
    )
    rows = admission.enrich(article, found)
    return rows.select("article_id", "body_kind", tx.word_count("body").cast("bigint").alias("words"), "extraction_fallback")


@query(
    "first_n_per_source",
    """SELECT source, doc_id FROM documents
    QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) <= 10""",
)
def first_n_per_source(spark, d):
    rows = tb.read(spark, d, "documents").select("source", "doc_id")
    return feeds.first_per_source(rows, 10, "source", "doc_id")


@query(
    "active_source_order",
    s.prelude(s.SOURCES) + " SELECT source_id, CAST(authority_score AS BIGINT) AS authority_score FROM sources WHERE is_active",
)
def active_source_order(spark, d):
    return registry.active_sources(tb.sources(spark, d)).select("source_id", *big("authority_score"))


@query(
    "seeded_sources",
    """WITH known AS (SELECT DISTINCT source AS url FROM documents WHERE doc_id % 7 = 0),
    incoming AS (SELECT DISTINCT source AS url FROM documents)
    SELECT url, url NOT IN (SELECT url FROM known) AS is_active FROM incoming""",
)
def seeded_sources(spark, d):
    docs = tb.read(spark, d, "documents").select("doc_id", F.col("source").alias("url"))
    existing = docs.where(F.col("doc_id") % 7 == 0).select("url").distinct().withColumn("is_active", F.lit(False))
    incoming = docs.select("url").distinct().withColumn("is_active", F.lit(True))
    return registry.seed_sources(existing, incoming).select("url", "is_active")


@query(
    "source_report",
    """SELECT source, CASE WHEN n % 6 = 0 THEN 'failed' ELSE 'ok' END AS status,
      CASE WHEN n % 6 <> 0 THEN items END AS items, CASE WHEN n % 6 = 0 THEN 'timeout' END AS error FROM (
      SELECT source, CAST(regexp_extract(source, '(\\d+)', 1) AS INTEGER) AS n, count(*) AS items FROM documents GROUP BY source)""",
)
def source_report(spark, d):
    n = F.regexp_extract("source_id", r"(\d+)", 1).cast("int")
    known = tb.sources(spark, d)
    outcomes = known.select(
        "source_id", F.when(n % 6 == 0, "timeout").alias("error"), F.array().cast("array<string>").alias("warnings")
    )
    return batches.source_report(known, tb.articles(spark, d), outcomes).select("source", "status", "items", "error")


@query(
    "source_health",
    s.prelude(s.SOURCES) + """ SELECT source_id, name, type, CASE WHEN authority_score > 5 THEN 'api' END AS fetch_mode,
      CAST(NULL AS VARCHAR) AS scope_note, is_active FROM sources""",
)
def source_health(spark, d):
    mode = F.to_json(F.struct(F.when(F.col("authority_score") > 5, "api").alias("fetch_mode")))
    rows = registry.source_health(tb.sources(spark, d).withColumn("config", F.try_parse_json(mode)))
    return rows.select("source_id", "name", "type", "fetch_mode", "scope_note", "is_active")


@query(
    "source_fallback",
    """WITH n AS (SELECT doc_id, source, CAST(regexp_extract(source, '(\\d+)', 1) AS INTEGER) % 5 AS k FROM documents)
    SELECT doc_id, CASE WHEN k IN (0, 1) THEN 'api' ELSE 'rss_fallback' END AS fetch_mode FROM n
    WHERE (k IN (0, 1) AND doc_id % 2 = 0) OR (k IN (2, 3) AND doc_id % 2 = 1)""",
)
def source_fallback(spark, d):
    """Sources answer, answer, fail with 429, time out, or fail for good (404)."""
    docs = tb.read(spark, d, "documents").select(F.col("source").alias("source_id"), "doc_id")
    kind = F.regexp_extract("source_id", r"(\d+)", 1).cast("int") % 5
    codes = F.array(F.lit(200), F.lit(304), F.lit(429), F.lit(None).cast("int"), F.lit(404))
    status = tb.sources(spark, d).select(
        "source_id", F.element_at(codes, kind + 1).alias("http_status"), (kind == 3).alias("timed_out"),
        F.lit(None).cast("int").alias("retry_after_seconds"),
    )
    rows = feeds.with_fallback(docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 = 1"), status)
    return rows.select("doc_id", "fetch_mode")


@query(
    "source_state",
    """WITH errs AS (SELECT source, doc_id, 'e' || doc_id AS error FROM documents WHERE doc_id % 9 = 0 AND source <> 'src1'),
    firsts AS (SELECT source, string_agg(error, '; ' ORDER BY doc_id) AS last_error FROM (
      SELECT * FROM errs QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) <= 10) GROUP BY source)
    SELECT s.source AS source_id, f.last_error, CASE WHEN f.source IS NULL THEN 'new' ELSE 'old' END AS etag, 'api' AS fetch_mode
    FROM (SELECT DISTINCT source FROM documents) s LEFT JOIN firsts f USING (source)""",
)
def source_state(spark, d):
    known = tb.sources(spark, d).select(
        "source_id",
        F.create_map(F.lit("etag"), F.lit("old")).alias("config"),
        F.lit(None).cast("timestamp").alias("last_fetched_at"),
        F.lit(None).cast("string").alias("last_error"),
    )
    states = known.select(
        "source_id", F.create_map(F.lit("etag"), F.lit("new"), F.lit("fetch_mode"), F.lit("api")).alias("state")
    )
    errors = tb.read(spark, d, "documents").where((F.col("doc_id") % 9 == 0) & (F.col("source") != "src1")).select(
        F.col("source").alias("source_id"), F.col("doc_id").alias("position"),
        F.concat(F.lit("e"), "doc_id").alias("error"),
    )
    rows = batches.advance_state(known, states, errors, MID)
    return rows.select(
        "source_id", "last_error", F.col("config")["etag"].alias("etag"), F.col("config")["fetch_mode"].alias("fetch_mode")
    )


def _escaped(column):
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        column = F.replace(column, F.lit(raw), F.lit(safe))
    return column


def _clean_text(column):
    """XML allows no control characters besides tab and line ends."""
    return F.regexp_replace(column, r"[^\x09\x0A\x0D\x20-\x{D7FF}\x{E000}-\x{FFFD}\x{10000}-\x{10FFFF}]", "")


# What a feed reader makes of a whole document: markup stripped, references decoded, blanks collapsed.
_BODY_MD5 = "md5(" + _SQUEEZED.format(
    _UNESCAPED.format(
        r"regexp_replace(regexp_replace(body, '(?is)<(script|style)\b[^>]*>.*?</(script|style)\s*>|<!--.*?-->', ' ', 'g'),"
        r" '<[/!?A-Za-z][^>]*>', ' ', 'g')"
    )
) + ")"


def _payloads(spark, d, kind: str):
    """Feed payloads of at most ten documents each."""
    docs = tb.articles(spark, d).withColumn("payload_id", F.expr("article_id div 10"))
    title = _escaped(F.concat(F.lit("Doc "), "article_id"))
    body = _escaped(_clean_text(F.col("body")))
    if kind == "rss":
        entry = F.concat(
            F.lit("<item><title>"), title, F.lit("</title>"),
            F.when(F.col("article_id") % 8 != 0, F.concat(F.lit("<link>/a/"), "article_id", F.lit("?utm_source=x</link>"))).otherwise(""),
            F.when(F.col("article_id") % 3 == 0, F.concat(F.lit("<guid isPermaLink=\"false\">g"), "article_id", F.lit("</guid>"))).otherwise(""),
            F.lit("<pubDate>"), F.date_format("published_at", "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" GMT</pubDate><description>"),
            body, F.lit("</description><category>"), F.col("source_id"), F.lit("</category></item>"),
        )
        head, tail = "<rss version=\"2.0\"><channel><title>T</title>", "</channel></rss>"
    else:
        entry = F.concat(
            F.lit("<entry><id>http://arxiv.org/abs/"), F.lpad("article_id", 4, "0"), F.lit(".00001v1</id><title> Paper\n "), title,
            F.lit("</title><summary>"), body, F.lit("</summary><author><name>A</name></author><author><name>B</name></author><published>"),
            F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z</published><category term=\"cs.CL\"/></entry>"),
        )
        head, tail = "<feed xmlns=\"http://www.w3.org/2005/Atom\"><title>T</title>", "</feed>"
    ordered = F.array_sort(F.collect_list(F.struct("article_id", entry.alias("x"))))
    packed = docs.groupBy("payload_id").agg(F.array_join(F.transform(ordered, lambda e: e["x"]), "").alias("items"))
    broken = F.when(F.col("payload_id") % 7 == 6, "").otherwise(tail)
    return packed.select(
        F.lit("s").alias("source_id"), "payload_id", F.lit("https://lab.example/feed/x.xml").alias("base_url"),
        F.concat(F.lit(head), "items", broken).alias("payload"),
    )


@query(
    "feed_candidates",
    s.prelude(s.ARTICLES) + r""" SELECT article_id // 10 AS payload_id, CAST(article_id % 10 AS INTEGER) AS position,
      'https://lab.example/a/' || article_id || '?utm_source=x' AS url,
      CASE WHEN article_id % 3 = 0 THEN 'g' || article_id ELSE 'https://lab.example/a/' || article_id || '?utm_source=x' END AS external_id,
      'Doc ' || article_id AS title, 'feed_summary' AS body_kind, """ + _BODY_MD5 + r""" AS body_md5,
      strftime(published_at, '%Y-%m-%d %H:%M:%S.%f') AS published_at
    FROM articles WHERE article_id % 10 < 8 AND article_id % 8 <> 0 AND (article_id // 10) % 7 <> 6""",
)
def feed_candidates(spark, d):
    rows = feeds.parse_feeds(_payloads(spark, d, "rss"), 8)
    return rows.select("payload_id", "position", "url", "external_id", "title", "body_kind", F.md5("body").alias("body_md5"), stamp("published_at"))


@query(
    "rejected_payloads",
    "SELECT DISTINCT doc_id // 10 AS payload_id, 'malformed_xml' AS error FROM documents WHERE (doc_id // 10) % 7 = 6",
)
def rejected_payloads(spark, d):
    return feeds.rejected(_payloads(spark, d, "rss")).select("payload_id", "error")


@query(
    "paper_candidates",
    s.prelude(s.ARTICLES) + r""" SELECT article_id // 10 AS payload_id,
      'http://arxiv.org/abs/' || CASE WHEN article_id < 1000 THEN lpad(CAST(article_id AS VARCHAR), 4, '0') ELSE substr(CAST(article_id AS VARCHAR), 1, 4) END || '.00001v1' AS external_id,
      'Paper Doc ' || article_id AS title, 'A, B' AS author, 'abstract' AS body_kind, """ + _BODY_MD5 + r""" AS body_md5
    FROM articles WHERE (article_id // 10) % 7 <> 6""",
)
def paper_candidates(spark, d):
    rows = feeds.parse_arxiv_atom(_payloads(spark, d, "atom"), 100)
    return rows.select(
        "payload_id", "external_id", "title", "author", "body_kind", F.md5("body").alias("body_md5")
    )


@query(
    "discussion_candidates",
    r"""SELECT CAST(event_id AS VARCHAR) AS external_id,
      CASE WHEN event_id % 4 = 0 THEN 'https://x.example/' || event_id ELSE 'https://news.ycombinator.com/item?id=' || event_id END AS url,
      'GPT-4 and ' || event_type AS title, 'u' || user_id AS author, strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S.%f') AS published_at,
      user_id AS points FROM events WHERE event_id % 5 <> 0 AND event_id % 3 <> 0""",
)
def discussion_candidates(spark, d):
    raw = tb.read(spark, d, "events")
    stamp_s = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000)
    item = F.to_json(
        F.struct(
            F.col("event_id").alias("id"),
            F.when(F.col("event_id") % 5 == 0, "job").otherwise("story").alias("type"),
            F.concat(F.when(F.col("event_id") % 3 == 0, "Cats").otherwise("GPT-4"), F.lit(" and "), "event_type").alias("title"),
            F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("https://x.example/"), "event_id")).alias("url"),
            stamp_s.alias("time"),
            F.col("user_id").alias("score"),
            F.concat(F.lit("u"), "user_id").alias("by"),
        )
    )
    items = raw.select(F.lit("hn").alias("source_id"), F.col("event_id").alias("rank"), item.alias("payload"))
    rows = discussions.normalize_items(items, 2**62)
    return rows.select(
        "external_id", "url", "title", "author", stamp("published_at"),
        F.try_variant_get("metadata", "$.hn_points", "bigint").alias("points"),
    )


@query(
    "excerpts",
    r"""WITH cutted AS (SELECT doc_id, regexp_extract_all(text, '\S+') AS w FROM documents),
    joined AS (SELECT doc_id, len(w) AS n, array_to_string(w[1:1200], ' ') AS j FROM cutted)
    SELECT doc_id, md5(substr(j, 1, 12000)) AS text_md5, n > 1200 OR length(j) > 12000 AS truncated,
      len(regexp_extract_all(substr(j, 1, 12000), '\S+')) < 80 AS short FROM joined""",
)
def excerpts(spark, d):
    rows = tb.read(spark, d, "documents").select("doc_id", tx.excerpt("text").alias("e"))
    return rows.select("doc_id", F.md5("e.text").alias("text_md5"), "e.truncated", "e.short")


_LINKS = r"""list_sort(list_distinct(list_filter(list_transform(
  regexp_extract_all(excerpt, 'https?://[^\s<>"\]]+'), lambda u: regexp_replace(rtrim(u, '.,;:)'), '#.*$', '')),
  lambda u: regexp_matches(u, '^https?://(www\.)?(arxiv\.org|github\.com)/[^/?#]'))))"""


def _linked_articles(spark, d):
    """Articles whose text cites code links, so that grounding has something to find."""
    key = F.col("article_id")
    link = F.concat(F.lit(" see https://github.com/org/repo"), key % 5, F.lit("), and https://other.example/x "))
    return tb.articles(spark, d).withColumn(
        "body", F.when(key % 3 == 0, F.concat(link, "body")).otherwise(F.col("body"))
    )


_EVIDENCE = s.BASE + r""", linked AS (
  SELECT article_id, source_id, canonical_url, title, published_at, CASE WHEN article_id % 3 = 0
    THEN ' see https://github.com/org/repo' || article_id % 5 || '), and https://other.example/x ' || body ELSE body END AS body
  FROM articles),
placed AS (
  SELECT m.cluster_id, l.article_id, l.body, c.cluster_size, l.title, l.canonical_url, l.published_at, s.name, s.category,
    row_number() OVER (PARTITION BY m.cluster_id ORDER BY l.article_id <> c.primary_article_id, s.authority_score DESC,
      least(len(regexp_extract_all(l.body, '\S+')), 3000) DESC, l.canonical_url) AS place
  FROM members m JOIN linked l USING (article_id) JOIN clusters c USING (cluster_id)
  JOIN sources s ON s.source_id = l.source_id),
chosen AS (
  SELECT *, len(regexp_extract_all(body, '\S+')) AS n, substr(array_to_string(regexp_extract_all(body, '\S+')[1:1200], ' '), 1, 12000) AS excerpt,
    length(array_to_string(regexp_extract_all(body, '\S+')[1:1200], ' ')) AS joined
  FROM placed WHERE place <= 4),
packs AS (
  SELECT cluster_id, any_value(cluster_size) AS cluster_article_count,
    string_agg(CAST(article_id AS VARCHAR), '|' ORDER BY place) AS article_ids,
    list_sort(list_distinct(flatten(list(""" + _LINKS + r""")))) AS allowed,
    CAST(sum(len(regexp_extract_all(excerpt, '\S+'))) AS BIGINT) AS evidence_words,
    CAST(count(*) FILTER (len(regexp_extract_all(excerpt, '\S+')) < 80) + count(*) FILTER (n > 1200 OR joined > 12000)
      + CASE WHEN any_value(cluster_size) = 1 OR any_value(cluster_size) > 4 THEN 1 ELSE 0 END AS BIGINT) AS limitation_count
  FROM chosen GROUP BY cluster_id)"""


def _packs(spark, d):
    t = tb.load(spark, d)
    return evidence.build_evidence(t.clusters, t.members, _linked_articles(spark, d), t.sources)


@query(
    "evidence_packs",
    _EVIDENCE + """ SELECT cluster_id, cluster_article_count, article_ids, array_to_string(allowed, '|') AS allowed_links,
    evidence_words, limitation_count, evidence_words >= 40 AS enough FROM packs""",
)
def evidence_packs(spark, d):
    return _packs(spark, d).select(
        "cluster_id", "cluster_article_count",
        listed(F.transform("articles", lambda a: a["id"]), "article_ids"),
        listed("allowed_links", "allowed_links"), *big("evidence_words"),
        F.size("limitations").cast("bigint").alias("limitation_count"), "enough",
    )


@query(
    "grounded_links",
    _EVIDENCE + """ SELECT cluster_id, list_contains(allowed, 'https://github.com/org/repo' || cluster_id % 5) AS grounded FROM packs""",
)
def grounded_links(spark, d):
    packs = _packs(spark, d)
    cited = packs.select(
        "cluster_id",
        F.array(F.concat(F.lit("https://GitHub.com/org/repo"), F.col("cluster_id") % 5, F.lit("?utm_source=model"))).alias("cited"),
    )
    return evidence.validate_links(cited, packs).select("cluster_id", "grounded")


_NOTES = """list_filter([
      CASE WHEN len(regexp_extract_all(excerpt, '\\S+')) < 80 THEN 'Article ' || article_id || ' has limited source text.' END,
      CASE WHEN n > 1200 OR joined > 12000 THEN 'Article ' || article_id || '""" + evidence.TRUNCATED_NOTE + """' END],
      lambda v: v IS NOT NULL)"""


@query(
    "evidence_fingerprints",
    _EVIDENCE + f""", told AS (
      SELECT cluster_id, '[' || string_agg('{{"body":' || CAST(to_json(excerpt) AS VARCHAR) || ',"id":"' || article_id ||
          '","published_at":"' || strftime(published_at, '%Y-%m-%dT%H:%M:%S') || '+00:00","source_category":"' || category ||
          '","source_name":"' || name || '","title":' || CAST(to_json(title) AS VARCHAR) || ',"url":"' || canonical_url || '"}}',
          ',' ORDER BY place) || ']' AS articles,
        list_concat(flatten(list({_NOTES} ORDER BY place)),
          CASE WHEN any_value(cluster_size) = 1 THEN ['{evidence.SINGLE_NOTE}']
               WHEN any_value(cluster_size) > 4 THEN ['{evidence.SELECTED_NOTE}'] ELSE [] END) AS notes
      FROM chosen GROUP BY cluster_id)
    SELECT cluster_id, sha256('{{"analysis_max_tokens":2048,"analysis_model":"deepseek-v4-pro","analysis_prompt":"analysis-v2",' ||
      '"evidence":{{"allowed_links":[' || array_to_string(list_transform(allowed, lambda v: '"' || v || '"'), ',') ||
      '],"articles":' || articles || ',"cluster_article_count":' || cluster_article_count ||
      ',"limitations":[' || array_to_string(list_transform(notes, lambda v: '"' || v || '"'), ',') ||
      ']}},"summary_max_tokens":768,"summary_model":"deepseek-flash","summary_prompt":"summary-v1"}}') AS input_hash
    FROM told JOIN packs USING (cluster_id)""",
)
def evidence_fingerprints(spark, d):
    return evidence.input_hash(_packs(spark, d)).select("cluster_id", "input_hash")


@query(
    "identity_matches",
    s.prelude(s.OBSERVATIONS, s.ARTICLES) + """, stored AS (
      SELECT source_id, external_id, arg_min(article_id, observation_id) AS article_id FROM obs WHERE observation_id % 2 = 0 GROUP BY 1, 2),
    fresh AS (SELECT observation_id, source_id, external_id, article_id AS target FROM obs WHERE observation_id % 2 = 1)
    SELECT f.observation_id, CASE WHEN s.article_id IS NOT NULL THEN 'by_observation' WHEN a.article_id IS NOT NULL THEN 'by_url' END AS matched_by,
      coalesce(s.article_id, a.article_id) AS article_id
    FROM fresh f LEFT JOIN stored s USING (source_id, external_id)
    LEFT JOIN articles a ON a.article_id = f.target AND a.article_id % 2 = 0""",
)
def identity_matches(spark, d):
    seen, article = tb.observations(spark, d), tb.articles(spark, d)
    hashed = article.where(F.col("article_id") % 2 == 0).select("article_id", urls.hash_of("canonical_url").alias("url_hash"))
    where = article.select(F.col("article_id").alias("target"), urls.hash_of("canonical_url").alias("url_hash"))
    old = seen.where(F.col("observation_id") % 2 == 0)
    stored = old.groupBy("source_id", "external_id").agg(F.min_by("article_id", "observation_id").alias("article_id"))
    fresh = seen.where(F.col("observation_id") % 2 == 1).select(
        "observation_id", "source_id", "external_id", F.col("article_id").alias("target")
    ).join(where, "target")
    matched = identity.match_url(identity.match_observation(fresh, stored), hashed)
    return identity.resolve_identity(matched).select("observation_id", "matched_by", "article_id")


@query(
    "alias_matches",
    s.prelude(s.ARTICLES, s.OBSERVATIONS) + """, aliases AS (
      SELECT external_id, arg_min(article_id, (fetched_at, article_id)) AS first FROM obs JOIN articles USING (article_id) GROUP BY external_id)
    SELECT observation_id, first AS by_alias FROM obs JOIN aliases USING (external_id)""",
)
def alias_matches(spark, d):
    seen = tb.observations(spark, d).withColumn("url_hash", urls.hash_of("external_id"))
    rows = identity.match_alias(seen.select("observation_id", "url_hash"), seen, tb.articles(spark, d))
    return rows.select("observation_id", "by_alias")


@query(
    "observation_upsert",
    s.prelude(s.OBSERVATIONS) + """ SELECT source_id, external_id, arg_min(article_id, observation_id) AS article_id,
      arg_min(url, observation_id) AS url, strftime(arg_max(seen_at, observation_id), '%Y-%m-%d %H:%M:%S.%f') AS seen_at,
      arg_max(points, observation_id) AS points FROM obs GROUP BY source_id, external_id""",
)
def observation_upsert(spark, d):
    seen = tb.observations(spark, d).withColumnRenamed("observation_id", "seq")
    rows = identity.upsert_observations(None, seen)
    return rows.select(
        "source_id", "external_id", "article_id", "url", stamp("seen_at"),
        F.try_variant_get("metadata", "$.hn_points", "double").alias("points"),
    )


@query(
    "ingest_counts",
    _REPLAYED.replace("FROM articles a JOIN sources USING (source_id) LEFT", "FROM admitted a JOIN sources USING (source_id) LEFT")
    .replace("placed AS", f"{_ADMITTED}, placed AS", 1).rsplit("SELECT p.source_id", 1)[0].replace(
        "LEFT JOIN prints ON doc_id = article_id)",
        "LEFT JOIN prints ON doc_id = article_id WHERE admission = 'admitted' AND is_active)") + """,
    counted AS (SELECT p.*, met.pos IS NULL AS created FROM placed p LEFT JOIN met USING (pos))
    SELECT (SELECT count(*) FROM admitted JOIN sources USING (source_id) WHERE is_active) AS fetched, count(*) FILTER (created) AS created,
      count(*) FILTER (NOT created) AS deduplicated, (SELECT count(*) FROM admitted JOIN sources USING (source_id) WHERE is_active AND admission <> 'admitted') AS filtered,
      count(*) FILTER (created AND words > 0) AS embedded, count(*) FILTER (created AND words > 0) AS clustered,
      0::BIGINT AS extraction_fallbacks, 'succeeded' AS status FROM counted""",
)
def ingest_counts(spark, d):
    """One whole ingest of the documents as landed candidates."""
    docs = tb.articles(spark, d).select(
        "source_id",
        F.col("canonical_url").alias("url"),
        F.col("article_id").cast("string").alias("external_id"),
        "title",
        "body",
        F.lit("feed_full").alias("body_kind"),
        F.lit(None).cast("string").alias("author"),
        "published_at",
        F.to_variant_object(F.struct("article_id")).alias("metadata"),
        F.col("article_id").alias("position"),
    )
    state = ingest.empty_tables(spark, tb.sources(spark, d))
    settings = replace(DEFAULTS, simhash_hash="md5")  # a hash that the checking SQL has too
    return ingest.run_ingest(state, docs, MID, settings).metrics
