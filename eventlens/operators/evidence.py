"""Evidence packs: bounded excerpts, allowed links, limitations, and grounding checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventlens import config
from eventlens.config import DEFAULTS, Settings
from eventlens.functions import digests, urls
from eventlens.functions import text as tx

ARTICLE_TYPE = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("url", T.StringType()),
        T.StructField("body", T.StringType()),
        T.StructField("published_at", T.StringType()),
        T.StructField("source_name", T.StringType()),
        T.StructField("source_category", T.StringType()),
    ]
)
EVIDENCE_TYPE = T.StructType(
    [
        T.StructField("cluster_article_count", T.LongType()),
        T.StructField("articles", T.ArrayType(ARTICLE_TYPE)),
        T.StructField("allowed_links", T.ArrayType(T.StringType())),
        T.StructField("limitations", T.ArrayType(T.StringType())),
    ]
)
# Notes on what an evidence pack lacks.
SHORT_NOTE = " has limited source text."
TRUNCATED_NOTE = (
    " is a truncated excerpt; omitted sections may contain additional evidence. "
    "Claims about missing details apply only to this excerpt."
)
SINGLE_NOTE = "One distinct article; independent corroboration is unavailable."
SELECTED_NOTE = "Only the primary article and three selected supporting articles are included."


def evidence_rows(
    clusters: DataFrame, members: DataFrame, articles: DataFrame, sources: DataFrame
) -> DataFrame:
    """Narrow join of memberships, articles and each article's own source."""
    keys = articles.select(
        "article_id", "source_id", "canonical_url", tx.word_count("body").alias("words")
    )
    owners = sources.select(
        "source_id",
        "authority_score",
        F.col("name").alias("source_name"),
        F.col("category").alias("source_category"),
    )
    return (
        members.select("cluster_id", "article_id")
        .join(clusters.select("cluster_id", "primary_article_id"), "cluster_id")
        .join(keys, "article_id")
        .join(owners, "source_id")
    )


def evidence_top(rows: DataFrame, k: int = config.EVIDENCE_ARTICLES) -> DataFrame:
    """Primary first, then authority, length and link; ``k`` rows per event."""
    order = Window.partitionBy("cluster_id").orderBy(
        (F.col("article_id") != F.col("primary_article_id")).asc(),
        F.desc("authority_score"),
        F.least("words", F.lit(config.QUALITY_WORD_CAP)).desc(),
        F.asc("canonical_url"),
    )
    return rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def extract_links(canonical: Column, excerpt: Column) -> Column:
    """Sorted distinct paper and code links of an article: its own and those in the excerpt."""
    found = F.regexp_extract_all(excerpt, F.lit(r"""https?://[^\s<>"\]]+"""), F.lit(0))
    raw = F.concat(F.array(canonical), found)
    spelled = F.transform(raw, lambda u: urls.canonical_url(F.rtrim(u, F.lit(".,;:)"))))
    kept = F.filter(spelled, lambda u: F.coalesce(urls.is_evidence_link(u), F.lit(False)))
    return F.array_sort(F.array_distinct(kept))


def build_evidence(
    clusters: DataFrame, members: DataFrame, articles: DataFrame, sources: DataFrame
) -> DataFrame:
    """One pack per event.

    Ranking runs on narrow rows; full texts are read again only for the at most four
    articles chosen per event, and are cut to the excerpt before they are shuffled.
    """
    rows = evidence_rows(clusters, members, articles, sources)
    counts = rows.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("cluster_article_count"))
    chosen = evidence_top(rows).select(
        "cluster_id", "article_id", "place", "source_name", "source_category"
    )
    texts = articles.select(
        "article_id", "title", "canonical_url", "published_at", tx.excerpt("body").alias("excerpt")
    )
    entry = chosen.join(texts, "article_id").select(
        "cluster_id",
        F.struct(
            "place",
            F.col("article_id").cast("string").alias("id"),
            "title",
            F.col("canonical_url").alias("url"),
            F.col("excerpt.text").alias("body"),
            _iso("published_at").alias("published_at"),
            "source_name",
            "source_category",
            F.col("excerpt.short").alias("short"),
            F.col("excerpt.truncated").alias("truncated"),
            extract_links(F.col("canonical_url"), F.col("excerpt.text")).alias("links"),
        ).alias("entry"),
    )
    packed = entry.groupBy("cluster_id").agg(
        F.array_sort(F.collect_list("entry")).alias("entries")
    )
    many = F.col("cluster_article_count")
    per_article = F.flatten(
        F.transform(
            "entries",
            lambda e: F.array_compact(
                F.array(
                    F.when(e["short"], F.concat(F.lit("Article "), e["id"], F.lit(SHORT_NOTE))),
                    F.when(
                        e["truncated"], F.concat(F.lit("Article "), e["id"], F.lit(TRUNCATED_NOTE))
                    ),
                )
            ),
        )
    )
    general = F.array_compact(
        F.array(F.when(many == 1, SINGLE_NOTE), F.when(many > config.EVIDENCE_ARTICLES, SELECTED_NOTE))
    )
    links = F.array_sort(F.array_distinct(F.flatten(F.transform("entries", lambda e: e["links"]))))
    articles_out = F.transform(
        "entries", lambda e: e.dropFields("place", "short", "truncated", "links")
    )
    words = F.aggregate(
        "entries", F.lit(0), lambda acc, e: acc + tx.word_count(e["body"])
    )
    return packed.join(counts, "cluster_id").select(
        "cluster_id",
        "cluster_article_count",
        articles_out.alias("articles"),
        links.alias("allowed_links"),
        F.concat(per_article, general).alias("limitations"),
        words.alias("evidence_words"),
        (words >= config.MIN_EVIDENCE_WORDS).alias("enough"),
    )


def _iso(name: str) -> Column:
    stamp = F.col(name)
    text = F.date_format(stamp, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.pmod(F.unix_micros(stamp), F.lit(1_000_000))
    fraction = F.when(micros > 0, F.concat(F.lit("."), F.lpad(micros.cast("string"), 6, "0")))
    return F.concat(text, F.coalesce(fraction, F.lit("")), F.lit("+00:00"))


def evidence_struct() -> Column:
    return F.struct("cluster_article_count", "articles", "allowed_links", "limitations")


def input_hash(packs: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Fingerprint of evidence, models, prompt versions and token limits."""
    fields = {
        "analysis_max_tokens": settings.analysis_max_tokens,
        "analysis_model": settings.analysis_model,
        "analysis_prompt": config.ANALYSIS_PROMPT_VERSION,
        "summary_max_tokens": settings.summary_max_tokens,
        "summary_model": settings.summary_model,
        "summary_prompt": config.SUMMARY_PROMPT_VERSION,
    }
    value = F.struct(
        evidence_struct().alias("evidence"), *[F.lit(v).alias(k) for k, v in fields.items()]
    )
    kind = T.StructType(
        [T.StructField("evidence", EVIDENCE_TYPE)]
        + [
            T.StructField(k, T.LongType() if isinstance(v, int) else T.StringType())
            for k, v in fields.items()
        ]
    )
    return packs.withColumn("input_hash", digests.digest(value, kind))


def links_grounded(cited: Column, allowed: Column) -> Column:
    """Whether every cited link, canonicalized, is allowed; an unusable link is not."""
    spelled = F.transform(cited, urls.canonical_url)
    return ~F.exists(spelled, lambda u: u.isNull()) & (F.size(F.array_except(spelled, allowed)) == 0)


def validate_links(outputs: DataFrame, packs: DataFrame) -> DataFrame:
    """Join outputs ``(cluster_id, cited)`` with their packs and add ``grounded``."""
    allowed = packs.select("cluster_id", "allowed_links")
    return outputs.join(allowed, "cluster_id", "left").withColumn(
        "grounded",
        links_grounded(
            F.col("cited"), F.coalesce("allowed_links", F.array().cast("array<string>"))
        ),
    )
