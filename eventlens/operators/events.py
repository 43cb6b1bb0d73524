"""Event clusters as tables: authority, representatives, refresh, invalidation, pending work."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventlens import config
from eventlens.functions import text as tx

ANALYSIS_COLUMNS = {
    "summary": "string",
    "analysis": None,
    "analysis_input_hash": "string",
    "significance_score": "int",
    "event_type": "string",
    "analysis_error": "string",
    "analyzed_at": "timestamp",
}


def event_time() -> Column:
    return F.coalesce(F.col("published_at"), F.col("fetched_at"))


def source_authority(observations: DataFrame, sources: DataFrame) -> DataFrame:
    """Highest authority among the sources that observed an article.

    Observations are first reduced to one row per article and source, map side, so an
    article seen a billion times still ships one row per task and source.
    """
    pairs = observations.groupBy("article_id", "source_id").agg(F.count(F.lit(1)).alias("_n"))
    return (
        pairs.join(sources.select("source_id", "authority_score"), "source_id")
        .groupBy("article_id")
        .agg(F.max("authority_score").alias("authority"))
    )


def article_quality(articles: DataFrame, authority: DataFrame) -> DataFrame:
    """Narrow table of the three keys that choose a representative."""
    texts = articles.select(
        "article_id", "title", "canonical_url", event_time().alias("event_time"), "body"
    )
    return (
        texts
        .withColumn("words", tx.word_count("body"))
        .drop("body")
        .join(authority, "article_id", "left")
        .withColumn("authority", F.coalesce("authority", F.lit(1)))
    )


def quality_key() -> Column:
    return F.struct(
        F.col("authority"),
        F.least("words", F.lit(config.QUALITY_WORD_CAP)).alias("words"),
        F.col("canonical_url"),
    )


def refresh_clusters(
    members: DataFrame, articles: DataFrame, authority: DataFrame
) -> DataFrame:
    """Size, latest event time, representative and topic of every cluster."""
    best = F.max_by(F.struct("article_id", "title"), quality_key())
    return (
        members.select("cluster_id", "article_id")
        .join(article_quality(articles, authority), "article_id")
        .groupBy("cluster_id")
        .agg(
            F.count(F.lit(1)).alias("cluster_size"),
            F.max("event_time").alias("latest_published_at"),
            best.alias("_best"),
        )
        .select(
            "cluster_id",
            F.col("_best.title").alias("topic"),
            F.col("_best.article_id").alias("primary_article_id"),
            "cluster_size",
            "latest_published_at",
        )
    )


def representatives(members: DataFrame, articles: DataFrame, authority: DataFrame) -> DataFrame:
    """The chosen article of every cluster with the keys that chose it."""
    chosen = F.max_by(
        F.struct("article_id", "authority", "words", "canonical_url"), quality_key()
    )
    return (
        members.select("cluster_id", "article_id")
        .join(article_quality(articles, authority), "article_id")
        .groupBy("cluster_id")
        .agg(chosen.alias("_best"))
        .select("cluster_id", "_best.*")
    )


def mark_primary(members: DataFrame, clusters: DataFrame) -> DataFrame:
    """Memberships with ``is_primary`` set for exactly the representative."""
    primary = clusters.select("cluster_id", "primary_article_id")
    return members.drop("is_primary").join(primary, "cluster_id").select(
        *[c for c in members.columns if c != "is_primary"],
        (F.col("article_id") == F.col("primary_article_id")).alias("is_primary"),
    )


def unclustered(articles: DataFrame, members: DataFrame) -> DataFrame:
    """Embedded articles that are in no cluster yet."""
    pending = articles.where(F.col("embedding").isNotNull()) if "embedding" in articles.columns else articles
    return pending.join(members.select("article_id"), "article_id", "left_anti")


def unembedded(articles: DataFrame) -> DataFrame:
    """Articles whose vector is still missing."""
    return articles.where(F.col("embedding").isNull())


def invalidate(clusters: DataFrame, changed: DataFrame) -> DataFrame:
    """Clear everything derived by analysis for clusters listed in ``changed``."""
    flagged = changed.select("cluster_id").distinct().withColumn("_changed", F.lit(True))
    joined = clusters.join(flagged, "cluster_id", "left")
    hit = F.coalesce(F.col("_changed"), F.lit(False))
    columns = []
    for field in clusters.schema.fields:
        column = F.col(field.name)
        if field.name in ANALYSIS_COLUMNS:
            column = F.when(~hit, column)
        elif field.name == "analysis_status":
            column = F.when(hit, F.lit("pending")).otherwise(column)
        columns.append(column.alias(field.name))
    return joined.select(*columns)
