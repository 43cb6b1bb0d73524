"""Who covered an event: one row per observation, and bounded per-event tops."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventlens import config


def coverage(
    members: DataFrame, articles: DataFrame, observations: DataFrame, sources: DataFrame
) -> DataFrame:
    """Rows of memberships, articles, observations and sources. Never nested into one value,
    since an event may be observed any number of times."""
    return (
        members.select("cluster_id", "article_id")
        .join(articles.select("article_id", "title"), "article_id")
        .join(
            observations.select("observation_id", "article_id", "source_id", "url", "metadata"),
            "article_id",
        )
        .join(
            sources.select(
                "source_id", F.col("name").alias("source"), "category", "authority_score"
            ),
            "source_id",
        )
        .select(
            "cluster_id",
            "article_id",
            "observation_id",
            "title",
            "source",
            F.col("category").alias("source_category"),
            "authority_score",
            "url",
            F.col("metadata").alias("signals"),
        )
    )


def coverage_order():
    return [F.desc("authority_score"), F.asc("source"), F.asc("article_id"), F.asc("observation_id")]


def coverage_top(rows: DataFrame, k: int = config.COVERAGE_LIMIT) -> DataFrame:
    """The first ``k`` rows of every event. Each task keeps ``k`` per event before the shuffle."""
    order = Window.partitionBy("cluster_id").orderBy(*coverage_order())
    return rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def public_coverage(rows: DataFrame, k: int = config.COVERAGE_LIMIT) -> DataFrame:
    """At most ``k`` public entries per event as one ordered list."""
    entry = F.struct("place", "title", "source", "url")
    return (
        coverage_top(rows, k)
        .groupBy("cluster_id")
        .agg(F.array_sort(F.collect_list(entry)).alias("coverage"))
        .select(
            "cluster_id",
            F.transform("coverage", lambda c: c.dropFields("place")).alias("coverage"),
            F.lit(k).alias("coverage_limit"),
        )
    )
