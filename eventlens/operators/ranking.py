"""Explainable ranking of event clusters.

All signals of a cluster are first written as narrow facts ``(cluster, kind, key, value)``.
One aggregation removes repeats per key with map-side combining, a second one sums up per
cluster. A cluster, article or story that holds a large share of all observations therefore
reaches any single task only as a handful of partial rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventlens import config
from eventlens.functions import numbers as nm
from eventlens.functions import urls

SATURATION = float(config.ENGAGEMENT_SATURATION)


def story_id(metadata: Column, external_id: Column) -> Column:
    """Story identity: the item id in the metadata unless it is empty or zero."""
    item = F.try_variant_get(metadata, "$.hn_item_id", "string")
    item = F.when(~item.rlike(r"^(?:|false|[-+]?0+(?:\.0*)?)$"), item)
    return F.when(
        F.coalesce(item, external_id, F.lit("")) != "", F.coalesce(item, external_id)
    )


def counter(metadata: Column, name: str) -> Column:
    value = F.try_variant_get(metadata, f"$.{name}", "variant")
    return F.least(nm.nonnegative(value), F.lit(SATURATION))


def story_observations(observations: DataFrame, sources: DataFrame) -> DataFrame:
    """Latest counters per article and story, from discussion sources only."""
    kinds = sources.where(F.col("type") == "hackernews").select("source_id")
    return (
        observations.join(kinds, "source_id", "left_semi")
        .select(
            "article_id",
            story_id(F.col("metadata"), F.col("external_id").cast("string")).alias("story_id"),
            F.struct(
                F.col("seen_at"),
                F.col("observation_id").cast("string").alias("observation_id"),
                counter(F.col("metadata"), "hn_points").alias("points"),
                counter(F.col("metadata"), "hn_comments").alias("comments"),
            ).alias("latest"),
        )
        .where(F.col("story_id").isNotNull())
        .groupBy("article_id", "story_id")
        .agg(F.max("latest").alias("latest"))
    )


def latest_story(members: DataFrame, observations: DataFrame, sources: DataFrame) -> DataFrame:
    """Latest counters per cluster and story."""
    return (
        story_observations(observations, sources)
        .join(members.select("article_id", "cluster_id"), "article_id")
        .groupBy("cluster_id", "story_id")
        .agg(F.max("latest").alias("latest"))
        .select("cluster_id", "story_id", "latest.*")
    )


def _facts(kind: str, key: Column, latest: Column | None = None) -> list[Column]:
    empty = F.lit(None).cast(
        "struct<seen_at:timestamp,observation_id:string,points:double,comments:double>"
    )
    return [
        F.lit(kind).alias("kind"),
        key.cast("string").alias("key"),
        (empty if latest is None else latest).alias("latest"),
    ]


def signal_facts(
    members: DataFrame, articles: DataFrame, observations: DataFrame, sources: DataFrame
) -> DataFrame:
    """Distinct publishers, categories and stories per cluster, with counts of articles."""
    bridge = members.select("article_id", "cluster_id")
    hosts = (
        bridge.join(articles.select("article_id", "canonical_url", "source_id"), "article_id")
        .select(
            "cluster_id",
            *_facts("publisher", urls.publisher("canonical_url", "source_id")),
            F.lit(1).alias("articles"),
        )
    )
    seen = observations.groupBy("article_id", "source_id").agg(F.count(F.lit(1)).alias("_n"))
    categories = (
        seen.join(sources.select("source_id", "category"), "source_id")
        .where(F.coalesce("category", F.lit("")) != "")
        .select("article_id", *_facts("category", F.col("category")))
    )
    stories = story_observations(observations, sources).select(
        "article_id", *_facts("story", F.col("story_id"), F.col("latest"))
    )
    provenance = (
        categories.unionByName(stories)
        .join(bridge, "article_id")
        .select("cluster_id", "kind", "key", "latest", F.lit(0).alias("articles"))
    )
    return (
        hosts.unionByName(provenance)
        .groupBy("cluster_id", "kind", "key")
        .agg(F.max("latest").alias("latest"), F.sum("articles").alias("articles"))
    )


def ranking_signals(
    members: DataFrame, articles: DataFrame, observations: DataFrame, sources: DataFrame
) -> DataFrame:
    """One row of counts and capped sums per cluster."""
    facts = signal_facts(members, articles, observations, sources)
    is_kind = F.col("kind")
    points, comments = F.sum("latest.points"), F.sum("latest.comments")
    return (
        facts.groupBy("cluster_id")
        .agg(
            F.sum("articles").alias("articles"),
            F.count_if(is_kind == "publisher").alias("_publishers"),
            F.count_if(is_kind == "category").alias("_categories"),
            F.count_if(is_kind == "story").alias("hn_stories"),
            F.coalesce(points, F.lit(0.0)).alias("hn_points"),
            F.coalesce(comments, F.lit(0.0)).alias("hn_comments"),
        )
        .select(
            "cluster_id",
            "articles",
            F.least("articles", "_publishers").alias("publishers"),
            F.least("articles", "_categories").alias("categories"),
            "hn_stories",
            "hn_points",
            "hn_comments",
            engagement_of(F.col("hn_points"), F.col("hn_comments")).alias("engagement"),
        )
    )


def engagement_of(points: Column, comments: Column) -> Column:
    return F.least(points + 2 * comments, F.lit(SATURATION))


def diversity_counts(
    members: DataFrame, articles: DataFrame, observations: DataFrame, sources: DataFrame
) -> DataFrame:
    return ranking_signals(members, articles, observations, sources).select(
        "cluster_id", "articles", "publishers", "categories"
    )


def engagement(members: DataFrame, observations: DataFrame, sources: DataFrame) -> DataFrame:
    """Capped engagement of every cluster that has at least one story."""
    return (
        latest_story(members, observations, sources)
        .groupBy("cluster_id")
        .agg(
            F.count(F.lit(1)).alias("hn_stories"),
            F.sum("points").alias("hn_points"),
            F.sum("comments").alias("hn_comments"),
        )
        .withColumn("engagement", engagement_of(F.col("hn_points"), F.col("hn_comments")))
    )


def score(clusters: DataFrame, signals: DataFrame, as_of) -> DataFrame:
    """Add the score and its explanation to clusters that already carry their signals."""
    zero, none = F.lit(0), F.lit(0.0)
    joined = clusters.join(signals, "cluster_id", "left")
    publishers, categories = F.coalesce("publishers", zero), F.coalesce("categories", zero)
    significance = nm.significance("significance_score")
    value = nm.rank_struct(
        significance["value"],
        nm.diversity(publishers, categories),
        nm.engagement_norm(F.coalesce("engagement", none)),
        nm.recency("latest_published_at", as_of),
    )
    return joined.select(
        *[F.col(c) for c in clusters.columns],
        *[F.coalesce(c, zero).alias(c) for c in ("articles", "publishers", "categories")],
        *[F.coalesce(c, none).alias(c) for c in ("hn_points", "hn_comments", "engagement")],
        F.coalesce("hn_stories", zero).alias("hn_stories"),
        significance["available"].alias("significance_available"),
        F.round(nm.age_hours("latest_published_at", as_of), 3).alias("age_hours"),
        value.alias("rank"),
    ).withColumn("rank_score", F.col("rank.rank_score"))


def rank_clusters(
    clusters: DataFrame,
    members: DataFrame,
    articles: DataFrame,
    observations: DataFrame,
    sources: DataFrame,
    as_of,
) -> DataFrame:
    """Score every given cluster. Facts of other clusters are dropped before they are joined."""
    wanted = members.join(clusters.select("cluster_id"), "cluster_id", "left_semi")
    return score(clusters, ranking_signals(wanted, articles, observations, sources), as_of)


def rank_page(
    clusters: DataFrame,
    members: DataFrame,
    articles: DataFrame,
    observations: DataFrame,
    sources: DataFrame,
    as_of,
) -> DataFrame:
    """Score the few clusters of one page; call only where a limit bounds ``clusters``.

    The page, at most a few hundred rows, is broadcast into the memberships, so that facts
    of all other events are dropped before the first shuffle.
    """
    bridge = members.join(F.broadcast(clusters.select("cluster_id")), "cluster_id", "left_semi")
    return score(clusters, ranking_signals(bridge, articles, observations, sources), as_of)


def by_rank() -> list[Column]:
    return [
        F.desc("rank_score"),
        F.desc("latest_published_at"),
        F.col("cluster_id").cast("string").asc(),
    ]


def by_time() -> list[Column]:
    return [F.desc("latest_published_at"), F.asc("cluster_id")]


def order_ranked(df: DataFrame) -> DataFrame:
    return df.orderBy(*by_rank())


def order_latest(df: DataFrame) -> DataFrame:
    return df.orderBy(*by_time())
