"""One ingest round: admit, resolve, embed, assign to events, refresh, count."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventlens import config
from eventlens.config import DEFAULTS, Settings
from eventlens.functions import numbers as nm
from eventlens.functions import text as tx
from eventlens.functions import vectors
from eventlens.operators import admission, assignment, events, resolve
from eventlens.session import cut
from eventlens.sources import batches

VECTORS = "article_id string, embedding array<float>, embedding_model string"
MEMBERS = "cluster_id string, article_id string, similarity_score double, is_primary boolean"
CLUSTERS = (
    "cluster_id string, topic string, primary_article_id string, cluster_size bigint, "
    "latest_published_at timestamp, created_at timestamp, summary string, analysis string, "
    "analysis_input_hash string, significance_score int, event_type string, "
    "analysis_status string, analysis_error string, analyzed_at timestamp"
)


@dataclass(frozen=True)
class IngestTables:
    sources: DataFrame
    articles: DataFrame
    observations: DataFrame
    vectors: DataFrame
    members: DataFrame
    clusters: DataFrame


@dataclass(frozen=True)
class IngestResult:
    tables: IngestTables
    metrics: DataFrame
    rejected: DataFrame


def empty_tables(spark: SparkSession, sources: DataFrame) -> IngestTables:
    article, seen = resolve.empty_state(spark)
    make = lambda schema: spark.createDataFrame([], schema)
    return IngestTables(sources, article, seen, make(VECTORS), make(MEMBERS), make(CLUSTERS))


def _qualities(articles: DataFrame, observations: DataFrame, sources: DataFrame) -> DataFrame:
    """Narrow quality keys and times of articles."""
    authority = events.source_authority(observations, sources)
    return (
        articles.select(
            "article_id", "published_at", "fetched_at", "canonical_url",
            tx.word_count("body").alias("words"),
        )
        .join(authority, "article_id", "left")
        .withColumn("authority", F.coalesce("authority", F.lit(1)))
    )


def _grow_events(tables: IngestTables, articles, observations, vecs, settings) -> DataFrame:
    """New memberships of articles that have a vector but no event. Pending articles of
    earlier rounds are picked up here as well."""
    keys = cut(_qualities(articles, observations, tables.sources))
    usable = vecs.where(F.col("embedding").isNotNull())
    pending = events.unclustered(usable, tables.members).join(keys, "article_id")
    heads = tables.clusters.select(
        "cluster_id", F.col("primary_article_id").alias("article_id"), "latest_published_at", "created_at"
    )
    # Only events still inside the window of some pending article can be joined.
    span = pending.agg(F.min(events.event_time()).alias("low")).first()
    if span.low is None:
        return tables.members.sparkSession.createDataFrame(
            [], "article_id string, cluster_id string, is_new boolean, similarity_score double"
        )
    window = F.make_dt_interval(F.lit(0), F.lit(settings.cluster_window_hours))
    live = heads.where(F.col("latest_published_at") >= F.lit(span.low) - window)
    seeds = live.join(usable, "article_id").join(keys, "article_id")
    return cut(
        assignment.assign_events(
            pending, seeds, settings.cluster_similarity, settings.cluster_window_hours
        )
    )


def _refresh(tables, articles, observations, members, joined, changed, as_of) -> DataFrame:
    """Clusters after the round: touched ones are rebuilt and lose their analysis."""
    touched = joined.select("cluster_id").unionByName(
        members.join(changed, "article_id", "left_semi").select("cluster_id")
    ).distinct()
    touched = cut(touched)
    affected = members.join(touched, "cluster_id", "left_semi")
    ids = affected.select("article_id")
    authority = events.source_authority(
        observations.join(ids, "article_id", "left_semi"), tables.sources
    )
    fresh = events.refresh_clusters(
        affected, articles.join(ids, "article_id", "left_semi"), authority
    )
    born = tables.clusters.select("cluster_id", "created_at")
    rebuilt = fresh.join(born, "cluster_id", "left").withColumn(
        "created_at", F.coalesce("created_at", nm.moment(as_of))
    ).withColumn("analysis_status", F.lit("pending"))
    kept = tables.clusters.join(touched, "cluster_id", "left_anti")
    return kept.unionByName(rebuilt, allowMissingColumns=True)


def run_ingest(
    tables: IngestTables,
    candidates: DataFrame,
    as_of,
    settings: Settings = DEFAULTS,
    embedder: str = config.EMBEDDING_SPACE,
    errors: DataFrame | None = None,
) -> IngestResult:
    """Apply landed candidates to the tables and return the next snapshot. ``errors`` of the
    sources, like rejected candidates, make the round partial.

    The result is written to the shared folder step by step; nothing refers to the old
    lineage, so the returned tables can overwrite the stored ones.
    """
    flags = tables.sources
    for name, default in (("is_active", True), ("ai_filter", False)):
        if name not in flags.columns:
            flags = flags.withColumn(name, F.lit(default))
    active = flags.where("is_active").select("source_id", "ai_filter")
    fetched = cut(
        admission.admission(candidates.join(active, "source_id"), as_of, settings.lookback_days)
    )
    admitted = fetched.where(F.col("admission") == "admitted").drop("admission", "ai_filter")
    done = resolve.resolve_articles(
        admitted, tables.sources, tables.articles, tables.observations, as_of, settings
    )
    articles, observations = cut(done.articles), cut(done.observations)
    outcomes, changed = cut(done.outcomes), cut(done.changed)
    stale = articles.where("needs_embedding")
    made = cut(vectors.embed(stale.select("article_id", "title", "body"), embedder).select(
        "article_id", "embedding", "embedding_model"
    ))
    good = made.where(F.col("embedding").isNotNull())
    vecs = cut(tables.vectors.join(stale.select("article_id"), "article_id", "left_anti").unionByName(good))
    embedded = good.select("article_id", F.lit(True).alias("_done"))
    articles = cut(
        articles.join(embedded, "article_id", "left")
        .withColumn("needs_embedding", F.col("needs_embedding") & F.col("_done").isNull())
        .drop("_done")
    )
    joined = _grow_events(tables, articles, observations, vecs, settings)
    members = cut(
        tables.members.drop("is_primary").unionByName(
            joined.select("cluster_id", "article_id", "similarity_score")
        )
    )
    clusters = cut(_refresh(tables, articles, observations, members, joined, changed, as_of))
    members = cut(events.mark_primary(members, clusters))
    rejected = cut(done.rejected)
    count = lambda df: df.agg(F.count(F.lit(1))).scalar()
    fallback = F.col("extraction_fallback") if "extraction_fallback" in fetched.columns else F.lit(False)
    failed = 0 if errors is None else count(errors)
    metrics = fetched.agg(
        F.count(F.lit(1)).alias("fetched"),
        F.count_if(F.col("admission") != "admitted").alias("filtered"),
        F.count_if(fallback).alias("extraction_fallbacks"),
    ).select(
        "fetched",
        count(outcomes.where("created")).alias("created"),
        count(outcomes.where(~F.col("created"))).alias("deduplicated"),
        "filtered",
        count(good).alias("embedded"),
        count(joined).alias("clustered"),
        "extraction_fallbacks",
        F.when(F.lit(count(rejected) + failed > 0), "partial").otherwise("succeeded").alias("status"),
    )
    after = IngestTables(tables.sources, articles, observations, vecs, members, clusters)
    return IngestResult(after, metrics, rejected)


def payload_errors(payloads: DataFrame, candidates: DataFrame) -> DataFrame:
    """``(source_id, position, error)`` of payloads that gave no candidate."""
    given = candidates.select("payload_id").distinct()
    empty = payloads.join(given, "payload_id", "left_anti")
    return empty.select(
        "source_id", F.col("rank").alias("position"), F.concat(F.lit("no items: "), "payload_id").alias("error")
    )


def run_payloads(
    tables: IngestTables,
    payloads: DataFrame,
    extracted: DataFrame,
    states: DataFrame,
    as_of,
    settings: Settings = DEFAULTS,
    embedder: str = config.EMBEDDING_SPACE,
) -> IngestResult:
    """One whole round from landed payloads: dispatch by source type, fill short bodies from the
    ``extracted (url, text)`` of their pages, ingest, and move the sources' reading state on.

    ``states`` is ``(source_id, state map<string,string>)`` of the sources that were read. Payloads
    of inactive sources are left out; a payload without items is an error of its source.
    """
    active = tables.sources.where(F.col("is_active")) if "is_active" in tables.sources.columns else tables.sources
    types = active.select("source_id", F.col("type").alias("_type"))
    landed = payloads.join(types, "source_id").withColumn("type", F.col("_type")).drop("_type")
    found = cut(batches.normalize(landed, settings.source_limit, as_of, settings.lookback_days))
    errors = cut(payload_errors(landed, found))
    typed = found.join(types.withColumnRenamed("_type", "type"), "source_id")
    # Payloads of a source follow each other in their order, items in theirs.
    ranks = landed.select("payload_id", "rank")
    ordered = typed.join(ranks, "payload_id").withColumn("position", F.col("rank") * (1 << 20) + F.col("position"))
    candidates = cut(admission.enrich(ordered.drop("rank", "payload_id"), extracted).drop("type"))
    done = run_ingest(tables, candidates, as_of, settings, embedder, errors)
    kept = done.tables
    if {"config", "last_fetched_at", "last_error"} <= set(tables.sources.columns):
        kept = replace(kept, sources=cut(batches.advance_state(tables.sources, states, errors, as_of)))
    return replace(done, tables=kept)
