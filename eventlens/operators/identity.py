"""Static identity joins: replayed observations, exact URLs, aliases, and their precedence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def match_observation(candidates: DataFrame, observations: DataFrame) -> DataFrame:
    """Article of the observation with the same source and external id."""
    known = observations.select("source_id", "external_id", F.col("article_id").alias("by_observation"))
    return candidates.join(known, ["source_id", "external_id"], "left")


def match_url(candidates: DataFrame, articles: DataFrame) -> DataFrame:
    """Article with the same canonical URL."""
    known = articles.select("url_hash", F.col("article_id").alias("by_url"))
    return candidates.join(known, "url_hash", "left")


def earliest(order: list[str]) -> Column:
    return F.min_by("article_id", F.struct(*order))


def match_alias(candidates: DataFrame, observations: DataFrame, articles: DataFrame) -> DataFrame:
    """Earliest article one of whose observations points to the URL."""
    dated = observations.select("article_id", "url_hash").distinct().join(
        articles.select("article_id", "fetched_at"), "article_id"
    )
    aliases = dated.groupBy("url_hash").agg(earliest(["fetched_at", "article_id"]).alias("by_alias"))
    return candidates.join(aliases, "url_hash", "left")


def resolve_identity(candidates: DataFrame) -> DataFrame:
    """First match in order of precedence; null where the candidate is new."""
    ways = [c for c in ("by_observation", "by_url", "by_alias", "by_text") if c in candidates.columns]
    reason = F.coalesce(*[F.when(F.col(w).isNotNull(), F.lit(w)) for w in ways])
    return candidates.withColumn("matched_by", reason).withColumn("article_id", F.coalesce(*ways))


def upsert_observations(existing: DataFrame | None, incoming: DataFrame) -> DataFrame:
    """One row per source and external id: url and article stay first, the rest is latest.

    ``incoming`` carries ``seq``, the processing order. Both ends come from one aggregation
    that combines map side, so an item observed a billion times ships one row per task.
    """
    key = ["source_id", "external_id"]
    lasting = ["url", "article_id"]
    moving = [c for c in incoming.columns if c not in (*key, *lasting, "seq")]
    merged = (
        incoming.groupBy(*key)
        .agg(
            F.min_by(F.struct(*lasting), "seq").alias("_first"),
            F.max_by(F.struct(*moving), "seq").alias("_last"),
        )
        .select(*key, "_first.*", "_last.*")
    )
    if existing is None:
        return merged
    old = existing.select(*key, *[F.col(c).alias(f"_{c}") for c in lasting])
    kept = existing.join(merged.select(*key), key, "left_anti")
    updated = merged.join(old, key, "left").select(
        *key, *[F.coalesce(f"_{c}", c).alias(c) for c in lasting], *moving
    )
    return kept.unionByName(updated, allowMissingColumns=True)
