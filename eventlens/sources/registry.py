"""The source registry: loading, seeding, ordering and health."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

REGISTRY = (
    "name string, url string, type string, category string, authority_score int, config string"
)


def load_sources(spark: SparkSession, path: str) -> DataFrame:
    """JSON array of sources; ``config`` keeps its JSON types as a variant."""
    raw = spark.read.option("multiLine", True).schema(REGISTRY).json(path)
    return raw.select(
        F.sha2("url", 256).alias("source_id"),
        "name",
        "url",
        "type",
        "category",
        F.coalesce("authority_score", F.lit(5)).alias("authority_score"),
        F.try_parse_json(F.coalesce("config", F.lit("{}"))).alias("config"),
        F.lit(True).alias("is_active"),
    )


def seed_sources(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Insert sources with an unseen URL; existing rows, also inactive ones, stay as they are."""
    fresh = incoming.join(existing.select("url"), "url", "left_anti")
    return existing.unionByName(fresh.select(*incoming.columns), allowMissingColumns=True)


def active_sources(sources: DataFrame) -> DataFrame:
    """Active sources in processing order: highest authority first, then name."""
    return sources.where("is_active").orderBy(*processing_order())


def processing_order() -> list[Column]:
    return [F.desc("authority_score"), F.asc("name")]


def source_health(sources: DataFrame) -> DataFrame:
    """Coverage mode and notes of every source, by name."""
    text = lambda key: F.try_variant_get("config", f"$.{key}", "string").alias(key)
    optional = [c for c in ("last_fetched_at", "last_error") if c in sources.columns]
    return sources.select(
        "source_id", "name", "url", "type", text("fetch_mode"), text("scope_note"), "is_active",
        *optional,
    ).orderBy("name")


def union_candidates(*frames: DataFrame) -> DataFrame:
    """All candidates of all sources, repeats kept."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def minus_by_key(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Rows of ``left`` whose key is not in ``right``."""
    return left.join(right.select(key), key, "left_anti")
