"""Invariant checks and inventory counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventlens.functions import vectors


def _rule(df: DataFrame, rule: str, key: str) -> DataFrame:
    return df.select(F.lit(rule).alias("rule"), F.col(key).cast("string").alias("key"))


def _repeated(df: DataFrame, rule: str, key: str, where=None) -> DataFrame:
    rows = df if where is None else df.where(where)
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    return _rule(counts, rule, key)


def violations(
    members: DataFrame,
    clusters: DataFrame | None = None,
    articles: DataFrame | None = None,
    dims: int | None = None,
) -> DataFrame:
    """Rows ``(rule, key)`` that break an invariant; empty for consistent tables."""
    found = [_repeated(members, "article_in_one_cluster", "article_id")]
    if "is_primary" in members.columns:
        primaries = members.groupBy("cluster_id").agg(F.count_if("is_primary").alias("n"))
        found.append(_rule(primaries.where(F.col("n") != 1), "one_primary", "cluster_id"))
    if clusters is not None:
        sizes = members.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n"))
        off = clusters.join(sizes, "cluster_id", "full").where(
            ~F.col("cluster_size").eqNullSafe(F.col("n"))
        )
        found.append(_rule(off, "size_is_member_count", "cluster_id"))
    if articles is not None:
        for column in ("canonical_url", "url_hash"):
            if column in articles.columns:
                found.append(_repeated(articles, f"unique_{column}", column))
        if "embedding" in articles.columns:
            length = vectors.norm("embedding")
            bad = F.col("embedding").isNotNull() & (
                ~F.coalesce(F.abs(length - 1) < 1e-3, F.lit(False))
                | (F.size("embedding") != (dims or F.size("embedding")))
            )
            found.append(_rule(articles.where(bad), "unit_vector", "article_id"))
    return reduce(DataFrame.unionByName, found)


def inventory(tables: dict[str, DataFrame]) -> DataFrame:
    """Row count of every table."""
    counts = [
        df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table"), "rows")
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, counts)
