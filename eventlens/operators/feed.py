"""Predicates, projections and pages of the event feeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventlens import config
from eventlens.functions import numbers as nm
from eventlens.operators import topics as tp

LATEST = "latest_published_at"
PUBLIC_COLUMNS = (
    "id",
    "title",
    "summary",
    "significance_score",
    "event_type",
    "published_at",
    "primary_link",
    "source_count",
)
WINDOWS = ("week", "today", "all")
SORTS = ("ranked", "latest")


def feed_window(df: DataFrame, window: str, as_of) -> DataFrame:
    """Lower time bound of a feed; ``all`` has none."""
    now = nm.moment(as_of)
    if window == "week":
        return df.where(F.col(LATEST) >= now - F.expr("INTERVAL 7 DAYS"))
    if window == "today":
        return df.where(F.col(LATEST) >= F.date_trunc("day", now))
    if window == "all":
        return df
    raise ValueError(f"unknown window: {window}")


def not_future(df: DataFrame, as_of) -> DataFrame:
    return df.where(F.col(LATEST) <= nm.moment(as_of))


def today(df: DataFrame, as_of) -> DataFrame:
    """The whole UTC day of ``as_of``, including what is still to come."""
    start = F.date_trunc("day", nm.moment(as_of))
    return df.where((F.col(LATEST) >= start) & (F.col(LATEST) < start + F.expr("INTERVAL 1 DAY")))


def search(df: DataFrame, q: str) -> DataFrame:
    """Literal search in topic, summary and primary title; a blank query keeps everything."""
    needle = q.strip()
    if not needle:
        return df
    return df.where(
        tp.holds("topic", needle) | tp.holds("summary", needle) | tp.holds("primary_title", needle)
    )


def topic_contains(df: DataFrame, text: str | None) -> DataFrame:
    return df.where(tp.holds("topic", text)) if text else df


def event_type(df: DataFrame, kind: str | None) -> DataFrame:
    if not kind:
        return df
    if kind not in config.EVENT_TYPES:
        raise ValueError(f"unknown event type: {kind}")
    return df.where(F.col("event_type") == kind)


def with_primary(clusters: DataFrame, articles: DataFrame) -> DataFrame:
    """Join the representative's title, link and date."""
    primary = articles.select(
        F.col("article_id").alias("primary_article_id"),
        F.col("title").alias("primary_title"),
        F.col("canonical_url").alias("primary_link"),
        F.col("published_at").alias("primary_published_at"),
    )
    return clusters.join(primary, "primary_article_id")


def public_events(df: DataFrame) -> DataFrame:
    """The public contract: exactly these eight columns, whatever else the input carries."""
    return df.select(
        F.col("cluster_id").alias("id"),
        F.col("primary_title").alias("title"),
        "summary",
        "significance_score",
        "event_type",
        F.col(LATEST).alias("published_at"),
        "primary_link",
        F.col("cluster_size").alias("source_count"),
    )


def customer_view(df: DataFrame) -> DataFrame:
    """Drop operator-only fields, also inside a nested coverage list where there is one."""
    view = df.drop("analysis_error", "signals")
    if "coverage" in df.columns:
        view = view.withColumn("coverage", F.transform("coverage", lambda c: c.dropFields("signals")))
    return view


def gate_analysis(df: DataFrame, features: Column) -> DataFrame:
    """Hide the analysis without full access and say whether there is one to unlock."""
    full = F.coalesce(F.array_contains(features, "full_analysis"), F.lit(False))
    return df.withColumn(
        "analysis_locked", ~full & (F.col("analysis_status") == "ready")
    ).withColumn("analysis", F.when(full, F.col("analysis")))


def with_entitlements(df: DataFrame, users: DataFrame, as_of) -> DataFrame:
    """Join tier and features by ``user_id``."""
    access = nm.entitlement("subscription_tier", "entitlement_expires_at", as_of)
    rights = users.select(
        "user_id", access["tier"].alias("tier"), access["features"].alias("features")
    )
    return df.join(rights, "user_id")


def page(df: DataFrame, order: list[Column], limit: int, offset: int = 0, most: int = 100) -> DataFrame:
    """Ordered slice. Spark keeps only ``offset + limit`` rows per task and merges those."""
    if not 1 <= limit <= most:
        raise ValueError(f"limit must be between 1 and {most}")
    if not 0 <= offset <= 100_000:
        raise ValueError("offset must be between 0 and 100000")
    return df.orderBy(*order).offset(offset).limit(limit)


def total(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("total"))


def recent(df: DataFrame, when: str, n: int = 20, tie: str | None = None) -> DataFrame:
    """The last ``n`` rows by time."""
    order = [F.desc(when)] + ([F.asc(tie)] if tie else [])
    return df.orderBy(*order).limit(n)


def normalize_requests(requests: DataFrame) -> DataFrame:
    """Clean logged feed requests: unknown choices fall back to defaults, text is bounded."""

    def text(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(""))

    def choice(name: str, allowed, default: str) -> Column:
        return F.when(text(name).isin(*allowed), text(name)).otherwise(default)

    trimmed = F.btrim(text("page"))
    number = F.when(
        trimmed.rlike(r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$"),
        trimmed.try_cast("double"),
    )
    good = F.coalesce((number == F.floor(number)) & number.between(1, 8334), F.lit(False))
    return requests.select(
        *[c for c in requests.columns if c not in
          ("q", "topic", "following", "window", "sort", "event_type", "page")],
        F.substring(F.btrim(text("q")), 1, 200).alias("q"),
        F.substring(text("topic"), 1, 60).alias("topic"),
        (text("following") == "true").alias("following"),
        choice("window", ("today", "all"), "week").alias("window"),
        choice("sort", ("latest",), "ranked").alias("sort"),
        choice("event_type", config.EVENT_TYPES, "").alias("event_type"),
        F.when(good, number).otherwise(1).cast("int").alias("page"),
    )
