"""The table set queries run on, and the projection of the test tables onto it."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventlens import config
from eventlens.operators import events
from eventlens.session import cut, intact, prepare, small, spread

AS_OF = "2024-01-31 00:00:00"
# After the last order, so that every event is known.
SUBSCRIPTION_AS_OF = "2001-09-01 00:00:00"


@dataclass(frozen=True)
class Tables:
    sources: DataFrame
    articles: DataFrame
    observations: DataFrame
    members: DataFrame
    clusters: DataFrame
    users: DataFrame | None = None
    user_topics: DataFrame | None = None
    runs: DataFrame | None = None
    calls: DataFrame | None = None

    def with_clusters(self, clusters: DataFrame) -> Tables:
        return replace(self, clusters=clusters)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One test table. The small files hold a single row group, which would leave the whole
    first stage to one task, so inputs below the size limit of ``spread`` are dealt out."""
    return spread(prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet"))


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registry of the distinct document sources; its size is counted before a broadcast."""
    n = F.regexp_extract("source", r"(\d+)", 1).cast("int")
    kinds = F.array(*map(F.lit, ("research", "community", "company", "press", "policy")))
    registry = (
        read(spark, sf_dir, "documents")
        .select("source")
        .distinct()
        .select(
            F.col("source").alias("source_id"),
            F.col("source").alias("name"),
            F.concat(F.lit("https://"), "source", F.lit(".example.com/feed")).alias("url"),
            F.when(n % 5 == 1, "hackernews").otherwise("rss").alias("type"),
            F.element_at(kinds, n % 5 + 1).alias("category"),
            (n % 10 + 1).alias("authority_score"),
            (n % 7 != 6).alias("is_active"),
            (n % 4 == 0).alias("ai_filter"),
        )
    )
    return small(registry)


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    published = F.timestamp_add("HOUR", F.col("doc_id") % 720, F.lit("2024-01-01").cast("timestamp"))
    return read(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("article_id"),
        F.col("source").alias("source_id"),
        F.substring("text", 1, 80).alias("title"),
        F.col("text").alias("body"),
        F.concat(F.lit("https://"), "source", F.lit(".example.com/a/"), "doc_id").alias("canonical_url"),
        published.alias("published_at"),
        F.timestamp_add("HOUR", F.lit(1), published).alias("fetched_at"),
    )


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact copies share the cluster named after their smallest id."""
    keyed = read(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("article_id"), F.md5("text").alias("copy_key")
    )
    first = keyed.groupBy("copy_key").agg(F.min("article_id").alias("cluster_id"))
    return keyed.join(first, "copy_key").select("cluster_id", "article_id")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").agg(F.count(F.lit(1))).scalar()
    k = F.get_json_object("props", "$.k").cast("bigint")
    return read(spark, sf_dir, "events").select(
        F.col("event_id").alias("observation_id"),
        (F.col("event_id") % docs).alias("article_id"),
        F.concat(F.lit("src"), F.col("user_id") % 20).alias("source_id"),
        F.concat(F.lit("x"), k.cast("string")).alias("external_id"),
        F.concat(F.lit("https://obs.example.com/"), "event_id").alias("url"),
        F.col("ts").cast("timestamp").alias("seen_at"),
        F.to_variant_object(
            F.struct(
                F.when(F.col("user_id") % 2 == 0, k).alias("hn_item_id"),
                F.col("value").alias("hn_points"),
                (F.col("user_id") % 100).alias("hn_comments"),
            )
        ).alias("metadata"),
    )


def clusters(
    spark: SparkSession, sf_dir: str, member: DataFrame, article: DataFrame, seen: DataFrame,
    registry: DataFrame,
) -> DataFrame:
    """Refreshed clusters with the analysis columns the labels table stands in for."""
    labels = read(spark, sf_dir, "labels").select(F.col("doc_id").alias("cluster_id"), "quality")
    kinds = F.array(*map(F.lit, config.EVENT_TYPES))
    cid = F.col("cluster_id")
    fresh = events.refresh_clusters(member, article, events.source_authority(seen, registry))
    known = F.col("quality").isNotNull()
    return fresh.join(labels, "cluster_id", "left").select(
        "cluster_id",
        "topic",
        "primary_article_id",
        "cluster_size",
        "latest_published_at",
        F.when(known, F.concat(F.lit("Research summary of "), "topic")).alias("summary"),
        F.when(known, F.concat(F.lit("why it matters: "), cid.cast("string"))).alias("analysis"),
        F.when(F.col("quality") == 1, 8).when(F.col("quality") == 0, 3).alias("significance_score"),
        F.element_at(kinds, (cid % 7 + 1).cast("int")).alias("event_type"),
        F.when(known, "ready").otherwise("pending").alias("analysis_status"),
        F.when(~known & (cid % 11 == 0), "timeout").alias("analysis_error"),
    )


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    return read(spark, sf_dir, "customer").select(
        key.alias("user_id"),
        F.lower("c_name").alias("email"),
        F.when(key % 4 == 0, "pro").otherwise("free").alias("subscription_tier"),
        F.when(
            key % 8 == 0,
            F.timestamp_add("DAY", (key % 3) - 1, F.lit(AS_OF).cast("timestamp")),
        ).alias("entitlement_expires_at"),
        F.concat(F.lit("cus_"), key).alias("customer_id"),
    )


def user_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*map(F.lit, config.TOPICS))
    key = F.col("c_custkey")
    picks = F.array_distinct(
        F.array(
            F.element_at(names, (key % 8 + 1).cast("int")),
            F.element_at(names, ((key + key % 5) % 8 + 1).cast("int")),
        )
    )
    return read(spark, sf_dir, "customer").where(key % 9 != 0).select(
        key.alias("user_id"), F.explode(picks).alias("topic")
    )


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One model call per conversation turn: reservation first, usage known unless failed."""
    size = F.octet_length("text").cast("bigint")
    summary_stage = F.col("turn") % 2 == 0
    status = (
        F.when(F.col("role") == "system", "started")
        .when((F.col("role") == "user") & (F.col("conv_id") % 7 == 0), "failed")
        .otherwise("succeeded")
    )
    return read(spark, sf_dir, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("call_id"),
        (F.col("conv_id") % 50).alias("run_id"),
        F.col("conv_id").alias("cluster_id"),
        F.when(summary_stage, "summary").otherwise("analysis").alias("stage"),
        F.when(summary_stage, "deepseek-flash").otherwise("deepseek-v4-pro").alias("model"),
        F.md5("text").alias("cache_key"),
        status.alias("status"),
        size.alias("input_tokens"),
        F.expr("octet_length(text) div 4").alias("cached_input_tokens"),
        F.regexp_count("text", F.lit(r"\S+")).cast("bigint").alias("output_tokens"),
        F.array("text").alias("messages"),
        F.when(summary_stage, 768).otherwise(2048).alias("max_tokens"),
        F.timestamp_add(
            "MINUTE", F.col("conv_id") * 10 + F.col("turn"), F.lit("2024-01-01").cast("timestamp")
        ).alias("created_at"),
    )


def subscription_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    order_date = F.col("o_orderdate").cast("timestamp")
    status = (
        F.when(F.col("o_orderstatus") == "F", "active")
        .when(F.col("o_orderstatus") == "O", "past_due")
        .otherwise("canceled")
    )
    return read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("event_id"),
        F.lit("customer.subscription.updated").alias("kind"),
        order_date.alias("created"),
        F.concat(F.lit("cus_"), "o_custkey").alias("customer_id"),
        status.alias("status"),
        F.timestamp_add("DAY", F.lit(180), order_date).alias("period_end"),
        F.concat(F.lit("sub_"), "o_custkey").alias("subscription_id"),
        F.substring("o_orderpriority", 1, 1).alias("price_id"),
        F.col("o_orderkey").alias("arrival"),
    )


# Written memberships and clusters, per application and directory.
_STORED: dict[tuple[str, str], tuple[DataFrame, DataFrame]] = {}


def load(spark: SparkSession, sf_dir: str) -> Tables:
    """The whole set. Memberships and clusters are stored tables in production, so they are
    written once per directory here and then read by every query."""
    registry = sources(spark, sf_dir)
    article = articles(spark, sf_dir)
    seen = observations(spark, sf_dir)
    place = (spark.sparkContext.applicationId, sf_dir)
    if place not in _STORED or not all(intact(t) for t in _STORED[place]):
        member = cut(members(spark, sf_dir))
        _STORED[place] = member, cut(clusters(spark, sf_dir, member, article, seen, registry))
    member, cluster = _STORED[place]
    return Tables(
        sources=registry,
        articles=article,
        observations=seen,
        members=member,
        clusters=cluster,
        users=users(spark, sf_dir),
        user_topics=user_topics(spark, sf_dir),
    )
