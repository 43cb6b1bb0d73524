"""Topic catalog: matching, tagging, following, and selection requests."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventlens import config
from eventlens.functions import numbers as nm

SEARCHED = ("topic", "summary", "primary_title")


def holds(text, needle) -> Column:
    """Literal, case-insensitive containment."""
    text = F.col(text) if isinstance(text, str) else text
    needle = needle if isinstance(needle, Column) else F.lit(needle)
    return F.contains(F.lower(text), F.lower(needle))


def topic_match(topic: str) -> Column:
    """Whether any keyword of the topic occurs in topic, summary or primary title."""
    if topic not in config.TOPICS:
        raise ValueError(f"unknown topic: {topic}")
    return reduce(
        lambda a, b: a | b,
        [holds(column, word) for word in config.TOPICS[topic][1] for column in SEARCHED],
    )


def tag_topics(df: DataFrame) -> DataFrame:
    """Add ``topics``, the catalog ids that match."""
    tags = [F.when(topic_match(topic), F.lit(topic)) for topic in config.TOPICS]
    return df.withColumn("topics", F.array_compact(F.array(*tags)))


def topic_rows(df: DataFrame) -> DataFrame:
    return tag_topics(df).select("cluster_id", F.explode("topics").alias("topic"))


def known_topics(user_topics: DataFrame) -> DataFrame:
    return user_topics.where(F.col("topic").isin(*config.TOPICS))


def following(df: DataFrame, user_topics: DataFrame, user_id) -> DataFrame:
    """Events in the union of one user's topics; a user without topics gets none.

    One user follows at most the whole catalog, so the broadcast side has at most eight rows.
    """
    mine = known_topics(user_topics).where(F.col("user_id") == user_id).select("topic")
    tagged = topic_rows(df).join(F.broadcast(mine.distinct()), "topic", "left_semi")
    return df.join(tagged.select("cluster_id").distinct(), "cluster_id", "left_semi")


def _bit(topic: Column) -> Column:
    bits = F.create_map(
        *[F.lit(v) for i, name in enumerate(config.TOPICS) for v in (name, 1 << i)]
    )
    return F.element_at(bits, topic)


def following_totals(df: DataFrame, user_topics: DataFrame) -> DataFrame:
    """Number of followed events for every user that follows something.

    Users and events are reduced to their sets of topics first. There are at most 256 sets,
    so the join is between catalogs of sets and never between users and events.
    """
    chosen = (
        known_topics(user_topics)
        .distinct()
        .groupBy("user_id")
        .agg(F.bit_or(_bit(F.col("topic"))).alias("user_set"))
    )
    mask = F.aggregate(
        "topics", F.lit(0), lambda acc, t: acc.bitwiseOR(_bit(t))
    )
    events = tag_topics(df).groupBy(mask.alias("event_set")).agg(F.count(F.lit(1)).alias("n"))
    bits = F.array(*[F.lit(1 << i) for i in range(len(config.TOPICS))])

    def spread(sets: DataFrame, name: str) -> DataFrame:
        members = F.filter(bits, lambda b: F.col(name).bitwiseAND(b) != 0)
        return sets.withColumn("bit", F.explode(members))

    reach = (
        spread(chosen.select("user_set").distinct(), "user_set")
        .join(spread(events, "event_set"), "bit")
        .select("user_set", "event_set", "n")
        .distinct()
        .groupBy("user_set")
        .agg(F.sum("n").alias("followed_events"))
    )
    return chosen.join(reach, "user_set", "left").select(
        "user_id", F.coalesce("followed_events", F.lit(0)).alias("followed_events")
    )


def profiles(users: DataFrame, user_topics: DataFrame, as_of) -> DataFrame:
    """Tier, topic limit and ordered topics of every user."""
    chosen = user_topics.groupBy("user_id").agg(F.array_sort(F.collect_set("topic")).alias("topics"))
    access = nm.entitlement("subscription_tier", "entitlement_expires_at", as_of)
    unlimited = F.array_contains(access["features"], "unlimited_topics")
    return users.join(chosen, "user_id", "left").select(
        "user_id",
        "email",
        access["tier"].alias("subscription_tier"),
        F.when(unlimited, len(config.TOPICS)).otherwise(config.FREE_TOPIC_LIMIT).alias("topic_limit"),
        F.coalesce("topics", F.array().cast("array<string>")).alias("topics"),
    )


def check_requests(requests: DataFrame, users: DataFrame, as_of) -> DataFrame:
    """Add ``violations`` to topic selection requests ``(request_id, user_id, topics)``."""
    access = nm.entitlement("subscription_tier", "entitlement_expires_at", as_of)
    limits = users.select(
        "user_id", F.array_contains(access["features"], "unlimited_topics").alias("unlimited")
    )
    topics = F.col("topics")
    unknown = F.exists(topics, lambda t: ~t.isin(*config.TOPICS) | t.isNull())
    free = ~F.coalesce("unlimited", F.lit(False))
    checks = {
        "missing": topics.isNull(),
        "too_many": F.size(topics) > len(config.TOPICS),
        "repeated": F.size(F.array_distinct(topics)) != F.size(topics),
        "unknown": unknown,
        "over_limit": free & (F.size(topics) > config.FREE_TOPIC_LIMIT),
    }
    found = F.array(*[F.when(F.coalesce(test, F.lit(False)), name) for name, test in checks.items()])
    return (
        requests.join(limits, "user_id", "left")
        .withColumn("violations", F.array_compact(found))
        .drop("unlimited")
    )


def save_topics(current: DataFrame, requests: DataFrame, users: DataFrame, as_of) -> DataFrame:
    """Topic sets after the newest valid request of every user; invalid requests change nothing."""
    valid = check_requests(requests, users, as_of).where(F.size("violations") == 0)
    newest = valid.groupBy("user_id").agg(F.max_by("topics", "request_id").alias("topics"))
    return replace_sets(current, newest)


def replace_sets(current: DataFrame, chosen: DataFrame) -> DataFrame:
    """Replace the whole topic set of every user in ``chosen``; others keep theirs."""
    kept = current.join(chosen.select("user_id"), "user_id", "left_anti")
    fresh = chosen.select("user_id", F.explode("topics").alias("topic"))
    return kept.select("user_id", "topic").unionByName(fresh)


def ensure_profiles(users: DataFrame, identities: DataFrame) -> DataFrame:
    """Create unseen users on the free tier and refresh the address of known ones.

    ``identities`` may repeat a user; the latest ``seen_at`` gives the address.
    """
    latest = identities.groupBy("user_id").agg(F.max_by("email", "seen_at").alias("_email"))
    known = users.join(latest, "user_id", "left").select(
        *[F.coalesce("_email", "email").alias("email") if c == "email" else F.col(c) for c in users.columns]
    )
    fresh = latest.join(users.select("user_id"), "user_id", "left_anti").select(
        "user_id", F.col("_email").alias("email"), F.lit("free").alias("subscription_tier")
    )
    return known.unionByName(fresh, allowMissingColumns=True)
