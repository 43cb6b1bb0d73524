"""Streams that keep the same state the batch operators compute.

State is a native aggregation wherever one exists: it stays in the JVM state store, combines
map side, and a hot key costs one row per task and trigger.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from eventlens.config import DEFAULTS
from eventlens.functions import numbers as nm
from eventlens.operators import ranking, subscriptions


def observation_stream(events: DataFrame) -> DataFrame:
    """Running upsert of observations, for update mode: url and article stay first."""
    lasting, key = ["url", "article_id"], ["source_id", "external_id"]
    moving = [c for c in events.columns if c not in (*key, *lasting, "seq")]
    return (
        events.groupBy(*key)
        .agg(
            F.min_by(F.struct(*lasting), "seq").alias("_first"),
            F.max_by(F.struct(*moving), "seq").alias("_last"),
        )
        .select(*key, "_first.*", "_last.*")
    )


def story_stream(events: DataFrame) -> DataFrame:
    """Latest capped counters per article and story, for update mode."""
    latest = F.struct(
        F.col("seen_at"),
        F.col("observation_id").cast("string").alias("observation_id"),
        ranking.counter(F.col("metadata"), "hn_points").alias("points"),
        ranking.counter(F.col("metadata"), "hn_comments").alias("comments"),
    )
    story = ranking.story_id(F.col("metadata"), F.col("external_id").cast("string"))
    return (
        events.select("article_id", story.alias("story_id"), latest.alias("latest"))
        .where(F.col("story_id").isNotNull())
        .groupBy("article_id", "story_id")
        .agg(F.max("latest").alias("latest"))
        .select("article_id", "story_id", "latest.*")
    )


def receipt_stream(events: DataFrame, within: str | None = None) -> DataFrame:
    """Each event id once. With ``within`` ids are forgotten after that much event time."""
    if within is None:
        return events.dropDuplicates(["event_id"])
    return events.withWatermark("created", within).dropDuplicatesWithinWatermark(["event_id"])


def subscription_stream(
    events: DataFrame, as_of, grace_days: int = DEFAULTS.past_due_grace_days
) -> DataFrame:
    """Running tier and expiry per customer, for update mode."""
    tier, expiry = subscriptions.access_of(as_of, grace_days)
    return subscriptions.latest_events(events).select(
        "customer_id",
        F.col("status").alias("subscription_status"),
        F.col("created").alias("state_created_at"),
        tier.alias("subscription_tier"),
        expiry.alias("entitlement_expires_at"),
    )


class NewestEvent(StatefulProcessor):
    """Keeps the deciding event per customer and reports every change.

    The alternative to the aggregation for append-mode consumers: one output row per accepted
    change, none for late or repeated events. Among equal times the first arrival stays.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.newest = handle.getValueState("newest", "created bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        best = self.newest.get()[0] if self.newest.exists() else None
        # A micro-batch bounds what a customer can have here; order holds across its chunks.
        frame = pd.concat(list(rows)).sort_values("arrival", kind="stable")
        before = frame["created"].cummax().shift()
        if best is not None:
            before = before.fillna(best).clip(lower=best)
        accepted = frame[before.isna() | (frame["created"] > before)]
        if len(accepted):
            self.newest.update((int(accepted["created"].iloc[-1]),))
            yield pd.DataFrame({
                "customer_id": key[0], "created": accepted["created"].astype("int64"), "status": accepted["status"]
            })

    def close(self) -> None:
        pass


def change_stream(events: DataFrame) -> DataFrame:
    """Accepted changes of subscription state as ``(customer_id, created, status)``."""
    usable = events.where(F.col("kind").startswith(subscriptions.PREFIX)).select(
        "customer_id", F.unix_micros("created").alias("created"), "status", "arrival"
    )
    return usable.groupBy("customer_id").transformWithStateInPandas(
        NewestEvent(), "customer_id string, created bigint, status string", "Append", "None"
    )


def admitted_stream(candidates: DataFrame, as_of, days: int = DEFAULTS.lookback_days) -> DataFrame:
    """Late data rule: the lookback bounds how late an item may be, an hour how early."""
    when, now = F.col("published_at"), nm.moment(as_of)
    watermarked = candidates.withWatermark("published_at", f"{days} days")
    return watermarked.where(
        when.isNull()
        | when.between(now - F.make_dt_interval(F.lit(days)), now + F.expr("INTERVAL 1 HOUR"))
    )
