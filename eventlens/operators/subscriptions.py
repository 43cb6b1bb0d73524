"""Subscription state from repeated and out-of-order events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventlens.config import DEFAULTS
from eventlens.functions import numbers as nm

PREFIX = "customer.subscription."


def dedupe_receipts(events: DataFrame) -> DataFrame:
    """Each event id once, with the fields of its first arrival; unknown customers included."""
    first = F.min_by(F.struct("kind", "created"), "arrival")
    return (
        events.groupBy("event_id").agg(first.alias("_first")).select("event_id", "_first.*")
    )


def latest_events(events: DataFrame) -> DataFrame:
    """The event that decides each customer's state.

    Only a strictly newer ``created`` changes the state, so the newest one decides and, among
    equal times, the one processed first. A maximum needs no sorting and combines map side.
    """
    usable = events.where(
        F.col("kind").startswith(PREFIX) & (F.coalesce("customer_id", F.lit("")) != "")
    )
    order = F.struct((-F.unix_micros("created")).alias("age"), F.col("arrival"))
    fields = F.struct("created", "status", "period_end", "subscription_id", "price_id")
    return (
        usable.groupBy("customer_id").agg(F.min_by(fields, order).alias("_last"))
        .select("customer_id", "_last.*")
    )


def access_of(as_of, grace_days: int) -> tuple[Column, Column]:
    """``(tier, expiry)`` of a deciding event."""
    status, end = F.col("status"), F.col("period_end")
    paying = status.isin("active", "trialing") & end.isNotNull()
    late = status == "past_due"
    leaving = (status == "canceled") & end.isNotNull() & (end > nm.moment(as_of))
    grace = F.coalesce(end, F.col("created")) + F.make_dt_interval(F.lit(grace_days))
    tier = F.when(paying | late | leaving, "pro").otherwise("free")
    expiry = F.when(paying | leaving, end).when(late, grace)
    return tier, expiry


def subscription_state(
    events: DataFrame, as_of, grace_days: int = DEFAULTS.past_due_grace_days
) -> DataFrame:
    """Tier and expiry per customer after all events."""
    tier, expiry = access_of(as_of, grace_days)
    return latest_events(events).select(
        "customer_id",
        "subscription_id",
        "price_id",
        F.col("status").alias("subscription_status"),
        F.col("created").alias("state_created_at"),
        tier.alias("subscription_tier"),
        expiry.alias("entitlement_expires_at"),
    )


def apply_state(users: DataFrame, state: DataFrame) -> DataFrame:
    """Update known users whose stored state is older; unknown customers are left out."""
    changed = ("subscription_tier", "entitlement_expires_at")
    fresh = state.select(
        "customer_id",
        F.col("state_created_at").alias("_created"),
        *[F.col(c).alias(f"_{c}") for c in changed],
    )
    stored = "state_created_at" in users.columns
    joined = users.join(fresh, "customer_id", "left")
    newer = F.col("_created").isNotNull()
    if stored:
        newer = newer & (F.col("state_created_at").isNull() | (F.col("_created") > F.col("state_created_at")))
    columns = []
    for name in users.columns:
        if name in changed:
            columns.append(F.when(newer, F.col(f"_{name}")).otherwise(F.col(name)).alias(name))
        elif name == "state_created_at":
            columns.append(F.when(newer, F.col("_created")).otherwise(F.col(name)).alias(name))
        else:
            columns.append(F.col(name))
    return joined.select(*columns)
