"""Feed, detail and status queries over a table set."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventlens.functions import numbers as nm
from eventlens.operators import coverage as cv
from eventlens.operators import feed, ledger, topics
from eventlens.operators import ranking as rk
from eventlens.plans.tables import Tables


@dataclass(frozen=True)
class FeedQuery:
    window: str = "week"
    sort: str = "ranked"
    q: str = ""
    topic: str | None = None
    following: bool = False
    event_type: str | None = None
    limit: int = 12
    offset: int = 0


def _ranked(tables: Tables, clusters: DataFrame, as_of, page: bool = False) -> DataFrame:
    rank = rk.rank_page if page else rk.rank_clusters
    return rank(
        clusters, tables.members, tables.articles, tables.observations, tables.sources, as_of
    )


def cluster_page(
    tables: Tables, clusters: DataFrame, sort: str, limit: int, offset: int, as_of
) -> DataFrame:
    """One page with its scores.

    By time, the page is cut first and only its rows are scored. By rank, every filtered
    cluster is scored and each task forwards only its best ``offset + limit`` rows.
    """
    if sort == "latest":
        rows = feed.page(clusters, rk.by_time(), limit, offset)
        return rk.order_latest(_ranked(tables, rows, as_of, page=True))
    if sort == "ranked":
        return feed.page(_ranked(tables, clusters, as_of), rk.by_rank(), limit, offset)
    raise ValueError(f"unknown sort: {sort}")


def filtered_events(tables: Tables, query: FeedQuery, user_id, as_of) -> DataFrame:
    """Clusters of a customer feed before paging; time bounds come before the article join."""
    rows = feed.not_future(feed.feed_window(tables.clusters, query.window, as_of), as_of)
    rows = feed.event_type(rows, query.event_type)
    rows = feed.search(feed.with_primary(rows, tables.articles), query.q)
    if query.topic:
        rows = rows.where(topics.topic_match(query.topic))
    if query.following:
        rows = topics.following(rows, tables.user_topics, user_id)
    return rows


def require_feature(tables: Tables, user_id, feature: str, as_of) -> None:
    """Raise unless the one user has the feature; reads a single row by key."""
    access = nm.entitlement("subscription_tier", "entitlement_expires_at", as_of)
    row = (
        tables.users.where(F.col("user_id") == user_id)
        .select(F.array_contains(access["features"], feature).alias("ok"))
        .first()
    )
    if row is None or not row.ok:
        raise PermissionError(f"a pro subscription is required for {feature}")


def customer_feed(tables: Tables, query: FeedQuery, user_id, as_of) -> DataFrame:
    """Items of one page; ``total`` counts all matching events."""
    if query.window == "all":
        require_feature(tables, user_id, "archive", as_of)
    rows = filtered_events(tables, query, user_id, as_of)
    total = feed.total(rows).scalar()
    items = cluster_page(tables, rows, query.sort, query.limit, query.offset, as_of)
    return feed.customer_view(items).withColumn("total", total)


def event_coverage(tables: Tables, cluster_id=None) -> DataFrame:
    """Coverage rows of one event or of all."""
    members = tables.members
    if cluster_id is not None:
        members = members.where(F.col("cluster_id") == cluster_id)
    return cv.coverage(members, tables.articles, tables.observations, tables.sources)


def customer_detail(
    tables: Tables, cluster_id, user_id, as_of
) -> tuple[DataFrame, DataFrame]:
    """``(event, coverage rows)`` of one event with its analysis gated for the user."""
    one = tables.clusters.where(F.col("cluster_id") == cluster_id)
    row = _ranked(tables, feed.with_primary(one, tables.articles), as_of, page=True)
    user = tables.users.where(F.col("user_id") == user_id)
    access = nm.entitlement("subscription_tier", "entitlement_expires_at", as_of)
    features = user.agg(F.first(access["features"])).scalar()
    event = feed.customer_view(feed.gate_analysis(row, features))
    rows = feed.customer_view(event_coverage(tables, cluster_id))
    return event, rows.orderBy(*cv.coverage_order())


def public_feed(tables: Tables, limit: int, offset: int, as_of) -> DataFrame:
    """Public page by time with the number of all public events; the page is cut before articles
    are joined."""
    public = feed.not_future(tables.clusters, as_of)
    total = feed.total(public).scalar()
    rows = feed.page(public, rk.by_time(), limit, offset, most=50)
    events = feed.public_events(feed.with_primary(rows, tables.articles)).withColumn("total", total)
    return events.orderBy(F.desc("published_at"), F.asc("id"))


def public_event(tables: Tables, cluster_id, as_of) -> DataFrame:
    """One public event with at most ten covering articles."""
    one = feed.not_future(tables.clusters.where(F.col("cluster_id") == cluster_id), as_of)
    events = feed.public_events(feed.with_primary(one, tables.articles))
    entries = cv.public_coverage(event_coverage(tables, cluster_id))
    return events.join(entries.withColumnRenamed("cluster_id", "id"), "id", "left")


def today_top(
    tables: Tables, as_of, topic: str | None = None, sort: str = "ranked", limit: int = 20,
    offset: int = 0,
) -> DataFrame:
    rows = feed.topic_contains(feed.today(tables.clusters, as_of), topic)
    return cluster_page(tables, rows, sort, limit, offset, as_of)


def all_clusters(
    tables: Tables, as_of, topic: str | None = None, sort: str = "ranked", limit: int = 20,
    offset: int = 0,
) -> DataFrame:
    rows = feed.topic_contains(tables.clusters, topic)
    return cluster_page(tables, rows, sort, limit, offset, as_of)


def run_history(runs: DataFrame, n: int = 20) -> DataFrame:
    return feed.recent(runs, "started_at", n, tie="run_id")


def analysis_status(runs: DataFrame, calls: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(runs, recent calls, total cost)``: histories of twenty, the total over everything."""
    return run_history(runs), ledger.recent_calls(calls), ledger.total_cost(calls)
