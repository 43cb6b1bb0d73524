"""What one round of reading did to each source: state, reports, dispatch."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventlens import config
from eventlens.functions import numbers as nm
from eventlens.sources import discussions, feeds
from eventlens.sources.registry import union_candidates

ERRORS_KEPT = 10


def normalize(payloads: DataFrame, limit: int, as_of, lookback_days: int) -> DataFrame:
    """Dispatch landed payloads ``(source_id, type, format, rank, payload_id, base_url, payload)``
    to the normalizer of their source type; an unknown type fails the job."""
    known = F.col("type").isin(*config.SOURCE_TYPES)
    checked = payloads.withColumn(
        "type",
        F.when(known, F.col("type")).otherwise(
            F.raise_error(F.concat(F.lit("unsupported source type: "), "type")).cast("string")
        ),
    )
    papers = checked.where(F.col("type") == "arxiv")
    snapshot = F.col("format") == "snapshot"
    return union_candidates(
        feeds.parse_feeds(checked.where(F.col("type") == "rss"), limit),
        feeds.parse_arxiv_atom(papers.where(~F.coalesce(snapshot, F.lit(False))), limit),
        feeds.parse_arxiv_rss(papers.where(snapshot), limit, lookback_days, as_of),
        discussions.normalize_items(checked.where(F.col("type") == "hackernews"), limit),
    )


def first_errors(errors: DataFrame, n: int = ERRORS_KEPT) -> DataFrame:
    """The first ``n`` errors of every source as one text; ``errors`` is
    ``(source_id, position, error)``. No more than ``n`` rows per source are gathered."""
    window = Window.partitionBy("source_id").orderBy("position")
    kept = errors.withColumn("_place", F.row_number().over(window)).where(F.col("_place") <= n)
    ordered = F.array_sort(F.collect_list(F.struct("_place", "error")))
    return kept.groupBy("source_id").agg(
        F.array_join(F.transform(ordered, lambda e: e["error"]), "; ").alias("last_error")
    )


def advance_state(sources: DataFrame, states: DataFrame, errors: DataFrame, as_of) -> DataFrame:
    """Source rows after a round.

    ``states`` is ``(source_id, state map<string,string>)`` for sources that were read. Cache
    validators move on only without errors, so that failed items are read again; coverage keys
    are kept in either case.
    """
    failed = first_errors(errors).withColumnRenamed("last_error", "new_error")
    joined = sources.join(states, "source_id", "left").join(failed, "source_id", "left")
    clean = F.col("new_error").isNull()
    read = F.col("state").isNotNull()
    kept = F.map_filter("state", lambda k, v: k.isin("fetch_mode", "scope_note"))
    incoming = F.when(clean, F.col("state")).otherwise(kept)
    remaining = F.map_filter("config", lambda k, v: ~F.map_contains_key(incoming, k))
    changed = {
        "config": F.when(read, F.map_concat(remaining, incoming)).otherwise(F.col("config")),
        "last_fetched_at": F.when(read & clean, nm.moment(as_of)).otherwise(F.col("last_fetched_at")),
        "last_error": F.when(read & clean, None).otherwise(F.coalesce("new_error", "last_error")),
    }
    return joined.select(*[changed.get(c, F.col(c)).alias(c) for c in sources.columns])


def source_report(sources: DataFrame, candidates: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Status, item count and warnings of every registered source.

    ``outcomes`` is ``(source_id, error, warnings array<string>)``, one row per read source.
    """
    counts = candidates.groupBy("source_id").agg(F.count(F.lit(1)).alias("items"))
    return (
        sources.select("source_id", "name")
        .join(outcomes, "source_id", "left")
        .join(counts, "source_id", "left")
        .select(
            F.col("name").alias("source"),
            F.when(F.col("error").isNull(), "ok").otherwise("failed").alias("status"),
            F.when(F.col("error").isNull(), F.coalesce("items", F.lit(0))).alias("items"),
            "warnings",
            "error",
        )
    )
