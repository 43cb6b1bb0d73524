"""Cost ledger, stage cache, budgets, the analysis queue and status bookkeeping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventlens import config
from eventlens.config import DEFAULTS, Settings
from eventlens.functions import digests
from eventlens.functions import numbers as nm
from eventlens.operators import feed, scans

LEDGER_COLUMNS = (
    "call_id",
    "cluster_id",
    "stage",
    "status",
    "model",
    "returned_model",
    "prompt_version",
    "input_tokens",
    "cached_input_tokens",
    "output_tokens",
    "estimated_cost_usd",
    "cost_is_upper_bound",
    "pricing_version",
    "error",
    "created_at",
)
# Failures that end a run instead of only one event.
FATAL = (
    "unauthorized",
    "insufficient_balance",
    "rate_limited",
    "timeout",
    "transport_error",
    "invalid_usage",
    "invalid_response",
    "unexpected_provider_failure",
)
MESSAGES_TYPE = T.ArrayType(
    T.StructType([T.StructField("role", T.StringType()), T.StructField("content", T.StringType())])
)


def cache_key(requests: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Add ``cache_key`` over provider, stage, model, prompt version, limit and messages."""
    kind = T.StructType(
        [
            T.StructField("provider", T.StringType()),
            T.StructField("stage", T.StringType()),
            T.StructField("model", T.StringType()),
            T.StructField("prompt", T.StringType()),
            T.StructField("max_tokens", T.LongType()),
            T.StructField("messages", MESSAGES_TYPE),
        ]
    )
    value = F.struct(
        F.lit(settings.provider).alias("provider"),
        "stage",
        "model",
        F.col("prompt_version").alias("prompt"),
        "max_tokens",
        "messages",
    )
    return requests.withColumn("cache_key", digests.digest(value, kind))


def cached_outputs(calls: DataFrame, keys: DataFrame) -> DataFrame:
    """Newest succeeded call of every requested key, found with map-side combining."""
    order = F.struct((-F.unix_micros("created_at")).alias("age"), F.col("call_id"))
    newest = (
        calls.where(F.col("status") == "succeeded")
        .groupBy("cache_key")
        .agg(F.min_by("call_id", order).alias("cached_call_id"))
    )
    return keys.join(newest, "cache_key", "left")


def reserve(calls: DataFrame) -> DataFrame:
    """Add ``reservation``, the upper bound journaled before a call."""
    return calls.withColumn("reservation", nm.reserve_cost("model", "messages", "max_tokens"))


def settle(calls: DataFrame, completions: DataFrame) -> DataFrame:
    """Replace reservations by actual cost where usage is known.

    ``completions`` carries ``call_id, returned_model, input_tokens, cached_input_tokens,
    output_tokens``; a call without usage keeps its reservation as an upper bound.
    """
    known = completions.select(
        "call_id", "returned_model", "input_tokens", "cached_input_tokens", "output_tokens"
    )
    actual = nm.estimate_cost("model", "input_tokens", "cached_input_tokens", "output_tokens")
    return (
        reserve(calls.drop("returned_model", "input_tokens", "cached_input_tokens", "output_tokens"))
        .join(known, "call_id", "left")
        .withColumn("cost_is_upper_bound", F.col("input_tokens").isNull())
        .withColumn("estimated_cost_usd", F.coalesce(actual, "reservation"))
        .withColumn("pricing_version", F.lit(config.PRICING_VERSION))
    )


def total_cost(ledger: DataFrame) -> DataFrame:
    return ledger.agg(
        F.coalesce(F.sum("estimated_cost_usd"), F.lit(0.0)).alias("estimated_total_cost_usd")
    )


def run_costs(ledger: DataFrame) -> DataFrame:
    return ledger.groupBy("run_id").agg(
        F.sum("estimated_cost_usd").alias("estimated_cost_usd"), F.count(F.lit(1)).alias("calls")
    )


def ledger_view(ledger: DataFrame) -> DataFrame:
    """Operator view without outputs and request ids."""
    missing = set(LEDGER_COLUMNS) - set(ledger.columns)
    return ledger.select(
        *[F.lit(None).cast("string").alias(c) if c in missing else F.col(c) for c in LEDGER_COLUMNS]
    )


def recent_calls(ledger: DataFrame, n: int = 20) -> DataFrame:
    return feed.recent(ledger_view(ledger), "created_at", n, tie="call_id")


def within_budget(plan: DataFrame, budget: float, keys=("run_id",), order=("created_at", "call_id")) -> DataFrame:
    """Requests admitted before the first one of a run that does not fit the budget.

    Reservations are positive, so a running total never comes back under the budget.
    """
    return scans.prefix_within(plan, list(keys), F.col("reservation"), budget, [F.col(c) for c in order])


def queue_key() -> Column:
    """Newest first, then id, as one ascending value."""
    return F.struct((-F.unix_micros("latest_published_at")).alias("age"), F.col("cluster_id"))


def analysis_queue(states: DataFrame, limit: int) -> DataFrame:
    """Rows one run looks at, with ``outcome`` cached, insufficient_evidence or attempt.

    ``states`` carries cluster_id, latest_published_at, unchanged (ready with the same input)
    and enough. The run stops at the first uncached row after ``limit`` attempts. Two bounded
    top-k selections find that row, so the table is never sorted as a whole.
    """
    if not 1 <= limit <= 100:
        raise ValueError("limit must be between 1 and 100")
    keyed = states.withColumn("_key", queue_key())
    attempt = ~F.col("unchanged") & F.col("enough")
    last = (
        keyed.where(attempt)
        .select("_key")
        .orderBy("_key")
        .limit(limit)
        .agg(F.when(F.count(F.lit(1)) == limit, F.max("_key")).alias("last"))
    )
    stop = (
        keyed.where(~F.col("unchanged") & (F.col("_key") > last.scalar()))
        .agg(F.min("_key").alias("stop"))
        .scalar()
    )
    outcome = (
        F.when(F.col("unchanged"), "cached")
        .when(~F.col("enough"), "insufficient_evidence")
        .otherwise("attempt")
    )
    return (
        keyed.withColumn("_stop", stop)
        .where(F.col("_stop").isNull() | (F.col("_key") < F.col("_stop")))
        .drop("_key", "_stop")
        .withColumn("outcome", outcome)
    )


def analysis_counts(results: DataFrame) -> DataFrame:
    """Counters of one run over rows with ``outcome`` and the two cache flags."""
    hit = lambda name: F.count_if(F.coalesce(name, F.lit(False))).alias(f"{name}s")
    count = lambda name: F.count_if(F.col("outcome") == name).alias(name)
    return results.agg(
        count("ready"),
        count("cached"),
        hit("summary_cache_hit"),
        hit("analysis_cache_hit"),
        count("failed"),
        count("insufficient_evidence"),
    )


def recover_runs(runs: DataFrame, as_of) -> DataFrame:
    """Runs left ``running`` by a dead writer become ``interrupted``."""
    stale = F.col("status") == "running"
    return runs.withColumn(
        "finished_at", F.when(stale, nm.moment(as_of)).otherwise(F.col("finished_at"))
    ).withColumn("status", F.when(stale, "interrupted").otherwise(F.col("status")))


def recover_calls(calls: DataFrame, as_of) -> DataFrame:
    """Calls left ``started`` become failed; their reserved cost stays."""
    stale = F.col("status") == "started"
    return (
        calls.withColumn("error", F.when(stale, "interrupted").otherwise(F.col("error")))
        .withColumn("finished_at", F.when(stale, nm.moment(as_of)).otherwise(F.col("finished_at")))
        .withColumn("status", F.when(stale, "failed").otherwise(F.col("status")))
    )


def apply_analysis(clusters: DataFrame, results: DataFrame, as_of) -> DataFrame:
    """Write stage results onto clusters.

    ``results`` has one row per cluster a run looked at: cluster_id, outcome (ready, failed,
    insufficient_evidence, budget, cached), error, summary, analysis, significance_score,
    event_type, input_hash. A summary survives a failed second stage.
    """
    fields = ("summary", "analysis", "significance_score", "event_type")
    renamed = results.select(
        "cluster_id",
        "outcome",
        F.col("error").alias("new_error"),
        F.col("input_hash").alias("new_hash"),
        *[F.col(c).alias(f"new_{c}") for c in fields],
    )
    joined = clusters.join(renamed, "cluster_id", "left")
    touched = F.col("outcome").isin("ready", "failed", "insufficient_evidence", "budget")
    touched = F.coalesce(touched, F.lit(False))
    ready = F.coalesce(F.col("outcome") == "ready", F.lit(False))
    status = F.when(F.col("outcome") == "budget", "pending").otherwise(F.col("outcome"))
    note = (
        F.when(ready, None)
        .when(F.col("outcome") == "insufficient_evidence", "At least 40 words of source text are required")
        .when(F.col("outcome") == "budget", "Run budget reached")
        .otherwise(F.col("new_error"))
    )
    replaced = {
        "summary": F.col("new_summary"),
        "analysis": F.when(ready, F.col("new_analysis")),
        "significance_score": F.when(ready, F.col("new_significance_score")),
        "event_type": F.when(ready, F.col("new_event_type")),
        "analysis_input_hash": F.when(ready, F.col("new_hash")),
        "analysis_status": status,
        "analysis_error": note,
        "analyzed_at": F.when(ready, nm.moment(as_of)),
    }
    return joined.select(
        *[
            F.when(touched, replaced[c]).otherwise(F.col(c)).alias(c) if c in replaced else F.col(c)
            for c in clusters.columns
        ]
    )
