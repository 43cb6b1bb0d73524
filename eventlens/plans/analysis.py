"""One analysis run over landed completions: evidence, queue, budget, checks, results.

A run looks at no more than one hundred uncached events, so everything after the queue is a
table of at most two hundred calls; windows without a partition are bounded by that limit.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventlens import config
from eventlens.config import DEFAULTS, Settings
from eventlens.functions import digests
from eventlens.functions import numbers as nm
from eventlens.operators import contracts, evidence, ledger
from eventlens.session import cut

PLACE = ["place", "stage_no"]


@dataclass(frozen=True)
class AnalysisResult:
    clusters: DataFrame
    calls: DataFrame
    counts: DataFrame
    results: DataFrame


def stage_requests(rows: DataFrame, stage: str, system: str, settings: Settings) -> DataFrame:
    """Add model, prompt version, limit, messages and cache key of one stage."""
    first = stage == "summary"
    fields = [T.StructField("evidence", evidence.EVIDENCE_TYPE)]
    parts = [evidence.evidence_struct().alias("evidence")]
    if not first:
        fields.append(T.StructField("draft_summary", T.StringType()))
        parts.append(F.col("summary").alias("draft_summary"))
    user = digests.canonical_json(F.struct(*parts), T.StructType(fields))
    message = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    requests = rows.withColumns(
        {
            "stage": F.lit(stage),
            "stage_no": F.lit(1 if first else 2),
            "model": F.lit(settings.summary_model if first else settings.analysis_model),
            "prompt_version": F.lit(
                config.SUMMARY_PROMPT_VERSION if first else config.ANALYSIS_PROMPT_VERSION
            ),
            "max_tokens": F.lit(settings.summary_max_tokens if first else settings.analysis_max_tokens),
            "messages": F.array(message("system", F.lit(system)), message("user", user)),
        }
    )
    return ledger.cache_key(requests, settings)


def attach_completions(requests: DataFrame, completions: DataFrame, calls: DataFrame) -> DataFrame:
    """Join landed responses ``(cache_key, payload)`` and stored outputs of earlier calls."""
    stored = ledger.cached_outputs(calls, requests.select("cache_key").distinct())
    known = stored.where(F.col("cached_call_id").isNotNull()).join(
        calls.select(F.col("call_id").alias("cached_call_id"), F.col("output").alias("cached_output")),
        "cached_call_id",
    )
    landed = completions.groupBy("cache_key").agg(F.min("payload").alias("payload"))
    return requests.join(known.select("cache_key", "cached_output"), "cache_key", "left").join(
        landed, "cache_key", "left"
    )


def checked_calls(attached: DataFrame, stage: str) -> DataFrame:
    """Add content, error, usage and cost of every request."""
    cached = F.col("cached_output").isNotNull()
    content = F.when(cached, F.col("cached_output")).otherwise(F.col("usage.content"))
    violations = (
        contracts.summary_violations("content") if stage == "summary" else contracts.analysis_violations("content")
    )
    links = F.try_variant_get(F.try_parse_json("content"), "$.code_paper_links", "array<string>")
    grounded = evidence.links_grounded(links, F.col("allowed_links")) if stage == "analysis" else F.lit(True)
    structured = (F.size(violations) == 0) & F.coalesce(grounded, F.lit(False))
    read = attached.withColumn("envelope_error", contracts.completion_error("payload")).withColumn(
        "usage", contracts.completion_fields("payload")
    )
    usable = ~F.coalesce(F.col("envelope_error").isin("invalid_usage", "invalid_response"), F.lit(False))
    known = usable & F.col("payload").isNotNull()
    actual = nm.estimate_cost("model", "usage.input_tokens", "usage.cached_input_tokens", "usage.output_tokens")
    reserved = nm.reserve_cost("model", F.transform("messages", lambda m: m["content"]), F.col("max_tokens"))
    error = (
        F.when(cached & structured, None)
        .when(cached, "invalid_structured_output")
        .when(F.col("payload").isNull(), "awaiting")
        .when(F.col("envelope_error").isNotNull(), F.col("envelope_error"))
        .when(~structured, "invalid_structured_output")
    )
    return (
        read.withColumn("cached", cached)
        .withColumn("content", content)
        .withColumn("error", error)
        .withColumn("reservation", reserved)
        .withColumn("cost_is_upper_bound", ~known)
        .withColumn(
            "estimated_cost_usd",
            F.when(cached | (F.col("error") == "awaiting"), 0.0)
            .when(known, actual)
            .otherwise(F.col("reservation")),
        )
    )


def _cut_off(calls: DataFrame, budget: float) -> DataFrame:
    """Calls up to the first that does not fit the budget (kept as ``budget``) or the first
    failure that ends the run. Earlier calls count with their settled cost."""
    before = Window.orderBy(*PLACE).rowsBetween(Window.unboundedPreceding, -1)
    spent = F.coalesce(F.sum("estimated_cost_usd").over(before), F.lit(0.0))
    asked = ~F.col("cached") & ~F.coalesce(F.col("error") == "awaiting", F.lit(False))
    over = asked & (spent + F.col("reservation") > budget)
    flagged = calls.withColumn("over", over).withColumn(
        "fatal", F.coalesce(F.col("error").isin(*ledger.FATAL), F.lit(False))
    )
    ended = F.coalesce(F.max((F.col("over") | F.col("fatal")).cast("int")).over(before), F.lit(0)) == 1
    return flagged.withColumn("ended", ended).where(~F.col("ended")).drop("ended")


def run_analysis(
    clusters: DataFrame,
    members: DataFrame,
    articles: DataFrame,
    sources: DataFrame,
    calls: DataFrame,
    completions: DataFrame,
    as_of,
    system: tuple[str, str] = ("", ""),
    settings: Settings = DEFAULTS,
    limit: int | None = None,
    run_id: str = "run",
) -> AnalysisResult:
    """``calls`` is the ledger: call_id, cache_key, status, output, created_at and costs."""
    since = nm.moment(as_of) - F.make_dt_interval(F.lit(settings.lookback_days))
    recent = clusters.where(F.col("latest_published_at") >= since)
    packs = cut(
        evidence.input_hash(
            evidence.build_evidence(
                recent, members.join(recent.select("cluster_id"), "cluster_id", "left_semi"),
                articles, sources,
            ),
            settings,
        )
    )
    unchanged = (
        (F.col("analysis_status") == "ready")
        & (F.col("analysis_input_hash") == F.col("input_hash"))
        & (F.coalesce("summary", F.lit("")) != "")
        & F.col("analysis").isNotNull()
    )
    states = recent.join(packs.select("cluster_id", "input_hash", "enough"), "cluster_id").select(
        "cluster_id", "latest_published_at", "input_hash", "enough",
        F.coalesce(unchanged, F.lit(False)).alias("unchanged"),
    )
    queue = cut(ledger.analysis_queue(states, limit or settings.analysis_cluster_limit))
    attempts = queue.where(F.col("outcome") == "attempt").withColumn(
        "place", F.row_number().over(Window.orderBy(ledger.queue_key()))
    )
    rows = attempts.drop("outcome", "input_hash", "enough").join(packs, "cluster_id")
    first = cut(
        checked_calls(
            attach_completions(stage_requests(rows, "summary", system[0], settings), completions, calls),
            "summary",
        )
    )
    sentences = F.try_variant_get(F.try_parse_json("content"), "$.sentences", "array<string>")
    summaries = first.where(F.col("error").isNull()).select(
        *rows.columns, F.array_join(F.transform(sentences, lambda t: F.btrim(t)), " ").alias("summary")
    )
    second = cut(
        checked_calls(
            attach_completions(stage_requests(summaries, "analysis", system[1], settings), completions, calls),
            "analysis",
        )
    )
    kept = ["cluster_id", "place", "stage", "stage_no", "model", "prompt_version", "cache_key", "cached",
            "error", "content", "usage", "reservation", "estimated_cost_usd", "cost_is_upper_bound"]
    both = first.select(*kept, F.lit(None).cast("string").alias("summary")).unionByName(
        second.select(*kept, "summary")
    )
    made = cut(_cut_off(both, settings.analysis_budget_usd))
    results = cut(_results(queue, made))
    ledger_rows = made.where(~F.col("cached") & ~F.col("over") & (F.coalesce("error", F.lit("")) != "awaiting"))
    new_calls = ledger_rows.select(
        F.sha2(F.concat_ws("|", F.lit(run_id), "cluster_id", "stage"), 256).alias("call_id"),
        F.lit(run_id).alias("run_id"),
        F.col("cluster_id").cast("string").alias("cluster_id"),
        "cache_key",
        "stage",
        "model",
        F.col("usage.model").alias("returned_model"),
        "prompt_version",
        F.when(F.col("error").isNull(), "succeeded").otherwise("failed").alias("status"),
        F.when(F.col("error").isNull(), F.col("content")).alias("output"),
        "usage.input_tokens",
        "usage.cached_input_tokens",
        "usage.output_tokens",
        "estimated_cost_usd",
        "cost_is_upper_bound",
        F.lit(config.PRICING_VERSION).alias("pricing_version"),
        "error",
        nm.moment(as_of).alias("created_at"),
    )
    updated = ledger.apply_analysis(clusters, results, as_of)
    return AnalysisResult(
        clusters=updated,
        calls=calls.unionByName(new_calls, allowMissingColumns=True),
        counts=ledger.analysis_counts(results),
        results=results,
    )


def _results(queue: DataFrame, made: DataFrame) -> DataFrame:
    """One row per cluster the run looked at."""
    one = lambda column, stage: F.max(F.when(F.col("stage") == stage, column))
    text = lambda name: F.try_variant_get(F.try_parse_json("analysis"), f"$.{name}", "string")
    per = made.groupBy("cluster_id").agg(
        F.max("over").alias("over"),
        F.max(F.when(~F.col("over"), F.col("error"))).alias("error"),
        one(F.col("cached"), "summary").alias("summary_cache_hit"),
        one(F.col("cached"), "analysis").alias("analysis_cache_hit"),
        F.max("summary").alias("summary"),
        one(F.when(F.col("error").isNull() & ~F.col("over"), F.col("content")), "analysis").alias("analysis"),
    )
    state: Column = (
        F.when(F.col("outcome") != "attempt", F.col("outcome"))
        .when(F.col("over"), "budget")
        .when(F.col("error") == "awaiting", "awaiting")
        .when(F.col("error").isNotNull(), "failed")
        .when(F.col("analysis").isNotNull(), "ready")
        .otherwise("skipped")
    )
    return queue.select("cluster_id", "input_hash", "outcome").join(per, "cluster_id", "left").select(
        "cluster_id",
        state.alias("outcome"),
        "error",
        "summary",
        "analysis",
        text("technical_significance").cast("int").alias("significance_score"),
        text("event_type").alias("event_type"),
        "input_hash",
        "summary_cache_hit",
        "analysis_cache_hit",
    )
