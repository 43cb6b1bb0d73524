"""Which candidates enter: time window, subject filter, enrichment, counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventlens import config
from eventlens.functions import numbers as nm
from eventlens.functions import text as tx

# The subject terms, each matched as a whole word in any case.
SUBJECT_TERMS = (
    "ai",
    "artificial intelligence",
    "machine learning",
    "deep learning",
    "llms?",
    r"gpt[\w.-]*",
    "openai",
    "anthropic",
    "claude",
    "gemini",
    "llama",
    "mistral",
    "qwen",
    "deepseek",
    "neural",
    "diffusion",
    "transformers?",
    "pytorch",
    "tensorflow",
    r"hugging\s?face",
    "computer vision",
    "reinforcement learning",
    r"fine.tun\w*",
)
SUBJECT = r"(?iU)\b(?:" + "|".join(SUBJECT_TERMS) + r")\b"


def mentions_ai(text: Column) -> Column:
    return text.rlike(SUBJECT)


def in_window(as_of, days: int) -> Column:
    """No date, or not older than ``days`` and at most an hour ahead."""
    now, when = nm.moment(as_of), F.col("published_at")
    oldest = now - F.make_dt_interval(F.lit(days))
    newest = now + F.expr("INTERVAL 1 HOUR")
    return when.isNull() | when.between(oldest, newest)


def admit_window(df: DataFrame, as_of, days: int = config.DEFAULTS.lookback_days) -> DataFrame:
    return df.where(in_window(as_of, days))


def on_subject() -> Column:
    """True for sources that need no filter (``ai_filter`` unset) and for matching text."""
    text = F.concat("title", F.lit(" "), F.coalesce("body", F.lit("")))
    return ~F.coalesce(F.col("ai_filter"), F.lit(False)) | mentions_ai(text)


def ai_relevant(df: DataFrame) -> DataFrame:
    return df.where(on_subject())


def admission(df: DataFrame, as_of, days: int = config.DEFAULTS.lookback_days) -> DataFrame:
    """Add ``admission``: admitted, outside_window or off_subject."""
    return df.withColumn(
        "admission",
        F.when(~in_window(as_of, days), "outside_window")
        .when(~on_subject(), "off_subject")
        .otherwise("admitted"),
    )


def enrich(candidates: DataFrame, extracted: DataFrame) -> DataFrame:
    """Take extracted page text for short candidates where it has more words.

    ``extracted`` is ``(url, text)`` with one row per URL. Adds ``extraction_fallback``.
    """
    words = tx.word_count("body")
    joined = candidates.join(extracted.select("url", F.col("text").alias("_text")), "url", "left")
    wanted = (F.col("type") != "arxiv") & (words < config.ENRICH_BELOW_WORDS)
    better = wanted & (tx.word_count(F.coalesce("_text", F.lit(""))) > words)
    replaced = {
        "body": F.when(better, F.col("_text")).otherwise(F.col("body")),
        "body_kind": F.when(better, "extracted").otherwise(F.col("body_kind")),
    }
    return joined.select(
        *[replaced.get(c, F.col(c)).alias(c) for c in candidates.columns],
        (wanted & ~better).alias("extraction_fallback"),
    )


def run_metrics(outcomes: DataFrame, errors: DataFrame | None = None) -> DataFrame:
    """Counters of a run from one row per candidate: ``admission``, ``created``, ``embedded``,
    ``clustered``, ``extraction_fallback``. Any error makes the run partial."""
    flag = lambda name: F.count_if(F.coalesce(F.col(name), F.lit(False)))
    admitted = F.col("admission") == "admitted"
    counts = outcomes.agg(
        F.count(F.lit(1)).alias("fetched"),
        F.count_if(admitted & F.coalesce("created", F.lit(False))).alias("created"),
        F.count_if(admitted & ~F.coalesce("created", F.lit(False))).alias("deduplicated"),
        F.count_if(~admitted).alias("filtered"),
        flag("embedded").alias("embedded"),
        flag("clustered").alias("clustered"),
        flag("extraction_fallback").alias("extraction_fallbacks"),
    )
    if errors is None:
        return counts.withColumn("status", F.lit("succeeded"))
    failed = errors.agg(F.count(F.lit(1))).scalar()
    return counts.withColumn("status", F.when(failed > 0, "partial").otherwise("succeeded"))
