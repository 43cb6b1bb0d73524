"""Tunable thresholds and the fixed values every operator shares."""

from __future__ import annotations

from dataclasses import dataclass

# Limits and defaults that results depend on.
EMBEDDING_DIMENSIONS = 384
EMBEDDING_SPACE = "hashed-ngrams-384@1"
RANKING_VERSION = "editorial-v1"
RANKING_WEIGHTS = {"technical_significance": 0.45, "diversity": 0.30, "engagement": 0.25}
RECENCY_HALF_LIFE_HOURS = 36
ENGAGEMENT_SATURATION = 1500
DIVERSITY_SATURATION = 5
COVERAGE_LIMIT = 10
EVIDENCE_ARTICLES = 4
EXCERPT_WORDS = 1200
EXCERPT_CHARS = 12000
SHORT_TEXT_WORDS = 80
MIN_EVIDENCE_WORDS = 40
QUALITY_WORD_CAP = 3000
ENRICH_BELOW_WORDS = 300
EMBEDDING_WORDS = 300
FREE_TOPIC_LIMIT = 3
SOURCE_TYPES = ("arxiv", "hackernews", "rss")
FEATURES = ("alerts", "api_quotas", "archive", "full_analysis", "unlimited_topics")
EVENT_TYPES = (
    "model_release",
    "paper",
    "funding",
    "regulation",
    "research_breakthrough",
    "tool_release",
    "other",
)
HYPE_LABELS = ("overhyped", "underhyped", "accurate")

# Topic catalog, id -> (label, keywords).
TOPICS = {
    "llm": ("Language models", ("language model", "llm", "fine-tun", "inference")),
    "agents": ("AI agents", ("agent", "tool use", "tool-use")),
    "vision": ("Computer vision", ("vision", "image", "video", "multimodal")),
    "open_source": ("Open source", ("open source", "open-source", "open weight", "open-weight")),
    "research": ("Research", ("research", "paper", "benchmark", "arxiv")),
    "policy": ("AI policy", ("policy", "regulat", "governance", "safety")),
    "robotics": ("Robotics", ("robot", "embodied", "autonomous")),
    "infrastructure": ("Infrastructure", ("infrastructure", "gpu", "serving", "deployment")),
}

# USD per million tokens (cache hit, cache miss, output).
PRICING_VERSION = "deepseek-peak-usd-2026-09-13"
RATES = {
    "deepseek-flash": (0.006, 0.30, 1.20),
    "deepseek-v4-pro": (0.044, 1.32, 3.96),
}
SUMMARY_PROMPT_VERSION = "summary-v1"
ANALYSIS_PROMPT_VERSION = "analysis-v2"


@dataclass(frozen=True)
class Settings:
    """Parameters of one run; ``as_of`` is always passed to operators explicitly."""

    source_limit: int = 100
    lookback_days: int = 7
    cluster_window_hours: int = 72
    cluster_similarity: float = 0.85
    simhash_distance: int = 3
    simhash_min_words: int = 80
    simhash_hash: str = "xxhash64"
    near_dup_days: int = 7
    near_dup_low: float = 0.8
    near_dup_high: float = 1.25
    past_due_grace_days: int = 3
    provider: str = "deepseek"
    summary_model: str = "deepseek-flash"
    analysis_model: str = "deepseek-v4-pro"
    summary_max_tokens: int = 768
    analysis_max_tokens: int = 2048
    analysis_cluster_limit: int = 10
    analysis_budget_usd: float = 0.25


DEFAULTS = Settings()
