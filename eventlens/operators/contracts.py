"""Strict checks of landed model outputs. No coercion: the JSON type itself must be right."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventlens import config
from eventlens.functions import numbers as nm
from eventlens.functions import text as tx
from eventlens.functions import urls

ANALYSIS_KEYS = (
    "event_type",
    "technical_significance",
    "who_should_care",
    "why_it_matters",
    "what_to_watch",
    "code_paper_links",
    "hype_check",
)


def _sub(json: Column, name: str) -> Column:
    return F.try_variant_get(json, f"$.{name}", "variant")


def _text(json: Column, name: str) -> Column:
    return F.try_variant_get(json, f"$.{name}", "string")


def _kind(json: Column) -> Column:
    return F.coalesce(F.schema_of_variant(json), F.lit("MISSING"))


def _is_text(json: Column) -> Column:
    return _kind(json) == "STRING"


def _is_list(json: Column) -> Column:
    return _kind(json).startswith("ARRAY")


def _is_object(json: Column) -> Column:
    return _kind(json).startswith("OBJECT")


def _items(json: Column) -> Column:
    """Elements of a JSON list; empty for anything else."""
    items = F.try_variant_get(json, "$", "array<variant>")
    return F.when(_is_list(json), items).otherwise(F.array().cast("array<variant>"))


def _stripped(json: Column) -> Column:
    return F.regexp_replace(
        F.try_variant_get(json, "$", "string"), f"^{tx.SPACE}+|{tx.SPACE}+$", ""
    )


def _bounded_text(json: Column, longest: int) -> Column:
    return _is_text(json) & F.char_length(_stripped(json)).between(1, longest)


def _violations(checks: dict[str, Column]) -> Column:
    """Names of the rules that do not hold; an undecidable rule does not hold."""
    return F.array_compact(
        F.array(*[F.when(~F.coalesce(ok, F.lit(False)), name) for name, ok in checks.items()])
    )


def summary_violations(content) -> Column:
    """Exactly ``sentences``: three to five texts of 1 to 1200 characters."""
    content = F.col(content) if isinstance(content, str) else content
    json = F.try_parse_json(content)
    sentences = _sub(json, "sentences")
    items = _items(sentences)
    return _violations(
        {
            "object": _is_object(json),
            "keys": F.array_sort(F.json_object_keys(content)) == F.array(F.lit("sentences")),
            "sentences": _is_list(sentences) & F.size(items).between(3, 5),
            "sentence_text": F.forall(items, lambda s: _bounded_text(s, 1200)),
        }
    )


def _usable_link(json: Column) -> Column:
    text = F.try_variant_get(json, "$", "string")
    return (
        _is_text(json)
        & F.char_length(text).between(1, 2048)
        & ~text.rlike(tx.SPACE)
        & text.rlike(r"^(?i)https?:/*[^/\\?#@]+(?:[/?#\\].*)?$")
        & urls.hostname(text).isNotNull()
    )


def analysis_violations(content) -> Column:
    """Exactly seven keys with their own types, ranges and vocabularies."""
    content = F.col(content) if isinstance(content, str) else content
    json = F.try_parse_json(content)
    audience, links = _sub(json, "who_should_care"), _sub(json, "code_paper_links")
    score = _sub(json, "technical_significance")
    expected = F.array(*[F.lit(k) for k in sorted(ANALYSIS_KEYS)])
    return _violations(
        {
            "object": _is_object(json),
            "keys": F.array_sort(F.json_object_keys(content)) == expected,
            "event_type": _is_text(_sub(json, "event_type"))
            & _text(json, "event_type").isin(*config.EVENT_TYPES),
            "technical_significance": nm.is_integer(score)
            & F.try_variant_get(score, "$", "double").between(1, 10),
            "who_should_care": _is_list(audience)
            & F.size(_items(audience)).between(1, 8)
            & F.forall(_items(audience), lambda a: _bounded_text(a, 120)),
            "why_it_matters": _bounded_text(_sub(json, "why_it_matters"), 2400),
            "what_to_watch": _bounded_text(_sub(json, "what_to_watch"), 2400),
            "code_paper_links": _is_list(links)
            & (F.size(_items(links)) <= 12)
            & F.forall(_items(links), _usable_link),
            "hype_check": _is_text(_sub(json, "hype_check"))
            & _text(json, "hype_check").isin(*config.HYPE_LABELS),
        }
    )


def _count(usage: Column, name: str) -> Column:
    value = _sub(usage, name)
    return F.when(nm.is_integer(value), F.try_variant_get(value, "$", "bigint"))


def _present(usage: Column, name: str) -> Column:
    return _kind(_sub(usage, name)) != "MISSING"


def _short_text(json: Column, longest: int) -> Column:
    text = F.try_variant_get(json, "$", "string")
    return _is_text(json) & (F.char_length(_stripped(json)) > 0) & (F.char_length(text) <= longest)


def completion_error(payload) -> Column:
    """First failing rule of a raw response, or null for a complete one."""
    payload = F.col(payload) if isinstance(payload, str) else payload
    json = F.try_parse_json(payload)
    usage = _sub(json, "usage")
    sent, cached = _count(usage, "prompt_tokens"), _count(usage, "prompt_cache_hit_tokens")
    out = _count(usage, "completion_tokens")
    missed, whole = _count(usage, "prompt_cache_miss_tokens"), _count(usage, "total_tokens")
    counts_ok = (
        _is_object(usage)
        & (sent >= 0)
        & (cached >= 0)
        & (out >= 0)
        & (cached <= sent)
        & (~_present(usage, "prompt_cache_miss_tokens") | ((missed >= 0) & (missed + cached == sent)))
        & (~_present(usage, "total_tokens") | ((whole >= 0) & (whole == sent + out)))
    )
    choices = _sub(json, "choices")
    choice = F.get(_items(choices), F.lit(0))
    message = _sub(choice, "message")
    content = _sub(message, "content")
    reason = _sub(choice, "finish_reason")
    request = _sub(json, "id")
    envelope_ok = (
        _is_list(choices)
        & (F.size(_items(choices)) == 1)
        & _is_object(choice)
        & _short_text(_sub(json, "model"), 100)
        & (_kind(request).isin("MISSING", "VOID") | _short_text(request, 255))
        & _is_object(message)
        & _kind(content).isin("STRING", "VOID")
        & _short_text(reason, 100)
    )
    reason_text = F.try_variant_get(reason, "$", "string")
    empty = (_kind(content) == "VOID") | (F.char_length(_stripped(content)) == 0)
    fails = lambda ok: ~F.coalesce(ok, F.lit(False))
    return (
        F.when(fails(_is_object(json)), "invalid_response")
        .when(fails(counts_ok), "invalid_usage")
        .when(fails(envelope_ok), "invalid_response")
        .when(reason_text == "length", "truncated_output")
        .when(reason_text != "stop", "incomplete_output")
        .when(empty, "empty_output")
    )


def completion_fields(payload) -> Column:
    """``struct<content, model, input_tokens, cached_input_tokens, output_tokens, request_id>``."""
    payload = F.col(payload) if isinstance(payload, str) else payload
    json = F.try_parse_json(payload)
    usage = _sub(json, "usage")
    choice = F.get(_items(_sub(json, "choices")), F.lit(0))
    return F.struct(
        F.coalesce(_text(_sub(choice, "message"), "content"), F.lit("")).alias("content"),
        _text(json, "model").alias("model"),
        _count(usage, "prompt_tokens").alias("input_tokens"),
        _count(usage, "prompt_cache_hit_tokens").alias("cached_input_tokens"),
        _count(usage, "completion_tokens").alias("output_tokens"),
        _text(json, "id").alias("request_id"),
    )


def validate_outputs(df: DataFrame, content: str = "content", stage: str = "stage") -> DataFrame:
    """Add ``violations`` to landed outputs of either stage."""
    return df.withColumn(
        "violations",
        F.when(F.col(stage) == "summary", summary_violations(content)).otherwise(
            analysis_violations(content)
        ),
    )


def validate_completions(df: DataFrame, payload: str = "payload") -> DataFrame:
    """Add ``error`` (null when complete) to raw responses."""
    return df.withColumn("error", completion_error(payload))


def violation_report(df: DataFrame, *keys: str) -> DataFrame:
    """How often each rule failed, by the given columns."""
    return (
        df.select(*keys, F.explode("violations").alias("violation"))
        .groupBy(*keys, "violation")
        .agg(F.count(F.lit(1)).alias("outputs"))
    )
