"""Numbers, times, entitlements and money as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from eventlens import config


def _col(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def moment(value) -> Column:
    """Accept a column or a literal such as ``2024-01-31 00:00:00`` (read as UTC)."""
    return value if isinstance(value, Column) else F.to_timestamp(F.lit(str(value)))


def seconds(timestamp) -> Column:
    """Seconds since the epoch with microseconds kept."""
    return F.unix_micros(_col(timestamp).cast("timestamp")) / F.lit(1e6)


def as_utc(timestamp) -> Column:
    """Values without a zone are read in the session zone, which is UTC."""
    return _col(timestamp).cast("timestamp")


def epoch_ts(variant) -> Column:
    """Epoch seconds to a timestamp; anything that is not a JSON number gives null."""
    variant = _col(variant)
    return F.when(_is_number(variant), F.timestamp_seconds(F.try_variant_get(variant, "$", "double")))


def _is_number(variant: Column) -> Column:
    return F.schema_of_variant(variant).rlike("^(TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|DECIMAL.*)$")


def is_integer(variant) -> Column:
    """JSON integer: not a boolean, not a fraction, not text."""
    kind = F.schema_of_variant(_col(variant))
    return F.coalesce(kind.rlike(r"^(TINYINT|SMALLINT|INT|BIGINT|DECIMAL\(\d+,0\))$"), F.lit(False))


def nonnegative(variant) -> Column:
    """A JSON number at or above zero; every other value counts as zero."""
    number = F.try_variant_get(_col(variant), "$", "double")
    usable = _is_number(_col(variant)) & ~F.isnan(number) & (F.abs(number) != F.lit(float("inf")))
    return F.when(F.coalesce(usable, F.lit(False)), F.greatest(number, F.lit(0.0))).otherwise(0.0)


def recency(latest, as_of) -> Column:
    """Halves every 36 hours; the future counts as age zero."""
    return F.pow(F.lit(2.0), -age_hours(latest, as_of) / config.RECENCY_HALF_LIFE_HOURS)


def age_hours(latest, as_of) -> Column:
    return F.greatest(F.lit(0.0), (seconds(moment(as_of)) - seconds(latest)) / 3600)


def _saturating(count: Column) -> Column:
    span = config.DIVERSITY_SATURATION - 1
    return F.least(F.greatest(count - 1, F.lit(0)) / F.lit(float(span)), F.lit(1.0))


def diversity(publishers, categories) -> Column:
    return (_saturating(_col(publishers)) + _saturating(_col(categories))) / 2


def engagement_norm(engagement) -> Column:
    return F.log1p(_col(engagement)) / F.log1p(F.lit(float(config.ENGAGEMENT_SATURATION)))


def significance(score) -> Column:
    """``struct<value, available>``; a missing or out-of-range score is neutral."""
    score = _col(score)
    known = F.coalesce(score.between(1, 10), F.lit(False))
    return F.struct(
        F.when(known, score / F.lit(10.0)).otherwise(0.5).alias("value"), known.alias("available")
    )


def rank_struct(significance_value, diversity_value, engagement_value, recency_value) -> Column:
    """Weighted, decayed and rounded score parts, with their sum."""
    values = {
        "diversity": _col(diversity_value),
        "engagement": _col(engagement_value),
        "technical_significance": _col(significance_value),
    }
    parts, total = [], None
    for name, value in values.items():
        weight = config.RANKING_WEIGHTS[name]
        points = F.round(F.lit(100.0) * _col(recency_value) * weight * value, 6)
        total = points if total is None else total + points
        parts.append(
            F.struct(
                F.round(value, 6).alias("value"),
                F.lit(weight).alias("weight"),
                F.round(F.lit(100.0) * weight * value, 6).alias("points_before_decay"),
                points.alias("points"),
            ).alias(name)
        )
    return F.struct(
        F.round(total, 6).alias("rank_score"),
        *parts,
        F.round(_col(recency_value), 6).alias("recency"),
        F.lit(config.RANKING_VERSION).alias("rank_version"),
    )


def entitlement(tier, expires, as_of) -> Column:
    """``struct<tier, features>``: paid access is all features, otherwise none."""
    expires = _col(expires)
    paid = (_col(tier) == "pro") & (expires.isNull() | (expires > moment(as_of)))
    paid = F.coalesce(paid, F.lit(False))
    return F.struct(
        F.when(paid, "pro").otherwise("free").alias("tier"),
        F.when(paid, F.array(*map(F.lit, config.FEATURES)))
        .otherwise(F.array().cast("array<string>"))
        .alias("features"),
    )


def _rate(model: Column, position: int) -> Column:
    rates = F.create_map(
        *[F.lit(item) for name, rate in config.RATES.items() for item in (name, rate[position])]
    )
    return F.try_element_at(rates, model)


def estimate_cost(model, input_tokens, cached_tokens, output_tokens) -> Column:
    """USD at the fixed rate table; null for a model without a rate."""
    model = _col(model)
    cached = _col(cached_tokens)
    return (
        cached * _rate(model, 0)
        + (_col(input_tokens) - cached) * _rate(model, 1)
        + _col(output_tokens) * _rate(model, 2)
    ) / F.lit(1_000_000.0)


def reserve_cost(model, messages, max_tokens) -> Column:
    """Upper bound before a call: UTF-8 bytes plus fixed overheads, and full output."""
    size = F.aggregate(
        _col(messages),
        F.lit(2048).cast("bigint"),
        lambda acc, m: acc + F.octet_length(m).cast("bigint") + F.lit(256),
    )
    tokens = max_tokens if isinstance(max_tokens, (int, Column)) else _col(max_tokens)
    tokens = F.lit(tokens) if isinstance(tokens, int) else tokens
    return estimate_cost(model, size, F.lit(0), tokens)


def label(value) -> Column:
    """Readable event type."""
    value = _col(value)
    spaced = F.replace(value, F.lit("_"), F.lit(" "))
    return F.when(F.coalesce(value, F.lit("")) == "", "Awaiting analysis").otherwise(
        F.concat(F.upper(F.substring(spaced, 1, 1)), F.substring(spaced, 2, 1_000_000))
    )


def relative_time(timestamp, as_of) -> Column:
    timestamp = _col(timestamp)
    hours = F.floor((seconds(moment(as_of)) - seconds(timestamp)) / 3600)
    hours = F.greatest(hours, F.lit(0))
    return (
        F.when(timestamp.isNull(), "Date unavailable")
        .when(hours < 1, "Just now")
        .when(hours < 24, F.concat(hours.cast("string"), F.lit("h ago")))
        .otherwise(F.concat(F.floor(hours / 24).cast("string"), F.lit("d ago")))
    )


def date_label(timestamp) -> Column:
    return F.coalesce(F.date_format(_col(timestamp), "MMM d"), F.lit("Date unavailable"))


# Date spellings accepted in feeds besides ISO 8601, after the day name.
DATE_FORMATS = (
    "d MMM yyyy HH:mm:ss z",
    "d MMM yyyy HH:mm:ss Z",
    "d MMM yyyy HH:mm z",
    "d MMM yyyy HH:mm Z",
)


def feed_date(text) -> Column:
    text = F.btrim(_col(text))
    plain = F.regexp_replace(F.regexp_replace(text, r"^[A-Za-z]+,\s*", ""), r"\b(?:UT|Z)$", "GMT")
    rfc = [F.try_to_timestamp(plain, F.lit(pattern)) for pattern in DATE_FORMATS]
    iso = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}"), F.try_to_timestamp(text))
    return F.coalesce(iso, *rfc)


def entry_date(published, updated) -> Column:
    """Publication date, else the update date."""
    return F.coalesce(feed_date(published), feed_date(updated))
