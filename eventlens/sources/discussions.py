"""Discussion items, as JSON text, to candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventlens.functions import numbers as nm
from eventlens.functions import text as tx
from eventlens.operators.admission import mentions_ai

DISCUSSION = "https://news.ycombinator.com/item?id="


def normalize_items(items: DataFrame, limit: int) -> DataFrame:
    """Candidates from ``(source_id, rank, payload)`` rows, ``rank`` being the list position.

    Only the first ``limit`` positions count; of those, live stories on the subject.
    """
    json = F.try_parse_json("payload")
    text = lambda key: F.try_variant_get("item", f"$.{key}", "string")
    raw = lambda key: F.try_variant_get("item", f"$.{key}", "variant")
    truthy = lambda key: F.coalesce(~text(key).isin("", "false", "0"), F.lit(False))
    blank = F.lit("")
    read = (
        items.where(F.col("rank") < limit)
        .withColumn("item", json)
        .where((text("type") == "story") & ~truthy("deleted") & ~truthy("dead"))
        .withColumn("title", F.coalesce(text("title"), blank))
        .withColumn("body", tx.html_to_text(F.coalesce(text("text"), blank)))
    )
    link = F.coalesce(text("url"), blank)
    discussion = F.concat(F.lit(DISCUSSION), text("id"))
    zero = F.try_parse_json(F.lit("0"))
    return read.where(mentions_ai(F.concat_ws(" ", "title", "body", link))).select(
        "source_id",
        F.col("rank").alias("position"),
        F.when(link != "", link).otherwise(discussion).alias("url"),
        text("id").alias("external_id"),
        "title",
        "body",
        F.lit("discussion").alias("body_kind"),
        text("by").alias("author"),
        nm.epoch_ts(raw("time")).alias("published_at"),
        F.to_variant_object(
            F.struct(
                raw("id").alias("hn_item_id"),
                F.coalesce(raw("score"), zero).alias("hn_points"),
                F.coalesce(raw("descendants"), zero).alias("hn_comments"),
                discussion.alias("discussion_url"),
            )
        ).alias("metadata"),
    )
