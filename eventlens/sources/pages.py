"""Text of stored web pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventlens.functions import text as tx


def page_text(pages: DataFrame) -> DataFrame:
    """``(page_id, text)``: all visible text."""
    return pages.select(
        "page_id", tx.html_to_text("html").alias("text")
    )


def extract_main_text(pages: DataFrame) -> DataFrame:
    """``(page_id, url, text)``: running text only; empty for content that is not HTML."""
    if "content_type" in pages.columns:
        is_html = F.contains(F.lower(F.coalesce("content_type", F.lit(""))), F.lit("html"))
    else:
        is_html = F.lit(True)
    return pages.select(
        "page_id", "url", F.when(is_html, tx.main_text("html")).otherwise("").alias("text")
    )
