"""Near-duplicate search over SimHash fingerprints, lossless and free of all-pairs output.

Fingerprints are cut into blocks. Two values that differ in at most k of m blocks agree on
the other m-k, so joining on every choice of m-k blocks finds every pair within k bits. Copies
are collapsed to their distinct fingerprint first: a text with a billion copies is one row in
the band join.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventlens.config import DEFAULTS
from eventlens.functions.simhash import hamming
from eventlens.operators import scans
from eventlens.session import cut, dealt

BUCKET_TARGET = 8
WIDEST = 3


def masks(max_bits: int, blocks: int) -> list[int]:
    """Signed 64-bit masks, one per choice of ``blocks - max_bits`` blocks."""
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    parts = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
    chosen = [sum(c) for c in combinations(parts, blocks - max_bits)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in chosen]


def pick_blocks(distinct: int, max_bits: int) -> int:
    """Fewest blocks whose keys are selective enough for that many fingerprints."""
    for blocks in range(max_bits + 1, max_bits + 1 + WIDEST):
        bits = 64 * (blocks - max_bits) / blocks
        if distinct / 2**bits <= BUCKET_TARGET:
            return blocks
    return max_bits + WIDEST


def _banded(df: DataFrame, column: str, choices: list[int]) -> DataFrame:
    keys = F.array(
        *[
            F.struct(F.lit(i).alias("band"), F.col(column).bitwiseAND(F.lit(m)).alias("part"))
            for i, m in enumerate(choices)
        ]
    )
    return df.select("*", F.explode(keys).alias("_key")).select("*", "_key.band", "_key.part").drop("_key")


def fingerprint_pairs(
    left: DataFrame, right: DataFrame, max_bits: int = DEFAULTS.simhash_distance,
    blocks: int | None = None,
) -> DataFrame:
    """``(left_fp, right_fp)`` within ``max_bits``, each once, from two distinct ``fingerprint``
    tables. A pair that agrees on several bands is kept only at the first of them, which
    replaces a distinct over all candidates."""
    if blocks is None:
        blocks = pick_blocks(right.count(), max_bits)
    choices = masks(max_bits, blocks)
    a = _banded(left.select(F.col("fingerprint").alias("left_fp")), "left_fp", choices)
    b = _banded(right.select(F.col("fingerprint").alias("right_fp")), "right_fp", choices)
    difference = F.col("left_fp").bitwiseXOR(F.col("right_fp"))
    first = F.coalesce(
        *[F.when(difference.bitwiseAND(F.lit(m)) == 0, F.lit(i)) for i, m in enumerate(choices)]
    )
    return (
        a.join(dealt(b), ["band", "part"])
        .where((hamming("left_fp", "right_fp") <= max_bits) & (F.col("band") == first))
        .select("left_fp", "right_fp")
    )


def ratio_ok(words: Column, other: Column, low: float, high: float) -> Column:
    ratio = words / F.greatest(other, F.lit(1))
    return (ratio >= low) & (ratio <= high)


def near_duplicates(
    articles: DataFrame,
    max_bits: int = DEFAULTS.simhash_distance,
    days: int = DEFAULTS.near_dup_days,
    low: float = DEFAULTS.near_dup_low,
    high: float = DEFAULTS.near_dup_high,
) -> DataFrame:
    """For every row its earliest earlier near duplicate, if any.

    Input: ``article_id, fingerprint, words, event_time, fetched_at``. Earliest is by
    ``(fetched_at, article_id)``. The time window is as long as a block of ``2 * days``, so it
    is the tail of one block plus the head of the next, and its minimum comes from two
    running minima instead of pairing rows.
    """
    narrow = articles.where(F.col("fingerprint").isNotNull()).select(
        "article_id",
        "fingerprint",
        "words",
        F.unix_micros(F.col("event_time").cast("timestamp")).alias("at"),
        F.struct(F.unix_micros(F.col("fetched_at").cast("timestamp")).alias("fetched"), "article_id").alias("rank"),
    )
    rows = cut(narrow)  # fingerprints are costly and read several times below
    points = rows.groupBy("fingerprint", "words", "at").agg(F.min("rank").alias("rank"))
    nodes = points.select("fingerprint", "words").distinct()
    prints = nodes.select("fingerprint").distinct()
    x = nodes.select(F.col("fingerprint").alias("left_fp"), F.col("words").alias("left_words"))
    y = nodes.select(F.col("fingerprint").alias("right_fp"), F.col("words").alias("right_words"))
    near = (
        fingerprint_pairs(prints, prints, max_bits)
        .join(x, "left_fp")
        .join(y, "right_fp")
        .where(ratio_ok(F.col("left_words"), F.col("right_words"), low, high))
    )
    half = days * 86_400_000_000
    asked = points.select(
        F.col("fingerprint").alias("left_fp"), F.col("words").alias("left_words"), F.col("at").alias("left_at")
    ).join(near, ["left_fp", "left_words"])
    ends = F.array(
        F.struct((F.col("left_at") - half).alias("at"), F.lit(-1).alias("side")),
        F.struct((F.col("left_at") + half).alias("at"), F.lit(1).alias("side")),
    )
    queries = asked.select("*", F.explode(ends).alias("_end")).select(
        F.col("right_fp").alias("fingerprint"),
        F.col("right_words").alias("words"),
        "_end.at",
        "_end.side",
        F.lit(None).cast(points.schema["rank"].dataType).alias("rank"),
        F.struct("left_fp", "left_words", "left_at").alias("asker"),
    )
    line = points.select(
        "fingerprint", "words", "at", F.lit(0).alias("side"), "rank",
        F.lit(None).cast(queries.schema["asker"].dataType).alias("asker"),
    ).unionByName(queries)
    line = line.withColumn("block", F.floor(F.col("at") / (2 * half)))
    placed = scans.positioned(line, [F.col(c) for c in ("fingerprint", "words", "at", "side")])
    keys = ["fingerprint", "words", "block"]
    heads = scans.running(placed, keys, {"head": ("min", F.col("rank"))})
    tails = scans.running(heads, keys, {"tail": ("min", F.col("rank"))}, descending=True)
    found = (
        tails.where(F.col("asker").isNotNull())
        .select("asker.*", F.when(F.col("side") == 1, F.col("head")).otherwise(F.col("tail")).alias("best"))
        .groupBy("left_fp", "left_words", "left_at")
        .agg(F.min("best").alias("best"))
        .select(
            F.col("left_fp").alias("fingerprint"),
            F.col("left_words").alias("words"),
            F.col("left_at").alias("at"),
            "best",
        )
    )
    earlier = F.col("best") < F.col("rank")
    return rows.join(found, ["fingerprint", "words", "at"], "left").select(
        "article_id", F.when(earlier, F.col("best.article_id")).alias("match_id")
    )
