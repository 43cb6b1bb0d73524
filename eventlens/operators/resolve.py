"""Article identity and correction across sources, in processing order.

A candidate belongs to the article its observation, URL, alias or text points to, and may
correct or take over that article, which changes what later candidates match. The order is
kept by ``wavefront``, which settles as rows whatever no earlier candidate can affect; it sees
hashes and lengths only, never texts. Pointers to the candidates that gave an article its
title, text, owner and author are turned back into rows at the end.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventlens.config import DEFAULTS, Settings
from eventlens.functions import numbers as nm
from eventlens.functions import simhash, urls
from eventlens.functions import text as tx
from eventlens.operators import near_dup, scans, wavefront
from eventlens.operators.identity import upsert_observations
from eventlens.operators.wavefront import FIELDS, FULL_KINDS, KEY  # noqa: F401
from eventlens.session import cut, dealt

ARTICLES = (
    "article_id string, source_id string, url string, canonical_url string, url_hash string, "
    "title string, body string, body_kind string, author string, published_at timestamp, "
    "fetched_at timestamp, sequence bigint, fingerprint bigint, metadata variant, "
    "needs_embedding boolean"
)
OBSERVATIONS = (
    "source_id string, external_id string, article_id string, url string, url_hash string, "
    "metadata variant, seen_at timestamp"
)


@dataclass(frozen=True)
class Resolved:
    """``outcomes``: pos, article_id, created, plus the candidate's source and external id;
    ``rejected``: candidates without effect; ``changed``: articles whose event needs a refresh."""

    articles: DataFrame
    observations: DataFrame
    outcomes: DataFrame
    rejected: DataFrame
    changed: DataFrame


def empty_state(spark) -> tuple[DataFrame, DataFrame]:
    return spark.createDataFrame([], ARTICLES), spark.createDataFrame([], OBSERVATIONS)


def _prepared(candidates: DataFrame, order: list[Column], settings: Settings) -> tuple[DataFrame, DataFrame]:
    """Candidates without their bodies in processing order, with everything replay compares, and
    ``(row, body)``. A body is read once, where it is, and takes no part in the sort."""
    spelled = candidates.withColumn("canonical_url", urls.canonical_url("url"))
    ext = F.when(F.coalesce("external_id", F.lit("")) == "", F.col("canonical_url")).otherwise(
        F.col("external_id")
    )
    body = F.coalesce("body", F.lit(""))
    rows = spelled.withColumns(
        {
            "external_id": ext,
            "body": body,
            "url_hash": urls.hash_of("canonical_url"),
            "title_hash": F.md5("title"),
            "body_hash": F.md5(body),
            "words": tx.word_count(body),
            "blank": tx.is_blank(body),
        }
    )
    printed = simhash.with_fingerprint(rows, "body", settings.simhash_min_words, settings.simhash_hash)
    told = cut(printed.withColumn("row", F.monotonically_increasing_id()))
    return scans.positioned(told.drop("body"), order, "pos"), told.select("row", "body")


def _near(good: DataFrame, seeds: DataFrame, settings: Settings) -> DataFrame:
    """``(fingerprint, other)`` of near-equal fingerprints of candidates and articles, both ways."""
    prints = good.where(F.col("fingerprint").isNotNull()).select("fingerprint").distinct()
    old = seeds.where(F.col("fingerprint").isNotNull()).select("fingerprint").distinct()
    every = cut(prints.unionByName(old).distinct())
    pairs = near_dup.fingerprint_pairs(cut(prints), every, settings.simhash_distance)
    pairs = cut(pairs.select(F.col("left_fp").alias("fingerprint"), F.col("right_fp").alias("other")))
    turned = pairs.select(F.col("other").alias("fingerprint"), F.col("fingerprint").alias("other"))
    itself = every.select("fingerprint", F.col("fingerprint").alias("other"))
    return cut(pairs.unionByName(turned).unionByName(itself).distinct())


def _micros(name: str) -> Column:
    return F.unix_micros(F.col(name).cast("timestamp"))


def _seed_state(articles: DataFrame, sources: DataFrame) -> DataFrame:
    """Existing articles as narrow replay state; nodes are negative and grow with age order."""
    authority = sources.select("source_id", F.col("authority_score").alias("authority"))
    rows = articles.join(authority, "source_id", "left").select(
        "article_id",
        "source_id",
        F.coalesce("authority", F.lit(0)).alias("authority"),
        "url_hash",
        F.md5("title").alias("title_hash"),
        F.md5("body").alias("body_hash"),
        "body_kind",
        tx.word_count("body").alias("words"),
        "fingerprint",
        _micros("published_at").alias("published"),
        _micros("fetched_at").alias("fetched"),
        *[F.lit(None).cast("bigint").alias(c) for c in ("owner_pos", "title_pos", "body_pos", "author_pos")],
        *[F.lit(False).alias(c) for c in ("created", "changed", "observed", "hit")],
        "sequence",
    )
    placed = scans.positioned(rows, [F.asc("fetched"), F.asc("sequence"), F.asc("article_id")], "node")
    return placed.withColumn("node", F.col("node") - F.lit(1 << 62)).select(*FIELDS)


def resolve_articles(
    candidates: DataFrame,
    sources: DataFrame,
    articles: DataFrame,
    observations: DataFrame,
    as_of,
    settings: Settings = DEFAULTS,
) -> Resolved:
    """Apply a batch of admitted candidates to the article and observation tables.

    ``candidates``: source_id, url, external_id, title, body, body_kind, author, published_at,
    metadata, position. Sources are taken in order of authority and name, items by position.
    """
    ranked = candidates.join(
        sources.select("source_id", "name", F.col("authority_score").alias("authority")), "source_id"
    )
    order = [F.desc("authority"), F.asc("name"), F.asc("source_id"), F.asc("position")]
    prepared, bodies = _prepared(ranked, order, settings)
    good = prepared.where(F.col("canonical_url").isNotNull())
    seeds = cut(_seed_state(articles, sources))
    now = F.unix_micros(nm.moment(as_of))
    narrow = good.select(
        "pos", *KEY, "authority", "url_hash", "title_hash", "body_hash", "body_kind", "words", "fingerprint", "blank",
        F.substring(F.sha2(F.concat_ws("|", *KEY), 256), 1, 32).alias("article_id"),
        _micros("published_at").alias("published"),
        now.alias("fetched"),
        F.coalesce(_micros("published_at"), now).alias("event"),
        (F.coalesce("author", F.lit("")) != "").alias("has_author"),
    )
    seen = observations.join(dealt(seeds.select("article_id", "node")), "article_id")
    keys = seen.select(*KEY, F.col("node").alias("k_node"), F.col("url_hash").alias("k_url"))
    aliases = seen.groupBy("url_hash", "node").agg(F.count(F.lit(1)).alias("n"))
    state, decided = wavefront.settle(narrow, seeds, keys, aliases, _near(good, seeds, settings), settings)
    return _finish(prepared, bodies, good, decided, state, articles, observations, as_of)


def _finish(prepared, bodies, good, decided, state, articles, observations, as_of) -> Resolved:
    """Turn pointers back into rows."""
    now = nm.moment(as_of)
    touched = state.where("hit")
    owner = good.select(
        F.col("pos").alias("owner_pos"), F.col("url").alias("o_url"),
        F.col("canonical_url").alias("o_canonical_url"), F.col("metadata").alias("o_metadata"),
    )
    title = good.select(F.col("pos").alias("title_pos"), F.col("title").alias("t_title"))
    place = good.select(F.col("pos").alias("body_pos"), F.col("row").alias("body_row"))
    body = bodies.select(F.col("row").alias("body_row"), F.col("body").alias("b_body"))
    author = good.select(F.col("pos").alias("author_pos"), F.col("author").alias("a_author"))
    old = articles.select(
        "article_id",
        *[F.col(c).alias(f"_{c}") for c in
          ("url", "canonical_url", "metadata", "title", "body", "author", "fetched_at", "sequence", "needs_embedding")],
    )
    joined = (
        touched.join(dealt(old), "article_id", "left")
        .join(dealt(owner), "owner_pos", "left")
        .join(dealt(title), "title_pos", "left")
        .join(dealt(place), "body_pos", "left")
        .join(dealt(body), "body_row", "left")
        .join(dealt(author), "author_pos", "left")
    )

    def pick(pointer: str, new: str, kept: str) -> Column:
        return F.when(F.col(pointer).isNotNull(), F.col(new)).otherwise(F.col(f"_{kept}")).alias(kept)

    updated = joined.select(
        "article_id",
        "source_id",
        pick("owner_pos", "o_url", "url"),
        pick("owner_pos", "o_canonical_url", "canonical_url"),
        "url_hash",
        pick("title_pos", "t_title", "title"),
        pick("body_pos", "b_body", "body"),
        "body_kind",
        pick("author_pos", "a_author", "author"),
        F.timestamp_micros("published").alias("published_at"),
        F.coalesce("_fetched_at", now).alias("fetched_at"),
        F.coalesce("_sequence", "node").alias("sequence"),
        "fingerprint",
        pick("owner_pos", "o_metadata", "metadata"),
        (F.col("changed") | F.coalesce("_needs_embedding", F.lit(False))).alias("needs_embedding"),
    )
    kept = articles.join(dealt(touched.select("article_id")), "article_id", "left_anti")
    applied = decided.where(F.col("article_id").isNotNull())
    outcomes = good.select("pos", "source_id", "external_id").join(dealt(applied), "pos")
    clashes = good.join(dealt(decided.where(F.col("article_id").isNull())), "pos", "left_semi")
    unusable = prepared.where(F.col("canonical_url").isNull())
    reject = lambda df, why: df.select("pos", "source_id", "url", F.lit(why).alias("error"))
    incoming = good.join(dealt(applied), "pos").select(
        "source_id", "external_id", "article_id", "url", "url_hash", "metadata",
        now.alias("seen_at"), F.col("pos").alias("seq"),
    )
    return Resolved(
        articles=kept.unionByName(updated),
        observations=upsert_observations(observations, incoming),
        outcomes=outcomes,
        rejected=reject(unusable, "invalid_url").unionByName(reject(clashes, "url_taken")),
        changed=touched.where(F.col("changed") | F.col("observed")).select("article_id"),
    )
