"""Feed payloads to candidates.

A payload row is ``(source_id, payload_id, base_url, payload)``. Entries are exploded with
their position, so "first n" rules are filters inside the scan task and need no shuffle.
Payloads that do not parse are rejected as a whole and listed by ``rejected``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventlens.functions import numbers as nm
from eventlens.functions import text as tx
from eventlens.functions import urls

OPTIONS = {
    "mode": "PERMISSIVE",
    "attributePrefix": "_",
    "valueTag": "_VALUE",
    "columnNameOfCorruptRecord": "_corrupt",
    "ignoreSurroundingSpaces": "false",
}
_TEXT = "struct<_VALUE:string>"
RSS_ITEM = (
    "struct<title:string,link:string,guid:struct<_VALUE:string>,pubDate:string,`dc:date`:string,"
    "description:string,`content:encoded`:array<string>,category:array<struct<_VALUE:string>>,"
    "author:string,`dc:creator`:string,`arxiv:announce_type`:string>"
)
RSS_SCHEMA = f"_version string, channel struct<item:array<{RSS_ITEM}>>, _corrupt string"
ATOM_ENTRY = (
    f"struct<id:string,title:{_TEXT},summary:{_TEXT},content:array<{_TEXT}>,published:string,"
    "updated:string,author:array<struct<name:string>>,category:array<struct<_term:string>>,"
    "link:array<struct<_href:string,_rel:string>>>"
)
ATOM_SCHEMA = f"id string, updated string, entry array<{ATOM_ENTRY}>, _corrupt string"
CANDIDATE = (
    "source_id",
    "payload_id",
    "position",
    "url",
    "external_id",
    "title",
    "body",
    "body_kind",
    "author",
    "published_at",
    "metadata",
)
# Fixed value: note stored with snapshots that replace an unavailable interface.
SNAPSHOT_NOTE = (
    "ArXiv RSS contains only the latest announcement snapshot, including revisions and "
    "cross-listings; it does not cover the complete requested lookback. "
    "The feed can be empty on weekends and holidays."
)
API_NOTE = "Bounded snapshot filtered by submitted date within the lookback window."


def _format(payload: Column) -> Column:
    """Root element of the document."""
    body = F.regexp_replace(payload, r"(?s)^\s*(?:<\?.*?\?>\s*|<!--.*?-->\s*|<!DOCTYPE[^>]*>\s*)*", "")
    root = F.lower(F.regexp_extract(body, r"^<(?:[\w.-]+:)?([\w.-]+)", 1))
    return F.when(root == "rss", "rss").when(root == "feed", "atom")


def parsed(payloads: DataFrame) -> DataFrame:
    """Add ``format``, ``rss``, ``atom`` and ``well_formed``."""
    kind = _format(F.col("payload"))
    tagged = payloads.withColumn("format", kind)
    read = tagged.withColumn(
        "rss", F.from_xml(F.when(F.col("format") == "rss", F.col("payload")), RSS_SCHEMA, OPTIONS)
    ).withColumn(
        "atom", F.from_xml(F.when(F.col("format") == "atom", F.col("payload")), ATOM_SCHEMA, OPTIONS)
    )
    broken = F.coalesce("rss._corrupt", "atom._corrupt").isNotNull()
    return read.withColumn("well_formed", F.col("format").isNotNull() & ~broken)


def rejected(payloads: DataFrame) -> DataFrame:
    """Payloads that are no feed or are malformed."""
    read = parsed(payloads)
    reason = F.when(F.col("format").isNull(), "not_a_feed").otherwise("malformed_xml")
    return read.where(~F.col("well_formed")).select("source_id", "payload_id", reason.alias("error"))


def _tags(names: Column) -> Column:
    return F.coalesce(names, F.array().cast("array<string>"))


def _blank(text: Column) -> Column:
    return F.coalesce(text, F.lit("")) == ""


def _rss_entries(read: DataFrame, limit: int) -> DataFrame:
    items = read.select(
        "source_id", "payload_id", "base_url", F.posexplode("rss.channel.item").alias("position", "e")
    ).where(F.col("position") < limit)
    content = F.array_join(F.col("e.`content:encoded`"), " ")
    return items.select(
        "source_id",
        "payload_id",
        "base_url",
        "position",
        F.col("e.title").alias("title"),
        F.btrim(F.col("e.link")).alias("link"),
        F.btrim(F.col("e.guid._VALUE")).alias("entry_id"),
        content.alias("content"),
        F.col("e.description").alias("summary"),
        F.size(F.coalesce("e.`content:encoded`", F.array())).alias("contents"),
        F.coalesce("e.author", "e.`dc:creator`").alias("author"),
        F.coalesce("e.pubDate", "e.`dc:date`").alias("published"),
        F.lit(None).cast("string").alias("updated"),
        _tags(F.transform("e.category", lambda c: c["_VALUE"])).alias("tags"),
        F.col("e.`arxiv:announce_type`").alias("announce_type"),
    )


def _atom_entries(read: DataFrame, limit: int) -> DataFrame:
    items = read.select(
        "source_id", "payload_id", "base_url", F.posexplode("atom.entry").alias("position", "e")
    ).where(F.col("position") < limit)
    links = F.col("e.link")
    alternate = F.filter(links, lambda k: F.coalesce(k["_rel"], F.lit("alternate")) == "alternate")
    contents = F.transform("e.content", lambda c: F.coalesce(c["_VALUE"], F.lit("")))
    return items.select(
        "source_id",
        "payload_id",
        "base_url",
        "position",
        F.col("e.title._VALUE").alias("title"),
        F.btrim(F.coalesce(F.get(alternate, F.lit(0))["_href"], F.lit(""))).alias("link"),
        F.btrim(F.col("e.id")).alias("entry_id"),
        F.array_join(contents, " ").alias("content"),
        F.col("e.summary._VALUE").alias("summary"),
        F.size(F.coalesce("e.content", F.array())).alias("contents"),
        F.get("e.author", F.lit(0))["name"].alias("author"),
        F.col("e.published").alias("published"),
        F.col("e.updated").alias("updated"),
        _tags(F.transform("e.category", lambda c: c["_term"])).alias("tags"),
        F.lit(None).cast("string").alias("announce_type"),
    )


def _entries(payloads: DataFrame, limit: int) -> DataFrame:
    good = parsed(payloads).where("well_formed")
    rss = _rss_entries(good.where(F.col("format") == "rss"), limit)
    return rss.unionByName(_atom_entries(good.where(F.col("format") == "atom"), limit))


def parse_feeds(payloads: DataFrame, limit: int) -> DataFrame:
    """Candidates of RSS and Atom payloads: the first ``limit`` entries, then the usable ones."""
    entries = _entries(payloads, limit)
    full = F.col("contents") > 0
    chosen = F.when(~_blank(F.col("content")), F.col("content")).otherwise(
        F.coalesce("summary", F.lit(""))
    )
    link = urls.url_join("base_url", "link")
    clean = entries.withColumn("title", tx.html_to_text(F.coalesce("title", F.lit(""))))
    return clean.where((F.col("title") != "") & ~_blank(F.col("link"))).select(
        "source_id",
        "payload_id",
        "position",
        link.alias("url"),
        F.when(_blank(F.col("entry_id")), link).otherwise(F.col("entry_id")).alias("external_id"),
        "title",
        tx.html_to_text(chosen).alias("body"),
        F.when(full, "feed_full").otherwise("feed_summary").alias("body_kind"),
        "author",
        nm.entry_date("published", "updated").alias("published_at"),
        F.to_variant_object(F.struct("tags")).alias("metadata"),
    )


def parse_arxiv_atom(payloads: DataFrame, limit: int = 100) -> DataFrame:
    """Candidates of paper listings; a payload that holds an error entry is rejected whole."""
    good = parsed(payloads).where(F.col("well_formed") & (F.col("format") == "atom"))
    failed = F.exists("atom.entry", lambda e: F.coalesce(e["id"], F.lit("")).endswith("/api/errors"))
    items = good.where(~F.coalesce(failed, F.lit(False))).select(
        "source_id", "payload_id", F.posexplode("atom.entry").alias("position", "e")
    ).where(F.col("position") < limit)
    entry_id, title = F.btrim(F.col("e.id")), F.col("e.title._VALUE")
    names = F.transform("e.author", lambda a: a["name"])
    categories = _tags(F.transform("e.category", lambda c: c["_term"]))
    return items.where(~_blank(entry_id) & ~_blank(title)).select(
        "source_id",
        "payload_id",
        "position",
        entry_id.alias("url"),
        entry_id.alias("external_id"),
        tx.squeeze(title).alias("title"),
        tx.squeeze(F.coalesce("e.summary._VALUE", F.lit(""))).alias("body"),
        F.lit("abstract").alias("body_kind"),
        F.coalesce(F.array_join(names, ", "), F.lit("")).alias("author"),
        nm.entry_date("e.published", "e.updated").alias("published_at"),
        F.to_variant_object(
            F.struct(
                categories.alias("categories"),
                entry_id.alias("arxiv_id"),
                F.lit("abstract").alias("content_kind"),
            )
        ).alias("metadata"),
    )


def parse_arxiv_rss(payloads: DataFrame, limit: int, lookback_days: int, as_of) -> DataFrame:
    """Candidates of announcement snapshots.

    One unusable paper link rejects its payload. Repeats and old items are dropped before
    the limit counts. Grouping is by payload, which is one downloaded file.
    """
    good = parsed(payloads).where(
        F.col("well_formed") & (F.col("format") == "rss") & (F.col("rss._version") == "2.0")
    )
    entries = _rss_entries(good, 2**31 - 1)
    titled = (
        entries.withColumn("title", tx.html_to_text(F.coalesce("title", F.lit(""))))
        .where((F.col("title") != "") & ~_blank(F.col("link")))
        .withColumn("url", urls.canonical_url("link"))
        .withColumn("published_at", nm.entry_date("published", "updated"))
        .withColumn("bad", ~F.coalesce(urls.is_paper_url("url"), F.lit(False)))
    )
    since = nm.moment(as_of) - F.make_dt_interval(F.lit(lookback_days))
    broken = titled.where("bad").select("payload_id").distinct()
    recent = titled.where(F.col("published_at").isNull() | (F.col("published_at") >= since))
    by_url = Window.partitionBy("payload_id", "url").orderBy("position")
    in_payload = Window.partitionBy("payload_id").orderBy("position")
    kept = (
        recent.join(broken, "payload_id", "left_anti")
        .withColumn("_repeat", F.row_number().over(by_url))
        .where(F.col("_repeat") == 1)
        .withColumn("_place", F.row_number().over(in_payload))
        .where(F.col("_place") <= limit)
    )
    return kept.select(
        "source_id",
        "payload_id",
        "position",
        "url",
        F.col("url").alias("external_id"),
        "title",
        tx.strip_announce(tx.html_to_text(F.coalesce("summary", F.lit("")))).alias("body"),
        F.lit("abstract").alias("body_kind"),
        "author",
        "published_at",
        F.to_variant_object(
            F.struct(
                F.col("tags").alias("categories"),
                F.col("url").alias("arxiv_id"),
                F.col("entry_id").alias("rss_guid"),
                "announce_type",
                F.lit("abstract").alias("content_kind"),
                F.lit("announcement").alias("date_kind"),
                F.lit("rss_fallback").alias("fetch_mode"),
            )
        ).alias("metadata"),
    )


def first_per_source(df: DataFrame, n: int, key: str = "source_id", order: str = "position") -> DataFrame:
    """First ``n`` rows of every source; each task keeps at most ``n`` per source before the shuffle."""
    window = Window.partitionBy(key).orderBy(order)
    return df.withColumn("_place", F.row_number().over(window)).where(F.col("_place") <= n).drop("_place")


def first_by_url(df: DataFrame, url: str = "url", order: str = "position") -> DataFrame:
    """First occurrence of every URL, with the number of copies."""
    rest = [c for c in df.columns if c != url]
    return (
        df.groupBy(url)
        .agg(F.min_by(F.struct(*rest), order).alias("_first"), F.count(F.lit(1)).alias("copies"))
        .select(url, "_first.*", "copies")
    )


def with_fallback(primary: DataFrame, fallback: DataFrame, status: DataFrame) -> DataFrame:
    """Use a source's snapshot where its interface failed for the moment.

    ``status`` is ``(source_id, http_status, timed_out, retry_after_seconds)``. Time-outs, 429
    and 5xx are temporary unless the announced wait exceeds a minute; other failures stay.
    """
    code = F.col("http_status")
    wait = F.coalesce("retry_after_seconds", F.lit(0))
    failure = F.when(F.col("timed_out"), "API timeout").when(
        ((code == 429) | code.between(500, 599)) & (wait <= 60),
        F.concat(F.lit("API HTTP "), code.cast("string")),
    )
    flagged = status.select("source_id", failure.alias("failure"), code.alias("code"))
    ok = flagged.where(F.col("failure").isNull() & F.coalesce(F.col("code") < 400, F.lit(True)))
    retry = flagged.where(F.col("failure").isNotNull())
    mode = lambda m: F.lit(m).alias("fetch_mode")
    direct = primary.join(ok.select("source_id"), "source_id", "left_semi")
    swapped = fallback.join(retry.select("source_id", "failure"), "source_id")
    note = F.concat("failure", F.lit("; used RSS fallback. "), F.lit(SNAPSHOT_NOTE))
    return direct.select("*", mode("api"), F.lit(None).cast("string").alias("warning")).unionByName(
        swapped.select(*primary.columns, mode("rss_fallback"), note.alias("warning"))
    )
