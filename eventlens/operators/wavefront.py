"""Ordered resolution of candidates by wavefronts.

Candidates are applied to articles in order of position, and what one does depends on what earlier
ones did to the keys, URLs, fingerprints and articles it meets. Each round looks every pending
candidate up in the state as it is, tells what it would do, and settles, as rows, all that no
pending earlier candidate can still affect. State is keyed by what is looked up (observation key,
URL, alias, fingerprint, article), so no task ever holds a connected group of candidates.

* A candidate is *quiet* if it meets an article, leaves it as it is, and adds no key or alias that
  another candidate of the batch asks for. All others are *loud*.
* Whoever is loud is a barrier, from its position on, at everything it may write: its key and URL,
  the articles it may meet, their URLs, and the fingerprints that it or those articles may take. A
  quiet candidate behind a barrier may turn loud and becomes a barrier itself, until nothing changes.
* Candidates in front of every barrier they meet are settled. Quiet ones see the state as it was;
  of the loud ones at most one writes each row.
* A *plain* candidate meets none, brings a date, and shares neither key nor URL with another one. It
  can meet an article by its text only, and one that comes to exist or to change before its turn has at
  least its authority, since candidates come in order of falling authority. So it makes an article or
  joins one without taking it over: to other plain candidates, and to quiet ones that meet an article by
  its text, it is a barrier within the window of near-equal texts only, and to the latter only from
  before the article they meet. Such a quiet candidate meets the one or the other and writes nothing
  that others read, so it is no barrier itself.

The earliest pending candidate is always settled. A round shrinks the state to what pending
candidates can still reach: an article that none meets now gains nothing by which it could be met
later. There are as many rounds as the longest chain of candidates each of which writes what the
next one reads; copies of a text, repeated keys and repeated URLs are settled together.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventlens.config import Settings
from eventlens.session import cut, dealt

DAY = 86_400_000_000
# Kinds of body that replace any other kind of the same publisher.
FULL_KINDS = ("extracted", "feed_full", "abstract")
#: What an article is during resolution; *_pos point to candidates, null means unchanged.
STATE = (
    "article_id string, node bigint, source_id string, authority int, url_hash string, "
    "title_hash string, body_hash string, body_kind string, words int, fingerprint bigint, "
    "published bigint, fetched bigint, owner_pos bigint, title_pos bigint, body_pos bigint, "
    "author_pos bigint, created boolean, changed boolean, observed boolean, hit boolean"
)
FIELDS = [f.split()[0] for f in STATE.split(", ")]
#: What a candidate brings.
ASKED = [
    "pos", "source_id", "external_id", "authority", "url_hash", "title_hash", "body_hash", "body_kind", "words",
    "fingerprint", "blank", "article_id", "published", "fetched", "event", "has_author",
]
KEY = ["source_id", "external_id"]


def _named(kind: str, *values) -> Column:
    """A resource as a number; two resources with one number only wait for each other needlessly."""
    return F.xxhash64(F.lit(kind), *values)


def _shared(candidates: DataFrame) -> DataFrame:
    """Mark candidates whose key or URL another candidate of the batch has too."""
    out = candidates
    for names, mark in ((KEY, "many_keys"), (["url_hash"], "many_urls")):
        several = candidates.groupBy(*names).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
        out = out.join(dealt(several.withColumn(mark, F.lit(True))), names, "left")
    return out.withColumns({m: F.coalesce(m, F.lit(False)) for m in ("many_keys", "many_urls")})


def _copies(open_: DataFrame, articles: DataFrame, near: DataFrame, settings: Settings) -> DataFrame:
    """``(pos, c_node)``: the earliest article with a near-equal text. Rows meet by fingerprint and
    stretch of time, so few articles are compared with a candidate."""
    reach = settings.near_dup_days * DAY
    stretch = F.floor(F.col("moment") / reach)
    held = articles.where(F.col("fingerprint").isNotNull()).select(
        F.col("fingerprint").alias("other"), "node", F.col("words").alias("a_words"),
        F.coalesce("published", "fetched").alias("moment"),
    ).withColumn("stretch", stretch)
    asked = open_.select(
        "pos", "words", "event", "fingerprint",
        F.explode(F.sequence(F.floor(F.col("event") / reach) - 1, F.floor(F.col("event") / reach) + 1)).alias("stretch"),
    ).join(dealt(near), "fingerprint")
    ratio = F.col("words") / F.greatest("a_words", F.lit(1))
    return (
        asked.join(dealt(held), ["other", "stretch"])
        .where(ratio.between(settings.near_dup_low, settings.near_dup_high))
        .where((F.abs(F.col("moment") - F.col("event")) <= reach) & (F.col("node") < F.col("pos")))
        .groupBy("pos").agg(F.min("node").alias("c_node"))
    )


def _looked_up(pending, articles, keys, aliases, near, settings: Settings) -> DataFrame:
    """Each pending candidate with the article it meets and what it would do to it."""
    owners = articles.select("url_hash", F.col("node").alias("u_node"))
    first = aliases.groupBy("url_hash").agg(F.min("node").alias("al_node"))
    first = first.join(dealt(
        articles.select(F.col("node").alias("al_node"), F.col("url_hash").alias("al_url"), F.col("fingerprint").alias("al_print"))),
        "al_node",
    )
    met = pending.join(dealt(keys), KEY, "left").join(dealt(owners), "url_hash", "left").join(dealt(first), "url_hash", "left")
    open_ = met.where("k_node IS NULL AND u_node IS NULL AND al_node IS NULL AND fingerprint IS NOT NULL")
    found = met.join(dealt(_copies(open_, articles, near, settings)), "pos", "left").withColumn(
        "met", F.coalesce("k_node", "u_node", "al_node", "c_node")
    )
    rows = found.join(dealt(articles.select(*[F.col(c).alias(f"m_{c}") for c in FIELDS])), F.col("met") == F.col("m_node"), "left")
    col = F.col
    same = lambda a, b: col(a).eqNullSafe(col(b))
    rows = rows.withColumns({
        "known": col("k_node").isNotNull(),
        "creates": col("met").isNull(),
        "promotes": F.coalesce(col("authority") > col("m_authority"), F.lit(False)),
        "own": F.coalesce((col("source_id") == col("m_source_id")) & (col("url_hash") == col("m_url_hash")), F.lit(False)),
        "same_text": same("body_hash", "m_body_hash"),
    })
    # Taking over would give two articles one URL; such a candidate changes nothing.
    rows = rows.withColumn(
        "rejected", col("promotes") & col("u_node").isNotNull() & (col("u_node") != col("met"))
    )
    fixes = col("own") & ~col("promotes") & ~col("creates")
    trusted = (col("body_kind") == col("m_body_kind")) | col("body_kind").isin(*FULL_KINDS)
    rows = rows.withColumns({
        "rekinds": F.coalesce(fixes & col("same_text") & (col("m_body_kind") == "unknown") & (col("body_kind") != "unknown"), F.lit(False)),
        "rebodies": F.coalesce(fixes & ~col("same_text") & ((trusted & ~col("blank")) | (col("words") > col("m_words"))), F.lit(False)),
        "retitles": fixes & ~same("title_hash", "m_title_hash"),
        "dates": ~col("creates") & col("m_published").isNull() & col("published").isNotNull(),
        "moves": col("known") & (col("k_url") != col("url_hash")),
    })
    adds = ~col("rejected") & (~col("known") | col("moves"))
    seen_alias = adds & col("u_node").isNull() & F.coalesce(col("met") < col("al_node"), F.lit(True))
    alters = col("promotes") | col("rekinds") | col("rebodies") | col("retitles") | col("dates")
    loud = col("creates") | (
        ~col("rejected") & (alters | col("moves") | (adds & col("many_keys")) | (seen_alias & col("many_urls")))
    )
    plain = col("creates") & ~col("many_keys") & ~col("many_urls") & col("published").isNotNull()
    return rows.withColumns({"adds": adds, "alters": ~col("rejected") & alters, "loud": loud, "plain": plain})


def _met(rows: DataFrame, reach: int) -> DataFrame:
    """``(pos, resource)`` that a candidate reads or may write, ``bound``: the position up to which it
    matters when that is written, and ``mild``: whether it can only make the candidate quiet."""
    stretch = F.floor(F.col("event") / reach)
    open_ = F.col("k_node").isNull() & F.col("u_node").isNull() & F.col("al_node").isNull()
    asks = open_ & F.col("fingerprint").isNotNull()
    writes = F.col("loud") & ~F.col("plain")
    mine = [
        _named("key", *KEY),
        _named("url", "url_hash"),
        F.when(F.col("moves"), _named("url", "k_url")),
        *[F.when(F.col(n).isNotNull(), _named("article", n)) for n in ("k_node", "u_node", "al_node", "c_node")],
        F.when(F.col("loud") & F.col("m_url_hash").isNotNull(), _named("url", "m_url_hash")),
        F.when(F.col("loud") & F.col("al_url").isNotNull(), _named("url", "al_url")),
        F.when(asks | (F.col("loud") & F.col("fingerprint").isNotNull()), _named("changed print", "fingerprint")),
        F.when(F.col("loud") & F.col("m_fingerprint").isNotNull(), _named("changed print", "m_fingerprint")),
        F.when(writes & F.col("fingerprint").isNotNull(), _named("plain print", "fingerprint")),
        F.when(writes & F.col("m_fingerprint").isNotNull(), _named("plain print", "m_fingerprint")),
        F.when(asks & F.col("creates"), _named("new print", "fingerprint", stretch)),
    ]
    mild = F.when(asks & F.col("c_node").isNotNull(), _named("new print", "fingerprint", stretch))

    def read(resources, bound: str, is_mild: bool):
        return F.transform(
            resources, lambda r: F.struct(r.alias("resource"), F.col(bound).alias("bound"), F.lit(is_mild).alias("mild"))
        )

    every = F.concat(
        read(F.array_distinct(F.array_compact(F.array(*mine))), "pos", False),
        read(F.array_compact(F.array(mild)), "c_node", True),
    )
    return rows.select("pos", "loud", F.inline(every))


def _barriers(sources: DataFrame, near: DataFrame, reach: int) -> DataFrame:
    """``(resource, barrier)``: the first position from which a resource may be written."""
    named = [
        _named("key", *KEY),
        _named("url", "url_hash"),
        *[F.when(F.col(u).isNotNull(), _named("url", u)) for u in ("k_url", "m_url_hash", "al_url")],
        *[F.when(F.col(n).isNotNull(), _named("article", n)) for n in ("k_node", "u_node", "al_node", "c_node")],
    ]
    direct = sources.select("pos", F.explode(F.array_compact(F.array(*named))).alias("resource"))
    prints = F.array_compact(F.array("fingerprint", "m_fingerprint", "al_print"))
    changed = (
        sources.select("pos", "plain", F.explode(prints).alias("other"))
        .groupBy("other", "plain").agg(F.min("pos").alias("pos"))
        .join(dealt(near), "other").select(
            "pos",
            F.when(F.col("plain"), _named("plain print", "fingerprint"))
            .otherwise(_named("changed print", "fingerprint")).alias("resource"),
        )
    )
    stretch = F.floor(F.col("event") / reach)
    made = (
        sources.where(F.col("fingerprint").isNotNull())
        .groupBy(F.col("fingerprint").alias("other"), stretch.alias("at")).agg(F.min("pos").alias("pos"))
        .join(dealt(near), "other")
        .select("pos", "fingerprint", F.explode(F.sequence(F.col("at") - 1, F.col("at") + 1)).alias("stretch"))
        .select("pos", _named("new print", "fingerprint", F.col("stretch")).alias("resource"))
    )
    every = direct.unionByName(changed).unionByName(made)
    return every.groupBy("resource").agg(F.min("pos").alias("barrier"))


def _behind(rows: DataFrame, near: DataFrame, reach: int) -> DataFrame:
    """``(pos, loud, mild)`` of the candidates that are behind a barrier."""
    met = cut(_met(rows, reach))
    sources, n = rows.where("loud"), 0
    while True:
        behind = cut(
            met.join(dealt(_barriers(sources, near, reach)), "resource").where("barrier < bound")
            .groupBy("pos").agg(F.min("loud").alias("loud"), F.min("mild").alias("mild"))
        )
        quiet = behind.where("NOT loud AND NOT mild")
        turned = quiet.count()
        if turned == n:
            return behind
        n = turned
        sources = rows.where("loud").unionByName(rows.join(dealt(quiet.select("pos")), "pos", "left_semi"))


def _changed_articles(articles: DataFrame, settled: DataFrame) -> DataFrame:
    """The articles after the settled candidates of a round."""
    col = F.col
    made = settled.where("creates").select(
        "article_id", col("pos").alias("node"), "source_id", "authority", "url_hash", "title_hash", "body_hash",
        "body_kind", "words", "fingerprint", "published", "fetched",
        *[col("pos").alias(c) for c in ("owner_pos", "title_pos", "body_pos", "author_pos")],
        *[F.lit(True).alias(c) for c in ("created", "changed", "observed", "hit")],
    )
    taken, rebodied = col("promotes"), col("promotes") | col("rebodies")
    retitled = col("promotes") | col("retitles")
    new = {
        "source_id": (taken, col("source_id")), "authority": (taken, col("authority")), "url_hash": (taken, col("url_hash")),
        "owner_pos": (taken, col("pos")), "author_pos": (taken & col("has_author"), col("pos")),
        "title_hash": (retitled, col("title_hash")), "title_pos": (retitled, col("pos")),
        "body_hash": (rebodied, col("body_hash")), "body_pos": (rebodied, col("pos")), "words": (rebodied, col("words")),
        "fingerprint": (rebodied, col("fingerprint")), "body_kind": (rebodied | col("rekinds"), col("body_kind")),
        "published": (col("dates"), col("published")),
    }
    altered = settled.where("alters").select(
        col("met").alias("node"), (rebodied | retitled).alias("n_changed"),
        *[F.when(when, value).otherwise(col(f"m_{name}")).alias(f"n_{name}") for name, (when, value) in new.items()],
    )
    touched = settled.where("NOT creates AND NOT rejected").groupBy(col("met").alias("node")).agg(
        F.max(~col("known") | col("dates")).alias("n_observed")
    )
    joined = articles.join(dealt(altered), "node", "left").join(dealt(touched), "node", "left")
    is_new = col("n_changed").isNotNull()
    columns = []
    for name in FIELDS:
        if name in new:
            columns.append(F.when(is_new, col(f"n_{name}")).otherwise(col(name)).alias(name))
        elif name in ("changed", "observed"):
            columns.append((col(name) | F.coalesce(f"n_{name}", F.lit(False))).alias(name))
        elif name == "hit":
            columns.append((col("hit") | col("n_observed").isNotNull()).alias("hit"))
        else:
            columns.append(col(name))
    return joined.select(*columns).unionByName(made.select(*FIELDS))


def _reachable(pending, articles, keys, aliases, near) -> DataFrame:
    """``(node)`` of the articles that pending candidates can meet or change."""
    urls = pending.select("url_hash").distinct()
    prints = pending.select("fingerprint").distinct().join(dealt(near), "fingerprint").select(F.col("other").alias("fingerprint"))
    return (
        keys.select(F.col("k_node").alias("node"))
        .unionByName(aliases.select("node"))
        .unionByName(articles.join(dealt(urls), "url_hash", "left_semi").select("node"))
        .unionByName(articles.join(dealt(prints.distinct()), "fingerprint", "left_semi").select("node"))
        .distinct()
    )


def settle(
    candidates: DataFrame, articles: DataFrame, keys: DataFrame, aliases: DataFrame, near: DataFrame, settings: Settings
) -> tuple[DataFrame, DataFrame]:
    """Apply ``candidates`` (``ASKED``) in order of ``pos``, in which their authority never rises;
    returns the articles that were met or made (``STATE``) and ``(pos, article_id, created)``, where a
    rejected candidate has no article.

    ``keys``: source_id, external_id, k_node, k_url; ``aliases``: url_hash, node, n; ``near``: pairs
    ``(fingerprint, other)`` of near-equal fingerprints, in both directions and with themselves.
    """
    reach = settings.near_dup_days * DAY
    pending = cut(_shared(candidates.select(*ASKED)))
    asked = pending.columns
    finished, decided = [], []
    keys = cut(keys.join(dealt(pending.select(*KEY).distinct()), KEY, "left_semi"))
    urls = pending.select("url_hash").unionByName(keys.select(F.col("k_url").alias("url_hash"))).distinct()
    aliases = cut(aliases.join(dealt(urls), "url_hash", "left_semi"))
    articles = cut(articles.join(dealt(_reachable(pending, articles, keys, aliases, near)), "node", "left_semi"))
    while True:
        rows = cut(_looked_up(pending, articles, keys, aliases, near, settings))
        behind = _behind(rows, near, reach).select("pos", F.lit(True).alias("waits"))
        told = cut(rows.join(dealt(behind), "pos", "left"))
        settled = told.where("waits IS NULL")
        decided.append(settled.select(
            "pos",
            F.when(~F.col("rejected"), F.coalesce("m_article_id", "article_id")).alias("article_id"),
            F.col("creates").alias("created"),
        ))
        after = _changed_articles(articles, settled)
        pending = told.where("waits").select(*asked)
        if pending.isEmpty():
            finished.append(cut(after))
            break
        done = settled.where("adds").withColumn("node", F.coalesce("met", "pos"))
        fresh = done.select(*KEY, F.col("node").alias("k_node"), F.col("url_hash").alias("k_url"))
        keys = cut(
            keys.join(dealt(fresh.select(*KEY)), KEY, "left_anti").unionByName(fresh)
            .join(dealt(pending.select(*KEY).distinct()), KEY, "left_semi")
        )
        urls = pending.select("url_hash").unionByName(keys.select(F.col("k_url").alias("url_hash"))).distinct()
        one = F.lit(1).cast("bigint")
        moved = done.where("moves").select(F.col("k_url").alias("url_hash"), "node", (-one).alias("n"))
        aliases = cut(
            aliases.unionByName(done.select("url_hash", "node", one.alias("n"))).unionByName(moved)
            .join(dealt(urls), "url_hash", "left_semi")
            .groupBy("url_hash", "node").agg(F.sum("n").alias("n")).where("n > 0")
        )
        after = cut(after)
        live = _reachable(pending, after, keys, aliases, near).withColumn("live", F.lit(True))
        after = cut(after.join(dealt(live), "node", "left"))
        finished.append(after.where("live IS NULL").drop("live"))
        articles = after.where("live").drop("live")
    union = lambda tables: reduce(DataFrame.unionByName, tables)
    return union(finished).where("hit"), union(decided)
