"""Replay over components equals one sequential pass over the whole stream."""

import datetime as dt
import random

from pyspark.sql import functions as F

from eventlens.config import Settings
from eventlens.functions import simhash
from eventlens.operators import resolve, wavefront

AS_OF = dt.datetime(2026, 9, 13, 12)
SETTINGS = Settings(simhash_min_words=8)
COLUMNS = (
    "source_id string, position int, url string, external_id string, title string, body string, "
    "body_kind string, author string, published_at timestamp"
)
SOURCES = [("a", "A", 9), ("b", "B", 5), ("c", "C", 5), ("d", "D", 2)]


def distance(x, y):
    return bin((x ^ y) & (2**64 - 1)).count("1")


class Sequential:
    """The same rules, one candidate after the other over one global list."""

    def __init__(self, prints):
        self.prints, self.articles, self.seen = prints, [], {}

    def run(self, batch, now):
        rank = {s: (-auth, name) for s, name, auth in SOURCES}
        authority = {s: auth for s, _, auth in SOURCES}
        created = []
        for c in sorted(batch, key=lambda c: (*rank[c["source_id"]], c["position"])):
            key = (c["source_id"], c["external_id"] or c["url"])
            obs, fp = self.seen.get(key), self.prints[c["body"]]
            art = obs["article"] if obs else None
            art = art or next((a for a in self.articles if a["url"] == c["url"]), None)
            if art is None:
                holders = [o["article"] for o in self.seen.values() if o["url"] == c["url"]]
                art = min(holders, key=self.articles.index) if holders else None
            if art is None and fp is not None:
                when = c["published_at"] or now
                for a in self.articles:
                    moment = a["published_at"] or a["fetched_at"]
                    ratio = len(c["body"].split()) / max(1, len(a["body"].split()))
                    if (
                        self.prints[a["body"]] is not None
                        and abs(moment - when) <= dt.timedelta(days=7)
                        and 0.8 <= ratio <= 1.25
                        and distance(fp, self.prints[a["body"]]) <= 3
                    ):
                        art = a
                        break
            owner = next((a for a in self.articles if a["url"] == c["url"]), None)
            if art and owner and owner is not art and authority[c["source_id"]] > authority[art["source_id"]]:
                continue
            created.append(art is None)
            if art is None:
                art = dict(c, fetched_at=now)
                self.articles.append(art)
            else:
                better = authority[c["source_id"]] > authority[art["source_id"]]
                same = (c["source_id"], c["url"]) == (art["source_id"], art["url"])
                if same:
                    if art["body_kind"] == "unknown" and c["body"] == art["body"]:
                        art["body_kind"] = c["body_kind"]
                    fixes = c["body"].strip() and (
                        c["body_kind"] == art["body_kind"] or c["body_kind"] in resolve.FULL_KINDS
                    )
                    longer = len(c["body"].split()) > len(art["body"].split())
                    if c["body"] != art["body"] and (fixes or longer):
                        art.update(body=c["body"], body_kind=c["body_kind"])
                    art["title"] = c["title"]
                if better:
                    for field in ("body", "body_kind", "url", "source_id", "title"):
                        art[field] = c[field]
                    art["author"] = c["author"] or art["author"]
                art["published_at"] = art["published_at"] or c["published_at"]
            if obs:
                obs["url"] = c["url"]
            else:
                self.seen[key] = {"article": art, "url": c["url"], "first": c["url"]}
        return created


def stream(seed, rows):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(400)}"
    texts = [" ".join(word() for _ in range(12)) for _ in range(5)]
    texts += [t + " extra" for t in texts[:2]] + ["short text", ""]
    kinds = ["feed_summary", "feed_full", "unknown", "extracted", "discussion"]
    out = []
    for i in range(rows):
        day = rng.randrange(0, 30)
        out.append(
            dict(
                source_id=rng.choice("abcd"),
                position=i,
                url=f"https://h.example/{rng.randrange(9)}",
                external_id=rng.choice(["", f"e{rng.randrange(12)}"]),
                title=f"t{rng.randrange(4)}",
                body=rng.choice(texts),
                body_kind=rng.choice(kinds),
                author=rng.choice([None, "", "me", "you"]),
                published_at=None if rng.random() < 0.3 else dt.datetime(2026, 9, 1) + dt.timedelta(days=day),
            )
        )
    return out


def view(rows):
    fields = ("source_id", "url", "title", "body", "body_kind", "author", "published_at")
    return sorted(
        (tuple("" if r[f] is None else str(r[f]) for f in fields) for r in rows)
    )


def test_batches_equal_sequential_pass(spark):
    # Nine URLs and twelve keys: nearly all candidates hang together, and most depend on others.
    batches = [stream(10 + i, 16) for i in range(2)]
    bodies = sorted({c["body"] for b in batches for c in b})
    texts = spark.createDataFrame([(b,) for b in bodies], "body string")
    prints = dict.fromkeys(bodies)
    for r in simhash.fingerprints(texts, "body", "body", 8).collect():
        prints[r.body] = r.fingerprint
    expected = Sequential(prints)
    sources = spark.createDataFrame(SOURCES, "source_id string, name string, authority_score int")
    articles, observations = resolve.empty_state(spark)
    for i, batch in enumerate(batches):
        now = AS_OF + dt.timedelta(hours=i)
        created = expected.run(batch, now)
        frame = spark.createDataFrame([tuple(c.values()) for c in batch], COLUMNS).withColumn(
            "metadata", F.to_variant_object(F.struct(F.lit(i).alias("run")))
        )
        done = resolve.resolve_articles(frame, sources, articles, observations, now, SETTINGS)
        articles, observations = resolve.cut(done.articles), resolve.cut(done.observations)
        assert done.outcomes.where("created").count() == sum(created)
    got = [r.asDict() for r in articles.collect()]
    assert view(got) == view(expected.articles)
    keyed = {(r.source_id, r.external_id): r.url for r in observations.collect()}
    assert keyed == {k: v["first"] for k, v in expected.seen.items()}
    assert len({r["article_id"] for r in got}) == len(got)


def test_dated_near_copies_settle_in_few_rounds(spark, monkeypatch):
    # Each has its own key and URL; what they meet hangs on the earlier ones' texts and times alone.
    rng = random.Random(5)
    base = [f"w{i}" for i in range(40)]
    texts = [" ".join(base[:i] + ["x"] + base[i + 1 :]) for i in range(0, 40, 20)]
    batch = [
        dict(
            source_id=rng.choice("abcd"), position=i, url=f"https://h.example/{i}", external_id=f"e{i}", title="t",
            body=rng.choice(texts), body_kind="feed_full", author=None,
            published_at=dt.datetime(2026, 1, 1) + dt.timedelta(days=rng.randrange(240)),
        )
        for i in range(60)
    ]
    frame = spark.createDataFrame([(t,) for t in texts], "body string")
    prints = {r.body: r.fingerprint for r in simhash.fingerprints(frame, "body", "body", 8).collect()}
    expected = Sequential(prints)
    created = expected.run(batch, AS_OF)
    rounds, look = [], wavefront._looked_up
    monkeypatch.setattr(wavefront, "_looked_up", lambda *a: rounds.append(1) or look(*a))
    candidates = spark.createDataFrame([tuple(c.values()) for c in batch], COLUMNS).withColumn(
        "metadata", F.to_variant_object(F.struct("position"))
    )
    sources = spark.createDataFrame(SOURCES, "source_id string, name string, authority_score int")
    done = resolve.resolve_articles(candidates, sources, *resolve.empty_state(spark), AS_OF, SETTINGS)
    assert view(r.asDict() for r in done.articles.collect()) == view(expected.articles)
    assert 5 < done.outcomes.where("created").count() == sum(created) < 55
    assert len(rounds) <= 5


def test_unusable_urls_are_rejected(spark):
    sources = spark.createDataFrame(SOURCES, "source_id string, name string, authority_score int")
    articles, observations = resolve.empty_state(spark)
    rows = [("a", 0, "ftp://x.example/", "e", "t", "b", "unknown", None, None)]
    frame = spark.createDataFrame(rows, COLUMNS).withColumn(
        "metadata", F.to_variant_object(F.struct(F.lit(1).alias("run")))
    )
    done = resolve.resolve_articles(frame, sources, articles, observations, AS_OF, SETTINGS)
    assert done.rejected.count() == 1
    assert done.articles.count() == 0


def test_state_of_a_batch_is_not_broadcast(spark):
    """A broadcast passes through the driver, and what is looked up grows with the batch."""
    rows = [
        ("ab"[i % 2], i, f"https://x.example/{i}", f"e{i}", f"t{i}", " ".join(f"w{i % 3}x{j}" for j in range(12)), "feed_full", "", AS_OF)
        for i in range(12)
    ]
    batch = spark.createDataFrame(rows, COLUMNS).withColumn("metadata", F.to_variant_object(F.struct("position")))
    sources = spark.createDataFrame(SOURCES, "source_id string, name string, authority_score int")
    articles, seen = resolve.empty_state(spark)
    done = resolve.resolve_articles(batch, sources, articles, seen, AS_OF, SETTINGS)
    for table in (done.outcomes, done.articles, done.changed):
        assert "Broadcast" not in table._jdf.queryExecution().executedPlan().toString()
    created = done.outcomes.where("created").count()
    assert created == done.articles.count() == 3
