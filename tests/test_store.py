"""The bucketed store: untouched buckets, killed writers, repeated batches, compaction; payload rounds."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from eventlens.plans import ingest
from eventlens.sources.store import Store, changed_rows
from eventlens.streaming import ingest as stream_ingest

NOW = dt.datetime(2026, 9, 13, 12)
KEYS = {"t": ["k"], "u": ["k", "j"]}


def table(spark, rows):
    return spark.createDataFrame(rows, "k long, v string")


def rows_of(frame):
    return sorted(tuple(r) for r in frame.collect())


def test_untouched_buckets_keep_their_files(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), KEYS, buckets=8)
    assert store.read("t") is None
    first = [(k, f"v{k}") for k in range(100)]
    assert store.commit({"t": (table(spark, first), None)}, {"batch_id": 0}) == 1
    before = store.manifest().files["t"]
    upserts, gone = changed_rows(
        store.read("t"), table(spark, [*first[1:50], (50, "new"), *first[51:], (100, "v100")]), ["k"]
    )
    assert rows_of(upserts) == [(50, "new"), (100, "v100")] and rows_of(gone) == [(0,)]
    store.commit({"t": (upserts, gone)}, {"batch_id": 1})
    touched = {str(r.b) for r in spark.createDataFrame([(0,), (50,), (100,)], "k long").select(store.bucket_of("t").alias("b")).collect()}
    after = store.manifest().files["t"]
    assert {b for b in after if after[b] != before[b]} == touched and len(touched) < 8
    wanted = sorted([*first[1:50], (50, "new"), *first[51:], (100, "v100")])
    assert rows_of(store.read("t")) == wanted
    assert rows_of(store.read("t", number=1)) == first
    one = int(sorted(touched)[0])
    assert rows_of(store.read("t", buckets=[one])) == rows_of(store.read("t").where(store.bucket_of("t") == one))


def test_killed_writer_leaves_the_old_version(spark, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path / "s"), KEYS, buckets=4)
    store.commit({"t": (table(spark, [(1, "a")]), None)}, {})
    monkeypatch.setattr(Store, "_publish", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt))
    with pytest.raises(KeyboardInterrupt):
        store.commit({"t": (table(spark, [(1, "b"), (2, "c")]), None)}, {})
    monkeypatch.undo()
    assert rows_of(store.read("t")) == [(1, "a")] and store.numbers() == [1]
    assert store.vacuum() > 0  # what the killed writer left
    assert rows_of(store.read("t")) == [(1, "a")]
    store.commit({"t": (table(spark, [(2, "d")]), None)}, {})
    assert rows_of(store.read("t")) == [(1, "a"), (2, "d")]


def test_compaction_folds_crowded_buckets_only(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), KEYS, buckets=4)
    store.commit({"t": (table(spark, [(k, "0") for k in range(40)]), None)}, {})
    for n in range(1, 4):
        store.commit({"t": (table(spark, [(7, str(n))]), table(spark, [(n + 10, "")]).select("k"))}, {"n": n})
    wanted = rows_of(store.read("t"))
    crowded = {int(b) for b, f in store.manifest().files["t"].items() if len(f) > 2}
    kept = {b: f for b, f in store.manifest().files["t"].items() if int(b) not in crowded}
    assert set(store.compact("t", most=2)) == crowded != set()
    after = store.manifest()
    assert all(len(after.files["t"][str(b)]) == 1 for b in crowded) and after.info == {"n": 3}
    assert {b: f for b, f in after.files["t"].items() if b in kept} == kept
    assert rows_of(store.read("t")) == wanted
    store.vacuum(keep=1)
    assert rows_of(store.read("t")) == wanted and store.numbers() == [after.number]


def test_empty_tables_and_variants(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), KEYS, buckets=4)
    frame = spark.range(3).select(
        F.col("id").alias("k"), F.lit("x").alias("j"), F.to_variant_object(F.struct(F.col("id").alias("a"))).alias("m")
    )
    store.commit({"u": (frame.limit(0), None)}, {})
    assert store.read("u").count() == 0
    upserts, gone = changed_rows(store.read("u"), frame, KEYS["u"])
    store.commit({"u": (upserts, gone)}, {})
    upserts, gone = changed_rows(store.read("u"), frame, KEYS["u"])
    assert upserts.count() == gone.count() == 0


FEED = """<rss version="2.0"><channel><title>f</title>{}</channel></rss>"""
ITEM = """<item><title>{0}</title><link>https://{1}.example/{2}</link><guid>{2}</guid>
<description>{3}</description><pubDate>Sat, 12 Sep 2026 10:00:00 GMT</pubDate></item>"""


def test_round_from_payloads(spark, tmp_path):
    names = "source_id string, name string, url string, authority_score int, category string, type string, is_active boolean, config map<string,string>, last_fetched_at timestamp, last_error string"
    sources = spark.createDataFrame([
        ("lab", "Lab", "https://lab.example/f", 9, "company", "rss", True, {"etag": "old"}, None, None),
        ("press", "Press", "https://press.example/f", 5, "press", "rss", True, {"etag": "old"}, None, None),
        ("off", "Off", "https://off.example/f", 5, "press", "rss", False, {"etag": "old"}, None, None),
    ], names)
    long = " ".join(f"token{k}" for k in range(320))
    payloads = spark.createDataFrame([
        ("lab", "rss", None, 0, "p1", "https://lab.example/f", FEED.format(ITEM.format("One", "lab", "a", long) + ITEM.format("Two", "lab", "b", "short"))),
        ("press", "rss", None, 0, "p2", "https://press.example/f", FEED.format(ITEM.format("Copy", "press", "c", long))),
        ("press", "rss", None, 1, "p3", "https://press.example/f", "not a feed"),
        ("off", "rss", None, 0, "p4", "https://off.example/f", FEED.format(ITEM.format("No", "off", "d", long))),
    ], "source_id string, type string, format string, rank bigint, payload_id string, base_url string, payload string")
    pages = spark.createDataFrame([("https://nowhere.example/", "x")], "url string, text string")
    states = spark.createDataFrame([("lab", {"etag": "new"}), ("press", {"etag": "new"})], "source_id string, state map<string,string>")
    done = ingest.run_payloads(ingest.empty_tables(spark, sources), payloads, pages, states, NOW)
    counts = done.metrics.first().asDict()
    assert (counts["fetched"], counts["created"], counts["deduplicated"], counts["extraction_fallbacks"], counts["status"]) == (3, 2, 1, 1, "partial")
    told = {r.source_id: (r.config["etag"], r.last_error) for r in done.tables.sources.collect()}
    assert told == {"lab": ("new", None), "press": ("old", "no items: p3"), "off": ("old", None)}
    store = Store(spark, str(tmp_path / "s"), stream_ingest.KEYS)
    blank = ingest.empty_tables(spark, sources)
    stream_ingest.store_round(store, blank, done.tables, {"batch_id": 0})
    stored = stream_ingest.load_tables(spark, store.root, sources)
    assert stored.articles.count() == 2 and stored.observations.count() == 3
    better = pages.unionByName(spark.createDataFrame([("https://lab.example/b", long + " more")], "url string, text string"))
    again = ingest.run_payloads(ingest.IngestTables(done.tables.sources, *(getattr(stored, n) for n in stream_ingest.STORED)), payloads.where("payload_id = 'p1'"), better, states, NOW)
    assert again.metrics.first().deduplicated == 2 and again.metrics.first().extraction_fallbacks == 0
    stream_ingest.store_round(store, stored, again.tables, {"batch_id": 1})
    bodies = stream_ingest.load_tables(spark, store.root, sources).articles.select("title", "body_kind").collect()
    assert ("Two", "extracted") in {tuple(r) for r in bodies}
