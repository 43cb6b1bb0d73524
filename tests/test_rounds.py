"""Streams, ingest rounds and analysis runs end to end."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from eventlens.config import Settings
from eventlens.operators import subscriptions
from eventlens.plans import analysis, ingest
from eventlens.sources import landing
from eventlens.streaming import ingest as stream_ingest
from eventlens.streaming import state

NOW = dt.datetime(2026, 9, 13, 12)
SOURCES = [("lab", "Lab", "https://lab.example/f", 9, "company", "rss"), ("hn", "HN", "https://hn.example", 5, "community", "hackernews")]
BODY = " ".join(f"token{i}" for i in range(120))
COLUMNS = (
    "source_id string, position int, url string, external_id string, title string, body string, "
    "body_kind string, author string, published_at timestamp"
)


def sources(spark):
    return spark.createDataFrame(
        SOURCES, "source_id string, name string, url string, authority_score int, category string, type string"
    )


def candidates(spark, rows):
    frame = spark.createDataFrame(rows, COLUMNS)
    return frame.withColumn("metadata", F.to_variant_object(F.struct(F.lit(3).alias("hn_points"))))


def first_batch():
    at = lambda hours: NOW - dt.timedelta(hours=hours)
    return [
        ("lab", 0, "https://lab.example/a", "1", "Model release", BODY, "feed_full", None, at(5)),
        ("hn", 0, "https://mirror.example/a", "2", "Model release copy", BODY, "discussion", None, at(4)),
        ("hn", 1, "https://other.example/b", "3", "Something else", "entirely different words here", "discussion", None, at(3)),
        ("hn", 2, "https://old.example/c", "4", "Old", BODY, "discussion", None, at(24 * 30)),
        ("hn", 3, "mailto:x", "5", "Bad link", "x", "discussion", None, at(3)),
    ]


def test_ingest_round_and_replay(spark):
    tables = ingest.empty_tables(spark, sources(spark))
    once = ingest.run_ingest(tables, candidates(spark, first_batch()), NOW)
    counts = once.metrics.first().asDict()
    assert counts == dict(
        fetched=5, created=2, deduplicated=1, filtered=1, embedded=2, clustered=2, extraction_fallbacks=0,
        status="partial",
    )
    assert once.tables.observations.count() == 3
    assert once.tables.members.where("is_primary").count() == once.tables.clusters.count() == 2
    again = ingest.run_ingest(once.tables, candidates(spark, first_batch()[:3]), NOW + dt.timedelta(minutes=30))
    counts = again.metrics.first().asDict()
    assert (counts["created"], counts["deduplicated"], counts["embedded"], counts["clustered"]) == (0, 3, 0, 0)
    assert again.tables.articles.count() == 2


def test_stream_rounds_match_batch(spark, tmp_path):
    folder, root = tmp_path / "in", str(tmp_path / "tables")
    frame = candidates(spark, first_batch()[:3])
    frame.drop("metadata").coalesce(1).write.parquet(str(folder))
    stream = spark.readStream.schema(COLUMNS).parquet(str(folder)).withColumn(
        "metadata", F.to_variant_object(F.struct(F.lit(3).alias("hn_points")))
    )
    for _ in range(2):  # the second start finds nothing new
        query = stream_ingest.ingest_stream(stream, root, sources(spark), str(tmp_path / "cp"), as_of=NOW)
        query.awaitTermination()
    stored = stream_ingest.load_tables(spark, root, sources(spark))
    assert stored.articles.count() == 2 and stored.clusters.count() == 2


def run_memory(frame, name, mode):
    query = frame.writeStream.format("memory").queryName(name).outputMode(mode).start()
    query.processAllAvailable()
    query.stop()


EVENTS = [
    (1, "customer.subscription.created", 10, "c1", "active", 90),
    (2, "customer.subscription.updated", 30, "c1", "canceled", 90),
    (3, "customer.subscription.updated", 20, "c1", "past_due", 90),
    (4, "customer.subscription.updated", 30, "c1", "active", 99),
    (2, "customer.subscription.updated", 30, "c1", "canceled", 90),
    (5, "invoice.paid", 40, "c2", None, None),
]


def subscription_rows(spark, path):
    base = dt.datetime(2026, 1, 1)
    day = lambda n: None if n is None else base + dt.timedelta(days=n)
    rows = [(i, k, day(c), cu, st, day(e), n) for n, (i, k, c, cu, st, e) in enumerate(EVENTS)]
    schema = "event_id int, kind string, created timestamp, customer_id string, status string, period_end timestamp, arrival int"
    extra = lambda df: df.withColumn("subscription_id", F.lit("s")).withColumn("price_id", F.lit("p"))
    frame = spark.createDataFrame(rows, schema)
    frame.coalesce(1).write.parquet(path)
    return extra(frame), extra(spark.readStream.schema(schema).parquet(path))


def test_subscription_stream_equals_batch(spark, tmp_path):
    batch, stream = subscription_rows(spark, str(tmp_path / "e"))
    as_of = "2026-02-15 00:00:00"
    expected = subscriptions.subscription_state(batch, as_of)
    run_memory(state.subscription_stream(stream, as_of), "subs", "update")
    got = spark.table("subs").select("customer_id", "subscription_status", "subscription_tier").collect()
    assert got == expected.select("customer_id", "subscription_status", "subscription_tier").collect()
    assert got[0].subscription_status == "canceled" and got[0].subscription_tier == "pro"
    run_memory(state.receipt_stream(stream), "receipts", "append")
    assert sorted(r.event_id for r in spark.table("receipts").collect()) == [1, 2, 3, 4, 5]
    run_memory(state.change_stream(stream), "changes", "append")
    assert [(r.customer_id, r.status) for r in spark.table("changes").collect()] == [("c1", "active"), ("c1", "canceled")]


def test_scope_deletes_its_own_tables_only(spark):
    from eventlens.session import cut, scope

    outside = cut(spark.range(3))
    with scope(spark):
        inside = cut(spark.range(4))
        assert inside.count() == 4
    assert outside.count() == 3 and cut(spark.range(2)).count() == 2
    with pytest.raises(Exception):
        spark.read.parquet(inside.inputFiles()[0]).count()


def test_landing_files(spark, tmp_path):
    folder = tmp_path / "source_id=lab" / "type=rss"
    folder.mkdir(parents=True)
    (folder / "7.xml").write_text("<rss/>")
    rows = landing.read_landing(spark, str(tmp_path), sources(spark)).collect()
    assert [(r.source_id, r.type, r["rank"], r.base_url, r.payload) for r in rows] == [
        ("lab", "rss", 7, "https://lab.example/f", "<rss/>")
    ]
    landing.register(spark)
    plugged = spark.read.format("landing").load(str(tmp_path)).collect()
    assert [(r.source_id, r["rank"], r.payload) for r in plugged] == [("lab", 7, "<rss/>")]


def payload(content, tokens=300):
    return json.dumps(
        {
            "usage": {"prompt_tokens": tokens, "prompt_cache_hit_tokens": 100, "completion_tokens": 90},
            "model": "m",
            "id": "r",
            "choices": [{"message": {"content": content}, "finish_reason": "stop"}],
        }
    )


ANALYSIS = {
    "event_type": "model_release", "technical_significance": 7, "who_should_care": ["engineers"],
    "why_it_matters": "x", "what_to_watch": "y", "code_paper_links": [], "hype_check": "accurate",
}
CALLS = "call_id string, cache_key string, status string, output string, created_at timestamp"


def test_analysis_run(spark):
    done = ingest.run_ingest(ingest.empty_tables(spark, sources(spark)), candidates(spark, first_batch()[:3]), NOW)
    t = done.tables
    settings = Settings()
    calls = spark.createDataFrame([], CALLS)
    none = spark.createDataFrame([], "cache_key string, payload string")
    run = lambda landed, calls=calls, clusters=t.clusters: analysis.run_analysis(
        clusters, t.members, t.articles, t.sources, calls, landed, NOW, settings=settings
    )
    waiting = run(none)
    assert {r.outcome for r in waiting.results.collect()} == {"awaiting", "insufficient_evidence"}

    packs = analysis.evidence.build_evidence(t.clusters, t.members, t.articles, t.sources).where("enough")
    rows = packs.withColumn("latest_published_at", F.lit(NOW))
    first = analysis.stage_requests(rows, "summary", "", settings).first().cache_key
    summary = rows.withColumn("summary", F.lit("a b c"))
    second = analysis.stage_requests(summary, "analysis", "", settings).first().cache_key
    landed = spark.createDataFrame(
        [(first, payload('{"sentences":["a","b","c"]}')), (second, payload(json.dumps(ANALYSIS)))],
        "cache_key string, payload string",
    )
    ready = run(landed)
    outcome = {r.outcome: r for r in ready.results.collect()}
    assert outcome["ready"].significance_score == 7 and outcome["ready"].summary == "a b c"
    cluster = ready.clusters.where("analysis_status = 'ready'").first()
    assert cluster.event_type == "model_release" and cluster.analysis_input_hash
    assert ready.calls.where("status = 'succeeded'").count() == 2
    repeat = run(none, ready.calls, ready.clusters)
    assert repeat.counts.first().cached == 1
    replay = run(none, ready.calls)
    assert (replay.counts.first().ready, replay.counts.first().summary_cache_hits) == (1, 1)
    assert replay.calls.count() == 2
