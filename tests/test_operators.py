import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventlens.operators import assignment, components, contracts, ledger, near_dup, scans, similarity
from eventlens.sources import feeds, sinks

START = dt.datetime(2024, 1, 1)


def test_running_values_equal_python(spark):
    rng = random.Random(1)
    rows = [(i, "hot" if rng.random() < 0.7 else f"k{i % 5}", rng.randrange(100)) for i in range(300)]
    frame = spark.createDataFrame(rows, "id long, key string, v long").repartition(4)
    placed = scans.positioned(frame, [F.asc("id")])
    got = scans.running(placed, ["key"], {"total": ("sum", F.col("v")), "top": ("max", F.col("v"))})
    seen = {}
    expected = {}
    for i, key, v in rows:
        total, top = seen.get(key, (0, -1))
        seen[key] = expected[i] = (total + v, max(top, v))
    assert {r.id: (r.total, r.top) for r in got.collect()} == expected


def test_components_equal_union_find(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)]
    label = list(range(60))
    for _ in range(60):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    nodes = spark.range(60).withColumnRenamed("id", "node")
    got = components.connected_components(nodes, spark.createDataFrame(edges, "a long, b long"))
    assert {r.node: r.component for r in got.collect()} == dict(enumerate(label))


@pytest.mark.parametrize("blocks", [4, 5, 6])
def test_banded_pairs_are_lossless(spark, blocks):
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(20)]
    values = {b ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(5))) & (2**64 - 1) for b in base for _ in range(6)}
    signed = [v - 2**64 if v >= 2**63 else v for v in (x & (2**64 - 1) for x in values)]
    frame = spark.createDataFrame([(v,) for v in signed], "fingerprint long")
    got = {tuple(r) for r in near_dup.fingerprint_pairs(frame, frame, 3, blocks).collect()}
    expected = {(a, b) for a in signed for b in signed if bin((a ^ b) & (2**64 - 1)).count("1") <= 3}
    assert got == expected


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(4)
    prints = [rng.getrandbits(63) for _ in range(4)]
    rows = []
    for i in range(150):
        fp = prints[0] if rng.random() < 0.4 else prints[rng.randrange(4)] ^ (1 << rng.randrange(64) if rng.random() < 0.5 else 0)
        fp = fp - 2**64 if fp >= 2**63 else fp
        event = START + dt.timedelta(hours=rng.randrange(1200))
        rows.append((i, fp, rng.choice([100, 120, 126, 90]), event, START + dt.timedelta(hours=rng.randrange(900))))
    frame = spark.createDataFrame(rows, "article_id long, fingerprint long, words int, event_time timestamp, fetched_at timestamp")
    got = {r.article_id: r.match_id for r in near_dup.near_duplicates(frame).collect()}
    for i, fp, words, event, fetched in rows:
        close = [
            (f, j) for j, g, w, e, f in rows
            if bin((fp ^ g) & (2**64 - 1)).count("1") <= 3 and abs(event - e) <= dt.timedelta(days=7)
            and 0.8 <= words / w <= 1.25 and (f, j) < (fetched, i)
        ]
        assert got[i] == (min(close)[1] if close else None)


def sequential_events(rows, threshold=0.85, window=dt.timedelta(hours=72)):
    """One pass over all articles against all clusters."""
    order = sorted(rows, key=lambda r: (r[1] is None, r[1] or START, r[2], r[0]))
    clusters, out = [], {}
    moment = lambda r: r[1] or r[2]
    for row in order:
        best, top = None, threshold
        for cluster in clusters:
            head = max(cluster, key=lambda r: r[4:])
            latest = max(map(moment, cluster))
            if abs(latest - moment(row)) <= window and abs(moment(head) - moment(row)) <= window:
                score = round(float(np.dot(row[3], head[3])), 9)
                if score >= top:
                    best, top = cluster, score
        if best is None:
            best = []
            clusters.append(best)
        best.append(row)
        out[row[0]] = best[0][0]
    return out


@pytest.mark.parametrize("copies,replay_rows", [(False, 20_000), (True, 5)])
def test_event_assignment_equals_sequential_pass(spark, copies, replay_rows):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(5, 8))
    rows = []
    for i in range(40 if copies else 90):
        v = base[rng.integers(2)] if copies else base[rng.integers(5)] + rng.normal(size=8) * 0.3
        v = (v / np.linalg.norm(v)).astype(np.float32).astype(float)
        v = v / np.linalg.norm(v)
        published = START + dt.timedelta(hours=int(rng.integers(200))) if rng.random() < 0.9 else None
        fetched = START + dt.timedelta(hours=int(rng.integers(250)))
        rows.append((i, published, fetched, v.tolist(), int(rng.integers(1, 4)), int(rng.integers(1, 9)), f"u{i:03d}"))
    frame = spark.createDataFrame(
        rows, "article_id long, published_at timestamp, fetched_at timestamp, embedding array<double>, authority int, words int, canonical_url string"
    )
    got = assignment.assign_events(frame, replay_rows=replay_rows)
    assert {r.article_id: r.cluster_id for r in got.collect()} == sequential_events(rows)


def test_pivot_cells_lose_nothing(spark):
    rng = np.random.default_rng(6)
    centers = rng.normal(size=(6, 16))
    data = [(centers[i % 6] + rng.normal(size=16) * 0.3) for i in range(200)]
    rows = [(i, i * 3_600_000_000, i, [float(x) for x in v]) for i, v in enumerate(data)]
    frame = spark.createDataFrame(rows, "id long, at long, rank long, vector array<float>")
    pivots = centers / np.linalg.norm(centers, axis=1, keepdims=True)
    plain = similarity.similar(frame, frame, 0.85, 48).select("left_id", "right_id")
    pruned = similarity.similar(frame, frame, 0.85, 48, pivots=pivots).select("left_id", "right_id")
    assert {tuple(r) for r in plain.collect()} == {tuple(r) for r in pruned.collect()}


@pytest.mark.parametrize("earlier_only", [True, False])
def test_blocks_of_a_bucket_meet_all_rows_with_few_copies(spark, monkeypatch, earlier_only):
    """Tiles, several blocks a bucket and right rows in several batches give what all pairs give."""
    for name, value in (("HELD_ROWS", 40), ("BLOCK_ROWS", 20), ("TILE", (16, 24))):
        monkeypatch.setattr(similarity, name, value)
    rng = np.random.default_rng(8)
    base = rng.normal(size=(12, 6))
    data = np.round(base[rng.integers(12, size=300)] + rng.integers(0, 2, size=(300, 1)) * 0.4, 3)
    rows = [(i, int(rng.integers(120)) * 3_600_000_000, int(r), v.tolist()) for i, (r, v) in enumerate(zip(rng.permutation(300), data))]
    frame = spark.createDataFrame(rows, "id long, at long, rank long, vector array<float>").repartition(3)
    unit = data.astype(np.float32).astype(float)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    score = np.round(unit @ unit.T, 9)
    pairs = {
        (x[0], y[0]) for x in rows for y in rows
        if score[x[0], y[0]] >= 0.9 and abs(x[1] - y[1]) <= 24 * 3_600_000_000
        and (y[2] < x[2] if earlier_only else x[0] != y[0])
    }
    got = similarity.similar(frame, frame, 0.9, 24, earlier_only)
    assert sorted((r.left_id, r.right_id) for r in got.collect()) == sorted(pairs)
    best = similarity.similar(frame, frame, 0.9, 24, earlier_only, best_only=True).collect()
    wanted = {}
    for a, b in pairs:
        wanted[a] = max(wanted.get(a, (-2, -1, -1)), (min(score[a, b], 1.0), rows[b][2], b))
    assert {r.left_id: r.right_id for r in best} == {a: w[2] for a, w in wanted.items()}
    links = {(r.a, r.b) for r in similarity.similar(frame, frame, 0.9, 24, earlier_only, links_only=True).collect()}

    def groups(edges):
        label = list(range(300))
        for _ in range(300):
            before = list(label)
            for a, b in edges:
                label[a] = label[b] = min(label[a], label[b])
            if before == label:
                return label

    assert groups(links) == groups(pairs)


def test_a_right_row_is_copied_per_block_not_per_pair_of_blocks(spark, monkeypatch):
    monkeypatch.setattr(similarity, "BLOCK_ROWS", 10, raising=False)
    rows = [(i, 0, i, [1.0, float(i)]) for i in range(400)]
    frame = spark.createDataFrame(rows, "id long, at long, rank long, vector array<float>")
    side = frame.withColumns({"bucket": F.lit(0).cast("bigint"), "cell": F.lit(0)})
    met = similarity._meet(side, side, True)
    assert met.count() <= 400 * (1 + similarity.LEAST_BLOCKS)


def test_a_right_row_goes_to_the_stretches_of_its_window(spark, monkeypatch):
    for name, value in (("HELD_ROWS", 10), ("BLOCK_ROWS", 10)):
        monkeypatch.setattr(similarity, name, value)
    met, meet = [], similarity._meet
    monkeypatch.setattr(similarity, "_meet", lambda *a: met.append(meet(*a)) or met[0])
    rng = np.random.default_rng(9)
    rows = [(i, i * 1_440_000_000, i, rng.normal(size=4).tolist()) for i in range(600)]
    frame = spark.createDataFrame(rows, "id long, at long, rank long, vector array<float>")
    got = {(r.left_id, r.right_id) for r in similarity.similar(frame, frame, 0.5, 24).collect()}
    unit = np.array([r[3] for r in rows], np.float32).astype(float)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    close = unit @ unit.T >= 0.5
    assert got == {(i, j) for i in range(600) for j in range(max(0, i - 60), i) if close[i, j]}
    # Sixty rows a window in blocks of ten: six blocks and those cut by its ends, not twice six.
    assert met[0].count() <= 600 * (1 + 6 + 2)


def test_only_linked_articles_are_replayed(spark, monkeypatch):
    given, replay = [], assignment.replay
    monkeypatch.setattr(assignment, "replay", lambda items, *a: given.append(items) or replay(items, *a))
    rows = [(i, START, START, [float(i % 4 == k) for k in range(4)], 1, 1, f"u{i}") for i in range(5)]
    frame = spark.createDataFrame(
        rows, "article_id long, published_at timestamp, fetched_at timestamp, embedding array<double>, authority int, words int, canonical_url string"
    )
    got = {r.article_id: (r.cluster_id, r.similarity_score) for r in assignment.assign_events(frame).collect()}
    assert got == {0: (0, 1.0), 1: (1, 1.0), 2: (2, 1.0), 3: (3, 1.0), 4: (0, 1.0)}
    assert given[0].count() == 2


GOOD = '{"sentences":["a","b","c"]}'


@pytest.mark.parametrize(
    "content,expected",
    [
        (GOOD, []),
        ('{"sentences":["a","b"," "]}', ["sentence_text"]),
        ('{"sentences":["a","b"]}', ["sentences"]),
        ('{"sentences":["a","b","c"],"x":1}', ["keys"]),
        ("nonsense", ["object", "keys", "sentences"]),
    ],
)
def test_summary_contract(spark, content, expected):
    frame = spark.createDataFrame([(content,)], "content string")
    assert frame.select(contracts.summary_violations("content").alias("v")).first().v == expected


def test_arxiv_snapshot_rules(spark):
    item = lambda link, day, kind="new": (
        f"<item><title>T</title><link>{link}</link><description>arXiv:1 Announce Type: {kind} Abstract: Text.</description>"
        f"<pubDate>{day} Sep 2026 00:00:00 GMT</pubDate><guid>g</guid></item>"
    )
    body = "".join(
        item(f"https://arxiv.org/abs/2609.{n:05d}", day) for n, day in ((1, 12), (1, 12), (2, 1), (3, 13), (4, 13))
    )
    wrap = lambda items: f'<rss version="2.0"><channel>{items}</channel></rss>'
    rows = [("s", "good", None, wrap(body)), ("s", "bad", None, wrap(body + item("https://x.example/", 13)))]
    frame = spark.createDataFrame(rows, "source_id string, payload_id string, base_url string, payload string")
    got = feeds.parse_arxiv_rss(frame, 2, 7, "2026-09-13 12:00:00").orderBy("position").collect()
    assert [(r.payload_id, r.url[-5:], r.body) for r in got] == [("good", "00001", "Text."), ("good", "00003", "Text.")]


def test_budget_and_queue(spark):
    plan = spark.createDataFrame([(i, "r", START, 0.4) for i in range(4)], "call_id long, run_id string, created_at timestamp, reservation double")
    assert sorted(r.call_id for r in ledger.within_budget(plan, 1.0).collect()) == [0, 1]
    states = spark.createDataFrame(
        [(i, START - dt.timedelta(hours=i), i in (0, 4), i != 1) for i in range(8)],
        "cluster_id long, latest_published_at timestamp, unchanged boolean, enough boolean",
    )
    got = {r.cluster_id: r.outcome for r in ledger.analysis_queue(states, 2).collect()}
    assert got == {0: "cached", 1: "insufficient_evidence", 2: "attempt", 3: "attempt", 4: "cached"}


def test_snapshots(spark, tmp_path):
    path = str(tmp_path / "t")
    assert sinks.read_snapshot(spark, path) is None
    sinks.write_snapshot(spark.range(3), path)
    merged = sinks.upsert(sinks.read_snapshot(spark, path).withColumn("v", F.lit(0)), spark.createDataFrame([(2, 9), (5, 9)], "id long, v int"), ["id"])
    assert sinks.write_snapshot(merged, path) == 2
    assert {(r.id, r.v) for r in sinks.read_snapshot(spark, path).collect()} == {(0, 0), (1, 0), (2, 9), (5, 9)}
