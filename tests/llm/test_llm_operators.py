"""Operators and pipeline over small tables with nulls, ties, repeats and clashing columns."""

import collections
import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from eventlens.llm import (
    bagminhash, exact_dedup, metric_join, packing, page_diff, preference, queries, segment_bpe, shingles, suffixes,
    token_files, toxicity,
)
from eventlens.llm.common import table
from eventlens.session import cut

WORDS, BYTES = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json"))
SMALL = "/root/testdata/sf0.001"
CLASHES = "hash string, plain string, rep long, key long, gram int, low int, places int, covers string, label string"
SCHEMA = f"doc_id long, text string, lang string, source string, n_chars long, {CLASHES}"


def passage(seed, words=80):
    rng = np.random.default_rng(seed)
    return " ".join("".join(rng.choice(list("abcdefghij"), 6)) for _ in range(words))


LONG = passage(0, 30_000)
TEXTS = [
    (1, "Same  text"), (2, "Same text"), (3, "Sametext"), (4, None), (5, ""), (6, " \n\t"), (7, "other"),
    (10, passage(1)), (11, passage(1) + " end"), (12, passage(1).replace(" ", "  ", 1)), (13, passage(2)),
    (14, passage(3) + " " + passage(2) + " " + passage(4)), (15, LONG), (16, "é" * 300), (17, "é" * 300),
    (18, "tiny"), (18, "tiny"), (19, "tiny"), (None, "nobody"), (None, "other"),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(d, t, None, "s", None, *[None] * 9) for d, t in TEXTS]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def rows_of(frame):
    return sorted((tuple(r) for r in frame.collect()), key=repr)


def test_exact_groups(docs, nothing):
    plain = [(d, t or "", re.sub(r"[\x20\x09-\x0D]", "", t or "")) for d, t in TEXTS]
    wanted = []
    for d, _, p in plain:
        same = [(-len(t), d2 is None, d2) for d2, t, q in plain if q == p]
        keep = min(same, key=lambda x: (x[0], x[1], x[2] or 0))[2]
        wanted.append((d, keep, len(same), d == keep, hashlib.sha256(p.encode()).hexdigest()))
    assert rows_of(exact_dedup.exact_groups(docs)) == sorted(wanted, key=repr)
    assert exact_dedup.exact_groups(nothing).count() == 0
    kept = exact_dedup.drop_exact(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {d for d, *_, k, _ in wanted if k}


def test_exact_groups_are_native(docs):
    assert "Python" not in exact_dedup.exact_groups(docs)._jdf.queryExecution().toString()


def test_near_classes(docs, nothing):
    named = [(d, t) for d, t in TEXTS if d is not None]
    sets = shingles.multisets([t for _, t in named])
    up = {d: d for d, _ in named}

    def find(x):
        return x if up[x] == x else find(up[x])

    for i, (a, _) in enumerate(named):
        for j, (b, _) in enumerate(named[:i]):
            if shingles.similarity(sets[i], sets[j]) >= 0.8:
                x, y = sorted((find(a), find(b)))
                up[y] = x
    wanted = [(d, find(d) if d is not None else None, d is None or find(d) == d) for d, _ in TEXTS]
    assert rows_of(bagminhash.near_classes(docs)) == sorted(wanted, key=repr)
    assert bagminhash.near_classes(nothing).count() == 0
    assert bagminhash.drop_near(docs).columns == docs.columns


def test_texts_under_one_id_each_keep_their_links(spark):
    one, two = passage(21), passage(22)
    rows = [(1, one), (1, two), (2, two + " end"), (3, one + " end"), (4, passage(23)), (5, passage(24)), (5, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in bagminhash.near_classes(frame).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5}


def test_copies_gather_round_the_text_they_come_from(spark, monkeypatch):
    """Copies at 0.85 of one text and 0.7 of each other, whose source has the largest id."""
    words = [f"word{k}" for k in range(200)]
    texts = []
    for n in range(80):
        own = list(words)
        for k in range(3):
            own[(n * 7 + k * 61) % 200] = f"own{n}x{k}"
        texts.append(" ".join(own))
    frame = spark.createDataFrame(list(enumerate([*texts, " ".join(words)])), "doc_id long, text string")
    counts = []
    compared = bagminhash._compared
    monkeypatch.setattr(bagminhash, "_compared", lambda p, t: counts.append(p.count()) or compared(p, t))
    assert {r.class_id for r in bagminhash.near_classes(frame).collect()} == {0}
    assert sum(counts) <= 2 * len(texts), counts


def test_members_of_a_dense_group_are_compared_about_once(spark, monkeypatch):
    base = passage(31, 200).split()
    rng = np.random.default_rng(7)
    texts = []
    for k in range(150):
        words = list(base)
        for at in rng.integers(0, 200, 2):
            words[at] = f"w{k}x{at}"
        texts.append((k, " ".join(words)))
    counts = []
    compared = bagminhash._compared
    monkeypatch.setattr(bagminhash, "_compared", lambda p, t: counts.append(p.count()) or compared(p, t))
    frame = spark.createDataFrame(texts, "doc_id long, text string")
    assert {r.class_id for r in bagminhash.near_classes(frame).collect()} == {0}
    assert sum(counts) <= 2 * len(texts)


def test_smallest_and_largest_ids_are_kept(spark):
    rows = [(-(1 << 63), "a b"), ((1 << 63) - 1, "a b"), (0, "ab"), (-(1 << 63), "c"), (5, "c")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.keep_id, r.kept) for r in exact_dedup.exact_groups(frame).collect()}
    low = -(1 << 63)
    assert got == {(low, low, True), ((1 << 63) - 1, low, False), (0, low, False), (5, low, False)}


def test_columns_of_any_name_pass_the_stages(spark):
    text = passage(41) + " " + passage(42)
    rows = [(1, text, 1, "x"), (2, text, 2, None), (3, "short", 3, "y")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, `my col` int, `a``b.c` string")
    for drop in (suffixes.drop_repeats, bagminhash.drop_near, exact_dedup.drop_exact):
        done = drop(frame)
        assert done.columns == frame.columns
        assert {tuple(r)[2:] for r in done.collect()} <= {(1, "x"), (2, None), (3, "y")}


def test_outliers_of_a_dense_group_keep_their_links(spark):
    base = passage(5, 200).split()
    rng = np.random.default_rng(4)
    texts = []
    for k in range(60):  # from near copies to texts that only resemble each other
        words = list(base)
        for at in rng.integers(0, 200, int(rng.integers(0, 16))):
            words[at] = f"w{k}x{at}"
        texts.append(" ".join(words))
    sets = shingles.multisets(texts)
    up = list(range(60))

    def find(x):
        return x if up[x] == x else find(up[x])

    for i in range(60):
        for j in range(i):
            if shingles.similarity(sets[i], sets[j]) >= 0.8:
                x, y = sorted((find(i), find(j)))
                up[y] = x
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r.class_id for r in bagminhash.near_classes(frame).orderBy("doc_id").collect()] == [find(k) for k in range(60)]


def brute_repeats(texts):
    coded = [(t or "").encode() for t in texts]
    seen = collections.Counter(c[i:i + 200] for c in coded for i in range(len(c) - 199))
    out = []
    for c in coded:
        mask = np.zeros(len(c) + 1, bool)
        for i in range(len(c) - 199):
            if seen[c[i:i + 200]] > 1:
                mask[i:i + 200] = True
        mask = mask[:len(c)]
        left = bytes(np.frombuffer(c, np.uint8)[~mask])
        spans = int((np.diff(np.concatenate([[0], mask.astype(int)])) == 1).sum())
        out.append((len(c), int(mask.sum()), spans, hashlib.sha256(left).hexdigest()))
    return out


@pytest.mark.parametrize("most", [1, 4_096])
def test_repeats_removed(docs, nothing, monkeypatch, most):
    monkeypatch.setattr(suffixes, "MOST_CONTENTS", most)
    short = docs.where(F.coalesce("doc_id", F.lit(0)) != 15)
    texts = [(d, t) for d, t in TEXTS if d != 15]
    wanted = [(d, *r) for (d, _), r in zip(texts, brute_repeats([t for _, t in texts]))]
    assert rows_of(suffixes.repeats_removed(short)) == sorted(wanted, key=repr)
    assert suffixes.repeats_removed(nothing).count() == 0
    assert suffixes.drop_repeats(short).columns == docs.columns


def test_light_and_heavy_minimisers_share_one_shuffle_of_texts(spark, monkeypatch):
    stored = []
    monkeypatch.setattr(suffixes, "cut", lambda df: stored.append(df) or cut(df))
    monkeypatch.setattr(suffixes, "MOST_CONTENTS", 2)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        suffixes.covered(table(spark, SMALL, "documents").select(F.col("doc_id").alias("row"), "text"))
        assert len(stored) == 2
        stored[1].collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    plan = stored[1]._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert re.search(r"ReusedExchange \[row#\w+, text#\w+\]", plan)
    shuffles = re.findall(r"Exchange hashpartitioning\(row#.*\n.*Project \[doc_id#\w+ AS row#\w+, text#", plan)
    assert len(shuffles) <= 1, plan


def test_token_files(spark, docs, nothing):
    library = Tokenizer.from_file(WORDS)
    coded = [(d, library.encode(t or "", add_special_tokens=False).ids + [1]) for d, t in TEXTS]
    path = token_files.new_path(spark)
    token_files.write_tokens(docs, path, WORDS, 1)
    got = sorted(token_files.read_tokens(spark, path).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted((d for d, _ in coded), key=lambda d: (d is not None, d or 0))
    assert [r.start for r in got] == np.cumsum([0] + [r.n_tokens for r in got])[:-1].tolist()
    assert sorted((r.doc_id or 0, r.ids_crc32) for r in got) == sorted(
        (d or 0, zlib.crc32(np.array(ids, "<u4").tobytes())) for d, ids in coded
    )
    path = token_files.new_path(spark)
    token_files.write_tokens(nothing, path, WORDS, 1)
    assert token_files.read_tokens(spark, path).count() == 0


def test_byte_coding(docs, nothing):
    library = Tokenizer.from_file(BYTES)
    wanted = []
    for d, t in TEXTS:
        ids = library.encode(t or "", add_special_tokens=False).ids
        wanted.append((d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                       hashlib.sha256((t or "").encode()).hexdigest()))
    assert rows_of(segment_bpe.coded(docs, BYTES)) == sorted(wanted, key=repr)
    assert segment_bpe.coded(nothing, BYTES).count() == 0


def test_packed_documents(docs, nothing):
    library = Tokenizer.from_file(WORDS)
    coded = [(d, library.encode(t or "", add_special_tokens=False).ids + [2]) for d, t in TEXTS]
    got = packing.pack_documents(docs, WORDS, 2).collect()
    assert collections.Counter(
        (d, s, zlib.crc32(np.array(ids[s:s + 4096], "<u4").tobytes()), len(ids))
        for d, ids in coded for s in range(0, len(ids), 4096)
    ) == collections.Counter((r.doc_id, r.start, r.ids_crc32, r.doc_tokens) for r in got)
    by = collections.defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for pieces in by.values():
        pieces.sort()
        assert sum(n for _, n in pieces) <= 4096
        assert [o for o, _ in pieces] == np.cumsum([0] + [n for _, n in pieces])[:-1].tolist()
    assert packing.pack_documents(nothing, WORDS, 2).count() == 0


def test_metric_join_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(metric_join, "BLOCK", 7)
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(4, 6))
    rows = [(k, (centres[k % 4] + 0.25 * rng.normal(size=6)).tolist(), k % 3, "x") for k in range(60)]
    rows += [(60, rows[5][1], rows[5][2], "x"), (61, None, 1, "x"), (62, [0.0] * 6, 1, "x"), (63, rows[0][1], None, "x"),
             (64, [float("nan")] * 6, 1, "x"), (65, [None, 1.0, 1.0, 1.0, 1.0, 1.0], 1, "x"), (66, [1.0, 2.0], 0, "x"),
             (67, [], 0, "x"), (60, rows[5][1], rows[5][2], "x"), (68, [1e300] * 6, 0, "x"), (69, [1e-300] * 6, 0, "x")]
    schema = "vec_id long, embedding array<double>, label int, rep string"
    good = {}
    for i, v, label, _ in rows:
        if v and label is not None and None not in v and np.isfinite(v).all() and np.any(v):
            x = np.array(v) / np.abs(v).max()
            good[i] = (x / np.linalg.norm(x), label)
    links = {i: {j for j, (y, m) in good.items() if j != i and m == n and len(x) == len(y) and x @ y >= 0.93}
             for i, (x, n) in good.items()}
    seen = {}
    for i in sorted(good):
        todo = [i]
        while todo:
            k = todo.pop()
            if k not in seen:
                seen[k] = i
                todo += links[k]
    wanted = sorted((i, len(links.get(i, ())), seen.get(i, i), seen.get(i, i) == i) for i, *_ in rows)
    assert sorted(tuple(r) for r in metric_join.range_join(spark.createDataFrame(rows, schema)).collect()) == wanted
    assert metric_join.range_join(spark.createDataFrame([], schema)).count() == 0


@pytest.mark.parametrize("spread, width", [(0.25, 8), (9.0, 32)])  # pivots prune, and do not
def test_metric_join_deals_a_row_per_block_not_per_pair_of_blocks(spark, monkeypatch, spread, width):
    rng = np.random.default_rng(1)
    wide = rng.normal(size=(12, width))[np.arange(600) % 12] + spread * rng.normal(size=(600, width))
    wide[300:360] = wide[:60] + 0.01 * rng.normal(size=(60, width))
    wide = wide.astype(np.float32)
    rows = [(k, v.tolist(), 1) for k, v in enumerate(wide)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    unit = metric_join._units(wide.astype(np.float64))
    wanted = (unit @ unit.T >= 0.93).sum(1) - 1
    monkeypatch.setattr(metric_join, "BLOCK", 32)
    monkeypatch.setattr(metric_join, "HELD_BYTES", 32 * 8 * width)
    written = []
    monkeypatch.setattr(metric_join, "cut", lambda df: written.append(cut(df)) or written[-1])
    got = {r.vec_id: r.n_links for r in metric_join.range_join(frame).collect()}
    assert [got[k] for k in range(600)] == wanted.tolist() and wanted.max() > 0
    cells = next(t for t in written if "owner" in t.columns)
    sizes = next(t for t in written if "blocks" in t.columns)
    copies = F.sum(F.when(F.col("owner"), (F.col("blocks") + 1) / 2).otherwise(F.col("blocks")))
    dealt = cells.join(sizes, ["label", "width", "cell"]).agg(copies).first()[0] / 600
    assert dealt <= 600 / 32  # about one copy for each block; pairs of blocks would be 361


def test_metric_join_forest_keeps_components_of_tiles(spark, monkeypatch):
    monkeypatch.setattr(metric_join, "TILE", 8)
    monkeypatch.setattr(metric_join, "BLOCK", 16)
    turn = np.linspace(0, np.pi / 2, 41)  # a chain: only neighbours reach the limit
    rows = [(k * 37 % 41, [float(np.cos(a)), float(np.sin(a))], 0) for k, a in enumerate(turn * 8)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert {r.component_id for r in metric_join.range_join(frame).collect()} == {0}


def test_preference_turns(spark):
    schema = "pair_id long, turn long, role string, text string, side string"
    chosen = [(1, 0, "user", "q", ""), (1, 1, "assistant", "good", ""), (2, 0, "user", None, ""), (2, 0, "user", "", ""),
              (3, 0, None, "a", ""), (None, 0, "user", "n", "")]
    rejected = [(1, 0, "user", "q", ""), (1, 1, "assistant", "bad", ""), (1, 2, "user", "more", ""), (2, 0, "user", "", ""),
                (None, 0, "user", "n", "")]
    got = rows_of(preference.preference_turns(*(spark.createDataFrame(r, schema) for r in (chosen, rejected))))
    end = "<|im_end|>\n"
    assert got == sorted([
        (1, "prompt", 0, "user", f"<|im_start|>user\nq{end}", 0, 0),
        (1, "chosen", 1, "assistant", f"<|im_start|>assistant\ngood{end}", 22, 36),
        (1, "rejected", 1, "assistant", f"<|im_start|>assistant\nbad{end}", 22, 35),
        (1, "rejected", 2, "user", f"<|im_start|>user\nmore{end}", 0, 0),
        (2, "prompt", 0, "user", f"<|im_start|>user\n{end}", 0, 0),
        (3, "chosen", 0, "unknown", f"<|im_start|>unknown\na{end}", 0, 0),
        (None, "prompt", 0, "user", f"<|im_start|>user\nn{end}", 0, 0),
    ], key=repr)
    empty = spark.createDataFrame([], schema)
    assert preference.preference_turns(empty, empty).count() == 0


def test_preference_query_keeps_turns_without_an_id(spark, tmp_path):
    rows = [(c, k, "assistant" if k % 2 else "user", f"t{k}") for c in (None, 4) for k in range(4)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    frame.write.parquet(str(tmp_path / "conversations.parquet"))
    got = rows_of(queries.op5_preference_format(spark, str(tmp_path)).select("pair_id", "part", "turn", "piece"))
    piece = {k: f"<|im_start|>{r}\n{t}<|im_end|>\n" for _, k, r, t in rows}
    assert got == sorted(
        [(None, "prompt", k, piece[k]) for k in range(4)] + [(4, "prompt", k, piece[k]) for k in range(3)]
        + [(4, "chosen", 3, piece[3]), (4, "rejected", 3, piece[1])], key=repr
    )


def test_page_texts(spark):
    page = "<body><div>Site</div><p>{}</p></body>"
    rows = [(1, "http://h/a/1", page.format("one"), "x"), (2, "http://h/a/2?q", page.format("two"), "x"),
            (3, None, page.format("three"), "x"), (4, "http://h/a/3", None, "x"), (1, "http://h/a/1", page.format("one"), "x"),
            (5, "http://h/a/9", "<article><p>Site</p></article>", "x")]
    schema = "page_id long, url string, html string, content string"
    got = rows_of(page_diff.page_texts(spark.createDataFrame(rows, schema)))
    told = {1: "one", 2: "two", 3: "Site\nthree", 4: "", 5: "Site"}
    assert got == sorted(((i, u, told[i], len(told[i])) for i, u, _, _ in rows), key=repr)
    assert page_diff.page_texts(spark.createDataFrame([], schema)).count() == 0


def test_template_prose_inside_articles_goes(spark):
    page = "<body><article><h1>{0}</h1><p>Subscribe now</p><p>{1}</p><p>All about us</p></article></body>"
    # A sentence of two articles stays; a notice of all pages, or of most, goes.
    told = ["Told twice", "Told twice", "two", "three", "four", "five"]
    rows = [(k, f"http://h/a/{k}", page.format(f"Head {k}", t)) for k, t in enumerate(told)]
    rows[3] = (3, "http://h/a/3", "<body><article><h1>Head 3</h1><p>three</p></article></body>")
    rows += [(9, "http://lone/a/9", page.format("Head 9", "nine")), (8, "http://pair/a/8", page.format("Head 8", "eight")),
             (7, "http://pair/a/7", page.format("Head 7", "seven"))]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in page_diff.page_texts(frame).collect()}
    wanted = {k: f"Head {k}\n{t}" for k, t in enumerate(told)}
    # Fewer than three pages do not tell a template from a shared sentence.
    wanted |= {k: f"Head {k}\nSubscribe now\n{t}\nAll about us" for k, t in ((7, "seven"), (8, "eight"), (9, "nine"))}
    assert got == wanted


def test_page_query_gives_the_article(spark):
    import html

    told = {r.page_id: r.text for r in queries.op1_page_diff(spark, SMALL).collect()}
    for r in table(spark, SMALL, "pages").collect():
        article = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        parts = (" ".join(html.unescape(re.sub("<[^>]+>", "", p)).split()) for p in re.split("</?(?:p|h1|br)[^>]*>", article))
        assert told[r.page_id] == "\n".join(p for p in parts if p)


def test_toxicity_on_held_out_labels(spark):
    scored = queries.op3_toxicity(spark, "/root/testdata/sf0.01")
    marked = scored.join(table(spark, "/root/testdata/sf0.01", "labels"), "doc_id").where("held_out").collect()
    assert scored.count() == 1_000
    clean = [r for r in marked if r.toxic == 0]
    assert sum(r.predicted for r in clean) <= 0.05 * len(clean)
    assert sum(r.predicted for r in marked if r.toxic == 1) >= 0.5 * (len(marked) - len(clean))


def test_toxicity_edges(spark, docs, nothing):
    labels = spark.createDataFrame([(1, None, 0), (7, 1, None)], "doc_id long, quality int, toxic int")
    lexicon = toxicity.learn(docs, labels)
    assert not lexicon.entries and toxicity.score(docs, lexicon).count() == len(TEXTS)
    assert toxicity.score(nothing, toxicity.learn(nothing, labels)).count() == 0
    assert toxicity.keep_clean(docs, lexicon).count() == len(TEXTS)


def test_pipeline_stages_against_plain_versions(spark):
    docs = table(spark, SMALL, "documents")
    frames = [docs]
    for _, stage in corpus_pipeline.STAGES:
        frames.append(cut(stage(spark, frames[-1], SMALL)))
    assert all(f.columns == docs.columns for f in frames[:-1])
    clean, unique, apart, left, packed = ({r.doc_id: r for r in f.collect()} for f in frames[1:])
    texts = collections.defaultdict(list)
    for r in clean.values():
        texts[re.sub(r"\s", "", r.text)].append((-len(r.text), r.doc_id))
    assert set(unique) == {min(v)[1] for v in texts.values()}
    ids = sorted(unique)
    sets = dict(zip(ids, shingles.multisets([unique[i].text for i in ids])))
    for i in set(ids) - set(apart):
        assert any(shingles.similarity(sets[i], sets[j]) >= 0.8 for j in ids if j != i)
    kept = sorted(apart)
    assert not any(shingles.similarity(sets[i], sets[j]) >= 0.8 for i in kept for j in kept if i < j)
    plain = brute_repeats([apart[i].text for i in kept])
    for i, (size, removed, _, _) in zip(kept, plain):
        assert size - removed - 6 <= len(left[i].text.encode()) <= size - removed
    assert set(packed) == set(left)
