"""Line dedup, periodic runs and tokenizer alignment against plain versions."""

import collections
import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from eventlens.llm import line_dedup, queries, runs, token_align
from eventlens.llm.common import table

BYTES, PIECES = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
SMALL = "/root/testdata/sf0.001"
# Names that the operators use inside, and one that needs quoting.
SCHEMA = (
    "doc_id long, text string, line string, place int, salt int, key string, key_a int, row_a string, out int, "
    "lines string, slice int, pairs int, n long, words string, start int, `my col` string, `a``b.c` int"
)
COMMON = "This line is shared by many"
LOW, HIGH = -(1 << 63), (1 << 63) - 1
TEXTS = [
    (1, f"{COMMON}\nown line of one\n\t {COMMON.upper()} \r\nend"), (2, f"x\n{COMMON}\n"), (3, f"{COMMON}"),
    (4, None), (5, ""), (6, "\n\n"), (7, "short\nshort"), (8, "short"), (9, "ÀÉ UPPER LINE\nplain"),
    (10, "àé upper line\nÀÉ upper LINE"), (11, "only here, only here\nonly here, only here"),
    (12, "one id first text"), (12, "one id first text\nand another text"), (13, "and another text"),
    (14, "the same row"), (14, "the same row"), (None, f"{COMMON}\nnobody has this line"), (None, "nobody has this line"),
    (LOW, "smallest id of all\nlargest id as well"), (HIGH, "largest id as well\nsmallest id of all"),
    (20, "a b " * 30), (21, "x " * 3 + "y y y y y y y"), (30, "w " * 40_000), (40, "\n".join(f"line number {k}" for k in range(3000))),
    (41, "\n".join(f"line number {k}" for k in range(0, 6000, 2))), (50, "▁ has it"), (51, "<|endoftext|> and </s> <s>"),
    (52, "blanks  at \n\n ends \t "), (53, "a\x00b é 漢字 🙂   　x"), (54, "z" * 20_000),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(d, t, *[None] * 15) for d, t in TEXTS], SCHEMA)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def rows_of(frame):
    return sorted((tuple(r) for r in frame.collect()), key=repr)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_lines(texts):
    key = lambda x: re.sub("[A-Z]", lambda c: c[0].lower(), x.strip(" \t\n\x0b\x0c\r"))
    holders = collections.defaultdict(set)
    for d, t in texts:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 10:
                holders[key(x)].add((d is None, d or 0))
    out = []
    for d, t in texts:
        lines = (t or "").split("\n")
        kept = [
            x for x in lines
            if len(holders.get(key(x), ())) < 2 or min(holders[key(x)]) == (d is None, d or 0)
        ]
        out.append((d, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def test_shared_lines_stay_in_the_smallest_id(docs, nothing):
    wanted = plain_lines(TEXTS)
    assert rows_of(line_dedup.line_report(docs)) == sorted(((d, n, m, sha(t)) for d, n, m, t in wanted), key=repr)
    assert line_dedup.line_report(nothing).count() == 0
    dropped = line_dedup.drop_lines(docs)
    assert dropped.columns == docs.columns
    told = collections.Counter((r.doc_id, r.text or "") for r in dropped.collect())
    assert told == collections.Counter((d, t) for d, *_, t in wanted)
    assert dropped.where("doc_id = 4 AND text IS NULL").count() == 1
    assert line_dedup.drop_lines(nothing).columns == nothing.columns


def test_line_threshold_counts_documents(spark):
    texts = [(k, "a line of two\na line of three" if k < 2 else "a line of three") for k in range(3)]
    frame = spark.createDataFrame(texts, "doc_id long, text string")
    got = {r.doc_id: r.n_dropped for r in line_dedup.line_report(frame, least_documents=3).collect()}
    assert got == {0: 0, 1: 1, 2: 1}


def test_line_report_is_native(docs):
    assert "Python" not in line_dedup.line_report(docs)._jdf.queryExecution().toString()


def test_line_query_equals_plain_version(spark):
    rows = [tuple(r) for r in table(spark, SMALL, "documents").select("doc_id", "text").collect()]
    got = rows_of(queries.QUERIES["op11_line_dedup"](spark, SMALL))
    assert got == sorted(((d, n, m, sha(t)) for d, n, m, t in plain_lines(rows)), key=repr)


def plain_runs(words, least_words=6, least_periods=4):
    found = {}
    for p in range(1, len(words) // least_periods + 1):
        i = 0
        while i + p < len(words):
            if words[i] != words[i + p]:
                i += 1
                continue
            j = i
            while j + p < len(words) and words[j] == words[j + p]:
                j += 1
            if j + p - i >= max(least_words, least_periods * p):
                found.setdefault((i, j + p - i), p)
            i = j
    return sorted(((s, n, p) for (s, n), p in found.items()), key=lambda r: (r[0], r[2]))


def plain_report(doc_id, text, repeated):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h, n = zlib.crc32(("" if doc_id is None else str(doc_id)).encode()), len(words)
    if repeated and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = plain_runs(words)
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
    gone = {k for s, m, p in found for k in range(s + p, s + m)}
    s, m, p = best
    return (
        doc_id, len(found), s, m, p, None if m is None else 1000 * m // p,
        sha("".join(f"{a},{b},{c}\n" for a, b, c in found)),
        sha(" ".join(w for k, w in enumerate(words) if k not in gone)),
    )


@pytest.mark.parametrize("least", [(6, 4), (2, 2), (3, 3)])
def test_runs_equal_plain_version(least):
    rng = np.random.default_rng(sum(least))
    for _ in range(600):
        n, kinds = int(rng.integers(1, 90)), int(rng.integers(1, 4))
        words = rng.integers(0, kinds, n)
        if rng.random() < 0.6:
            a = int(rng.integers(0, n))
            p = 1 + (n - a) // int(rng.integers(3, 11))
            words = np.array([words[i] if i < a else words[a + (i - a) % p] for i in range(n)])
        _, symbols = np.unique(words, return_inverse=True)
        symbols = np.append(symbols, symbols.max() + 1).astype(np.int64)
        assert [tuple(r) for r in runs.runs(symbols, *least).tolist()] == plain_runs(words.tolist(), *least)


def test_suffix_order_and_prefixes():
    rng = np.random.default_rng(1)
    for _ in range(50):
        words = np.append(rng.integers(0, 2, 70), 5)
        order, place, levels = runs.suffix_order(words)
        plain = sorted(range(71), key=lambda k: words[k:].tolist())
        assert order.tolist() == plain and place[order].tolist() == list(range(71))
        for k, n in enumerate(runs.common_prefixes(order, levels)[1:], 1):
            a, b = words[order[k - 1]:], words[order[k]:]
            assert n == next(x for x in range(71) if a[x] != b[x])


def test_long_periodic_text_is_quick():
    words = np.append(np.tile(np.arange(7), 60_000), 9)
    assert runs.runs(words).tolist() == [[0, 420_000, 7]]
    stairs = np.append(np.concatenate([np.repeat(k, 6 + k) for k in range(600)]), 601)
    assert len(runs.runs(stairs)) == 600


@pytest.mark.parametrize("repeated", [False, True])
def test_run_report(docs, nothing, repeated):
    texts = [(d, t) for d, t in TEXTS if d != 30]
    got = rows_of(runs.run_report(docs.where("doc_id IS NULL OR doc_id <> 30"), repeated=repeated))
    assert got == sorted((plain_report(d, t, repeated) for d, t in texts), key=repr)
    assert runs.run_report(nothing).count() == 0
    long = runs.run_report(docs.where("doc_id = 30")).first()
    assert (long.n_runs, long.start, long.length, long.period) == (1, 0, 40_000, 1)
    assert long.collapsed_sha256 == sha("w")


def test_run_query_equals_plain_version(spark):
    rows = table(spark, SMALL, "documents").where("length(text) < 3000").select("doc_id", "text").collect()
    got = {r.doc_id: tuple(r) for r in queries.QUERIES["op12_periodic_runs"](spark, SMALL).collect()}
    assert any(r[1] for r in got.values())
    for d, t in rows:
        assert got[d] == plain_report(d, t, True)


def test_merge_path_pieces_are_equal_work():
    rng = np.random.default_rng(2)
    a, b = (np.unique(rng.integers(1, 4000, 900)) for _ in range(2))
    i, j = token_align.merge_path(a, b, 64)
    assert set((np.diff(i) + np.diff(j))[:-1].tolist()) == {64} and (i[-1], j[-1]) == (len(a), len(b))


def test_overlaps_equal_plain_version():
    rng = np.random.default_rng(3)
    for _ in range(300):
        size = int(rng.integers(1, 60))
        a, b = (
            np.unique(np.append(rng.integers(1, size + 1, int(rng.integers(0, size))), size)).astype(np.int64)
            for _ in range(2)
        )
        from_a, from_b = np.append(0, a[:-1]), np.append(0, b[:-1])
        pairs = [(i, j) for i in range(len(a)) for j in range(len(b)) if from_a[i] < b[j] and from_b[j] < a[i]]
        ends = sorted(set(a.tolist()) & set(b.tolist()))
        for step in (1, 3, 256):
            x, y, of_a, of_b = token_align.overlaps(a, b, step)
            assert list(zip(x.tolist(), y.tolist())) == pairs
            assert of_a.tolist() == [sum(c < e for c in ends) for e in a.tolist()]
            assert of_b.tolist() == [sum(c < e for c in ends) for e in b.tolist()]


def plain_alignment(texts):
    """All of it from the two libraries, text by text."""
    one, two = Tokenizer.from_file(BYTES), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    one.encode_special_tokens = True
    letters = {c: bytes([k]) for k, c in token_align.byte_letters().items()}
    told, counts = [], collections.Counter()
    for doc_id, text in texts:
        whole = b" " + (text or "").encode()
        first = one.encode(" " + (text or ""), add_special_tokens=False)
        a = [(k, b"".join(letters[c] for c in t)) for k, t in zip(first.ids, first.tokens)]
        b = []
        for k in two.encode(text or ""):
            piece = two.id_to_piece(k)
            b.append((k, bytes([int(piece[3:5], 16)]) if two.is_byte(k) else piece.replace("▁", " ").encode()))
        if not text or any(b"".join(x for _, x in side) != whole for side in (a, b)):
            told.append((doc_id, 0, 0, [], ""))
            continue
        a_ends, b_ends = (np.cumsum([len(x) for _, x in side]).tolist() for side in (a, b))
        links, groups, i, j = [], [[[], []]], 0, 0
        for k, (token, x) in enumerate(a):
            while j and b_ends[j - 1] > a_ends[k] - len(x):
                j -= 1
            while b_ends[j] <= a_ends[k] - len(x):
                j += 1
            while j < len(b) and b_ends[j] - len(b[j][1]) < a_ends[k]:
                links.append((token, b[j][0]))
                j += 1
            j = max(0, j - 1)
        i = 0
        for k, end in enumerate(a_ends):
            groups[-1][0].append(str(a[k][0]))
            while i < len(b) and b_ends[i] <= end:
                groups[-1][1].append(str(b[i][0]))
                i += 1
            if end in b_ends[i - 1:i]:
                groups.append([[], []])
        counts.update(links)
        told.append((doc_id, len(a), len(b), links, groups[:-1]))
    best = collections.defaultdict(int)
    for (_, y), n in counts.items():
        best[y] = max(best[y], n)
    out = []
    for doc_id, n_a, n_b, links, groups in told:
        line = ";".join(f"{','.join(x)}|{','.join(y)}" for x, y in groups)
        out.append((
            doc_id, n_a, n_b, len(groups), len(links), sha(line) if n_a else "",
            sum(counts[p] == best[p[1]] for p in links), sum(counts[p] for p in links),
        ))
    return out


@pytest.mark.parametrize("most", [4_000_000, 300])
def test_alignment_equals_plain_version(docs, nothing, monkeypatch, most):
    monkeypatch.setattr(token_align, "SLICE", most)
    got = rows_of(token_align.aligned(docs, BYTES, PIECES, step=16))
    assert got == sorted(plain_alignment(TEXTS), key=repr)
    if most > 300:
        assert token_align.aligned(nothing, BYTES, PIECES).count() == 0


def test_random_texts_are_cut_as_the_libraries_cut_them():
    rng = np.random.default_rng(4)
    texts = ["".join(rng.choice(list("ab \n\té '1s.\r▁漢 　"), 30)) for _ in range(1500)]
    texts += [" " * 5000 + "x", "\n " * 3000]
    told, pairs, owner = token_align.Aligner(BYTES, PIECES).align(texts)
    wanted = plain_alignment([(0, t) for t in texts])
    assert [(*t[:4], t[4]) for t in told] == [tuple(w[1:6]) for w in wanted]
    assert np.bincount(owner, minlength=len(texts)).tolist() == [w[4] for w in wanted]
    counts = collections.Counter(pairs.tolist())
    assert sum(n * n for n in counts.values()) == sum(w[7] for w in wanted)


def test_places_are_packed_without_loss():
    rng = np.random.default_rng(5)
    for most in (2, 255, 256, 100_000):
        places = np.sort(rng.integers(0, most, 500))
        assert token_align.unpacked(token_align.packed(places)).tolist() == places.tolist()
    assert token_align.unpacked(token_align.packed(places[:0])).tolist() == []


def test_alignment_query_equals_plain_version(spark):
    rows = [tuple(r) for r in table(spark, SMALL, "documents").select("doc_id", "text").collect()]
    assert rows_of(queries.QUERIES["op13_token_alignment"](spark, SMALL)) == sorted(plain_alignment(rows), key=repr)
