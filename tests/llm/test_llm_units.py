"""Array-level parts of the training-data operators against plain versions."""

import collections
import time

import numpy as np
import pyarrow as pa
import pytest
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from eventlens.llm import bagminhash, encode, packing, page_diff, segment_bpe, shingles, suffixes, token_files, toxicity

ODD_TEXTS = [
    "", " ", "a", "Hello<|endoftext|>World", "a<|startoftext|> b", "  a  b \n c ", "x'll don't ... ,,. a.b,c 1234 \t z",
    "\x00a \x00 b", "日本語のテキスト " * 9, "aaaa" * 60, "\n\n  \n", "ÉÀ é É İI ß ſ K µ ª", "J̌ ≠ ≠", "a,̸ .́", "q\x1cq \x85w",
]


def runs(ids, sizes):
    ends = np.cumsum(sizes)
    return [[int(i) for i in ids[e - n:e]] for e, n in zip(ends, sizes)]


@pytest.fixture(scope="module")
def words():
    path = public_tokenizers.path("word_bpe_49k.json")
    return encode.WordEncoder(path), Tokenizer.from_file(path)


@pytest.fixture(scope="module")
def byte_level():
    path = public_tokenizers.path("byte_bpe_50k.json")
    return segment_bpe.ByteBpe(path), Tokenizer.from_file(path)


text_lists = st.lists(st.text(st.sampled_from(list("abE éß\n\t '.,1٣日😀　́\x1c\x85<|>z"))), max_size=12)


@settings(max_examples=60, deadline=None)
@given(texts=text_lists)
def test_word_ids_equal_the_library(words, texts):
    own, library = words
    texts = texts + ODD_TEXTS
    assert runs(*own.encode(texts)) == [library.encode(t, add_special_tokens=False).ids for t in texts]


@settings(max_examples=60, deadline=None)
@given(texts=st.lists(st.text(st.sampled_from(list("aBÉßÿ×÷ .,;:!?&*%$#)'(-|\u0338\u0301")), max_size=40), max_size=12))
def test_words_with_tails_equal_the_library(words, texts):
    own, library = words
    assert runs(*own.encode(texts)) == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_a_dictionary_that_starts_anew_gives_the_same_ids(words, monkeypatch):
    own, library = words
    monkeypatch.setattr(encode, "MOST_PIECES", 5)
    for texts in (["one two, three***", "Été! ÉTÉ été."], ["two three*** four", "x'll Été! été"], ["été. one"]):
        assert runs(*own.encode(texts)) == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_a_worker_loads_its_vocabulary_once(monkeypatch):
    loads = []

    class Counted:
        @staticmethod
        def from_file(path):
            loads.append(path)
            return Tokenizer.from_file(path)

    monkeypatch.setattr(encode, "Tokenizer", Counted)
    path = public_tokenizers.path("word_bpe_49k.json")
    batch = pa.RecordBatch.from_pydict({"doc_id": [1, 2], "row": [1, 2], "text": ["one two", ""]})
    tasks = [list(packing._pieces(path, 2, 4_096, 4_096)([batch])) for _ in range(3)]
    assert tasks[0] == tasks[1] == tasks[2]
    assert len(loads) <= 1


@settings(max_examples=60, deadline=None)
@given(texts=text_lists)
def test_byte_ids_equal_the_library_and_decode(byte_level, texts):
    own, library = byte_level
    texts = texts + ODD_TEXTS
    ids, sizes = own.encode(texts)
    wanted = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert runs(ids, sizes) == wanted
    back = [b.decode("utf-8", "replace") for b in own.decode(ids, sizes)]
    assert back == [library.decode(w, skip_special_tokens=False) for w in wanted] == texts


def test_long_word_merges_like_short_ones(byte_level):
    own, library = byte_level
    text = "abcdefgh" * 5_000
    assert runs(*own.encode([text]))[0] == library.encode(text, add_special_tokens=False).ids


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.integers(0, (1 << 64) - 1) | st.integers(0, 70_000) | st.integers(0, 1), max_size=130), max_size=6))
def test_simple8b_round_trip(rows):
    ids = np.array([i for r in rows for i in r], np.uint64)
    sizes = np.array([len(r) for r in rows], np.int64)
    names = [None if k == 1 else k for k in range(len(rows))]
    got_names, got_sizes, got_ids = token_files.from_block(token_files.to_block(names, ids, sizes))
    assert got_names == names and got_sizes.tolist() == sizes.tolist() and got_ids.tolist() == ids.tolist()
    words, firsts, escapes = token_files.pack(ids, sizes)
    for k, row in enumerate(rows):  # documents decode alone
        stop = firsts[k + 1] if k + 1 < len(rows) else len(words)
        assert token_files.unpack(words[firsts[k]:stop], escapes).tolist() == row


def test_not_a_block():
    with pytest.raises(ValueError):
        token_files.from_block(b"nothing at all here")


def test_bagminhash_estimates_without_bias():
    rng, off = np.random.default_rng(7), []
    for _ in range(150):
        h = np.unique(rng.integers(0, 2**63, 50).astype(np.uint64))
        count = rng.integers(1, 9, len(h))
        other = np.where(rng.random(len(h)) < 0.6, count, rng.integers(1, 9, len(h)))
        a, b = (h[:-5], count[:-5]), (h[3:], other[3:])
        s = bagminhash.signatures([a, b], 160)
        off.append((s[0] == s[1]).mean() - shingles.similarity(a, b))
    assert abs(np.mean(off)) < 4 * 0.04 / 150**0.5


def test_shingles_count_repeats_and_ignore_case():
    (h, c), (short, _), (none, _) = shingles.multisets(["A b c d e a B c d e", "x y", None])
    assert c.sum() == 6 and len(h) == 5 and len(short) == 1 and len(none) == 0
    assert shingles.similarity((none, none), (none, none)) == 1.0 and shingles.similarity((none, none), (h, c)) == 0.0


@pytest.mark.parametrize("shard", [300, 1 << 19])
def test_merged_transforms_find_every_repeated_window(monkeypatch, shard):
    monkeypatch.setattr(suffixes, "SHARD", shard)
    rng = np.random.default_rng(3)
    for trial in range(12):
        base = bytes(rng.integers(97, 100 if trial % 2 else 120, 700).astype(np.uint8))
        parts = [b"ab" * 150]
        for _ in range(10):
            a = int(rng.integers(0, 400))
            part = bytearray(base[a:a + int(rng.integers(200, 420))])
            if rng.random() < 0.6:
                part[int(rng.integers(0, len(part)))] = 65
            parts.append(bytes(part))
        seen = collections.Counter(p[i:i + 200] for p in parts for i in range(len(p) - 199))
        wanted = [[i for i in range(len(p) - 199) if seen[p[i:i + 200]] > 1] for p in parts]
        assert [s.tolist() for s in suffixes.repeated_starts(parts)] == wanted


def test_every_window_lies_in_one_segment():
    rng = np.random.default_rng(1)
    sizes = np.array([0, 150, 200, 900, 201])
    data = rng.integers(97, 99, sizes.sum()).astype(np.uint8)
    doc, _, _, low, high = suffixes.segments(data, sizes)
    begin = np.cumsum(sizes) - sizes
    starts = sorted(s for a, b in zip(low.tolist(), high.tolist()) for s in range(a, b + 1))
    assert starts == [b + k for b, n in zip(begin.tolist(), sizes.tolist()) for k in range(max(0, n - 199))]
    assert (low >= begin[doc]).all() and (high + 200 <= (begin + sizes)[doc]).all()


def test_order_is_stable_where_places_hide_low_bits():
    close = np.array([(1 << 63) + 3, (1 << 63) + 1, (1 << 63) + 3, (1 << 63) + 2] * 5, np.uint64)
    for x in (close, close >> np.uint64(60), np.random.default_rng(1).integers(0, 9, 500), np.zeros(0, np.int64)):
        order, found = suffixes.ordered(x)
        assert order.tolist() == np.argsort(x, kind="stable").tolist()
        assert found.tolist() == sorted(x.tolist())
        assert suffixes.ranked(x)[0].tolist() == np.unique(x, return_inverse=True)[1].ravel().tolist()


def test_spans_do_not_run_from_one_segment_into_the_next():
    segment, start = np.array([0, 0, 0, 2, 2]), np.array([5, 205, 406, 406, 407])
    told = [x.tolist() for x in suffixes.spans(segment, start)]
    assert told == [[0, 0, 2], [5, 406, 406], [405, 606, 607]]


def test_packing_keeps_all_limits():
    rng = np.random.default_rng(2)
    length = np.concatenate([rng.integers(1, 4096, 300), rng.integers(1, 30, 700)])
    loss = (length * rng.random(1000)).astype(np.int64)
    limits = (4096, 20, 2500)
    fit = loss <= limits[2]
    length, loss = length[fit], loss[fit]
    sequence, offset = packing.pack_group(length, loss, limits)
    for s in range(sequence.max() + 1):
        mine = np.flatnonzero(sequence == s)
        assert len(mine) <= 20 and length[mine].sum() <= 4096 and loss[mine].sum() <= 2500
        order = mine[np.argsort(offset[mine])]
        assert (offset[order] == np.cumsum(length[order]) - length[order]).all()
    assert length.sum() / 4096 <= sequence.max() + 1 <= 1.4 * max(length.sum() / 4096, len(length) / 20, loss.sum() / 2500) + 1


@settings(max_examples=80, deadline=None)
@given(st.lists(st.sampled_from("abcde"), max_size=14), st.lists(st.sampled_from("abcdx"), max_size=14))
def test_shared_lines_are_a_longest_common_subsequence(left, right):
    best = np.zeros((len(left) + 1, len(right) + 1), int)
    for i, a in enumerate(left):
        for j, b in enumerate(right):
            best[i + 1, j + 1] = best[i, j] + 1 if a == b else max(best[i, j + 1], best[i + 1, j])
    got = sorted(page_diff.shared(left, right))
    assert len(got) == best[-1, -1]
    rest = iter(right)
    assert all(left[k] in rest for k in got)


PAGE = """<html><head><title>T</title></head><body class="has-sidebar"><header><h1>Site</h1></header>
<nav><a href="/">Home</a></nav><div class="cookie-notice">We use cookies</div><main><article><header><h2>Head</h2>
<span>by X</span></header><p>One &amp; two<br>three<p>Four <b>five</b>&nbsp;six</p><div class="ad">Buy</div>
<script>var t="</p>";</script><!-- gone --><form><p>Mail</p></form></article>
<section id="comments"><p>Nice</p></section></main><aside>More</aside><footer>(c)</footer></body></html>"""


def test_page_blocks_keep_the_article_only():
    assert page_diff.main_text(*page_diff.blocks(PAGE), None) == "Head\nOne & two\nthree\nFour five six"


def test_pages_without_a_container_lose_shared_lines():
    page = "<body><div>Acme News</div><p>{}</p><div>All rights reserved</div></body>"
    one, two = page_diff.blocks(page.format("Alpha story")), page_diff.blocks(page.format("Beta story"))
    assert page_diff.main_text(*one, two[0]) == "Alpha story"
    assert page_diff.main_text(*one, one[0]) == "Acme News\nAlpha story\nAll rights reserved"
    assert page_diff.main_text(*page_diff.blocks(None), None) == ""


@pytest.mark.parametrize("name", ["layout has-sidebar", "no-sidebar", "with-menu", "search-results", "ad-free", "modal-open",
                                  "sidebar-left", "header-fixed"])
@pytest.mark.parametrize("tag", ["article", "main", "div role=main"])
def test_pages_in_a_named_wrapper_keep_the_article(name, tag):
    page = f'<body><div class="{name}"><{tag}><p>Story</p><div class="ad">Buy</div></{tag.split()[0]}><p>Aside</p></div></body>'
    assert page_diff.main_text(*page_diff.blocks(page), None) == "Story"
    bare = f'<body><div id="{name}"><p>{{}}</p><p>Rights</p><nav>Home</nav></div></body>'
    one, two = page_diff.blocks(bare.format("Alpha")), page_diff.blocks(bare.format("Beta"))
    assert page_diff.main_text(*one, two[0]) == "Alpha"


def test_named_cards_stay_out_beside_a_clear_article():
    cards = '<div class="related"><article><p>Card</p></article></div>'
    reply = '<div class="comments"><article><p>Reply</p></article></div>'
    for page in (f"<article><p>Story</p>{reply}</article>{cards}", f"<main><p>Story</p>{cards}</main>",
                 f'<div class="sidebar-left"><article><p>Story</p>{reply}</article></div>',
                 f'<div class="has-sidebar"><article><p>Story</p></article></div>{cards}'):
        assert page_diff.main_text(*page_diff.blocks(page), None) == "Story"


def test_folding_and_exceptions():
    assert toxicity.folded("1D​10T іdіоt") == "idiot idiot"
    lexicon = toxicity.Lexicon({"clown": (5.0, True), "idio": (6.0, False)}, frozenset({"clown fish"}), [0.0] * 32, 40.0)
    machine = lexicon.automaton()
    assert toxicity._raw(machine, lexicon.exceptions, "A clown fish swims")[1] == 0
    assert toxicity._raw(machine, lexicon.exceptions, "A cl0wn, an 1diotic one; clowning; preidiot")[1] == 2


@pytest.mark.parametrize("page", [
    "<a" * 500_000, "<div>x" * 100_000, "<a '>" * 100_000, '<a ">"' * 100_000, "<!--" * 250_000, "<!x" * 300_000,
    "<i><div>" + "<b>" * 100_000 + "</i>" * 100_000, "<div>" * 100_000 + "</p>x" * 100_000, "<a " + "x" * 1_000_000 + ">",
    "<script>" + "</script " * 100_000, "<" * 1_000_000,
])
def test_broken_pages_end_soon(page):
    begun = time.monotonic()
    page_diff.blocks(page)
    assert time.monotonic() - begun < 10  # some ten times what it takes


def test_quotes_hide_the_end_of_a_tag():
    assert page_diff.blocks("<p title='a>b'>one</p><p>two</p>")[0] == ["one", "two"]
    assert page_diff.blocks("<p title='a>one</p><p>two</p>")[0] == ["one", "two"]
    assert page_diff.blocks("a < b <!-- > --> c")[0] == ["a < b c"]
