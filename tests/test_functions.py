import hashlib
import math

import pytest
from pyspark.sql import functions as F

from eventlens.functions import numbers as nm
from eventlens.functions import simhash, urls, vectors
from eventlens.functions import text as tx


def evaluate(spark, expression, *values):
    frame = spark.createDataFrame([values], [f"c{i}" for i in range(len(values))])
    return frame.select(expression(*[F.col(c) for c in frame.columns]).alias("v")).first().v


@pytest.mark.parametrize(
    "url,expected",
    [
        ("HTTP://Example.com:80/a?utm_Source=x&b=2&a=1#top", "http://example.com/a?a=1&b=2"),
        ("https://example.com", "https://example.com/"),
        ("https://example.com:8443/x/", "https://example.com:8443/x/"),
        ("https://example.com/?q=a%20b&q=&fbclid=1", "https://example.com/?q=&q=a+b"),
        ("http://export.arxiv.org/pdf/2401.00001v2.pdf", "https://arxiv.org/abs/2401.00001"),
        ("https://bücher.example/ä", "https://xn--bcher-kva.example/ä"),
        ("https://[::1]:443/x", "https://[::1]/x"),
        (" https://news.ycombinator.com/item?id=7 ", "https://news.ycombinator.com/item?id=7"),
        ("https://u:p@example.com/", None),
        ("ftp://example.com/", None),
        ("https:///x", None),
        ("https://example.com:99999/", None),
        ("relative/path", None),
        ("https://example.com/?x=%zz&y=~*", "https://example.com/?x=%25zz&y=~%2A"),
    ],
)
def test_canonical_url(spark, url, expected):
    assert evaluate(spark, urls.canonical_url, url) == expected


@pytest.mark.parametrize(
    "link,expected",
    [
        ("/note", "https://lab.example/note"),
        ("note", "https://lab.example/feed/note"),
        ("../x/./y", "https://lab.example/x/y"),
        ("//other.example/z", "https://other.example/z"),
        ("https://abs.example/q?x=1", "https://abs.example/q?x=1"),
        ("?page=2", "https://lab.example/feed/index.xml?page=2"),
    ],
)
def test_url_join(spark, link, expected):
    assert evaluate(spark, urls.url_join, "https://lab.example/feed/index.xml", link) == expected


def test_publisher_and_paper_links(spark):
    assert evaluate(spark, urls.publisher, "https://WWW.Lab.example/x", "s1") == "lab.example"
    assert evaluate(spark, urls.publisher, "no url", "s1") == "source:s1"
    assert evaluate(spark, urls.is_paper_url, "https://arxiv.org/abs/2401.00001")
    assert not evaluate(spark, urls.is_paper_url, "https://arxiv.org/list/cs")
    assert evaluate(spark, urls.safe_url, "javascript:alert(1)") is None
    assert evaluate(spark, urls.safe_url, "HTTPS://A.example:443") == "https://a.example/"


def test_words_and_excerpt(spark):
    sample = "Straße  naïve x_1 ² tail\x1cend"
    assert evaluate(spark, tx.words, sample) == ["strasse", "naïve", "x_1", "²", "tail", "end"]
    assert evaluate(spark, tx.word_count, sample) == len(sample.split())
    long = " ".join(f"w{i}" for i in range(1300))
    cut = evaluate(spark, tx.excerpt, long)
    assert cut.truncated and not cut.short and cut.text == " ".join(long.split()[:1200])
    wide = evaluate(spark, tx.excerpt, " ".join(["x" * 100] * 200))
    assert len(wide.text) == 12000 and wide.truncated


def test_html_to_text(spark):
    html = "<p>Weights &amp; <b>data</b></p><script>x<1</script><style>p{}</style> end&hellip;"
    assert evaluate(spark, tx.html_to_text, html) == "Weights & data end…"
    assert evaluate(spark, tx.html_to_text, "  plain \n text ") == "plain text"


@pytest.mark.parametrize(
    "markup,expected",
    [
        ("<title>a &amp;&amp; b&amp</title><p>c", "a && b&amp c"),
        ("&ampx &copy2; &eacute; &#233; &#xe9; &nosuch; &lt", "&ampx &copy2; é é é &nosuch; &lt"),
        ("&amp;eacute; &eacute;&amp", "&eacute; é&amp"),
    ],
)
def test_only_terminated_references_are_decoded(spark, markup, expected):
    assert evaluate(spark, tx.html_to_text, markup) == expected


def python_simhash(text):
    tokens = text.lower().split()
    votes = [0] * 64
    for i in range(len(tokens) - 2):
        gram = " ".join(tokens[i : i + 3]).encode()
        value = int.from_bytes(hashlib.blake2b(gram, digest_size=8).digest(), "big")
        for bit in range(64):
            votes[bit] += 1 if value >> bit & 1 else -1
    return f"{sum(1 << b for b in range(64) if votes[b] > 0):016x}"


def test_simhash_compatible_format(spark):
    text = " ".join(f"token{i % 90}" for i in range(200))
    frame = spark.createDataFrame([(1, text), (2, "short")], "id long, text string")
    got = simhash.fingerprints(frame, "id", "text", hash_name="blake2b")
    rows = got.select("id", simhash.to_hex("fingerprint").alias("h")).collect()
    assert [(r.id, r.h) for r in rows] == [(1, python_simhash(text))]


@pytest.mark.parametrize(
    "json,expected",
    [("5", 5.0), ("2.5", 2.5), ("-1", 0.0), ('"1000"', 0.0), ("true", 0.0), ("null", 0.0), ("[1]", 0.0)],
)
def test_nonnegative(spark, json, expected):
    assert evaluate(spark, lambda c: nm.nonnegative(F.try_parse_json(c)), json) == expected


def test_scores(spark):
    fresh = evaluate(
        spark,
        lambda c: nm.rank_struct(F.lit(0.5), F.lit(0.0), F.lit(0.0), nm.recency(F.to_timestamp(c), "2026-09-13 12:00:00")),
        "2026-09-13 12:00:00",
    )
    assert fresh.rank_score == 22.5
    half = evaluate(spark, lambda c: nm.recency(F.to_timestamp(c), "2026-09-13 12:00:00"), "2026-09-12 00:00:00")
    assert half == 0.5
    ahead = evaluate(spark, lambda c: nm.recency(F.to_timestamp(c), "2026-09-13 12:00:00"), "2026-09-20 00:00:00")
    assert ahead == 1.0
    assert not evaluate(spark, lambda c: nm.significance(c), 11).available


def test_costs(spark):
    cost = evaluate(spark, lambda m, a, b, c: nm.estimate_cost(m, a, b, c), "deepseek-flash", 300, 100, 90)
    assert math.isclose(cost, (100 * 0.006 + 200 * 0.30 + 90 * 1.20) / 1e6)
    bound = evaluate(spark, lambda m, t: nm.reserve_cost(m, F.array(t), 768), "deepseek-flash", "é")
    assert math.isclose(bound, ((2 + 256 + 2048) * 0.30 + 768 * 1.20) / 1e6)


def test_dates(spark):
    for text in ("Sun, 13 Sep 2026 10:00:00 GMT", "2026-09-13T10:00:00Z", "13 Sep 2026 12:00:00 +0200"):
        value = evaluate(spark, lambda c: F.date_format(nm.feed_date(c), "yyyy-MM-dd HH:mm"), text)
        assert value == "2026-09-13 10:00"
    assert evaluate(spark, nm.feed_date, "yesterday") is None


def test_vectors(spark):
    frame = spark.createDataFrame(
        [(1, [3.0, 4.0]), (2, [0.0, 0.0]), (3, [float("nan"), 1.0]), (4, [1.0])], "id long, v array<float>"
    )
    rows = {r.id: r.u for r in frame.select("id", vectors.unit_vector("v", 2).alias("u")).collect()}
    assert rows[1] == pytest.approx([0.6, 0.8]) and rows[2] is rows[3] is rows[4] is None
    made = vectors.batch_embedder(lambda texts: [[float(len(t)), 0.0] for t in texts], dims=2)
    texts = spark.createDataFrame([("ab",), ("",)], "t string")
    assert [r.e for r in texts.select(made(F.col("t")).alias("e")).collect()] == [[1.0, 0.0], None]
