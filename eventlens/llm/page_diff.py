"""Main text of pages by differencing each page against the nearest page of its host.

1. A page becomes blocks of text in page order, each with marks: inside an element that is never
   article text (menus, headers, footers, sidebars, notices, adverts, forms, scripts, comments),
   inside an ``article`` or ``main`` container, prose or mostly links. A class or id name of what
   surrounds a container is a weak sign, since layouts name what they hold: such a container counts
   only where the page has none in the clear, which leaves out cards of related articles.
2. Pages pair by URL path inside their host. Distinct pages of a host are put in path order by a
   global sort of narrow rows, and each takes the neighbour of the same folder, else the one
   before, else the one after; a hot host is a long run of sorted rows, never one task's group.
   Copies of a page on a host collapse before, so a page is never compared with itself.
3. Comparison works on hashes of lines and yields the numbers of the blocks that stay. A page's text
   moves once, without what its marks bar, and its neighbour's not at all. The lines of a pair are aligned by longest common subsequence and the shared ones deleted:
   templates, notices and repeated chrome.
4. Two articles may truly share a sentence, so one neighbour is not enough to delete prose inside an
   article container. It is compared with all distinct pages of the host: lines are counted per host,
   combined before the shuffle, and prose on at least ``USUAL_PAGES`` pages and half of those with a
   container is the host's and deleted. A host has at most twice as many such lines as a page has on average.

Defined cases: null html is an empty page, whose text is empty. A null or odd URL has an empty host
and its text up to the query as path. Where the marks leave nothing, names
count for nothing and the shared lines alone decide; elements, roles and hidden parts stay out. Other than that,
a page alone on its host is judged by marks only, as is one
all of whose lines are shared or usual on the host. Rows that repeat are each returned. An empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import html
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventlens.operators.scans import positioned
from eventlens.session import BROADCAST_ROWS, cut

JUNK, INSIDE, PROSE, LINKS, HEADER = 1, 2, 4, 8, 16
#: Marked as junk by a name, in an article element, and in a container inside what a name marks.
NAMED, ARTICLE, WRAPPED = 32, 64, 128
#: Pages of a host that must have a line of prose before it can be the host's.
USUAL_PAGES = 3

#: HTML element names by the part they play.
RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "svg", "math", "xmp"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
NEVER = {"head", "nav", "footer", "aside", "form", "button", "select", "option", "dialog", "menu", "object", "audio",
         "video", "canvas", "datalist", "fieldset"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i",
          "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong",
          "sub", "sup", "time", "tt", "u", "var", "wbr", "img"}
SPEECH = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "blockquote", "pre", "td", "th", "dd", "dt", "figcaption"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Words of class and id names, and roles, that mark what is not article text.
JUNK_WORDS = {"ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo",
              "promotion", "banner", "nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "sidebar",
              "aside", "rail", "widget", "widgets", "footer", "foot", "copyright", "cookie", "cookies", "consent",
              "gdpr", "notice", "notices", "alert", "popup", "modal", "overlay", "newsletter", "subscribe",
              "subscription", "signup", "login", "form", "search", "social", "share", "sharing", "related",
              "recommended", "comment", "comments", "disqus", "replies", "toolbar", "skip", "pagination", "pager"}
HEADER_WORDS = {"header", "masthead"}
#: First and last words of names that tell the state of a page, such as ``has-sidebar``.
STATE_FIRST, STATE_LAST = {"has", "no", "with", "without"}, {"free", "open"}
JUNK_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alertdialog", "alert",
              "menu", "menubar", "toolbar", "form"}

TAG_NAME = re.compile(r"(/?)([A-Za-z][^\s/>]*+)")
ATTRIBUTE = re.compile(r"""([^\s=/>"']++)\s*+=\s*+(?:"([^"]*)"|'([^']*)'|([^\s>]+))|([^\s=/>"']++)""")
NAME_PART = re.compile(r"[^a-z0-9]+")


def _marks(tag: str, attributes: str, above: int) -> int:
    """Marks of an element, with those of its parent."""
    marks = above
    if tag in NEVER:
        marks |= JUNK
    if tag == "header":
        marks |= HEADER
    article, main = tag == "article", tag == "main"
    marks = marks & ~PROSE | (PROSE if tag in SPEECH or tag in INLINE and above & PROSE else 0)
    words: set[str] = set()
    if attributes and not attributes.isspace():
        for name, a, b, c, bare in ATTRIBUTE.findall(attributes):
            name, value = (name or bare).lower(), (a or b or c).lower()
            if name in ("class", "id"):
                for part in map(NAME_PART.split, value.split()):
                    if part[0] not in STATE_FIRST and part[-1] not in STATE_LAST:
                        words.update(part)
            elif name == "role":
                if value in JUNK_ROLES:
                    marks |= JUNK
                article, main = article or value == "article", main or value == "main"
            elif name == "hidden" or name == "aria-hidden" and value == "true":
                marks |= JUNK
            elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                marks |= JUNK
    if main and not above & INSIDE or article and not above & ARTICLE:
        if marks & (NAMED | HEADER):
            marks = marks & ~(NAMED | HEADER) | WRAPPED
    if article or main:
        marks |= INSIDE | (ARTICLE if article else 0)
    if main or tag in ("html", "body"):
        words.clear()
    elif article:
        words &= {"comment", "comments", "ad", "advert", "related", "promo", "sponsored"}
    if words & JUNK_WORDS:
        marks |= NAMED
    if words & HEADER_WORDS:
        marks |= HEADER
    if tag in HEADINGS and marks & INSIDE:
        marks &= ~HEADER
    return marks


class _Markup:
    """The tags of a page, one after the other, each character looked at a bounded number of times.
    Quotes hide a ``>``; once a tag's quotes run to the end of the page, they do no longer."""

    def __init__(self, page: str) -> None:
        self.page, self.last, self.quotes = page, page.rfind(">"), True
        self.missing: set[str] = set()

    def _ahead(self, what: str, at: int) -> int:
        """Where ``what`` is next, or -1, which is looked for once only."""
        if what in self.missing:
            return -1
        found = self.page.find(what, at)
        if found < 0:
            self.missing.add(what)
        return found

    def _tag_end(self, at: int) -> int:
        """The ``>`` that ends the tag whose name ends at ``at``."""
        plain = self.page.find(">", at)
        if not self.quotes:
            return plain
        while True:
            close = self._ahead(">", at)
            marks = [m for m in (self._ahead('"', at), self._ahead("'", at)) if m >= 0]
            mark = min(marks, default=-1)
            if close >= 0 and (mark < 0 or close < mark):
                return close
            at = self._ahead(self.page[mark], mark + 1) + 1 if mark >= 0 and close >= 0 else 0
            if not at:
                self.quotes = False
                return plain

    def tag(self, at: int) -> tuple[int, int, str, str, str] | None:
        """``(start, end, slash, name, rest)`` of the next markup; the name of what is no tag is empty."""
        page = self.page
        while (start := page.find("<", at)) >= 0:
            for opening, closing in (("<!--", "-->"), ("<![CDATA[", "]]>")):
                if page.startswith(opening, start):
                    end = self._ahead(closing, start + len(opening))
                    return start, len(page) if end < 0 else end + len(closing), "", "", ""
            if start < self.last:
                if page.startswith(("<!", "<?"), start):
                    return start, page.find(">", start) + 1, "", "", ""
                named = TAG_NAME.match(page, start + 1)
                if named:
                    end = self._tag_end(named.end())
                    return start, end + 1, named[1], named[2].lower(), page[named.end():end]
            at = start + 1
        return None

    def raw_end(self, tag: str, at: int) -> int:
        """Where the content of a raw element ends, its end tag included."""
        found = re.compile(rf"</{tag}\b", re.I).search(self.page, at)
        end = self.page.find(">", found.end()) if found else -1
        return end + 1 if end >= 0 else len(self.page)


class _Open:
    """The open elements with their marks; the places of each name and of barriers are at hand."""

    def __init__(self) -> None:
        self.names: list[str] = []
        self.marks: list[int] = []
        self.places: dict[str, list[int]] = {}

    def _kinds(self, tag: str) -> list[str]:
        kinds = [tag]
        if tag not in INLINE:
            kinds.append("<block>")
            if tag not in SPEECH:
                kinds.append("<barrier>")
        return kinds

    def last(self, name: str) -> int:
        places = self.places.get(name)
        return places[-1] if places else -1

    def push(self, tag: str, marks: int) -> None:
        for kind in self._kinds(tag):
            self.places.setdefault(kind, []).append(len(self.names))
        self.names.append(tag)
        self.marks.append(marks)

    def cut(self, place: int) -> None:
        """Close the element at ``place`` and all inside it."""
        while len(self.names) > place:
            for kind in self._kinds(self.names.pop()):
                self.places[kind].pop()
            self.marks.pop()

    def above(self) -> int:
        return self.marks[-1] if self.marks else 0


def blocks(page: str | None) -> tuple[list[str], list[int]]:
    """The page's blocks of text and their marks, in page order, in time linear in its length."""
    page = page or ""
    markup, opened = _Markup(page), _Open()
    texts: list[str] = []
    marks: list[int] = []
    said: list[str] = []
    linked, here, at = 0, 0, 0

    def close() -> None:
        nonlocal linked
        text = " ".join(html.unescape("".join(said)).split())
        if text:
            texts.append(text)
            marks.append(here | (LINKS if 2 * linked > len(text) else 0))
        said.clear()
        linked = 0

    def say(piece: str) -> None:
        nonlocal linked
        if piece:
            said.append(piece)
            if opened.last("a") >= 0:
                linked += len(piece)

    while at < len(page):
        found = markup.tag(at)
        if not found:
            say(page[at:])
            break
        start, end, ending, tag, rest = found
        say(page[at:start])
        at = end
        if not tag:
            continue
        block = tag not in INLINE
        if block:
            close()
        if ending:
            if tag in RAW:
                continue
            place = opened.last(tag)
            if place >= 0 and (block or place > opened.last("<block>")):
                opened.cut(place)
        elif tag in RAW:
            if not rest.endswith("/"):
                at = markup.raw_end(tag, at)
        elif tag not in VOID:
            if block and tag in SPEECH:  # an open element of the same kind ends here
                place = max(opened.last(tag), opened.last("p"))
                if place > opened.last("<barrier>"):
                    opened.cut(place)
            if not rest.endswith("/"):
                opened.push(tag, _marks(tag, rest, opened.above()))
        if block:
            here = opened.above()
    close()
    return texts, marks


def shared(left: list, right: list) -> set[int]:
    """Indexes of ``left`` in a longest common subsequence with ``right``, in linear memory."""
    out: set[int] = set()
    numbers: dict = {}
    a = np.array([numbers.setdefault(x, len(numbers)) for x in left], np.int64)
    b = np.array([numbers.setdefault(x, len(numbers)) for x in right], np.int64)
    # Lines of one side only are in no common subsequence.
    ia, ib = np.flatnonzero(np.isin(a, b)), np.flatnonzero(np.isin(b, a))

    def row(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Length of the common subsequence of all of x and each beginning of y."""
        best = np.zeros(len(y) + 1, np.int64)
        for v in x:
            step = best.copy()
            step[1:] = np.maximum(step[1:], best[:-1] + (y == v))
            best = np.maximum.accumulate(step)
        return best

    todo = [(ia, ib)]
    while todo:
        p, q = todo.pop()
        while len(p) and len(q) and a[p[0]] == b[q[0]]:
            out.add(int(p[0]))
            p, q = p[1:], q[1:]
        while len(p) and len(q) and a[p[-1]] == b[q[-1]]:
            out.add(int(p[-1]))
            p, q = p[:-1], q[:-1]
        if not len(p) or not len(q):
            continue
        if len(p) == 1:
            if a[p[0]] in b[q]:
                out.add(int(p[0]))
            continue
        half = len(p) // 2
        split = int(np.argmax(row(a[p[:half]], b[q]) + row(a[p[half:]][::-1], b[q][::-1])[::-1]))
        todo += [(p[:half], q[:split]), (p[half:], q[split:])]
    return out


def _left(marks: list[int]) -> tuple[list[int], bool, bool]:
    """Places of the blocks that the marks leave, whether a container decides, and whether names
    would have taken all and so count for nothing."""
    barred = JUNK | HEADER | NAMED | WRAPPED
    contained = any(m & INSIDE and not m & (JUNK | NAMED | WRAPPED) for m in marks)
    if not contained and any(m & INSIDE and not m & (JUNK | NAMED) for m in marks):
        contained, barred = True, JUNK | HEADER | NAMED

    def fits(m: int) -> bool:
        if m & barred:
            return False
        return bool(m & INSIDE) if contained else not m & LINKS

    kept = [k for k, m in enumerate(marks) if fits(m)]
    if kept:
        return kept, contained, False
    return [k for k, m in enumerate(marks) if not m & (JUNK | LINKS)], contained, True


def chosen(marks: list[int], lines: list, other: list | None, usual: list | None = None) -> list[int]:
    """Which of the blocks that the marks leave are the article, as numbers among these, given the
    lines of the nearest page and those usual on the host; lines may be hashes on all sides."""
    left, contained, nameless = _left(marks)
    everywhere = set(usual or ())
    common = shared(lines, other) if other else set()
    if nameless:
        return [n for n, k in enumerate(left) if k not in common]

    def repeats(k: int) -> bool:
        return lines[k] in everywhere if contained and marks[k] & PROSE else k in common

    return [n for n, k in enumerate(left) if not repeats(k)] or list(range(len(left)))


def main_text(texts: list[str], marks: list[int], other: list | None, usual: list | None = None) -> str:
    """The article of a page, given the lines of its nearest page and those usual on its host."""
    left = _left(marks)[0]
    return "\n".join(texts[left[n]] for n in chosen(marks, texts, other, usual))


def _parse(batches):
    for batch in batches:
        parsed = [blocks(h) for h in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column(c) for c in ("host", "path", "content")]
            + [pa.array([p[0] for p in parsed], pa.list_(pa.string())),
               pa.array([p[1] for p in parsed], pa.list_(pa.int32()))],
            names=["host", "path", "content", "texts", "marks"],
        )


def _choose(batches):
    for batch in batches:
        rows = zip(*(batch.column(c).to_pylist() for c in ("marks", "lines", "other", "usual")))
        yield pa.RecordBatch.from_arrays(
            [batch.column("host"), batch.column("content"), pa.array([chosen(*r) for r in rows], pa.list_(pa.int32()))],
            names=["host", "content", "chosen"],
        )


def _leave(batches):
    """The texts that the marks leave; what they bar is in no outcome and need not move."""
    for batch in batches:
        parsed = (blocks(h) for h in batch.column("html").to_pylist())
        left = [[texts[k] for k in _left(marks)[0]] for texts, marks in parsed]
        yield pa.RecordBatch.from_arrays(
            [batch.column(c) for c in ("page_id", "url", "host", "content")] + [pa.array(left, pa.list_(pa.string()))],
            names=["page_id", "url", "host", "content", "texts"],
        )


def _neighbours(distinct: DataFrame) -> DataFrame:
    """``host, content, other``: for each distinct page, the content of its nearest one."""
    placed = positioned(
        distinct.select("host", "path", "content"), [F.col("host"), F.col("path"), F.col("content")], "place"
    )
    # Dense positions: one count per sort partition shifts the places inside it.
    part, inside = F.shiftright("place", 33), F.col("place").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).orderBy("part").collect()
    before, seen = [], 0
    for row in sizes:  # as many as sort partitions
        before.append((row["part"], seen))
        seen += row["n"]
    shift = distinct.sparkSession.createDataFrame(before or [(0, 0)], "part long, shift long")
    dense = placed.withColumn("part", part).join(F.broadcast(shift), "part").select(
        (F.col("shift") + inside).alias("place"), "host", "path", "content",
        F.regexp_replace("path", "[^/]*$", "").alias("folder"),
    )

    def beside(name: str, step: int) -> DataFrame:
        return dense.select(
            (F.col("place") - step).alias("place"),
            F.struct("host", "folder", "content").alias(name),
        )

    near = dense.join(beside("prior", -1), "place", "left").join(beside("next", 1), "place", "left")

    def same(name: str, column: str):
        return F.coalesce(F.col(f"{name}.{column}") == F.col(column), F.lit(False))

    other = (
        F.when(same("prior", "host") & same("prior", "folder"), F.col("prior.content"))
        .when(same("next", "host") & same("next", "folder"), F.col("next.content"))
        .when(same("prior", "host"), F.col("prior.content"))
        .when(same("next", "host"), F.col("next.content"))
    )
    return near.select("host", "content", other.alias("other_content"))


def _usual(distinct: DataFrame) -> DataFrame:
    """``host, usual``: the lines of prose inside containers that are the host's, of hosts with any.
    Broadcast only where the hosts' lines, not just the hosts, are few."""
    prose = F.filter(
        "lines", lambda _, k: F.get("marks", k).bitwiseAND(JUNK | NAMED | INSIDE | PROSE | HEADER) == (INSIDE | PROSE)
    )
    counts = cut(
        distinct.select("host", F.array_distinct(prose).alias("prose"))
        .where(F.size("prose") > 0)
        # The null line counts the host's pages.
        .select("host", F.explode(F.concat("prose", F.array(F.lit(None).cast("long")))).alias("line"))
        .groupBy("host", "line")
        .agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") >= USUAL_PAGES)
    )
    pages = counts.where("line is null").select("host", F.col("n").alias("pages"))
    usual = cut(
        counts.where("line is not null").join(pages, "host").where(2 * F.col("n") >= F.col("pages"))
        .groupBy("host").agg(F.collect_list("line").alias("usual"))
    )
    held = usual.agg(F.coalesce(F.sum(F.size("usual")), F.lit(0))).first()[0]
    return F.broadcast(usual) if held <= BROADCAST_ROWS else usual


def page_texts(pages: DataFrame) -> DataFrame:
    """One row per page: ``page_id, url, text, n_chars``."""
    address = F.coalesce("url", F.lit(""))
    bare = F.regexp_replace(address, "[?#].*$", "")
    rows = pages.select(
        "page_id",
        "url",
        F.lower(F.regexp_extract(bare, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/]*)", 1)).alias("host"),
        F.regexp_replace(bare, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/]*", "").alias("path"),
        F.unhex(F.md5(F.coalesce("html", F.lit("")))).alias("content"),
        "html",
    )
    # Pages are parsed twice: first into hashes and marks, which settle what stays, then into the texts
    # that may stay, which move once. No parsed text is written.
    parsed = rows.select("host", "path", "content", "html").mapInArrow(
        _parse, "host string, path string, content binary, texts array<string>, marks array<int>"
    )
    lines = F.transform("texts", lambda t: F.xxhash64(t)).alias("lines")
    distinct = cut(
        parsed.select("host", "path", "content", "marks", lines)
        .groupBy("host", "content")
        .agg(F.min("path").alias("path"), F.first("lines").alias("lines"), F.first("marks").alias("marks"))
    )
    others = distinct.select("host", F.col("content").alias("other_content"), F.col("lines").alias("other"))
    settled = (
        _neighbours(distinct).join(others, ["host", "other_content"], "left")
        .join(distinct.select("host", "content", "lines", "marks"), ["host", "content"])
        .join(_usual(distinct), "host", "left")
        .select("host", "content", "marks", "lines", "other", "usual")
        .mapInArrow(_choose, "host string, content binary, chosen array<int>")
    )
    texts = rows.select(F.col("page_id").cast("long").alias("page_id"), "url", "host", "content", "html").mapInArrow(
        _leave, "page_id long, url string, host string, content binary, texts array<string>"
    )
    text = F.array_join(F.transform("chosen", lambda n: F.get("texts", n)), "\n").alias("text")
    told = texts.join(settled, ["host", "content"]).select("page_id", "url", text)
    return told.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
