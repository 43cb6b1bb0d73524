"""Maximal periodic runs of words by an enhanced suffix array, and collapsing them.

The words of many documents are numbered, document by document, so that no word of one document
equals a word of another, and their suffixes are sorted together by rank doubling. The rank arrays
of the rounds also give common prefixes: two suffixes share ``2^k`` words when their ranks of round
``k`` are equal. LCP intervals come as bounds and depth from the nearest smaller values on both
sides; no tree is built. For an interval of depth ``d`` the suffixes of all children but the largest
are tested: ``i`` starts a branching square of period ``d`` when ``ISA[i+d]`` lies in the interval and
the words after both halves differ, and ``i-d`` is tested the same way. Every run ends with exactly
one branching square of its smallest period, so rotating that square to the left, as long as the
word before it equals the word at the end of its first half, gives the whole run; squares of a
multiple of the period, found at the same end inside a run known already, are merged into it.

Defined cases: a null or empty text has no words and no runs, and collapses to the empty text. A
null id is written as the empty text where its checksum is asked for. Rows that repeat an id are
each told. A long text is one row of a task and takes time in proportion to n log n, whatever its
repeats. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventlens.llm.common import text_of
from eventlens.session import spread

#: A run has at least this many words and this many periods.
LEAST_WORDS, LEAST_PERIODS = 6, 4
#: Words handled together; a longer document is handled alone.
SLICE = 400_000
#: Input up to this size, which may be one row group, is dealt out to all cores.
DEALT = 32 << 20
#: Rows of interval tests made at a time.
TESTS = 2_000_000


def suffix_order(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Suffix array, its inverse, and the ranks of the prefixes of 1, 2, 4, .. words. ``symbols`` are
    from 0 on and end with one that occurs nowhere else."""
    n = len(symbols)
    order = np.argsort(symbols, kind="stable").astype(np.int64)
    first = np.concatenate([[True], symbols[order[1:]] != symbols[order[:-1]]])
    starts = np.flatnonzero(first)
    rank = np.empty(n, np.int32)  # a group of equals is named after its first place
    rank[order] = np.repeat(starts, np.diff(np.append(starts, n))).astype(np.int32)
    levels = [rank]
    reach = 1
    sizes = np.diff(np.append(starts, n))
    open_ = np.flatnonzero(np.repeat(sizes > 1, sizes))  # places of the order still tied
    while len(open_):
        suffixes = order[open_]
        group = rank[suffixes]
        follow = rank[np.minimum(suffixes + reach, n - 1)]
        by = np.argsort(group.astype(np.int64) << 32 | follow, kind="stable")
        suffixes, group, follow = suffixes[by], group[by], follow[by]
        order[open_] = suffixes
        new = np.ones(len(open_), bool)
        new[1:] = (group[1:] != group[:-1]) | (follow[1:] != follow[:-1])
        at = np.flatnonzero(new)
        sizes = np.diff(np.append(at, len(open_)))
        rank = rank.copy()
        rank[suffixes] = np.repeat(open_[at], sizes)
        levels.append(rank)
        open_ = open_[np.repeat(sizes > 1, sizes)]
        reach *= 2
    return order, rank, levels


def common_prefixes(order: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """LCP of each suffix in order with the one before it; 0 for the first."""
    a, b = order[:-1].copy(), order[1:].copy()
    lcp = np.zeros(len(order), np.int64)
    live = np.flatnonzero(levels[0][a] == levels[0][b])
    a, b, got = a[live], b[live], np.zeros(len(live), np.int64)
    last = len(order) - 1
    for k in range(len(levels) - 1, -1, -1):
        same = np.flatnonzero(levels[k][a] == levels[k][b])
        same = same[a[same] != b[same]]
        got[same] += 1 << k
        a[same] = np.minimum(a[same] + (1 << k), last)
        b[same] = np.minimum(b[same] + (1 << k), last)
    lcp[live + 1] = got
    return lcp


def nearest(values: np.ndarray, or_equal: bool) -> np.ndarray:
    """For each place of a positive value the nearest earlier place with a smaller value (or an equal
    one); place 0 must hold the smallest value. Pointers first jump over what their targets have
    jumped over; the few places behind long stairs are then found in a tree of minima."""
    below = np.less_equal if or_equal else np.less
    to = np.maximum(np.arange(len(values)) - 1, 0)
    live = np.flatnonzero(values > 0)
    for _ in range(12):
        live = live[~below(values[to[live]], values[live])]
        if not len(live):
            return to
        to[live] = to[to[live]]
    minima = [values]
    while len(minima[-1]) > 1:
        level = minima[-1]
        level = np.append(level, level[-1]) if len(level) % 2 else level
        minima.append(np.minimum(level[::2], level[1::2]))
    wanted = values[live]
    node, height = live.copy(), np.full(len(live), -1)
    for h, level in enumerate(minima):  # up to the first left sibling that holds such a value
        up = np.flatnonzero(height < 0)
        right = up[(node[up] & 1) == 1]
        right = right[below(level[node[right] - 1], wanted[right])]
        node[right] -= 1
        height[right] = h
        node[up] >>= height[up] < 0
    for h in range(len(minima) - 1, 0, -1):  # and down to its last place
        down = np.flatnonzero(height >= h)
        last = np.minimum(2 * node[down] + 1, len(minima[h - 1]) - 1)
        node[down] = np.where(below(minima[h - 1][last], wanted[down]), last, 2 * node[down])
    to[live] = node
    return to


def children(lcp: np.ndarray) -> tuple[np.ndarray, ...]:
    """All children but the largest of all LCP intervals of positive depth: ``(from, to, depth, lower,
    upper)``, with bounds as half-open ranges of the suffix array."""
    n = len(lcp)
    padded = np.concatenate([lcp, [-1]])
    padded[0] = -1
    back = padded[::-1].copy()
    after = n - nearest(back, False)[::-1]  # the next smaller value
    until = n - nearest(back, True)[::-1]  # the next smaller or equal value
    lower, before = nearest(padded, False), nearest(padded, True)
    marks = np.flatnonzero(padded[:n] > 0)
    depth, low, high = padded[marks], lower[marks], after[marks]
    # A child begins at each mark; the first child of an interval ends at the interval's first mark.
    head = marks[padded[before[marks]] < depth]
    starts = np.concatenate([marks, lower[head]])
    ends = np.concatenate([until[marks], head])
    depths = np.concatenate([depth, padded[head]])
    lows, highs = np.concatenate([low, lower[head]]), np.concatenate([high, after[head]])
    size = ends - starts
    by = np.lexsort((-size, depths, lows))
    largest = np.ones(len(by), bool)
    largest[1:] = (lows[by][1:] != lows[by][:-1]) | (depths[by][1:] != depths[by][:-1])
    rest = by[~largest]
    return starts[rest], ends[rest], depths[rest], lows[rest], highs[rest]


def branching_squares(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(start, period)`` of the squares that the word after them does not continue."""
    n = len(symbols)
    order, place, levels = suffix_order(symbols)
    start, end, depth, low, high = children(common_prefixes(order, levels))
    del levels
    padded = np.concatenate([symbols, [-1]])
    found_at, found_of = [], []
    size = end - start
    bounds = np.concatenate([[0], np.cumsum(size)])
    k = 0
    while k < len(size):
        to = max(k + 1, int(np.searchsorted(bounds, bounds[k] + TESTS, "right")) - 1)
        part = size[k:to]
        row = np.repeat(np.arange(k, to), part)
        i = order[np.arange(len(row)) + np.repeat(start[k:to] - (bounds[k:to] - bounds[k]), part)]
        d, lo, hi = depth[row], low[row], high[row]
        for first in (i, i - d):  # the suffix is the first or the second half's start
            second, other = first + d, first + d if first is i else first
            inside = (other >= 0) & (other < n)
            spot = place[np.where(inside, other, 0)]
            hit = np.flatnonzero(inside & (spot >= lo) & (spot < hi))
            f, p, s = first[hit], d[hit], second[hit]
            branch = padded[s] != padded[np.minimum(s + p, n)]
            found_at.append(f[branch])
            found_of.append(p[branch])
        k = to
    if not found_at:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at, of = np.concatenate(found_at), np.concatenate(found_of)
    return tuple(np.unique(np.stack([at, of], 1), axis=0).T)


def _rotated(symbols: np.ndarray, start: int, period: int) -> int:
    """Where the run of a square begins: the square is rotated left in steps that double."""
    step = 64
    while start:
        low = max(0, start - step)
        differ = np.flatnonzero(symbols[low:start] != symbols[low + period:start + period])
        if len(differ):
            return low + int(differ[-1]) + 1
        start, step = low, step * 2
    return 0


def runs(symbols: np.ndarray, least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS) -> np.ndarray:
    """Rows ``(start, length, period)`` of the runs that are long enough, by start, then period."""
    at, period = branching_squares(symbols)
    # The first rotations of all squares side by side; most squares are found to be short here.
    back = np.zeros(len(at), np.int64)
    live = np.flatnonzero(at > 0)
    for _ in range(4):
        moved = at[live] - back[live] - 1
        keep = moved >= 0
        live, moved = live[keep], moved[keep]
        live = live[symbols[moved] == symbols[moved + period[live]]]
        back[live] += 1
    long_enough = 2 * period + back >= np.maximum(least_words, least_periods * period)
    going = np.zeros(len(at), bool)
    going[live] = True
    chosen = np.flatnonzero(long_enough | going)
    ends = (at + 2 * period)[chosen]
    chosen = chosen[np.lexsort((period[chosen], ends))]
    out = []
    last_end, known = -1, []
    for k in chosen:
        s, p = int(at[k]), int(period[k])
        e = s + 2 * p
        if e != last_end:
            last_end, known = e, []
        if any(p % q == 0 and from_ <= s for from_, q in known):
            continue  # a square of a multiple of a known run's period, inside that run
        from_ = s - int(back[k])
        if going[k]:
            from_ = _rotated(symbols, from_, p)
        known.append((from_, p))
        if e - from_ >= max(least_words, least_periods * p):
            out.append((from_, e - from_, p))
    return np.array(sorted(out, key=lambda r: (r[0], r[2])), np.int64).reshape(-1, 3)


def with_repeats(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words of a document, one in ten of which is made periodic from some word on."""
    h = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    n = len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    unit = words[a:a + p]
    return words[:a] + (unit * (-(-(n - a) // p)))[:n - a]


def _runs_of(slices: list[list[bytes]], least_words: int, least_periods: int) -> list[np.ndarray]:
    """The runs of each document, places counted from its first word."""
    sizes = np.array([len(w) for w in slices], np.int64)
    total = int(sizes.sum())
    if not total:
        return [np.zeros((0, 3), np.int64)] * len(slices)
    flat = pa.array([w for words in slices for w in words], pa.binary()).dictionary_encode()
    kinds = len(flat.dictionary)
    document = np.repeat(np.arange(len(slices)), sizes)
    keys = document * kinds + flat.indices.to_numpy(zero_copy_only=False)
    _, symbols = np.unique(keys, return_inverse=True)
    symbols = np.append(symbols, symbols.max() + 1).astype(np.int64)
    found = runs(symbols, least_words, least_periods)
    begins = np.cumsum(sizes) - sizes
    owner = np.searchsorted(begins + sizes, found[:, 0], "right")
    found[:, 0] -= begins[np.minimum(owner, len(sizes) - 1)]
    cuts = np.searchsorted(owner, np.arange(len(slices) + 1))
    return [found[cuts[k]:cuts[k + 1]] for k in range(len(slices))]


def _told(doc_id: int | None, words: list[bytes], found: np.ndarray) -> tuple:
    if not len(found):
        nothing = hashlib.sha256(b"").hexdigest()
        return doc_id, 0, None, None, None, None, nothing, hashlib.sha256(b" ".join(words)).hexdigest()
    start, length, period = found.T
    best = np.lexsort((period, start, -length))[0]
    lines = "".join(f"{s},{n},{p}\n" for s, n, p in found.tolist())
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, start + period, 1)
    np.add.at(change, start + length, -1)
    kept = np.flatnonzero(np.cumsum(change)[:-1] == 0)
    s, n, p = (int(x) for x in found[best])
    return (
        doc_id, len(found), s, n, p, 1000 * n // p, hashlib.sha256(lines.encode()).hexdigest(),
        hashlib.sha256(b" ".join([words[k] for k in kept])).hexdigest(),
    )


def _report(repeated: bool, least_words: int, least_periods: int):
    def run(batches):
        held: list[tuple[int | None, list[bytes]]] = []

        def done():
            found = _runs_of([w for _, w in held], least_words, least_periods)
            rows = [_told(d, w, f) for (d, w), f in zip(held, found)]
            held.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows), [pa.int64()] * 6 + [pa.string()] * 2)],
                names=["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256",
                       "collapsed_sha256"],
            )

        size = 0
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                words = text.as_py().encode().split()  # bytes split at these six blanks only
                if size and size + len(words) > SLICE:
                    yield done()
                    size = 0
                held.append((doc_id, with_repeats(words, doc_id) if repeated else words))
                size += len(words)
        if held:
            yield done()

    return run


def run_report(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    repeated: bool = False,
    least_words: int = LEAST_WORDS,
    least_periods: int = LEAST_PERIODS,
) -> DataFrame:
    """One row per input row: the number of runs, the longest run, and digests of all runs and of the
    collapsed text. ``repeated`` makes one in ten documents periodic first (``with_repeats``)."""
    text = docs.select(F.col(id_column).cast("long").alias("doc_id"), text_of(text_column).alias("text"))
    return spread(text, DEALT).mapInArrow(
        _report(repeated, least_words, least_periods),
        "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, "
        "runs_sha256 string, collapsed_sha256 string",
    )
