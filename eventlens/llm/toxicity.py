"""Toxicity by a weighted lexicon, matched by Aho-Corasick over folded text.

Folding lowers case and maps homoglyphs (Cyrillic, Greek, full-width) and digit or sign
substitutions to Latin letters, so that ``1d10t`` and its Cyrillic look-alikes read as one word.
An entry is a whole word or the beginning of words; entries and weights are learned:

1. Word and word-beginning frequencies over the toxic training rows give candidates, then the
   clean training rows are counted for the candidates only. An entry's weight is its smoothed
   log odds. A word that an equally strong beginning covers is left out.
2. Exception phrases: an entry together with the word before or after it that is not toxic in the
   training rows (for instance a harmless compound) cancels the entry where it occurs.
3. The sum of weights of a text, divided by a slowly growing function of its length, is mapped to
   the share of toxic training rows at such values: a monotone step function over fixed bins.

Training rows are at most ``TRAIN_ROWS`` labelled rows, the smallest by a hash of the id; every
text is scored whole. Lexicon and exceptions are bounded by ``MOST_ENTRIES``, so what is shipped
with the tasks does not grow with the corpus. Scoring is one pass without a shuffle.

Defined cases: a null or empty text has no hits and gets the score of texts without hits. Null
labels are not training rows, and a repeated label counts as toxic if any says so. Without any
toxic or any clean training row the score is the share of toxic ones (0 if there are no rows).
Rows that repeat an id are each scored. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventlens.llm.common import text_of

#: Bound of the training sample, entries kept, and the least support and log odds of an entry.
TRAIN_ROWS = 60_000
MOST_ENTRIES = 5_000
LEAST_ROWS, LEAST_SHARE, LEAST_ODDS = 4, 0.005, 3.0
BEGINNINGS = range(4, 8)
BINS = 32
THRESHOLD = 0.3

#: Look-alike letters and substitutions, each to the letter it stands for.
LOOKALIKES = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "ѕ": "s", "һ": "h", "і": "i", "ј": "j",
    "к": "k", "ӏ": "l", "м": "m", "о": "o", "р": "p", "ԛ": "q", "г": "r", "т": "t", "у": "y",
    "ѵ": "v", "ԝ": "w", "х": "x", "α": "a", "β": "b", "ε": "e", "ι": "i", "κ": "k", "ν": "v",
    "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ɡ": "g",
    "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s",
}
FULL_WIDTH = {0xFF41 + k: chr(97 + k) for k in range(26)}
#: Zero-width characters and the soft hyphen vanish.
INVISIBLE = {0x200B: None, 0x200C: None, 0x200D: None, 0x2060: None, 0xFEFF: None, 0x00AD: None}
FOLD = str.maketrans(LOOKALIKES) | FULL_WIDTH | INVISIBLE
WORD = regex.compile(r"\w+")


def folded(text: str | None) -> str:
    return (text or "").lower().translate(FOLD)


@dataclass
class Lexicon:
    """``entries``: pattern to (weight, whole word); ``exceptions``: phrases that cancel entries;
    ``scores``: per bin of the normalised sum."""

    entries: dict[str, tuple[float, bool]]
    exceptions: frozenset[str]
    scores: list[float]
    top: float

    def automaton(self) -> ahocorasick.Automaton | None:
        if not self.entries:
            return None
        machine = ahocorasick.Automaton()
        for pattern, (weight, whole) in self.entries.items():
            machine.add_word(pattern, (len(pattern), weight, whole))
        machine.make_automaton()
        return machine


def _features(text: str) -> set[tuple[str, bool]]:
    words = set(WORD.findall(folded(text)))
    found = {(w, True) for w in words}
    found.update((w[:k], False) for w in words for k in BEGINNINGS if len(w) >= k)
    return found


def _word_at(text: str, start: int, stop: int) -> tuple[int, int]:
    """The whole word around ``[start, stop)``; matches start at word starts."""
    while stop < len(text) and (text[stop].isalnum() or text[stop] == "_"):
        stop += 1
    return start, stop


def _hits(machine, text: str) -> Iterator[tuple[int, int, float]]:
    """One hit per word: of the entries at a word's beginning, the heaviest."""
    best: dict[int, tuple[int, float]] = {}
    for last, (size, weight, whole) in machine.iter(text):
        start, stop = last + 1 - size, last + 1
        if start and (text[start - 1].isalnum() or text[start - 1] == "_"):
            continue
        if whole and stop < len(text) and (text[stop].isalnum() or text[stop] == "_"):
            continue
        if weight > best.get(start, (0, 0.0))[1]:
            best[start] = (stop, weight)
    for start, (stop, weight) in best.items():
        yield *_word_at(text, start, stop), weight


def _phrases(text: str, start: int, stop: int) -> tuple[str, ...]:
    """The hit word with its neighbour words, where there are any."""
    word = text[start:stop]
    before = WORD.findall(text[max(0, start - 60):start])
    after = WORD.findall(text[stop:stop + 60])
    return tuple(([f"{before[-1]} {word}"] if before else []) + ([f"{word} {after[0]}"] if after else []))


def _raw(machine, exceptions: frozenset[str], text: str | None) -> tuple[float, int]:
    """Normalised sum of weights and number of hits."""
    plain = folded(text)
    total, count = 0.0, 0
    if machine is not None and plain:
        for start, stop, weight in _hits(machine, plain):
            if exceptions and not exceptions.isdisjoint(_phrases(plain, start, stop)):
                continue
            total += weight
            count += 1
    return total / (1.0 + math.log1p(len(plain) / 2_000)), count


def _bin(raw: float, top: float) -> int:
    return 0 if raw <= 0 else 1 + min(BINS - 2, int((BINS - 1) * raw / top))


def _counted(rows: DataFrame, of) -> Counter:
    """Sum of per-task counters; ``of(texts)`` yields the features of each text."""

    def count(batches):
        seen: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                seen.update(of(text))
        keys = list(seen)
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.bool_()),
             pa.array([seen[k] for k in keys], pa.int64())],
            names=["feature", "whole", "rows"],
        )

    return rows.select("text").mapInArrow(count, "feature string, whole boolean, rows long").groupBy(
        "feature", "whole"
    ).agg(F.sum("rows").alias("rows"))


def _isotonic(good: np.ndarray, all_rows: np.ndarray, prior: float) -> list[float]:
    """Monotone shares per bin by pooling neighbours, each bin with one row of prior."""
    blocks: list[list[float]] = []
    for g, n in zip(good, all_rows):
        blocks.append([g + prior, n + 1.0, 1])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] > blocks[-1][0] / blocks[-1][1]:
            g2, n2, k2 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + g2, blocks[-1][1] + n2, blocks[-1][2] + k2]
    return [float(g / n) for g, n, k in blocks for _ in range(k)]


def held_out(doc: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc.cast("string")), F.lit(4)) == 2, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> Lexicon:
    """Fit on the labelled rows that are not held out, at most ``most`` of them."""
    marked = (
        labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    )
    # At most ``most`` ids: small enough to broadcast, so no text is shuffled.
    sample = docs.select("doc_id", text_of().alias("text")).join(F.broadcast(marked), "doc_id")
    toxic, clean = sample.where("toxic = 1"), sample.where("toxic = 0")
    sizes = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_toxic, n_clean = sizes.get(1, 0), sizes.get(0, 0)
    share = n_toxic / max(1, n_toxic + n_clean)
    if not n_toxic or not n_clean:
        return Lexicon({}, frozenset(), [share] * BINS, 1.0)

    least = max(LEAST_ROWS, math.ceil(LEAST_SHARE * n_toxic))
    candidates = {
        (r["feature"], r["whole"]): r["rows"]
        for r in _counted(toxic, _features).where(F.col("rows") >= least)
        .orderBy(F.col("rows").desc(), "feature", "whole").limit(20 * MOST_ENTRIES).collect()
    }
    wanted = frozenset(candidates)
    ordinary = {
        (r["feature"], r["whole"]): r["rows"]
        for r in _counted(clean, lambda text: _features(text) & wanted).collect()
    }
    weights = {}
    for key, rows in candidates.items():
        odds = math.log((rows + 0.5) / (n_toxic + 1)) - math.log((ordinary.get(key, 0) + 0.5) / (n_clean + 1))
        if odds >= LEAST_ODDS:
            weights[key] = odds
    # A beginning whose rows nearly all come from one longer form gives way to that form.
    for pattern, whole in sorted(weights, key=lambda x: (-len(x[0]), x)):
        if (pattern, whole) not in weights:
            continue
        for k in BEGINNINGS:
            short = (pattern[:k], False)
            if (k < len(pattern) or whole) and short in weights and candidates[pattern, whole] >= 0.95 * candidates[short]:
                del weights[short]
    entries: dict[str, tuple[float, bool]] = {}
    for (pattern, whole), odds in sorted(weights.items(), key=lambda x: (len(x[0][0]), x[0])):
        covering = [entries[pattern[:k]] for k in range(1, len(pattern) + 1) if pattern[:k] in entries]
        if any(not w and have >= odds - 1.0 for have, w in covering):
            continue
        if pattern not in entries or entries[pattern][0] < odds:
            entries[pattern] = (odds, whole)
    entries = dict(sorted(entries.items(), key=lambda x: (-x[1][0], x[0]))[:MOST_ENTRIES])

    plain = Lexicon(entries, frozenset(), [], 1.0)

    def phrases(text):
        machine = plain.automaton()
        return {(p, True) for a, b, _ in _hits(machine, t) for p in _phrases(t, a, b)} if machine and (
            t := folded(text)) else ()

    # Only phrases that clean rows hold can be exceptions, and few clean rows have hits at all.
    harmless = {
        r["feature"]: r["rows"]
        for r in _counted(clean, phrases).where("rows >= 3")
        .orderBy(F.col("rows").desc(), "feature").limit(MOST_ENTRIES).collect()
    }
    known = frozenset(harmless)
    harmful = {
        r["feature"]: r["rows"]
        for r in _counted(toxic, lambda text: {p for p in phrases(text) if p[0] in known}).collect()
    } if known else {}
    exceptions = frozenset(p for p, n in harmless.items() if harmful.get(p, 0) <= share * n)

    top = 40.0

    def placed(batches):
        machine = plain.automaton()
        for batch in batches:
            where = [_bin(_raw(machine, exceptions, t)[0], top) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(where, pa.int64()), batch.column(1)], names=["bin", "toxic"])

    counts = np.zeros((BINS, 2))
    for r in (
        sample.select("text", F.col("toxic").cast("long").alias("toxic"))
        .mapInArrow(placed, "bin long, toxic long").groupBy("bin", "toxic").agg(F.count(F.lit(1)).alias("n")).collect()
    ):
        counts[r["bin"], int(r["toxic"] == 1)] += r["n"]
    return Lexicon(entries, exceptions, _isotonic(counts[:, 1], counts.sum(1), share), top)


def score(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """``doc_id, held_out, score, predicted, n_hits`` per row."""

    def run(batches):
        machine = lexicon.automaton()
        for batch in batches:
            raw = [_raw(machine, lexicon.exceptions, t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"),
                 pa.array([lexicon.scores[_bin(r, lexicon.top)] for r, _ in raw], pa.float64()),
                 pa.array([n for _, n in raw], pa.int64())],
                names=["doc_id", "score", "n_hits"],
            )

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(
        run, "doc_id long, score double, n_hits long"
    )
    return scored.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
        "n_hits",
    )


def keep_clean(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """The rows of ``docs`` whose text is not predicted toxic, all columns kept."""
    names = docs.columns

    def run(batches):
        machine = lexicon.automaton()
        for batch in batches:
            keep = [
                lexicon.scores[_bin(_raw(machine, lexicon.exceptions, t)[0], lexicon.top)] < THRESHOLD
                for t in batch.column(names.index("text")).to_pylist()
            ]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
