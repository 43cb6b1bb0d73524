"""Alignment of two tokenizers' tokens by merge-path partitioning, and corpus-wide link counts.

Both tokenizers cut the same bytes, so texts are two ascending lists of end offsets, here those of a
task's slice of documents end to end. Merging them takes ``|A| + |B|`` steps; diagonals of the merge
grid, ``STEP`` apart, are searched by bisection, all at once, and divide the merging into pieces of
equal work that do not depend on each other, whatever the lengths of documents. The pieces advance
side by side, a step of every piece per array operation: a piece emits the overlap of its current A
and B token, then passes the one that ends first. Where both end together a group ends; pieces
count their group ends, and running sums over the pieces stitch groups that cross from piece to
piece.

Counts: a slice gives its id pairs, each once with its number of links, and each document the pairs
of its links, as places in the slice's list. Pairs are counted over the corpus by an aggregation
that combines before the shuffle, the highest count of each B id is a table of at most the
vocabulary's size, and counts go back to slices: one row per pair and slice, never per link.

Defined cases: null and empty texts, and texts whose joined token bytes differ from a space and the
text (such as those holding U+2581), have no tokens. Special tokens' strings are plain text. Rows
that repeat an id are each told and each count. An empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from eventlens.llm.common import text_of
from eventlens.llm.encode import byte_letters
from eventlens.llm.segment_bpe import WORDS
from eventlens.session import cut, spread

#: Steps of one piece of a merge.
STEP = 256
#: Characters of a slice. A longer document is a slice by itself.
SLICE = 2_000_000
#: Input up to this size, which may be one row group, is dealt out to all cores.
DEALT = 32 << 20
#: Bits of the B id in a pair of ids.
SHIFT = 32
#: Runs of blanks that the pattern of the fast encoder cannot take.
LONG_BLANK = re.compile(r"\s{2000}")


def merge_path(a_ends: np.ndarray, b_ends: np.ndarray, step: int = STEP) -> tuple[np.ndarray, np.ndarray]:
    """Where the merge path of two ascending lists crosses the diagonals ``0, step, 2 step, ..``: how
    many of A and of B come before it. Of equal ends the one of A comes first."""
    n, m = len(a_ends), len(b_ends)
    diagonal = np.append(np.arange(0, n + m, step), n + m)
    low, high = np.maximum(diagonal - m, 0), np.minimum(diagonal, n)
    while (open_ := low < high).any():
        middle = (low + high) >> 1
        # A's ``middle`` comes before B's ``diagonal - middle - 1``: the crossing is further on.
        a, b = a_ends[np.minimum(middle, n - 1)], b_ends[np.clip(diagonal - middle - 1, 0, m - 1)]
        further = open_ & (a <= b)
        low = np.where(further, middle + 1, low)
        high = np.where(open_ & ~further, middle, high)
    return low, diagonal - low


def overlaps(
    a_ends: np.ndarray, b_ends: np.ndarray, step: int = STEP
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(a, b)`` of all overlapping tokens in order, and the group of each A and of each B token."""
    n, m = len(a_ends), len(b_ends)
    if not n or not m:
        return *np.zeros((2, 0), np.int64), np.zeros(n, np.int64), np.zeros(m, np.int64)
    i, j = merge_path(a_ends, b_ends, step)
    i_to, j_to = i[1:], j[1:]
    i, j = i[:-1].copy(), j[:-1].copy()
    pieces = len(i)
    padded_a, padded_b = np.append(a_ends, np.int64(1) << 62), np.append(b_ends, np.int64(1) << 62)
    begin_a, begin_b = np.concatenate([[0], a_ends]), np.concatenate([[0], b_ends])
    links_a, links_b = np.full((2, step, pieces), -1, np.int32)
    group_a, group_b = np.zeros(n, np.int64), np.zeros(m, np.int64)
    of_a, of_b = np.zeros(n, np.int64), np.zeros(m, np.int64)
    groups = np.zeros(pieces, np.int64)
    every = np.arange(pieces)
    for k in range(step):
        live = (i < i_to) | (j < j_to)
        if not live.all():
            every = every[live]
            i, j, i_to, j_to = i[live], j[live], i_to[live], j_to[live]
        if not len(every):
            break
        a, b = padded_a[i], padded_b[j]
        over = (begin_a[i] < b) & (begin_b[j] < a)
        links_a[k, every] = np.where(over, i, -1)
        links_b[k, every] = np.where(over, j, -1)
        first = a <= b
        took_a, took_b = i[first], j[~first]
        group_a[took_a], of_a[took_a] = groups[every[first]], every[first]
        group_b[took_b], of_b[took_b] = groups[every[~first]], every[~first]
        # Of equal ends A's is passed first, so a group ends when B passes an end that A has passed.
        groups[every] += ~first & (b == begin_a[i])
        i, j = i + first, j + ~first
    before = np.cumsum(groups) - groups
    flat_a, flat_b = links_a.T.ravel(), links_b.T.ravel()
    real = flat_a >= 0
    return flat_a[real], flat_b[real], group_a + before[of_a], group_b + before[of_b]


class TokenizerA:
    """Byte-level BPE from a file of the tokenizers library. Where ids follow the order of merges, as
    in vocabularies of this family, the rank encoder gives the same ids several times faster."""

    def __init__(self, path: str) -> None:
        self.slow = Tokenizer.from_file(path)
        self.slow.no_truncation()
        self.slow.no_padding()
        self.slow.encode_special_tokens = True
        byte_of = {c: bytes([k]) for k, c in byte_letters().items()}
        vocab = self.slow.get_vocab()
        self.bytes = [b""] * (max(vocab.values()) + 1)
        for token, k in vocab.items():
            self.bytes[k] = b"".join(byte_of.get(c, c.encode()) for c in token)
        with open(path, encoding="utf-8") as file:
            merges = json.load(file)["model"]["merges"]
        joined = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in merges]
        self.fast = None
        if all(vocab.get(t) == 256 + k for k, t in enumerate(joined)):
            ranks = {self.bytes[k]: k for k in range(256 + len(joined))}
            self.fast = tiktoken.Encoding("ranks", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> np.ndarray:
        if self.fast is None or LONG_BLANK.search(text):
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.int64)
        return np.array(self.fast.encode_ordinary(text), np.int64)


class TokenizerB:
    """Pieces from a file of the sentencepiece library."""

    def __init__(self, path: str) -> None:
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(k) for k in range(self.model.get_piece_size())]
        self.bytes = [
            bytes([int(p[3:5], 16)]) if self.model.is_byte(k) else p.replace("▁", " ").encode()
            for k, p in enumerate(pieces)
        ]

    def encode(self, text: str) -> np.ndarray:
        return np.array(self.model.encode(text), np.int64)


class Aligner:
    """Tokenizes and aligns slices of texts by both tokenizers."""

    def __init__(self, a_path: str, b_path: str, step: int = STEP) -> None:
        self.step = step
        self.a, self.b = TokenizerA(a_path), TokenizerB(b_path)
        self.a_size, self.b_size = (np.array([len(x) for x in t.bytes], np.int64) for t in (self.a, self.b))
        self.a_bytes, self.b_bytes = (pa.array(t.bytes, pa.large_binary()) for t in (self.a, self.b))
        # Each id written out with what may follow it: within its group, and at its side's end.
        n = len(self.a_size)
        self.written = pa.array(
            [f"{k}{mark}" for mark in ",|" for k in range(n)]
            + [f"{k}{mark}" for mark in ",;" for k in range(len(self.b_size))],
            pa.large_string(),
        )

    def _same(self, ids: list[np.ndarray], pieces: pa.Array, texts: list[bytes]) -> list[bool]:
        """Whether the bytes of each text's tokens are the text."""
        got = pieces.take(pa.array(np.concatenate(ids)))
        ends = np.frombuffer(got.buffers()[1], np.int64, len(got) + 1, got.offset * 8)
        data = memoryview(got.buffers()[2] or b"")
        bounds = ends[np.concatenate([[0], np.cumsum([len(x) for x in ids])])].tolist()
        return [data[x:y].tobytes() == t for x, y, t in zip(bounds, bounds[1:], texts)]

    def align(self, texts: list[str]) -> tuple[list[tuple[int, int, int, int, str]], np.ndarray, np.ndarray]:
        """For each text the numbers of A tokens, B tokens, groups and links and the groups' digest, and
        the links' id pairs with the text of each."""
        spaced = [" " + t for t in texts]
        a_ids, b_ids = [self.a.encode(t) for t in spaced], [self.b.encode(t) for t in texts]
        raw = [t.encode() for t in spaced]
        same_a, same_b = self._same(a_ids, self.a_bytes, raw), self._same(b_ids, self.b_bytes, raw)
        for k, text in enumerate(texts):
            if not (text and same_a[k] and same_b[k]):
                a_ids[k] = b_ids[k] = np.zeros(0, np.int64)
        a, b = np.concatenate(a_ids), np.concatenate(b_ids)
        a_to, b_to = (np.concatenate([[0], np.cumsum([len(x) for x in ids])]) for ids in (a_ids, b_ids))
        at_a, at_b, group_a, group_b = overlaps(np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b]), self.step)
        link_to = np.searchsorted(at_a, a_to)
        # The groups written out, A ids before B ids in each.
        last_a, last_b = (np.append(g[1:] != g[:-1], np.ones(len(g[:1]), bool)) for g in (group_a, group_b))
        order = np.empty(len(a) + len(b), np.int64)
        width = len(self.a_size)
        order[np.arange(len(a)) + np.searchsorted(group_b, group_a, "left")] = a + last_a * width
        order[np.arange(len(b)) + np.searchsorted(group_a, group_b, "right")] = (
            2 * width + b + last_b * len(self.b_size)
        )
        line = self.written.take(pa.array(order))
        ends = np.frombuffer(line.buffers()[1], np.int64, len(line) + 1, line.offset * 8)
        data = memoryview(line.buffers()[2] or b"")
        bounds = ends[a_to + b_to].tolist()
        told = []
        for k in range(len(texts)):
            x, y = a_to[k], a_to[k + 1]
            if x == y:
                told.append((0, 0, 0, 0, ""))
                continue
            digest = hashlib.sha256(data[bounds[k]:bounds[k + 1] - 1]).hexdigest()
            told.append((
                int(y - x), int(b_to[k + 1] - b_to[k]), int(group_a[y - 1] - group_a[x]) + 1,
                int(link_to[k + 1] - link_to[k]), digest,
            ))
        return told, a[at_a] << SHIFT | b[at_b], np.repeat(np.arange(len(texts)), np.diff(link_to))


def packed(places: np.ndarray) -> bytes:
    """Ascending places as the gaps between them, a byte each; 255 adds to the gap that follows."""
    gap = np.diff(places, prepend=0)
    jumps = gap // 255
    out = np.full(len(places) + int(jumps.sum()), 255, np.uint8)
    out[np.arange(len(places)) + np.cumsum(jumps)] = gap % 255
    return out.tobytes()


def unpacked(data: bytes) -> np.ndarray:
    gaps = np.frombuffer(data, np.uint8)
    return np.cumsum(gaps, dtype=np.int64)[gaps != 255]


#: Documents with their links as packed places, and for each slice one row of its pairs.
TOLD = pa.schema([
    ("slice", pa.string()), ("doc_id", pa.int64()),
    *[(c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")], ("groups_sha256", pa.string()),
    ("links", pa.binary()), ("pairs", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64())),
])
TOLD_TYPES = (
    "slice string, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
    "links binary, pairs array<long>, counts array<long>"
)


def _rows(n: int, columns: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in TOLD], schema=TOLD
    )


def _slices(a_path: str, b_path: str, step: int):
    def run(batches):
        aligner = Aligner(a_path, b_path, step)
        ids: list[int | None] = []
        texts: list[str] = []

        def told():
            name = uuid.uuid4().hex
            rows, pairs, owner = aligner.align(texts)
            coded = pa.array(pairs).dictionary_encode()
            # The commonest pairs come first: gaps between a document's places are small.
            place = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            n = len(coded.dictionary)
            counts = np.bincount(place, minlength=n)
            by = np.argsort(-counts, kind="stable")
            rank = np.empty(n, np.int64)
            rank[by] = np.arange(n)
            key = np.sort(owner * max(n, 1) + rank[place])
            bounds = np.searchsorted(key, np.arange(len(texts) + 1) * max(n, 1))
            links = [packed(key[x:y] - k * n) for k, (x, y) in enumerate(zip(bounds, bounds[1:]))]
            numbers = dict(zip(("n_a", "n_b", "n_groups", "n_links", "groups_sha256"), zip(*rows)))
            yield _rows(len(ids), {"slice": [name] * len(ids), "doc_id": ids, "links": links, **numbers})
            own = coded.dictionary.to_numpy(zero_copy_only=False)[by]
            yield _rows(1, {"slice": [name], "pairs": [own], "counts": [counts[by]]})
            ids.clear()
            texts.clear()

        size = 0
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                text = text.as_py()
                if size and size + len(text) > SLICE:
                    yield from told()
                    size = 0
                ids.append(doc_id)
                texts.append(text)
                size += len(text)
        if ids:
            yield from told()

    return run


def _scored(docs: pa.Table, known: pa.Table) -> pa.Table:
    """Add to a slice's documents their links' counts, and how many are their B id's best."""
    place = known.column("place").to_numpy()
    count, best = np.zeros((2, len(place)), np.int64)
    count[place], best[place] = known.column("count").to_numpy(), known.column("best").to_numpy()
    links = [unpacked(x) for x in docs.column("links").to_pylist()]
    out = docs.drop_columns(["part", "links"])
    for name, of in (("n_best", best), ("count_sum", count)):
        out = out.append_column(name, pa.array([int(of[x].sum()) for x in links], pa.int64()))
    return out


def aligned(
    docs: DataFrame, a_path: str, b_path: str, id_column: str = "doc_id", text_column: str = "text", step: int = STEP
) -> DataFrame:
    """One row per input row: ``doc_id, n_a, n_b, n_groups, n_links, groups_sha256, n_best, count_sum``."""
    text = docs.select(F.col(id_column).cast("long").alias("doc_id"), text_of(text_column).alias("text"))
    told = cut(spread(text, DEALT).mapInArrow(_slices(a_path, b_path, step), TOLD_TYPES))
    pairs = cut(
        told.where("pairs IS NOT NULL")
        .select("slice", F.posexplode(F.arrays_zip("pairs", "counts")).alias("place", "x"))
        .select("slice", "place", F.col("x.pairs").alias("pair"), F.col("x.counts").alias("n"))
    )
    counted = cut(pairs.groupBy("pair").agg(F.sum("n").alias("count")))
    b_id = F.col("pair").bitwiseAND((1 << SHIFT) - 1)
    # At most as many rows as B has ids: a bound that does not grow with the data.
    highest = counted.groupBy(b_id.alias("b")).agg(F.max("count").alias("most"))
    judged = counted.join(F.broadcast(highest), b_id == F.col("b")).select(
        "pair", "count", (F.col("count") == F.col("most")).cast("long").alias("best")
    )
    placed = pairs.join(judged, "pair").select("slice", "place", "count", "best")
    fixed = ["n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    rows = told.where("pairs IS NULL").select(F.col("slice").alias("part"), "doc_id", *fixed, "links")
    numbers = ", ".join(f"{c} long" for c in fixed[:4])
    return rows.groupBy("part").cogroup(placed.groupBy("slice")).applyInArrow(
        _scored, f"doc_id long, {numbers}, groups_sha256 string, n_best long, count_sum long"
    )
