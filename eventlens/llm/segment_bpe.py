"""Byte-level BPE by a segment tree over adjacent pair ranks, and its decoding.

The leaf of a token holds the rank of its pair with the next token, combined with its position, so
the root of the tree is the leftmost pair of lowest rank. A merge writes three leaves (the merged
token's pair, its left neighbour's pair, and the consumed token, which becomes empty) and the
nodes above them; it ends when the root is empty.

Distinct words are merged once per task, all words of a length class side by side: the trees of a
class are the rows of one array, and each round makes one merge in every row that has one. Long
words take the same steps one at a time in a tree of their own, with logarithmic cost per merge.

Defined cases: a null or empty text has no ids and decodes to the empty text. Special tokens in a
text become their ids. Rows that repeat an id are each coded. An empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventlens.llm.common import text_of
from eventlens.llm.encode import Ragged, byte_letters, in_slices

#: Fixed value: how byte-level tokenizers of this family split text into words.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Where a text must be split as a whole: white space after a blank, and the cutting mark itself.
CROSSING = regex.compile(r" (?=\s)| $|\x00")
NONE = np.int64(1) << 62
#: Words of at most this many pairs are merged side by side.
WIDEST = 64
MOST_WORDS = 300_000


class Ranks:
    """Pair to (rank, merged id), as a dict and as an open-addressed table for arrays."""

    def __init__(self, merges: list[tuple[int, int, int]]) -> None:
        self.of = {(a, b): (rank, c) for rank, (a, b, c) in enumerate(merges)}
        self.merged = np.array([c for _, _, c in merges] + [0], np.int64)
        self.bits = max(4, (4 * len(merges)).bit_length())
        size = 1 << self.bits
        self.keys = np.full(size, -1, np.int64)
        self.values = np.zeros(size, np.int64)
        for rank, (a, b, _) in enumerate(merges):
            at = int(self._slot(np.array([a << 32 | b]))[0])
            while self.keys[at] >= 0:
                at = (at + 1) & (size - 1)
            self.keys[at], self.values[at] = a << 32 | b, rank

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks, -1 where a pair has none."""
        wanted = left << 32 | right
        at = self._slot(wanted)
        got = self.keys[at]
        out = np.where(got == wanted, self.values[at], -1)
        open_ = np.flatnonzero((got != wanted) & (got >= 0))
        while len(open_):
            at[open_] = (at[open_] + 1) & (len(self.keys) - 1)
            got = self.keys[at[open_]]
            hit = got == wanted[open_]
            out[open_[hit]] = self.values[at[open_[hit]]]
            open_ = open_[~hit & (got >= 0)]
        return out


def merge_rows(tokens: np.ndarray, sizes: np.ndarray, ranks: Ranks) -> tuple[np.ndarray, np.ndarray]:
    """Merge many short words side by side. ``tokens`` has a word per row, ``sizes`` their lengths;
    returns the surviving ids of all rows in order and how many each row has."""
    rows, width = tokens.shape
    leaves = 1 << max(1, (width - 1).bit_length())
    slots = width + 2  # a slot before and after stand for no neighbour
    token = np.zeros((rows, slots), np.int64)
    token[:, 1:-1] = tokens
    after = np.tile(np.arange(1, slots + 1), (rows, 1)).ravel()
    before = np.tile(np.arange(-1, slots - 1), (rows, 1)).ravel()
    alive = np.zeros((rows, slots), bool)
    alive[:, 1:-1] = np.arange(width) < sizes[:, None]
    tree = np.full((rows, 2 * leaves), NONE, np.int64)
    rank = ranks.find(token[:, 1:-2].ravel(), token[:, 2:-1].ravel()).reshape(rows, width - 1)
    real = (rank >= 0) & alive[:, 2:-1]
    place = np.arange(width - 1)
    tree[:, leaves:leaves + width - 1] = np.where(real, rank * leaves + place, NONE)
    for node in range(leaves - 1, 0, -1):
        np.minimum(tree[:, 2 * node], tree[:, 2 * node + 1], out=tree[:, node])
    token, alive, tree = token.ravel(), alive.ravel(), tree.ravel()

    def put(row, leaf, value):
        """Write one leaf per row and the nodes above it."""
        node = row * (2 * leaves) + leaves + leaf
        tree[node] = value
        at = leaves + leaf
        while True:
            at = at >> 1
            if not at[0]:
                return
            node = row * (2 * leaves) + at
            below = row * (2 * leaves) + 2 * at
            tree[node] = np.minimum(tree[below], tree[below + 1])

    def value(row, left, right):
        """Leaf value of the pair in slots ``left`` and ``right``, none where either is missing."""
        base = row * slots
        found = ranks.find(token[base + left], token[base + right])
        good = (found >= 0) & alive[base + left] & alive[base + right]
        return np.where(good, found * leaves + (left - 1), NONE)

    active = np.arange(rows)
    while True:
        root = tree[active * (2 * leaves) + 1]
        going = root < NONE
        active, root = active[going], root[going]
        if not len(active):
            break
        base = active * slots
        left = root % leaves + 1
        right = after[base + left]
        beyond, prior = after[base + right], before[base + left]
        token[base + left] = ranks.merged[root // leaves]
        alive[base + right] = False
        after[base + left] = beyond
        before[base + np.minimum(beyond, slots - 1)] = left
        # Leaves of missing neighbours: the end slot's leaf and slot 0 are written back as none.
        put(active, np.minimum(right - 1, leaves - 1), np.full(len(active), NONE))
        put(active, left - 1, value(active, left, np.minimum(beyond, slots - 1)))
        there = np.flatnonzero(prior > 0)
        if len(there):
            put(active[there], prior[there] - 1, value(active[there], prior[there], left[there]))
    keep = alive.reshape(rows, slots)
    return token[alive], keep.sum(1)


def merge_long(tokens: list[int], ranks: Ranks) -> list[int]:
    """Merge one word of any length."""
    n, none = len(tokens), 1 << 62
    leaves = 1 << max(1, (n - 1).bit_length())
    tree = [none] * (2 * leaves)
    token, after, before = list(tokens), list(range(1, n + 1)), list(range(-1, n - 1))

    def value(i: int) -> int:
        j = after[i]
        found = ranks.of.get((token[i], token[j])) if j < n else None
        return none if found is None else found[0] * leaves + i

    def put(i: int, leaf: int) -> None:
        at = leaves + i
        tree[at] = leaf
        at >>= 1
        while at:
            a, b = tree[2 * at], tree[2 * at + 1]
            low = a if a < b else b
            if tree[at] == low:
                return
            tree[at] = low
            at >>= 1

    for i in range(n - 1):
        tree[leaves + i] = value(i)
    for at in range(leaves - 1, 0, -1):
        tree[at] = min(tree[2 * at], tree[2 * at + 1])
    while tree[1] < none:
        rank, i = divmod(tree[1], leaves)
        j = after[i]
        token[i] = int(ranks.merged[rank])
        token[j] = -1
        after[i] = after[j]
        if after[i] < n:
            before[after[i]] = i
        put(j, none)
        put(i, value(i))
        if before[i] >= 0:
            put(before[i], value(before[i]))
    return [t for t in token if t >= 0]


class ByteBpe:
    """Encoder and decoder for a byte-level BPE vocabulary file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            stored = json.load(file)
        vocabulary = stored["model"]["vocab"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in stored["model"]["merges"]]
        self.ranks = Ranks([(vocabulary[a], vocabulary[b], vocabulary[a + b]) for a, b in pairs])
        letters = byte_letters()
        self.first = np.array([vocabulary[letters[b]] for b in range(256)], np.int64)
        self.special = {t["content"]: t["id"] for t in stored["added_tokens"]}
        self.cut = regex.compile(
            "(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")"
        ) if self.special else None
        back = {c: b for b, c in letters.items()}
        spelled = {i: bytes(back[c] for c in word) for word, i in vocabulary.items()}
        spelled |= {i: s.encode() for s, i in self.special.items()}
        self.bytes = Ragged()
        self.bytes.extend([spelled.get(i, b"") for i in range(max(spelled) + 1)])
        self.words = regex.compile(WORDS)
        self._restart()

    def _restart(self) -> None:
        self.known: dict[str, int] = {}
        self.pieces: dict[str, list[int]] = {}
        self.store = Ragged()

    def _learn(self, words: list[str]) -> None:
        """Merge new words and remember their ids."""
        coded = [w.encode() for w in words]
        sizes = np.fromiter(map(len, coded), np.int64, len(coded))
        flat = self.first[np.frombuffer(b"".join(coded), np.uint8)]
        starts = np.cumsum(sizes) - sizes
        rows: list = [None] * len(words)
        low = 0
        for width in (1, 2, 4, 8, 12, 16, 24, 32, WIDEST):
            for mine in np.array_split(*self._chunks(np.flatnonzero((sizes > low) & (sizes <= width)), width)):
                if not len(mine):
                    continue
                at = starts[mine][:, None] + np.minimum(np.arange(width), sizes[mine][:, None] - 1)
                ids, counts = (flat[at][:, 0], np.ones(len(mine), np.int64)) if width == 1 else merge_rows(
                    flat[at], sizes[mine], self.ranks
                )
                for k, part in zip(mine.tolist(), np.split(ids, np.cumsum(counts)[:-1])):
                    rows[k] = part
            low = width
        for k in np.flatnonzero(sizes > WIDEST).tolist():
            rows[k] = merge_long(flat[starts[k]:starts[k] + sizes[k]].tolist(), self.ranks)
        self.store.extend(rows)

    @staticmethod
    def _chunks(index: np.ndarray, width: int) -> tuple[np.ndarray, int]:
        """Arguments of array_split: at most about a million slots at once."""
        return index, max(1, -(-len(index) * width // 1_000_000))

    def _number(self, words: list[str]) -> list[int]:
        known = self.known
        return [known.setdefault(w, len(known)) for w in words]

    def _words_of(self, text: str) -> list[str]:
        """Words of a text that has no special token."""
        return self.words.findall(text)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order, and the number of ids of each text."""
        if len(self.known) > MOST_WORDS:
            self._restart()
        before = len(self.known)
        # A blank that starts a word is a word boundary, so pieces from blank to blank are split
        # once per distinct piece. Texts where white space follows a blank are split as a whole.
        plain = [
            not CROSSING.search(t) and (self.cut is None or not self.cut.search(t)) for t in texts
        ]
        column = pa.array([t if p else "" for t, p in zip(texts, plain)], pa.large_string())
        split = pc.split_pattern(pc.replace_substring(column, " ", "\x00 "), "\x00")
        parted = split.flatten().dictionary_encode()
        by_piece = Ragged()
        names = parted.dictionary.to_pylist()
        by_piece.extend([self._number(self._words_of(p)) for p in names])
        # Words of the plain texts, as numbers.
        numbers, per_piece = by_piece.gather(parted.indices.to_numpy(zero_copy_only=False))
        ends = np.concatenate([[0], np.cumsum(per_piece)])
        bounds = np.concatenate([[0], np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False))])
        counts = np.diff(ends[bounds])
        special = {}
        if not all(plain):
            offsets = np.concatenate([[0], np.cumsum(counts)])
            parts, counts = [], counts.copy()
            for k, text in enumerate(texts):
                if plain[k]:
                    parts.append(numbers[offsets[k]:offsets[k + 1]])
                    continue
                row: list[int] = []
                for piece in self.cut.split(text) if self.cut else [text]:
                    if piece in self.special:
                        special[piece] = self.special[piece]
                        row += self._number([piece])
                    elif piece:
                        row += self._number(self._words_of(piece))
                parts.append(np.array(row, np.int64))
                counts[k] = len(row)
            numbers = np.concatenate(parts)
        if len(self.known) > before:
            self._learn(list(islice(self.known, before, None)))
        ids, sizes = self.store.gather(numbers.astype(np.int64))
        if special:
            ids, sizes = self._with_special(numbers, special, ids, sizes)
        ends = np.concatenate([[0], np.cumsum(sizes)])
        return ids, np.diff(ends[np.concatenate([[0], np.cumsum(counts)])])

    def _with_special(self, numbers, special, ids, sizes):
        """Special tokens got a word's number; give them their own single id."""
        ends = np.cumsum(sizes)
        rows = np.split(ids, ends[:-1])
        of = {self.known[s]: i for s, i in special.items()}
        rows = [np.array([of[n]], np.uint32) if n in of else r for n, r in zip(numbers.tolist(), rows)]
        return np.concatenate(rows), np.array([len(r) for r in rows])

    def decode(self, ids: np.ndarray, sizes: np.ndarray) -> list[bytes]:
        """The bytes of each run of ids."""
        flat, per_id = self.bytes.gather(ids.astype(np.int64))
        ends = np.concatenate([[0], np.cumsum(per_id)])
        bounds = ends[np.concatenate([[0], np.cumsum(sizes)])].tolist()
        data = flat.astype(np.uint8).tobytes()
        return [data[a:b] for a, b in zip(bounds, bounds[1:])]


def coded(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Encode and decode whole texts: ``doc_id, n_tokens, ids_sha256, decoded_sha256``."""

    def run(batches):
        coder = ByteBpe(vocabulary)
        for batch in batches:
            docs, texts = batch.column("doc_id"), batch.column("text").to_pylist()
            for a, b in in_slices(texts):
                ids, sizes = coder.encode(texts[a:b])
                decoded = coder.decode(ids, sizes)
                ends = np.cumsum(sizes).tolist()
                flat = memoryview(ids.astype("<u4").tobytes())
                digests = [hashlib.sha256(flat[4 * (e - n):4 * e]).hexdigest() for e, n in zip(ends, sizes.tolist())]
                texts_back = [
                    hashlib.sha256(d.decode("utf-8", "replace").encode()).hexdigest() for d in decoded
                ]
                yield pa.RecordBatch.from_arrays(
                    [docs[a:b], pa.array(sizes, pa.int64()), pa.array(digests), pa.array(texts_back)],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return text.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
