"""Whole texts to token ids with the tokenizers library, each distinct word encoded once per worker.

The tokenizer normalises, drops white space and splits words by a pattern that does not look
across white space, so the ids of a text are the ids of its blank-separated pieces in order. A
worker keeps a bounded dictionary of pieces; new pieces go to the library. Pieces that are one word
of Latin letters with trailing punctuation, nearly all, are taken apart as columns; their words go to
the library's merge model directly after the lower-casing and byte mapping that its pipeline
would do; all others take the library's whole pipeline.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

#: Pieces, words and tails remembered per worker; beyond it the dictionary starts anew.
MOST_PIECES = 300_000
#: Fixed value: a word of Latin letters, and punctuation that makes one word of its own after it.
LATIN, TAIL = "^[A-Za-zÀ-ÖØ-öø-ÿ]+$", ".,;:!?&*%$#)"


def _strings(names: pa.Array) -> list[str]:
    return names.to_numpy(zero_copy_only=False).tolist()


def byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies: printable Latin-1 bytes
    stand for themselves, the others take the code points from 256 on, in order."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(others)}


class Ragged:
    """Growing rows of ids in one flat array."""

    def __init__(self) -> None:
        self.parts: list[np.ndarray] = []
        self.flat = np.zeros(0, np.uint32)
        self.starts = np.zeros(0, np.int64)
        self.sizes = np.zeros(0, np.int64)

    def extend(self, rows: list) -> None:
        sizes = np.fromiter(map(len, rows), np.int64, len(rows))
        self.add(sizes, np.fromiter(chain.from_iterable(rows), np.uint32, int(sizes.sum())))

    def add(self, sizes: np.ndarray, flat: np.ndarray) -> None:
        starts = len(self.flat) + np.cumsum(sizes) - sizes
        self.flat = np.concatenate([self.flat, flat])
        self.starts = np.concatenate([self.starts, starts])
        self.sizes = np.concatenate([self.sizes, sizes])

    def gather(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of ``rows`` one after another, and how many each row gave."""
        sizes = self.sizes[rows]
        ends = np.cumsum(sizes)
        at = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(self.starts[rows] - (ends - sizes), sizes)
        return self.flat[at], sizes


class WordEncoder:
    """Encodes batches of texts as ``tokenizer.encode(text, add_special_tokens=False)`` does."""

    def __init__(self, path: str) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        # Words are translated a line each.
        self.letters = str.maketrans({b: c for b, c in byte_letters().items() if b != 10})
        self._restart()

    def _restart(self) -> None:
        self.known: dict[str, int] = {}
        self.store = Ragged()

    def _added(self, sizes: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Put new rows into the store; their numbers."""
        start = len(self.store.sizes)
        self.store.add(sizes, ids)
        return np.arange(start, start + len(sizes))

    def _found(self, names: list[str]) -> np.ndarray:
        """Rows in the store, -1 where a name is not known."""
        return np.fromiter(map(self.known.get, names, repeat(-1)), np.int64, len(names))

    def _rows(self, names: list[str], ids_of: Callable[[list[str]], Iterable[list[int]]]) -> np.ndarray:
        """Rows of different names; those not known get theirs from ``ids_of``."""
        rows = self._found(names)
        places = np.flatnonzero(rows < 0)
        if len(places):
            new = [names[k] for k in places.tolist()]
            flat, sizes = [], []
            for ids in ids_of(new):
                flat += ids
                sizes.append(len(ids))
            rows[places] = self._added(np.array(sizes, np.int64), np.array(flat, np.uint32))
            self.known.update(zip(new, rows[places].tolist()))
        return rows

    def _whole(self, texts: list[str]) -> Iterable[list[int]]:
        return (e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False))

    def _merged(self, words: list[str]) -> Iterable[list[int]]:
        merge = self.tokenizer.model.tokenize
        letters = "\n".join(words).encode().decode("latin-1").translate(self.letters).split("\n")
        return ([t.id for t in merge(w)] for w in letters)

    def _learn(self, new: pa.Array) -> np.ndarray:
        """Rows of different pieces that are not known."""
        words = pc.utf8_rtrim(new, TAIL)
        plain = pc.match_substring_regex(words, LATIN).to_numpy(zero_copy_only=False)
        out = np.empty(len(new), np.int64)
        if not plain.all():
            out[~plain] = self._rows(_strings(new.filter(pa.array(~plain))), self._whole)
        new = new.filter(pa.array(plain))
        coded = pc.utf8_lower(words.filter(pa.array(plain))).dictionary_encode()
        rows = self._rows(_strings(coded.dictionary), self._merged)[coded.indices.to_numpy()]
        # Words with punctuation after them: the word's ids and the tail's.
        words = coded.dictionary.take(coded.indices)
        tailed = pc.not_equal(pc.binary_length(new), pc.binary_length(words)).to_numpy(zero_copy_only=False)
        if tailed.any():
            sizes = pc.utf8_length(words.filter(pa.array(tailed))).to_pylist()
            tails = pa.array(
                [n[k:] for n, k in zip(_strings(new.filter(pa.array(tailed))), sizes)], pa.large_string()
            ).dictionary_encode()
            ends = self._rows(_strings(tails.dictionary), self._whole)[tails.indices.to_numpy()]
            ids, sizes = self.store.gather(np.column_stack([rows[tailed], ends]).ravel())
            rows[tailed] = self._added(sizes.reshape(-1, 2).sum(1), ids)
        other = pc.not_equal(new, words).to_numpy(zero_copy_only=False)
        self.known.update(zip(_strings(new.filter(pa.array(other))), rows[other].tolist()))
        out[plain] = rows
        return out

    def _lowered(self, column: pa.Array) -> pa.Array:
        """ASCII capitals lowered ahead of the library, so that fewer pieces differ. Left alone
        where a combining mark could join a capital or a special token's spelling could arise."""
        buffer = column.buffers()[2]
        data = np.frombuffer(buffer, np.uint8) if buffer else np.zeros(0, np.uint8)
        if b"<|" in memoryview(data).tobytes() or ((data == 0xCC) | (data == 0xCD)).any():
            return column
        return pc.ascii_lower(column)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order, and the number of ids of each text."""
        if len(self.known) > MOST_PIECES:
            self._restart()
        column = self._lowered(pc.replace_substring(pa.array(texts, pa.large_string()), "\n", " "))
        split = pc.split_pattern(column, " ")
        coded = split.flatten().dictionary_encode()
        rows = self._found(_strings(coded.dictionary))
        places = np.flatnonzero(rows < 0)
        if len(places):
            rows[places] = self._learn(coded.dictionary.take(pa.array(places)))
        ids, sizes = self.store.gather(rows[coded.indices.to_numpy(zero_copy_only=False)])
        ends = np.concatenate([[0], np.cumsum(sizes)])
        bounds = np.concatenate([[0], np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False))])
        return ids, np.diff(ends[bounds])


@lru_cache(maxsize=1)
def word_encoder(path: str) -> WordEncoder:
    """The encoder of a worker, kept from task to task: loading a vocabulary anew each time costs more
    than what a small task encodes, and leaves memory behind."""
    return WordEncoder(path)


def in_slices(texts: list[str | None], most: int = 1_500_000):
    """Consecutive slices ``(from, to)`` of at most about ``most`` characters each."""
    start, size = 0, 0
    for k, text in enumerate(texts):
        size += len(text or "")
        if size >= most:
            yield start, k + 1
            start, size = k + 1, 0
    if start < len(texts):
        yield start, len(texts)
