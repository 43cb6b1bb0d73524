"""Multisets of five-word shingles as 64-bit hashes, for many texts at once.

Words are runs without ASCII white space, ASCII letters in lower case. A text of fewer than five words
has one shingle, all its words; one without words has none.
"""

from __future__ import annotations

import numpy as np

WORDS = 5
_BASE = np.uint64(0x100000001B3)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F],
                np.uint64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers: dict[int, np.ndarray] = {}


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: np.uint64, size: int) -> np.ndarray:
    """Powers of ``base`` modulo 2^64, at least ``size`` of them."""
    have = _powers.get(int(base))
    if have is None or len(have) < size:
        steps = np.full(max(size, 1 << 16), base, np.uint64)
        steps[0] = 1
        have = _powers[int(base)] = np.cumprod(steps)
    return have


def _word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and how many each text has."""
    data = _LOWER[np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)]
    space = _SPACE[data]
    before = np.concatenate([[True], space[:-1]])
    starts = np.flatnonzero(~space & before)
    ends = np.flatnonzero(space & ~before)
    prefix = np.concatenate([
        np.zeros(1, np.uint64),
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(_BASE, len(data))[:len(data)]),
    ])
    hashes = (prefix[ends] - prefix[starts]) * powers(_INVERSE, len(data) + 1)[starts]
    bounds = np.cumsum([len(t) + 1 for t in texts])
    return mixed(hashes), np.diff(np.concatenate([[0], np.searchsorted(starts, bounds)]))


def multisets(texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per text its distinct shingle hashes, sorted, and how often each occurs."""
    words, counts = _word_hashes([(t or "").encode() for t in texts])
    out, at = [], 0
    if len(words) >= WORDS:
        rolled = mixed(sum(words[t:len(words) - WORDS + 1 + t] * _ODD[t] for t in range(WORDS)))
    else:
        rolled = np.zeros(0, np.uint64)
    for n in counts.tolist():
        if n >= WORDS:
            own = rolled[at:at + n - WORDS + 1]
        elif n:
            own = mixed((words[at:at + n] * _ODD[:n]).sum(keepdims=True))
        else:
            own = words[:0]
        out.append(np.unique(own, return_counts=True))
        at += n
    return out


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity; two empty multisets are equal."""
    if len(a[0]) > len(b[0]):
        a, b = b, a
    total = int(a[1].sum() + b[1].sum())
    if not total:
        return 1.0
    if not len(a[0]):
        return 0.0
    at = np.minimum(np.searchsorted(b[0], a[0]), len(b[0]) - 1)
    both = int(np.minimum(a[1], b[1][at])[b[0][at] == a[0]].sum())
    return both / (total - both)
