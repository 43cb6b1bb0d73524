"""64-bit SimHash over word trigrams."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventlens.config import DEFAULTS
from eventlens.functions import text as tx

#: Hashes whose bits are spread out at a time.
VOTE_ROWS = 1 << 16


def hamming(left, right) -> Column:
    left = F.col(left) if isinstance(left, str) else left
    right = F.col(right) if isinstance(right, str) else right
    return F.bit_count(left.bitwiseXOR(right))


def to_hex(fingerprint) -> Column:
    """Sixteen hex digits."""
    fingerprint = F.col(fingerprint) if isinstance(fingerprint, str) else fingerprint
    return F.when(fingerprint.isNotNull(), F.lpad(F.lower(F.hex(fingerprint)), 16, "0"))


def from_hex(text) -> Column:
    return F.conv(text, 16, -10).cast("bigint")


def feature_hash(feature: Column, name: str) -> Column:
    """64-bit hash of one trigram: ``xxhash64``, or ``md5`` for results other engines can check."""
    if name == "xxhash64":
        return F.xxhash64(feature)
    if name == "md5":
        return F.conv(F.substring(F.md5(feature), 1, 16), 16, -10).cast("bigint")
    raise ValueError(f"unknown hash: {name}")


def _trigram_hashes(words: str, hash_name: str) -> Column:
    w = F.col(words)
    return F.transform(
        F.slice(w, 1, F.greatest(F.size(w) - 2, F.lit(0))),
        lambda word, i: feature_hash(F.concat_ws(" ", word, F.get(w, i + 1), F.get(w, i + 2)), hash_name),
    )


def with_fingerprint(
    df: DataFrame,
    text,
    min_words: int = DEFAULTS.simhash_min_words,
    hash_name: str = DEFAULTS.simhash_hash,
) -> DataFrame:
    """``df`` with ``fingerprint``, null for texts of fewer than ``min_words`` words.

    Trigrams are hashed by an expression; the votes of a row are counted in Arrow batches where the
    row is. Nothing is exploded or shuffled. ``hash_name='blake2b'`` hashes in the batches as well.
    """
    rows = df.withColumn("_words", tx.words(text))
    enough = F.size("_words") >= min_words
    if hash_name == "blake2b":
        print_ = blake2b_simhash(F.when(enough, F.col("_words")))
    else:
        print_ = majority(F.when(enough, _trigram_hashes("_words", hash_name)))
    return rows.withColumn("fingerprint", print_).drop("_words")


def fingerprints(
    df: DataFrame,
    key: str,
    text: str,
    min_words: int = DEFAULTS.simhash_min_words,
    hash_name: str = DEFAULTS.simhash_hash,
) -> DataFrame:
    """``(key, fingerprint)`` for rows whose text has at least ``min_words`` words."""
    rows = with_fingerprint(df.select(*{key: 0, text: 0}), text, min_words, hash_name).select(key, "fingerprint")
    return rows.where(F.col("fingerprint").isNotNull())


def _votes(raw: np.ndarray) -> np.ndarray:
    """How many of the words, given as rows of eight bytes, have each of the 64 bits."""
    total = np.zeros(64, np.int64)
    for at in range(0, len(raw), VOTE_ROWS):  # 64 bytes a word, whatever the length of the text
        total += np.unpackbits(raw[at : at + VOTE_ROWS], axis=1).sum(axis=0, dtype=np.int64)
    return total


def _winner(raw: np.ndarray) -> int:
    """Bits that more than half of the big-endian words have."""
    won = (2 * _votes(raw) > len(raw)).astype(np.uint8)
    return int.from_bytes(np.packbits(won).tobytes(), "big", signed=True)


@F.pandas_udf(T.LongType())
def majority(hashes: pd.Series) -> pd.Series:
    """Per row the bits that more than half of its 64-bit hashes have; null stays null."""
    out = [None if h is None else _winner(h.astype(">i8").view(np.uint8).reshape(-1, 8)) for h in hashes]
    return pd.Series(out, dtype="Int64")


@F.pandas_udf(T.LongType())
def blake2b_simhash(words: pd.Series) -> pd.Series:
    """Fingerprints with BLAKE2b trigram hashes, for compatibility with stored values."""
    out = []
    for tokens in words:
        if tokens is None:
            out.append(None)
            continue
        grams = (" ".join(tokens[i : i + 3]) for i in range(len(tokens) - 2))
        raw = b"".join(hashlib.blake2b(g.encode(), digest_size=8).digest() for g in grams)
        out.append(_winner(np.frombuffer(raw, np.uint8).reshape(-1, 8)))
    return pd.Series(out, dtype="Int64")


# Both are repeatable; marked otherwise, a filter on their result does not run them a second time.
majority, blake2b_simhash = majority.asNondeterministic(), blake2b_simhash.asNondeterministic()
