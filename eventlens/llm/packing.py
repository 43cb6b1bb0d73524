"""Vector bin packing of documents into training sequences by the dot-product heuristic.

A sequence holds at most ``tokens`` tokens, ``segments`` pieces and ``loss`` loss-bearing tokens at
once. Documents longer than a sequence are cut at multiples of its length; what remains of them, and
every shorter document, is packed whole. Into an open sequence goes, of all pieces that fit in
every dimension, the one whose demand vector has the largest dot product with what the sequence
has left, both as shares of the limits and demands weighed by their total in the group, so that
the dimension in shortest supply counts most. A sequence closes when nothing fits.

Pieces are narrow rows (ids, lengths, checksums); texts are encoded where they are read and never
shuffled. Pieces are dealt by a hash into groups of about ``GROUP`` pieces, whose number follows
the input, and each group is packed in a task: one sequence per group may stay half empty.
Inside a group, equal (tokens, loss) demands are one class, so a step looks at classes, not pieces.

Defined cases: a null or empty text is the end id alone. A piece whose loss exceeds the limit by
itself is cut shorter where documents are encoded. Rows that repeat an id are packed each; null
ids are kept. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventlens.llm.common import text_of
from eventlens.llm.encode import in_slices, word_encoder
from eventlens.session import cut

TOKENS, SEGMENTS, LOSS = 4_096, 512, 4_096
#: About how many pieces are packed by a task.
GROUP = 20_000
#: Characters encoded at a time.
SLICE = 500_000
PIECES = "doc_id long, row long, start long, length long, loss long, ids_crc32 long, doc_tokens long"


def _pieces(tokenizer: str, end_id: int, tokens: int, loss: int):
    """Encode and cut; all tokens but a document's first bear loss."""
    most = min(tokens, loss)

    def run(batches):
        encoder = word_encoder(tokenizer)
        for batch in batches:
            docs, rows, texts = (batch.column(c).to_pylist() for c in ("doc_id", "row", "text"))
            for a, b in in_slices(texts, SLICE):
                ids, sizes = encoder.encode(texts[a:b])
                ids = np.insert(ids, np.cumsum(sizes), end_id)
                sizes = sizes + 1
                ends = np.cumsum(sizes)
                flat = memoryview(ids.astype("<u4").tobytes())
                out = []
                for doc, row, n, end in zip(docs[a:b], rows[a:b], sizes.tolist(), ends.tolist()):
                    for start in range(0, n, most):
                        length = min(most, n - start)
                        at = 4 * (end - n + start)
                        crc = zlib.crc32(flat[at:at + 4 * length])
                        out.append((doc, row, start, length, length - (start == 0), crc, n))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.int64()) for c in zip(*out)],
                    names=["doc_id", "row", "start", "length", "loss", "ids_crc32", "doc_tokens"],
                )

    return run


def pack_group(length: np.ndarray, loss: np.ndarray, limits: tuple[int, int, int]) -> tuple[np.ndarray, np.ndarray]:
    """``(sequence, offset)`` of each piece by the dot-product heuristic."""
    cap = np.array(limits, np.float64)
    kinds, of = np.unique(np.stack([length, loss], 1), axis=0, return_inverse=True)
    of = of.ravel()
    demand = np.column_stack([kinds[:, 0], np.ones(len(kinds)), kinds[:, 1]]).astype(np.float64)
    left = np.bincount(of, minlength=len(kinds))
    order = np.argsort(of, kind="stable")
    next_of = np.concatenate([[0], np.cumsum(left)[:-1]])
    share = demand / cap
    weight = (share * left[:, None]).sum(0)
    share *= weight / weight.max()
    sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
    number, remaining, used = 0, cap.copy(), 0
    alive = np.arange(len(kinds))  # classes with pieces left
    for _ in range(len(length)):
        fits = alive[(demand[alive] <= remaining).all(1)]
        if not len(fits):
            number, remaining, used = number + 1, cap.copy(), 0
            fits = alive
        k = int(fits[np.argmax(share[fits] @ (remaining / cap))])
        piece = order[next_of[k]]
        next_of[k] += 1
        left[k] -= 1
        sequence[piece], offset[piece] = number, used
        used += int(demand[k, 0])
        remaining = remaining - demand[k]
        if not left[k]:
            alive = alive[alive != k]
    return sequence, offset


def pack_pieces(pieces: DataFrame, limits: tuple[int, int, int] = (TOKENS, SEGMENTS, LOSS)) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to piece rows with ``length`` and ``loss``; every piece must
    fit a sequence by itself."""
    groups = max(1, -(-pieces.count() // GROUP))
    dealt = pieces.withColumn("_group", F.pmod(F.xxhash64("doc_id", "row", "start"), F.lit(groups)))
    names = pieces.columns

    def run(key, table):
        table = table.combine_chunks().sort_by([(c, "ascending") for c in names])
        sequence, offset = pack_group(table.column("length").to_numpy(), table.column("loss").to_numpy(), limits)
        group = key[0].as_py() << 32
        return table.select(names).append_column("sequence_id", pa.array(sequence + group)).append_column(
            "offset", pa.array(offset)
        )

    schema = ", ".join(f"{n} {t}" for n, t in pieces.dtypes) + ", sequence_id long, offset long"
    return dealt.groupBy("_group").applyInArrow(run, schema)


def pack_documents(
    docs: DataFrame,
    tokenizer: str,
    end_id: int,
    limits: tuple[int, int, int] = (TOKENS, SEGMENTS, LOSS),
    stored: Callable[[DataFrame], DataFrame] = cut,
) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``."""
    text = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.xxhash64("doc_id", text_of()).alias("row"),
        text_of().alias("text"),
    )
    pieces = stored(text.mapInArrow(_pieces(tokenizer, end_id, limits[0], limits[2]), PIECES))
    return pack_pieces(pieces, limits).drop("row", "loss")
