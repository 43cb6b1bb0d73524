"""Token ids in Simple-8b blocks: written in document order, read back by block.

A 64-bit word holds a 4-bit selector and as many ids as fit at one width; ids too wide for any
selector are escapes. A document's words start at a word boundary, so documents decode alone.

A block is self-contained bytes: magic, counts, then per document id, number of ids and first
word, then the escapes, then the words. Escapes are stored apart from the words and a word with the
escape selector holds an index to them, so that every word can be decoded without the one before
it: all words of a block at once, one array operation per selector. Blocks are rows of a Parquet
table, which gives atomic commits and works on every store Spark writes to; a row also says the
block's shard, its place and the ids before it in the shard.

Order comes from a range shuffle over (doc_id, hash of text) and a sort inside its partitions, so
an id that many rows share spreads over tasks. Shard totals, one number per partition, are the
only thing the driver sees; blocks know their place inside the shard, so reading back shuffles
nothing.

Defined cases: a null text is empty and has the end id alone. Null ids come first. Rows that
repeat an id follow each other. An empty table gives an empty file set. Other columns are ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventlens.llm.common import text_of
from eventlens.llm.encode import in_slices, word_encoder
from eventlens.session import checkpoint_root

#: Selector k packs COUNTS[k] ids of WIDTHS[k] bits; selector 15 marks an escape.
COUNTS = np.array([60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
WIDTHS = np.array([1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
ESCAPE = 15
LIMITS = (np.uint64(1) << WIDTHS.astype(np.uint64)) - np.uint64(1)
MAGIC = b"S8B1"
#: About how many words a block holds.
BLOCK_WORDS = 1 << 17
#: Characters encoded at a time.
SLICE = 750_000
#: Ids that each selector covers.
STEPS = np.concatenate([COUNTS, [1, 1]]).astype(np.uint8)
SMALL = np.searchsorted(LIMITS, np.arange(1 << 16, dtype=np.uint64), "left").astype(np.int8)
BLOCKS = "shard long, block long, before long, ids long, data binary"


def pack(ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(words, first word of each document, escapes)`` for consecutive documents."""
    ids = ids.astype(np.uint64)
    ends = np.cumsum(sizes)
    if len(ids) and int(ids.max()) < 1 << 16:
        need = SMALL[ids]
    else:
        need = np.searchsorted(LIMITS, ids, "left").astype(np.int8)
    # A stop after each document keeps windows from crossing it.
    stops = ends + np.arange(len(sizes))
    values = np.zeros(len(ids) + len(sizes), np.uint64)
    wanted = np.full(len(values), 99, np.int8)
    place = np.ones(len(values), bool)
    place[stops] = False
    values[place], wanted[place] = ids, need
    choice = np.where(wanted == len(COUNTS), ESCAPE, len(COUNTS) - 1).astype(np.int8)
    # The widest id of each window of COUNTS[k] ids, from two windows that together cover it.
    widest = {1: wanted}
    for k in range(len(COUNTS) - 2, -1, -1):
        count = int(COUNTS[k])
        if count > len(values):
            break
        part = max(c for c in widest if c < count)
        inner = widest[part]
        widest[count] = np.maximum(inner[:len(values) - count + 1], inner[count - part:])
        np.copyto(choice[:len(values) - count + 1], k, where=widest[count] <= k)
    step = STEPS[choice].tobytes()
    heads, at, total = [], 0, len(step)
    while at < total:
        heads.append(at)
        at += step[at]
    heads = np.array(heads, np.int64)
    real = place[heads]
    # Words before each stop, less the stops among them.
    first_stop = np.flatnonzero(~real)
    word_ends = first_stop - np.arange(len(first_stop))
    firsts = np.concatenate([[0], word_ends[:-1]]) if len(sizes) else np.zeros(0, np.int64)
    heads = heads[real]
    chosen = choice[heads].astype(np.int64)
    words = chosen.astype(np.uint64) << np.uint64(60)
    for k in range(len(COUNTS)):
        mine = np.flatnonzero(chosen == k)
        if len(mine):
            for t in range(int(COUNTS[k])):
                words[mine] |= values[heads[mine] + t] << np.uint64(int(WIDTHS[k]) * t)
    out = np.flatnonzero(chosen == ESCAPE)
    words[out] |= np.arange(len(out), dtype=np.uint64)
    return words, firsts, values[heads[out]]


def unpack(words: np.ndarray, escapes: np.ndarray) -> np.ndarray:
    """All ids of the words, in order."""
    selector = (words >> np.uint64(60)).astype(np.int64)
    per_word = np.concatenate([COUNTS, [0, 1]])[selector]
    ends = np.cumsum(per_word)
    starts = ends - per_word
    ids = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint64)
    for k in range(len(COUNTS)):
        mine = np.flatnonzero(selector == k)
        for t in range(int(COUNTS[k])) if len(mine) else ():
            ids[starts[mine] + t] = (words[mine] >> np.uint64(int(WIDTHS[k]) * t)) & LIMITS[k]
    out = np.flatnonzero(selector == ESCAPE)
    ids[starts[out]] = escapes[(words[out] & LIMITS[-1]).astype(np.int64)]
    return ids


def to_block(doc_ids: list, ids: np.ndarray, sizes: np.ndarray) -> bytes:
    words, firsts, escapes = pack(ids, sizes)
    known = np.array([d is not None for d in doc_ids], np.uint8)
    names = np.array([0 if d is None else d for d in doc_ids], np.int64)
    return b"".join((
        MAGIC, struct.pack("<III", len(sizes), len(escapes), len(words)),
        names.tobytes(), known.tobytes(), sizes.astype("<u4").tobytes(), firsts.astype("<u4").tobytes(),
        escapes.astype("<u8").tobytes(), words.astype("<u8").tobytes(),
    ))


def from_block(data: bytes | memoryview) -> tuple[list, np.ndarray, np.ndarray]:
    """``(doc ids, number of ids of each, all ids)``; documents are consecutive."""
    if bytes(data[:4]) != MAGIC:
        raise ValueError("not a token block")
    docs, n_escapes, n_words = struct.unpack_from("<III", data, 4)
    at = 16
    names = np.frombuffer(data, "<i8", docs, at)
    known = np.frombuffer(data, np.uint8, docs, at + 8 * docs)
    sizes = np.frombuffer(data, "<u4", docs, at + 9 * docs)
    at += 17 * docs
    escapes = np.frombuffer(data, "<u8", n_escapes, at)
    words = np.frombuffer(data, "<u8", n_words, at + 8 * n_escapes)
    return [int(d) if k else None for d, k in zip(names, known)], sizes, unpack(words, escapes)


def _packed(tokenizer: str, end_id: int):
    """Encode a sorted partition into blocks."""

    def rows(shard, number, before, docs, ids, sizes):
        data = to_block(docs, ids, sizes)
        return pa.RecordBatch.from_arrays(
            [pa.array([v], pa.int64()) for v in (shard, number, before, len(ids))] + [pa.array([data], pa.binary())],
            names=["shard", "block", "before", "ids", "data"],
        )

    def run(batches):
        encoder = word_encoder(tokenizer)
        shard = TaskContext.get().partitionId()
        number, before = 0, 0
        for batch in batches:
            docs, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            for a, b in in_slices(texts, SLICE):
                ids, sizes = encoder.encode(texts[a:b])
                ids = np.insert(ids, np.cumsum(sizes), end_id)
                sizes = sizes + 1
                ends = np.cumsum(sizes)
                first, done = 0, 0
                while first < len(sizes):  # documents up to about a block's words, at four ids a word
                    last = max(first + 1, int(np.searchsorted(ends, done + 4 * BLOCK_WORDS, "right")))
                    stop = int(ends[last - 1])
                    yield rows(shard, number, before, docs[a + first:a + last], ids[done:stop], sizes[first:last])
                    number, before = number + 1, before + stop - done
                    first, done = last, stop

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int) -> None:
    """Write the ids of all documents, each with ``end_id`` appended, in ascending id order."""
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    order = ["doc_id", F.xxhash64("text")]
    placed = text.repartitionByRange(*order).sortWithinPartitions(*order)
    placed.mapInArrow(_packed(tokenizer, end_id), BLOCKS).write.option("compression", "none").parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Per document ``doc_id, start, n_tokens, ids_crc32``, from the files alone."""
    blocks = spark.read.schema(BLOCKS).parquet(path)
    # One number per shard; shards are shuffle partitions, whose count is a setting.
    totals = blocks.groupBy("shard").agg(F.sum("ids").alias("ids")).orderBy("shard").collect()
    starts, seen = {}, 0
    for row in totals:
        starts[row["shard"]] = seen
        seen += row["ids"]

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                shard, before = batch.column(0)[k].as_py(), batch.column(1)[k].as_py()
                names, sizes, ids = from_block(memoryview(batch.column(2)[k].as_buffer()))
                ends = np.cumsum(sizes.astype(np.int64))
                flat = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(flat[4 * (e - n):4 * e]) for e, n in zip(ends.tolist(), sizes.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names, pa.int64()),
                     pa.array(starts[shard] + before + ends - sizes, pa.int64()),
                     pa.array(sizes, pa.int64()), pa.array(crc, pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    # Blocks are about a megabyte; few at a time enter an Arrow batch of a reading task.
    return blocks.select("shard", "before", "data").mapInArrow(
        run, "doc_id long, start long, n_tokens long, ids_crc32 long"
    )


def new_path(spark: SparkSession) -> str:
    return f"{checkpoint_root(spark).rstrip('/')}/tokens-{uuid.uuid4().hex}"
