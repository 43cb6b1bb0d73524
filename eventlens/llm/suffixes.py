"""Repeated 200-byte strings by merging shard Burrows-Wheeler transforms.

Any two equal windows of ``SPAN`` bytes have the same minimiser: the leftmost smallest hash of their
``GRAM``-byte strings, at the same offset. So each document is cut into segments, the windows that
share a minimiser, and equal windows are only looked for between segments of one minimiser hash:

1. Segments as narrow rows (minimiser, content hash, place) are counted per content, combined
   before the shuffle. A content that occurs twice is repeated as a whole; a million copies of a
   passage are one row per task.
2. Where a minimiser has several contents, one example of each is fetched and dealt by minimiser.
   A task takes its segments in shards of at most ``SHARD`` bytes. Over an alphabet of
   ``LETTER``-byte strings (a window is a few letters; the strings of a segment are its residue
   classes), each shard is suffix-sorted by itself and gives its Burrows-Wheeler transform.
3. Transforms are merged by interleave refinement: the interleave starts as one shard after the
   other; a pass takes each shard's next transform letter in interleave order and stably sorts
   the shard numbers by it, which orders the merged suffixes by one letter more. Block numbers carried
   along give the common prefixes: after ``SPAN / LETTER`` passes two suffixes share a block if
   and only if their windows are equal. No suffix is sorted again.
4. The repeated intervals go back to all places of their content, and every document removes the
   union of its intervals.

A minimiser with more than ``MOST_CONTENTS`` contents, such as the edge of a passage in a third of
all documents, is not gathered: its windows are counted as hashed rows by an aggregation instead.

Defined cases: a null text is empty; texts under ``SPAN`` bytes lose nothing. Rows that repeat an id
are documents of their own; identical rows remove each other. Null ids take part and are returned.
An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventlens.llm.common import quoted, text_of
from eventlens.llm.encode import in_slices
from eventlens.llm.shingles import _BASE, _INVERSE, mixed, powers
from eventlens.session import cut

SPAN, GRAM, LETTER = 200, 40, 50
WIDTH = SPAN - GRAM + 1
#: Bytes of a shard, and contents of a minimiser beyond which its windows are counted one by one.
SHARD, MOST_CONTENTS = 1 << 17, 4_096
#: Characters handled at once where segments are found.
SLICE = 300_000
NO_HASH = np.uint64((1 << 64) - 1)


class Rolling:
    """Hashes of any substring of a byte array."""

    def __init__(self, data: np.ndarray) -> None:
        n = len(data)
        terms = (data.astype(np.uint64) + np.uint64(1)) * powers(_BASE, n)[:n]
        self.prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms)])
        self.back = powers(_INVERSE, n + 1)

    def of(self, start, stop) -> np.ndarray:
        return mixed((self.prefix[stop] - self.prefix[start]) * self.back[start])


def _sliding(x: np.ndarray, width: int, pick, fill) -> np.ndarray:
    """``pick.accumulate`` extremes of all windows of ``width``, from block prefixes and suffixes."""
    padded = np.concatenate([x, np.full(-len(x) % width, fill, x.dtype)]).reshape(-1, width)
    ahead = pick.accumulate(padded, 1).ravel()
    behind = pick.accumulate(padded[:, ::-1], 1)[:, ::-1].ravel()
    n = len(x) - width + 1
    return pick(behind[:n], ahead[width - 1:width - 1 + n])


def segments(data: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of consecutive documents: ``(document, minimiser, content, first start, last start)``, starts
    in the whole array; a segment's bytes end ``SPAN`` after its last start."""
    empty = np.zeros(0, np.int64)
    if len(data) < SPAN:
        return empty, empty.astype(np.uint64), empty.astype(np.uint64), empty, empty
    rolling = Rolling(data)
    grams = rolling.of(slice(0, len(data) - GRAM + 1), slice(GRAM, len(data) + 1))
    least = _sliding(grams, WIDTH, np.minimum, NO_HASH)
    ends = np.cumsum(sizes)
    owner_doc = np.repeat(np.arange(len(sizes)), sizes)[:len(least)]
    starts = np.flatnonzero(np.arange(len(least)) <= np.repeat(ends - SPAN, sizes)[:len(least)])
    if not len(starts):
        return empty, empty.astype(np.uint64), empty.astype(np.uint64), empty, empty
    # Places that are the minimum of some window, then the first of them at or after each start
    # that has the window's minimum.
    around = np.concatenate([np.zeros(WIDTH - 1, np.uint64), least, np.zeros(WIDTH - 1, np.uint64)])
    least_of_some = _sliding(around, WIDTH, np.maximum, np.uint64(0)) == grams
    places = np.flatnonzero(least_of_some)
    at = (np.cumsum(least_of_some) - least_of_some)[starts]  # places before each start
    wanted = least[starts]
    wrong = np.flatnonzero(grams[places[at]] != wanted)
    while len(wrong):
        at[wrong] += 1
        wrong = wrong[grams[places[at[wrong]]] != wanted[wrong]]
    owner = places[at]
    doc = owner_doc[starts]
    new = np.concatenate([[True], (owner[1:] != owner[:-1]) | (doc[1:] != doc[:-1])])
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(starts)]]) - 1
    low, high, own = starts[first], starts[last], owner[first]
    content = rolling.of(low, high + SPAN)
    content = mixed(content ^ mixed(((own - low) << 32 | (high - low)).astype(np.uint64)))
    return doc[first], grams[own], content, low, high


def _bytes_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    coded = [t.encode() for t in texts]
    return np.frombuffer(b"".join(coded), np.uint8), np.array([len(c) for c in coded], np.int64)


def _found(collapse: bool):
    """Narrow segment rows of each document; collapsed, one row per content of a batch, with the
    number of its places and one of them."""

    def run(batches):
        for batch in batches:
            rows, texts = batch.column("row").to_numpy(), batch.column("text").to_pylist()
            found = []
            for a, b in in_slices(texts, SLICE):
                data, sizes = _bytes_of(texts[a:b])
                doc, gram, content, low, high = segments(data, sizes)
                begin = (np.cumsum(sizes) - sizes)[doc]
                found.append((rows[a:b][doc], gram.view(np.int64), content.view(np.int64), low - begin, high - low + SPAN))
            if not found:
                continue
            row, gram, content, low, size = (np.concatenate(c) for c in zip(*found))
            places = np.ones(len(row), np.int64)
            if collapse:
                _, index, places = np.unique(content, return_index=True, return_counts=True)
                row, gram, content, low, size = (c[index] for c in (row, gram, content, low, size))
            yield pa.RecordBatch.from_arrays(
                [pa.array(row), pa.array(gram), pa.array(content), pa.array(low.astype(np.int32)),
                 pa.array(size.astype(np.int32)), pa.array(places.astype(np.int32))],
                names=["row", "gram", "content", "low", "size", "places"],
            )

    return run


def _released(run):
    """``run``, after which a reused worker gives back the memory that Arrow holds for later."""
    def released(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()

    return released


def _fetched(batches):
    """The bytes of the wanted segments of each document."""
    for batch in batches:
        texts, wanted = batch.column("text"), batch.column("wanted").to_pylist()
        gram, content, data = [], [], []
        for k, want in enumerate(wanted):
            text = texts[k].as_py().encode()
            for w in want:
                gram.append(w["gram"])
                content.append(w["content"])
                data.append(text[w["low"]:w["low"] + w["size"]])
        yield pa.RecordBatch.from_arrays(
            [pa.array(gram, pa.int64()), pa.array(content, pa.int64()), pa.array(data, pa.binary())],
            names=["gram", "content", "data"],
        )


def ordered(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(stable order, sorted numbers)``. Numbers are sorted with their places in the low bits, which
    is several times as fast as an argsort; where large ones lose bits that way, the order is checked."""
    x = x.astype(np.uint64, copy=False)
    bits = np.uint64(len(x).bit_length())
    small = not len(x) or not int(x.max()) >> (64 - int(bits))
    keys = x << bits if small else x >> bits << bits
    keys |= np.arange(len(x), dtype=np.uint64)
    keys.sort()
    keys &= (np.uint64(1) << bits) - np.uint64(1)
    order = keys.view(np.int64)
    found = x[order]
    if not small and (found[1:] < found[:-1]).any():
        order = np.argsort(x, kind="stable")
        found = x[order]
    return order, found


def ranked(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(ranks from 0, stable order)``."""
    order, found = ordered(x)
    rank = np.zeros(len(x), np.int64)
    rank[order[1:]] = np.cumsum(found[1:] != found[:-1])
    return rank, order


class Shard:
    """Letters, suffix order and transform of some segments."""

    def __init__(self, parts: list[bytes], base: int) -> None:
        data = np.frombuffer(b"".join(parts), np.uint8)
        sizes = np.array([len(p) for p in parts], np.int64)
        ends = np.repeat(np.cumsum(sizes), sizes)
        place = np.arange(len(data))
        n = len(data)
        whole = np.flatnonzero(place + LETTER <= ends)
        # Letters are hashes; a suffix too short for one ends its string with a stop of its own.
        self.letter = (np.uint64(base) + place.astype(np.uint64)) | np.uint64(1 << 63)
        self.letter[whole] = Rolling(data).of(whole, whole + LETTER) >> np.uint64(1)
        jump = np.where(place + LETTER < ends, place + LETTER, n)
        rank, self.order = ranked(self.letter)
        reach = 1
        while reach < SPAN // LETTER:  # orders by twice as many letters
            rank += 1
            rank, self.order = ranked(rank * (n + 2) + np.concatenate([rank, [0]])[jump])
            jump = np.concatenate([jump, [n]])[jump]
            reach *= 2
        starts = np.cumsum(sizes) - sizes
        # Whether a letter stands before each suffix: none before the first suffixes of a string.
        self.inside = self.order - LETTER >= np.repeat(starts, sizes)[self.order]
        self.rest = np.flatnonzero(place + LETTER >= ends)  # suffixes that no other precedes
        self.size, self.segment = n, np.repeat(np.arange(len(parts), dtype=np.int32), sizes)
        self.start = (place - np.repeat(starts, sizes)).astype(np.int32)


def merge(shards: list[Shard]) -> tuple[np.ndarray, np.ndarray]:
    """``(interleave, block)``: the shard number of every merged suffix in order, and numbers that
    are equal for suffixes that agree in ``SPAN`` bytes."""
    # One code per distinct letter, in one order for all shards.
    codes = ranked(np.concatenate([s.letter for s in shards]))[0]
    bounds = np.cumsum([0] + [s.size for s in shards])
    letters = [codes[a:b] for a, b in zip(bounds, bounds[1:])]
    # Transform letters as codes, in each shard's suffix order.
    transforms = np.concatenate([
        np.where(s.inside, c[np.maximum(s.order - LETTER, 0)], -1) for s, c in zip(shards, letters)
    ])
    kind = np.uint16 if len(shards) < 1 << 16 else np.int64  # numpy sorts the former by radix
    tails = np.concatenate([c[s.rest] for s, c in zip(shards, letters)])
    tail_shards = np.repeat(np.arange(len(shards)), [len(s.rest) for s in shards]).astype(kind)
    interleave = np.repeat(np.arange(len(shards)), [s.size for s in shards]).astype(kind)
    block = np.zeros(len(interleave), np.int64)
    for depth in range(SPAN // LETTER):
        # The transform letters in interleave order: each shard's in its own order.
        sequence = np.empty(len(interleave), np.int64)
        sequence[np.argsort(interleave, kind="stable")] = transforms
        real = np.flatnonzero(sequence >= 0)
        # Suffixes at a string's end precede nothing: they come before all longer ones of a letter.
        order, letter = ordered(np.concatenate([tails, sequence[real]]))
        # A string's last letter agrees with others at the first depth only.
        alone = np.zeros(len(tails), np.int64) if depth == 0 else -1 - np.arange(len(tails))
        beyond = np.concatenate([alone, block[real]])[order]
        interleave = np.concatenate([tail_shards, interleave[real]])[order]
        block = np.cumsum(np.concatenate([[0], (letter[1:] != letter[:-1]) | (beyond[1:] != beyond[:-1])]))
    return interleave, block


def repeated(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """``(segment, start)``, in order, of the ``SPAN`` bytes that occur at another place too."""
    shards, at, size, base = [], 0, 0, 0
    firsts = []
    for k, part in enumerate(parts):
        size += len(part)
        if size >= SHARD or k + 1 == len(parts):
            shards.append(Shard(parts[at:k + 1], base))
            firsts.append(at)
            at, base, size = k + 1, base + size, 0
    interleave, block = merge(shards)
    twice = np.bincount(block)[block] > 1
    own = [np.sort(s.order[twice[interleave == k]]) for k, s in enumerate(shards)]
    return (
        np.concatenate([s.segment[mine] + first for s, mine, first in zip(shards, own, firsts)]),
        np.concatenate([s.start[mine] for s, mine in zip(shards, own)]),
    )


def repeated_starts(parts: list[bytes]) -> list[np.ndarray]:
    """Per segment, the starts whose ``SPAN`` bytes occur at another place too."""
    segment, start = repeated(parts)
    cuts = np.searchsorted(segment, np.arange(len(parts) + 1))
    return [start[a:b] for a, b in zip(cuts, cuts[1:])]


def spans(segment: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(segment, from, to)``: the union of the windows at each segment's ascending starts."""
    if not len(start):
        return segment, start, start
    breaks = np.flatnonzero((np.diff(start) > SPAN) | (segment[1:] != segment[:-1]))
    low = np.concatenate([[0], breaks + 1])
    high = np.concatenate([breaks, [len(start) - 1]])
    return segment[low], start[low], start[high] + SPAN


def _merged(batches):
    """Repeated spans per content, for a task's segments in minimiser order."""

    def told(keys, parts):
        segment, low, high = spans(*repeated(parts))
        gram, content = np.array(keys, np.int64)[segment].T
        return pa.RecordBatch.from_arrays(
            [pa.array(gram), pa.array(content), pa.array(low.astype(np.int32)), pa.array(high.astype(np.int32))],
            names=["gram", "content", "from", "to"],
        )

    keys: list[tuple[int, int]] = []
    parts: list[bytes] = []
    size = 0
    for batch in batches:
        rows = zip(*(
            batch.column(c).to_numpy(zero_copy_only=False).tolist() for c in ("gram", "content", "data")
        ))
        for gram, content, data in rows:
            if size >= 4 * SHARD and gram != keys[-1][0]:  # all contents of a minimiser are together
                yield told(keys, parts)
                keys, parts, size = [], [], 0
            keys.append((gram, content))
            parts.append(data)
            size += len(data)
    if keys:
        yield told(keys, parts)


def _window_hashes(batches):
    for batch in batches:
        for gram, content, data in zip(*(batch.column(c).to_pylist() for c in ("gram", "content", "data"))):
            array = np.frombuffer(data, np.uint8)
            start = np.arange(len(array) - SPAN + 1)
            hashed = Rolling(array).of(start, start + SPAN)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(start), gram)), pa.array(np.full(len(start), content)),
                 pa.array(hashed.view(np.int64)), pa.array(start.astype(np.int32))],
                names=["gram", "content", "window", "from"],
            )


def _cut_out(keep_text: bool):
    def run(batches):
        for batch in batches:
            out = []
            names = batch.schema.names
            covers = batch.column(names.index("covers")).to_pylist()
            texts = batch.column(names.index("text")).to_pylist()
            for text, cover in zip(texts, covers):
                data = (text or "").encode()
                runs: list[list[int]] = []
                for c in sorted((c["from"], c["to"]) for c in cover or ()):
                    if runs and c[0] <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], c[1])
                    else:
                        runs.append([c[0], c[1]])
                kept, at = [], 0
                for a, b in runs:
                    kept.append(data[at:a])
                    at = b
                kept.append(data[at:])
                left = b"".join(kept)
                out.append((len(data), len(data) - len(left), len(runs), left))
            if keep_text:  # cut characters at span edges are replaced
                text = pa.array([r[3].decode("utf-8", "ignore") for r in out], pa.string())
                yield batch.set_column(names.index("text"), "text", text).drop_columns(["covers"])
            else:
                yield pa.RecordBatch.from_arrays(
                    [batch.column(names.index("doc_id"))]
                    + [pa.array([r[k] for r in out], pa.int64()) for k in range(3)]
                    + [pa.array([hashlib.sha256(r[3]).hexdigest() for r in out], pa.string())],
                    names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
                )

    return run


def covered(texts: DataFrame) -> DataFrame:
    """``row, covers``: the byte spans to remove from those of ``row, text`` that lose any."""
    narrow = "row long, gram long, content long, low int, size int, places int"
    texts = texts.select("row", "text")
    dealt = texts.mapInArrow(_released(_found(True)), narrow).repartition("gram")
    contents = dealt.groupBy("gram", "content").agg(
        F.sum("places").alias("places"), F.min(F.struct("row", "low", "size")).alias("at")
    )
    # Both sides of the join need the same columns of ``dealt``, so that it is dealt out once.
    uses = contents.groupBy("gram").agg(
        F.sum("places").alias("uses"), F.count(F.lit(1)).alias("kinds"), F.min("places").alias("fewest"),
        F.max("at").alias("last"),
    ).where("uses > 1 and last is not null")
    shared = cut(contents.join(uses.drop("uses", "last"), "gram"))
    span = "gram long, content long, `from` int, `to` int"
    repeated = shared.where("places > 1").select(
        "gram", "content", F.lit(0).alias("from"), F.col("at.size").alias("to")
    )

    def examples(which) -> DataFrame:
        """Bytes of one place of each content of the wanted minimisers."""
        wanted = shared.where((F.col("kinds") > 1) & (F.col("fewest") == 1) & which).groupBy(
            F.col("at.row").alias("row")
        ).agg(F.collect_list(F.struct("gram", "content", "at.low", "at.size")).alias("wanted"))
        return texts.join(wanted, "row").select("text", "wanted").mapInArrow(
            _fetched, "gram long, content long, data binary"
        )

    light = examples(F.col("kinds") <= MOST_CONTENTS).repartition("gram").sortWithinPartitions("gram", "content")
    repeated = repeated.unionByName(light.mapInArrow(_released(_merged), span))
    if shared.where(F.col("kinds") > MOST_CONTENTS).limit(1).count():
        # Not stored: in one plan with the light minimisers, texts are dealt out once for both.
        windows = examples(F.col("kinds") > MOST_CONTENTS).mapInArrow(
            _window_hashes, "gram long, content long, window long, `from` int"
        )
        often = windows.groupBy("gram", "window").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
        repeated = repeated.unionByName(
            windows.join(often, ["gram", "window"]).select(
                "gram", "content", "from", (F.col("from") + SPAN).alias("to")
            )
        )
    places = texts.mapInArrow(_released(_found(False)), narrow).select("row", "gram", "content", "low")
    return (
        places.join(cut(repeated), ["gram", "content"])
        .select("row", F.struct((F.col("low") + F.col("from")).alias("from"), (F.col("low") + F.col("to")).alias("to")).alias("c"))
        .groupBy("row").agg(F.collect_list("c").alias("covers"))
    )


def _with_covers(docs: DataFrame) -> DataFrame:
    """``docs`` with a ``row`` key and its ``covers``, null where nothing is removed."""
    keyed = docs.withColumn("row", F.xxhash64("doc_id", text_of()))
    covers = covered(keyed.select("row", text_of().alias("text")))
    return keyed.join(covers, "row", "left").drop("row")


def repeats_removed(docs: DataFrame) -> DataFrame:
    """One row per input row: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256``."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return _with_covers(rows).select("doc_id", "text", "covers").mapInArrow(
        _cut_out(False), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    )


def drop_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with the repeated spans cut out of the texts, all columns kept."""
    extra = [c for c in docs.columns if c not in ("doc_id", "text")]
    others = F.struct(*map(quoted, extra)) if extra else F.lit(0)
    done = _with_covers(docs.select("doc_id", "text", others.alias("others")))
    out = done.mapInArrow(_cut_out(True), done.drop("covers").schema)
    return out.select(*[
        F.col("others").getField(c).alias(c) if c in extra else F.col(c) for c in docs.columns
    ])
