"""Near duplicates by BagMinHash signatures of weighted shingles, banding and exact verification.

A text is a multiset of five-word shingles. Each shingle has, for each of the weight intervals
[0,1), [1,2), [2,4), [4,8) ..., a Poisson process whose rate is the interval's length; a point has
a time, a signature component and a level inside the interval, all from hashes of (shingle,
interval, number). A point of a shingle of weight w counts if its level is below w, so intervals
under w count whole and the one around w is thinned. A component's value is the earliest time of
its points: two texts agree in a component with probability sum(min) / sum(max), the weighted
Jaccard similarity. Points come in order of time and are generated only up to a time by which all
components are almost surely filled, which is later than any value; a text where one stays empty
is taken again with twice the time. So the values are exact and the cost is about
m log m points a text, however long it is.

Classes:
1. Texts of equal multisets collapse to one row by a 128-bit digest, combined before the shuffle.
2. Band keys bring candidates together. A bucket is never paired within itself: each text is first
   compared exactly with one hub: of the members of its buckets the one that meets most others, which
   in a group of copies of one text is that text or the one changed least.
3. Links make components. Where a bucket still holds several, the most central member of each is
   compared with that of the largest one, for a round or two. What still hangs apart is paired across
   components and compared as well. The join takes a pair only if the sizes allow the similarity,
   the distances of both to a hub they share do (1 - similarity is a metric), and longer
   signatures, four bits a value and made for these members only, agree to within 4.5 deviations
   of it. So a bucket of texts that share a passage gives no pairs, nor do outliers beside a dense
   group of near copies, which is one component by then. No link between candidates is lost but by
   a chance below one in a million.
4. Components over all links are the classes; the smallest id of a class is kept.

With ``BANDS`` bands of ``ROWS`` values a pair of similarity 0.8 is missed with probability 3e-6.

Defined cases: a null text is empty; texts without words form one class. Rows that repeat an id
with different texts each take part and are one class, with all that is near to any of them; ids
are below 2^62 where that happens. Null ids
take no part: they are their own class, null, and kept. An empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventlens.llm.common import text_of
from eventlens.llm.encode import in_slices
from eventlens.llm.shingles import mixed, multisets, similarity
from eventlens.operators.components import connected_components
from eventlens.session import cut

BANDS, ROWS = 32, 5
LEAST = 0.8
#: Values of the longer signature that tells candidates of step 3 apart, four bits each.
CODE = 1_024
#: Rounds in which components of a bucket are compared by one member each.
HUB_ROUNDS = 2
#: Where names of further texts under one id begin.
BEYOND = 1 << 62
#: Covers rounding of similarities.
SLACK = 1e-9
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _nth(number: int) -> np.uint64:
    return np.uint64(number * int(_STEP) & (1 << 64) - 1)


def _uniform(x: np.ndarray) -> np.ndarray:
    """Doubles in (0, 1] from hashes."""
    return ((x >> np.uint64(11)).astype(np.float64) + 1.0) * 2.0**-53


def signatures(sets: list[tuple[np.ndarray, np.ndarray]], size: int) -> np.ndarray:
    """One row of earliest times per multiset; rows of empty multisets hold infinity."""
    out = np.full((len(sets), size), np.inf)
    totals = np.array([int(c.sum()) for _, c in sets], np.float64)
    open_ = np.flatnonzero(totals)
    reach = size * (math.log(size) + 4.0)
    while len(open_):
        limits = np.zeros(len(sets))
        limits[open_] = reach / totals[open_]
        element = np.concatenate([sets[k][0] for k in open_])
        weight = np.concatenate([sets[k][1] for k in open_]).astype(np.int64)
        text = np.repeat(open_, [len(sets[k][0]) for k in open_])
        level = 0
        while len(element):
            lower = 0 if level == 0 else 1 << (level - 1)
            length = 1 if level == 0 else lower
            inside = weight > lower
            element, weight, text = element[inside], weight[inside], text[inside]
            _points(out, element, weight, text, limits, level, lower, length)
            level += 1
        open_ = open_[np.isinf(out[open_]).any(1)]
        reach *= 2
    return out


def _points(out, element, weight, text, limits, level, lower, length) -> None:
    """The points of one weight interval for all its elements, in order of time."""
    size = out.shape[1]
    flat = out.ravel()
    seed = mixed(element + _nth(level + 1))
    time = np.zeros(len(seed))
    limit = limits[text]
    number = 0
    while len(seed):
        number += 1
        draw = mixed(seed + _nth(number))
        time = time - np.log(_uniform(draw)) / length
        going = np.flatnonzero(time <= limit)
        seed, time, text, limit, weight, draw = (x[going] for x in (seed, time, text, limit, weight, draw))
        where = mixed(draw + _STEP)
        component = (where >> np.uint64(32)) % np.uint64(size)
        if length > 1:
            offset = mixed(where).astype(np.uint64) % np.uint64(length)
            mine = np.flatnonzero(offset.astype(np.int64) + lower < weight)
            np.minimum.at(flat, text[mine] * size + component[mine].astype(np.int64), time[mine])
        else:
            np.minimum.at(flat, text * size + component.astype(np.int64), time)


def band_keys(values: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit key per text and band."""
    bits = np.ascontiguousarray(values[:, :bands * rows]).view(np.uint64).reshape(len(values), bands, rows)
    key = np.zeros((len(values), bands), np.uint64) + np.arange(1, bands + 1, dtype=np.uint64) * _STEP
    for k in range(rows):
        key = mixed(key ^ bits[:, :, k])
    return key.view(np.int64)


def agreement_codes(values: np.ndarray) -> np.ndarray:
    """Four hashed bits of every value, 16 values to a word."""
    nibbles = (mixed(values.view(np.uint64)) >> np.uint64(60)).reshape(len(values), -1, 16)
    return (nibbles << (np.arange(16, dtype=np.uint64) * np.uint64(4))).sum(2, dtype=np.uint64).view(np.int64)


def most_differing_bits(size: int, least: float) -> int:
    """Code bits that differ at most, four and a half deviations above the mean, at similarity
    ``least``: an unequal value differs in two of its four bits on average, with variance one."""
    unequal = size * (1 - least)
    return math.ceil(2 * unequal + 4.5 * math.sqrt(unequal + 4 * unequal * least))


def _codes(batches):
    for batch in batches:
        texts = batch.column("text").to_pylist()
        for a, b in in_slices(texts, 100_000):
            codes = agreement_codes(signatures(multisets(texts[a:b]), CODE))
            offsets = pa.array(np.arange(b - a + 1, dtype=np.int32) * codes.shape[1])
            yield pa.RecordBatch.from_arrays(
                [batch.column("rep")[a:b], pa.ListArray.from_arrays(offsets, pa.array(codes.ravel()))],
                names=["rep", "code"],
            )


def _sketch(bands: int, rows: int):
    def run(batches):
        for batch in batches:
            docs, prints, texts = batch.column("doc_id"), batch.column("print"), batch.column("text").to_pylist()
            for a, b in in_slices(texts, 1_000_000):
                sets = multisets(texts[a:b])
                keys = band_keys(signatures(sets, bands * rows), bands, rows)
                # Order does not matter to a multiset: sums of hashes of (shingle, count).
                pairs = [mixed(h + mixed(c.astype(np.uint64))) for h, c in sets]
                one = np.array([p.sum() for p in pairs], np.uint64).view(np.int64)
                two = np.array([mixed(p ^ _STEP).sum() for p in pairs], np.uint64).view(np.int64)
                sizes = np.array([int(c.sum()) for _, c in sets], np.int64)
                offsets = np.concatenate([[0], np.cumsum(np.where(sizes > 0, bands, 0))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [docs[a:b], prints[a:b], pa.array(one), pa.array(two), pa.array(sizes),
                     pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys[sizes > 0].ravel()))],
                    names=["doc_id", "print", "one", "two", "size", "keys"],
                )

    return run


def _compare(batches):
    last, known = None, None
    for batch in batches:
        a = batch.column("a").to_pylist()
        left, right = batch.column("text_a"), batch.column("text_b").to_pylist()
        alike = []
        for x, y in in_slices(right, 1_000_000):
            for k, own in enumerate(multisets(right[x:y]), x):
                if a[k] != last:
                    last, known = a[k], multisets([left[k].as_py()])[0]
                alike.append(similarity(known, own))
        yield pa.RecordBatch.from_arrays(
            [batch.column("a"), batch.column("b"), pa.array(alike, pa.float64())], names=["a", "b", "alike"]
        )


def _compared(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs ``(a, b)`` with the similarity of their texts."""
    left = texts.select(F.col("rep").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("rep").alias("b"), F.col("text").alias("text_b"))
    both = pairs.join(right, "b").join(left, "a").sortWithinPartitions("a")
    return cut(both.select("a", "b", "text_a", "text_b").mapInArrow(_compare, "a long, b long, alike double"))


def near_classes(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    bands: int = BANDS,
    rows: int = ROWS,
    least: float = LEAST,
) -> DataFrame:
    """One row per input row: ``doc_id, class_id, kept``."""
    ids = docs.select(F.col(id_column).cast("long").alias("doc_id"), text_of(text_column).alias("text"))
    named = ids.where(F.col("doc_id").isNotNull())
    sketch = cut(
        named.withColumn("print", F.xxhash64("text")).mapInArrow(
            _sketch(bands, rows), "doc_id long, print long, one long, two long, size long, keys array<long>"
        )
    )
    same = ["one", "two"]
    found = sketch.groupBy(*same).agg(F.min(F.struct("doc_id", "print")).alias("first"), F.max("size").alias("size"))
    # A set is named after its smallest id; of several sets with one smallest id the others get a
    # number beyond all ids and are linked to it below.
    place = F.row_number().over(Window.partitionBy("first.doc_id").orderBy(*same))
    beyond = F.lit(BEYOND) + F.shiftrightunsigned(F.xxhash64(*same), 3)
    reps = cut(found.withColumn("place", place).select(
        *same, "size", "first.doc_id", "first.print", F.when(F.col("place") == 1, F.col("first.doc_id")).otherwise(beyond).alias("rep")
    ))
    members = cut(sketch.select("doc_id", *same).join(reps.select(*same, "rep", "size"), same).select("doc_id", "rep", "size"))
    keyed = cut(
        sketch.join(reps.select(*same, "doc_id", "rep"), [*same, "doc_id"])
        .select("rep", "size", F.explode("keys").alias("key"))
        .distinct()
    )
    crowds = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    met = cut(keyed.join(crowds, "key"))
    # The members that a text meets over all its buckets: most for the text in the middle of a group.
    central = cut(met.groupBy("rep").agg(F.struct(F.sum("n").alias("met"), F.bitwise_not("rep").alias("not_rep")).alias("rank")))
    crowded = cut(met.select("rep", "size", "key").join(central, "rep"))
    wanted = crowded.select("rep").distinct()
    texts = cut(
        named.withColumn("print", F.xxhash64("text")).join(reps.select("doc_id", "print", "rep"), ["doc_id", "print"])
        .join(wanted, "rep").groupBy("rep").agg(F.min("text").alias("text"))
    )
    # One comparison per text: with the most central member of all its buckets.
    hubs = crowded.groupBy("key").agg(F.max("rank").alias("top"))
    near_hub = crowded.join(hubs, "key").groupBy("rep").agg(F.bitwise_not(F.max("top").getField("not_rep")).alias("hub"))
    told = _compared(cut(near_hub.where("hub <> rep").select(F.col("hub").alias("a"), F.col("rep").alias("b"))), texts)
    far = told.select(F.col("b").alias("rep"), F.col("a").alias("hub"), (1 - F.col("alike")).alias("far"))
    stated = cut(crowded.join(far, "rep", "left"))
    seen = told.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "alike")
    linked = seen.where(F.col("alike") >= least).select("a", "b")
    nodes = crowded.select(F.col("rep").alias("node")).distinct()
    for step in range(HUB_ROUNDS + 1):
        groups = connected_components(nodes, linked)
        placed = cut(stated.join(groups.select(F.col("node").alias("rep"), F.col("component").alias("part")), "rep"))
        # Of each bucket with several components, the one with most members is its main part: every pair
        # across components has a member outside it, so a dense main part is not paired with itself.
        parts = cut(placed.groupBy("key", "part").agg(F.count(F.lit(1)).alias("n"), F.max("rank").alias("delegate")))
        mains = parts.groupBy("key").agg(
            F.max(F.struct("n", "part", "delegate")).alias("top"), F.count(F.lit(1)).alias("parts")
        ).where("parts > 1").select("key", F.col("top.part").alias("main"), F.col("top.delegate").alias("head"))
        if step == HUB_ROUNDS:
            break
        # A component's most central member in a bucket is compared with that of the bucket's main part.
        sent = (
            parts.join(mains, "key").where("part <> main").groupBy("delegate").agg(F.max("head").alias("head"))
            .select(*[F.bitwise_not(F.col(side).getField("not_rep")).alias(side) for side in ("delegate", "head")])
        )
        asked = cut(
            sent.select(F.least("delegate", "head").alias("a"), F.greatest("delegate", "head").alias("b"))
            .distinct().join(seen.select("a", "b"), ["a", "b"], "left_anti")
        )
        told = _compared(asked, texts)
        seen = seen.unionByName(told)
        linked = seen.where(F.col("alike") >= least).select("a", "b")
        if told.where(F.col("alike") >= least).isEmpty():
            break
    loose = cut(placed.join(mains.select("key", "main"), "key"))
    codes = texts.join(loose.select("rep").distinct(), "rep").mapInArrow(_codes, "rep long, code array<long>")
    # At most one key a band: a pair is taken in the smallest bucket it shares, not in each.
    shared = crowded.groupBy("rep").agg(F.collect_list("key").alias("keys"))
    words = CODE // 16
    coded = cut(
        loose.join(codes.join(shared, "rep"), "rep").select(
            "key", "rep", "size", "part", "main", "hub", "far", "keys",
            *[F.col("code")[k].alias(f"c{k}") for k in range(words)],
        )
    )

    def named_as(side: str) -> DataFrame:
        return coded.select("key", *[F.col(c).alias(f"{c}_{side}") for c in coded.columns if c != "key"])

    apart = sum((F.bit_count(F.col(f"c{k}_a").bitwiseXOR(F.col(f"c{k}_b"))) for k in range(words)), F.lit(0))
    possible = (
        (F.col("size_a") >= least * F.col("size_b"))
        & (F.col("size_b") >= least * F.col("size_a"))
        & ~F.coalesce(
            (F.col("hub_a") == F.col("hub_b")) & (F.abs(F.col("far_a") - F.col("far_b")) > 1 - least + SLACK), F.lit(False)
        )
        & (apart <= most_differing_bits(CODE, least))
        & (F.array_min(F.array_intersect("keys_a", "keys_b")) == F.col("key"))
    )
    different = (F.col("part_a") != F.col("part_b")) & (
        (F.col("part_b") == F.col("main_b")) | (F.col("rep_a") < F.col("rep_b"))
    )
    left = named_as("a").where(F.col("part_a") != F.col("main_a"))
    right = named_as("b").withColumnRenamed("key", "key_b")
    across = (
        left.join(right, (F.col("key") == F.col("key_b")) & different & possible)
        .select(F.least("rep_a", "rep_b").alias("a"), F.greatest("rep_a", "rep_b").alias("b"))
        .join(seen.select("a", "b"), ["a", "b"], "left_anti")
    )
    second = _compared(cut(across), texts).where(F.col("alike") >= least).select("a", "b")
    one_id = reps.where(F.col("rep") != F.col("doc_id")).select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    classes = connected_components(
        members.select(F.col("rep").alias("node")).distinct(), linked.unionByName(second).unionByName(one_id)
    )
    told = (
        members.join(classes.withColumnRenamed("node", "rep"), "rep")
        .groupBy(F.col("doc_id").alias("_doc")).agg(F.min("component").alias("class_id"))
    )
    return ids.select("doc_id").join(told, F.col("doc_id") == F.col("_doc"), "left").select(
        "doc_id", "class_id", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("kept")
    )


def drop_near(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of ``docs`` whose id is kept, all columns; one document of each class stays."""
    dropped = near_classes(docs, id_column, text_column).where(~F.col("kept"))
    out = dropped.select(F.col("doc_id").alias("_dropped_id")).distinct()
    return docs.join(out, docs[id_column] == out["_dropped_id"], "left_anti")
