"""Exact metric range join of embeddings: pivots, the triangle inequality, independent cells.

Cosine at least ``c`` between unit vectors is Euclidean distance at most ``r = sqrt(2 - 2c)``.

1. Equal vectors of a label collapse to one representative before anything is paired, so a vector
   with a million copies is one row in the join.
2. Pivots are a bounded sample of representatives. Each representative belongs to the cell of its
   nearest pivot ``p`` and visits the cell of pivot ``q`` where the distance to the bisecting
   plane, ``(d(x,q)^2 - d(x,p)^2) / (2 d(p,q))``, is at most ``r``. Any ``y`` within ``r`` of
   ``x`` that belongs to ``q`` is then met in ``q``'s cell: nothing is lost. Of two cells only one
   visits the other, so a pair is met once. There are as many pivots as the sample says pay: where
   they prune little, more of them would only multiply copies.
3. Cells join independently. Owners of a cell are dealt into blocks; a task holds one block, and
   visitors and the owners of half of the other blocks stream past it, so copies of a row grow with
   the blocks and not with blocks times cells, and a task's memory does not depend on what comes by.
   Distances to the cell's pivot give a window by the triangle inequality,
   ``|d(x,p) - d(y,p)| <= r``; a slack covers rounding. Scores in single precision tell what is
   clearly a link or none; the exact test is the cosine in double precision.
4. A task emits per-row link counts and a spanning forest of its links, never all pairs of a
   dense group; counts add up, and the forests give the connected components.

Defined cases: null, zero and non-finite vectors and vectors with a null label or a null or
non-finite component link with nothing and are their own component. Vectors of different lengths
do not link. Equal vectors link if their computed cosine reaches the limit. Rows that repeat an id
with the same vector and label are one vector; null ids never link. An empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventlens.operators.components import connected_components
from eventlens.session import cut

COSINE = 0.93
#: Sample from which pivots are drawn, pivots per label, and rows that make a block worth a task.
SAMPLE_ROWS, MOST_PIVOTS, BLOCK = 8_192, 256, 2_048
#: Bytes of vectors a task holds, tasks for each core, and rows of a tile.
HELD_BYTES, TASKS, TILE = 32 << 20, 3, 4_096
#: Comparisons that cost as much as dealing out one more copy of a row.
DEAL = 4_096
#: Covers rounding of distances to pivots; candidates inside it still take the exact test.
SLACK = 1e-6


def _units(rows: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled first, so that no square overflows or vanishes."""
    rows = rows / np.abs(rows).max(1)[:, None]
    return rows / np.sqrt((rows * rows).sum(1))[:, None]


def _matrix(column: pa.Array) -> np.ndarray:
    """Equal-length lists of floats as a matrix of unit rows."""
    width = len(column[0]) if len(column) else 0
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return _units(flat.reshape(len(column), width))


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (x @ pivots.T)))


def _visits(home, q):
    """Of two cells one visits the other: which of them changes with their distance, for balance."""
    return (home != q) & ((home > q) == ((home + q) % 2 == 0))


def _reach(x: np.ndarray, pivots: np.ndarray, radius: float):
    """Own cell of each row, distances to the pivots, and the other cells that it visits."""
    d, gap = _distances(x, pivots), _distances(pivots, pivots)
    home = d.argmin(1)
    nearest = d[np.arange(len(x)), home]
    with np.errstate(divide="ignore", invalid="ignore"):
        plane = (d**2 - nearest[:, None] ** 2) / (2 * gap[home])
    there = (plane <= radius + SLACK) & _visits(home[:, None], np.arange(len(pivots))[None, :])
    return home, d, there


def _pivots(rows: DataFrame, radius: float, total: int, share: int) -> dict[tuple[int, int], np.ndarray]:
    """Per (label, width), pivots far from each other, from a bounded sample of vectors. Their number
    is the one for which comparing and dealing out cost least, as counted on the sample."""
    some = F.pmod(F.xxhash64("rep"), F.lit(max(1, total // SAMPLE_ROWS))) == 0
    sample = rows.where(some).select("label", "width", "embedding").limit(2 * SAMPLE_ROWS).collect()
    by: dict[tuple[int, int], list] = {}
    for r in sample:
        by.setdefault((r["label"], r["width"]), []).append(r["embedding"])
    out = {}
    for key, vectors in by.items():
        m = _units(np.asarray(vectors, np.float64))
        scale = total / len(sample)
        chosen = [0]
        far = 1 - m @ m[0]
        while len(chosen) < min(MOST_PIVOTS, len(m)) and far.max() > 1e-9:
            chosen.append(int(far.argmax()))
            far = np.minimum(far, 1 - m @ m[chosen[-1]])
        best, number = math.inf, 1
        while number <= len(chosen):
            home, _, there = _reach(m, m[chosen[:number]], radius)
            owners = scale * np.bincount(home, minlength=number)
            visitors = scale * there.sum(0)
            blocks = np.ceil(owners / share)
            cost = (owners * (owners / 2 + visitors)).sum()
            cost += DEAL * (owners * (blocks + 1) / 2 + visitors * blocks).sum()
            if cost <= best:
                best, out[key] = cost, m[chosen[:number]]
            number *= 2
    return out


def _cells(pivots, radius):
    """Assign rows to their own cell and to the cells within reach of the boundary."""

    def run(batches):
        for batch in batches:
            frame = batch.select(["label", "width"]).to_pandas()
            for (label, width), index in frame.groupby(["label", "width"]).indices.items():
                part = batch.take(pa.array(index))
                x = _matrix(part.column("embedding"))
                own = pivots.get((label, width))
                if own is None:  # a label outside the sample is one cell, split into blocks only
                    home, d, there = np.zeros(len(x), int), np.zeros((len(x), 1)), np.zeros((len(x), 1), bool)
                else:
                    home, d, there = _reach(x, own, radius)
                there[np.arange(len(x)), home] = True
                row, cell = np.nonzero(there)
                got = part.take(pa.array(row))
                yield pa.RecordBatch.from_arrays(
                    [got.column("rep"), got.column("label"), got.column("width"), got.column("copies"),
                     pa.array(cell.astype(np.int32)), pa.array(home[row] == cell), pa.array(d[row, cell]),
                     got.column("embedding")],
                    names=["rep", "label", "width", "copies", "cell", "owner", "to_pivot", "embedding"],
                )

    return run


class _Rows:
    """Rows of a block or of a stretch that comes by, sorted by their distance to the pivot."""

    def __init__(self, table: pa.Table):
        table = table.combine_chunks().sort_by("to_pivot")
        self.rep, self.copies, self.far = (table.column(c).to_numpy() for c in ("rep", "copies", "to_pivot"))
        self.unit = _matrix(table.column("embedding").combine_chunks())
        self.single = self.unit.astype(np.float32)
        self.counts = np.zeros(len(self.rep), np.int64)

    def told(self):
        some = np.flatnonzero(self.counts)
        return _batch(self.rep[some], self.rep[some], self.counts[some])


def _batch(a, b, links):
    return pa.record_batch({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "links": pa.array(links, pa.int64())})


def _blocks(batches):
    """``(block, passing)``: every block once with itself, then with each stretch that comes by."""
    key, waiting, block = None, [], None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if not table.num_rows:
            continue
        marks = np.stack([table.column(c).to_numpy() for c in ("label", "width", "cell", "block", "side")])
        turns = np.flatnonzero((marks[:, 1:] != marks[:, :-1]).any(axis=0)) + 1
        for start, stop in zip([0, *turns], [*turns, table.num_rows]):
            if key != tuple(marks[:4, start]):
                if waiting:
                    block = _Rows(pa.concat_tables(waiting))
                    yield block, block
                key, waiting, block = tuple(marks[:4, start]), [], None
            rows = table.slice(start, stop - start)
            if marks[4, start] == 0:
                waiting.append(rows)
                continue
            if waiting:
                block, waiting = _Rows(pa.concat_tables(waiting)), []
                yield block, block
            if block is not None:
                yield block, _Rows(rows)
    if waiting:
        block = _Rows(pa.concat_tables(waiting))
        yield block, block


def _pairs(block: _Rows, passing: _Rows, cosine: float, radius: float):
    """Linked ``(i, j)`` of a block and of what comes by, tile by tile."""
    rounding = 1e-6 + 1.2e-7 * block.unit.shape[1]
    for at in range(0, len(passing.rep), TILE // 4):
        to = min(at + TILE // 4, len(passing.rep))
        low = np.searchsorted(block.far, passing.far[at] - radius - SLACK, "left")
        high = np.searchsorted(block.far, passing.far[to - 1] + radius + SLACK, "right")
        if block is passing:
            high = min(high, to)
        for first in range(low, high, TILE):
            last = min(first + TILE, high)
            score = block.single[first:last] @ passing.single[at:to].T
            i, j = np.nonzero(score >= cosine - rounding)
            unsure = np.flatnonzero(score[i, j] < cosine + rounding)
            i, j = i + first, j + at
            keep = i < j if block is passing else np.ones(len(i), bool)
            for part in range(0, len(unsure), 1 << 16):
                at_ = unsure[part:part + (1 << 16)]
                keep[at_] &= (block.unit[i[at_]] * passing.unit[j[at_]]).sum(1) >= cosine
            if keep.any():
                yield i[keep], j[keep]


def _links(cosine: float, radius: float):
    """Link counts per row and a spanning forest, for each block and what comes by."""

    def run(batches):
        held = None
        for block, passing in _blocks(batches):
            if block is not held:
                if held is not None:
                    yield held.told()
                held, root = block, np.arange(len(block.rep))
            for i, j in _pairs(block, passing, cosine, radius):
                block.counts += np.bincount(i, passing.copies[j], len(block.rep)).astype(np.int64)
                passing.counts += np.bincount(j, block.copies[i], len(passing.rep)).astype(np.int64)
                # A passing row hangs on the first row it is linked with, and ties the others to that one.
                linked, at = np.unique(j, return_index=True)
                first = np.zeros(len(passing.rep), np.int64)
                first[linked] = i[at]
                edges = [] if block is passing else [(passing.rep[linked], block.rep[first[linked]])]
                u, v = (i, j) if block is passing else (i, first[j])
                while len(open_ := np.flatnonzero(root[u] != root[v])):  # links between known parts are not news
                    u, v = u[open_], v[open_]
                    high_root, first_of = np.unique(np.maximum(root[u], root[v]), return_index=True)
                    edges.append((block.rep[u[first_of]], block.rep[v[first_of]]))
                    root[high_root] = np.minimum(root[u], root[v])[first_of]
                    while (root[root] != root).any():
                        root = root[root]
                for a, b in edges:
                    yield _batch(a, b, np.zeros(len(a), np.int64))
            if block is not passing:
                yield passing.told()
        if held is not None:
            yield held.told()

    return run


def range_join(
    vectors: DataFrame,
    cosine: float = COSINE,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    label_column: str = "label",
) -> DataFrame:
    """One row per input row: ``vec_id, n_links, component_id, kept``."""
    radius = math.sqrt(2 - 2 * cosine)
    single = isinstance(vectors.schema[vector_column].dataType, T.ArrayType) and isinstance(
        vectors.schema[vector_column].dataType.elementType, T.FloatType
    )
    kind = "array<float>" if single else "array<double>"
    doubles = F.col(vector_column).cast(kind)
    usable = (
        F.col(id_column).isNotNull()
        & F.col(label_column).isNotNull()
        & F.col(vector_column).isNotNull()
        & F.coalesce(F.forall(doubles, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))), F.lit(False))
        & F.coalesce(F.exists(doubles, lambda v: v != 0), F.lit(False))
    )
    rows = vectors.select(
        F.col(id_column).alias("vec_id"),
        F.col(label_column).alias("label"),
        F.when(usable, doubles).alias("embedding"),
    ).withColumn("key", F.when(F.col("embedding").isNotNull(), F.xxhash64("label", "embedding")))
    good = rows.where(F.col("embedding").isNotNull())
    same = ["label", "embedding"]
    reps = cut(
        good.groupBy(*same)
        .agg(F.min("vec_id").alias("rep"), F.count_distinct("vec_id").alias("copies"))
        .withColumn("width", F.size("embedding"))
    )
    members = cut(good.select("vec_id", *same).distinct().join(reps, same).select("vec_id", "rep", "copies"))
    total = reps.count()
    spark = vectors.sparkSession
    share = max(BLOCK, math.ceil(total / (TASKS * spark.sparkContext.defaultParallelism)))
    pivots = _pivots(reps, radius, total, share)
    cells = cut(
        reps.select("rep", F.col("label").cast("int").alias("label"), "width", "copies", "embedding")
        .mapInArrow(
            _cells(pivots, radius),
            f"rep long, label int, width int, copies long, cell int, owner boolean, to_pivot double, embedding {kind}",
        )
    )
    place = ["label", "width", "cell"]
    most = F.greatest(F.lit(1), F.floor(F.lit(HELD_BYTES) / (8 * F.col("width"))))
    sizes = cut(
        cells.where("owner").groupBy(*place).agg(F.count(F.lit(1)).alias("rows"))
        .select(*place, F.ceil(F.col("rows") / F.least(F.lit(share), most)).cast("int").alias("blocks"))
    )
    n, block = F.col("blocks"), F.col("block")
    # Of two blocks of a cell one passes the other: those up to half of the way round.
    last = F.floor((n - 1) / 2) + ((n % 2 == 0) & (block < n / 2)).cast("long")
    ahead = F.when(last >= 1, F.sequence(F.lit(1).cast("long"), last)).otherwise(F.array().cast("array<long>"))
    passes = F.when(F.col("owner"), F.transform(ahead, lambda d: ((block + d) % n).cast("int"))).otherwise(
        F.sequence(F.lit(0), n - 1)
    )
    stays = F.when(F.col("owner"), F.array(F.struct(block.alias("block"), F.lit(0).alias("side"))))
    goes = F.transform(passes, lambda o: F.struct(o.alias("block"), F.lit(1).alias("side")))
    dealt = cells.join(sizes, place).withColumn("block", F.pmod(F.xxhash64("rep"), n).cast("int"))
    tasks = dealt.select(
        *place, "rep", "copies", "to_pivot", "embedding",
        F.inline(F.concat(F.coalesce(stays, F.array().cast("array<struct<block:int,side:int>>")), goes)),
    )
    number = 2 * (sizes.agg(F.sum("blocks")).first()[0] or 1)
    together = tasks.repartition(number, *place, "block").sortWithinPartitions(*place, "block", "side")
    found = cut(together.mapInArrow(_links(cosine, radius), "a long, b long, links long"))
    links = found.where("links > 0").groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links"))
    parts = connected_components(
        reps.select(F.col("rep").alias("node")), found.where("a <> b").select("a", "b")
    )
    # Copies among themselves: the computed cosine of a vector with itself, as for other pairs.
    selfsame = F.when(F.col("copies") > 1, F.col("copies") - 1).otherwise(F.lit(0))
    told = (
        members.join(links, "rep", "left")
        .join(parts.withColumnRenamed("node", "rep"), "rep")
        .select(
            F.col("vec_id").alias("_vec"),
            (F.coalesce("links", F.lit(0)) + selfsame).alias("n_links"),
            F.col("component").alias("component_id"),
        )
    )
    ids = told.groupBy("_vec").agg(F.max("n_links").alias("n_links"), F.min("component_id").alias("component_id"))
    out = rows.select("vec_id").join(ids, F.col("vec_id") == F.col("_vec"), "left")
    return out.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
        F.coalesce("component_id", "vec_id").eqNullSafe(F.col("vec_id")).alias("kept"),
    )
