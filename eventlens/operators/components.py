"""Connected components by minimum label and pointer jumping, one written table per round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventlens.session import cut


def connected_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(node, component)`` for ``nodes (node)`` and ``edges (a, b)``; a component is named
    after its smallest node. Edges may be listed in one direction and repeatedly.

    Per round every node takes the smallest label among its neighbours (an aggregation that
    combines map side, so a hub costs one row per task) and then the label of its label, which
    halves the remaining distance.
    """
    both = cut(
        edges.select("a", "b")
        .unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        .where(F.col("a") != F.col("b"))
        .distinct()
    )
    first = both.groupBy("a").agg(F.min("b").alias("low"))
    linked = cut(first.select(F.col("a").alias("node"), F.least("a", "low").alias("component")))
    while True:
        spread = (
            both.join(linked.select(F.col("node").alias("b"), F.col("component").alias("seen")), "b")
            .groupBy("a")
            .agg(F.min("seen").alias("seen"))
        )
        lowered = linked.join(spread.withColumnRenamed("a", "node"), "node").select(
            "node",
            F.least("component", "seen").alias("label"),
            F.col("component").alias("before"),
        )
        jump = linked.select(F.col("node").alias("label"), F.col("component").alias("further"))
        stepped = cut(
            lowered.join(jump, "label", "left").select(
                "node", F.least("label", F.coalesce("further", "label")).alias("component"), "before"
            )
        )
        changed = stepped.where(F.col("component") < F.col("before")).limit(1).count()
        linked = stepped.drop("before")
        if not changed:
            break
    return nodes.select("node").join(linked, "node", "left").select(
        "node", F.coalesce("component", "node").alias("component")
    )
