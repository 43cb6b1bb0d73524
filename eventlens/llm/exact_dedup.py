"""Exact duplicates: group by a 128-bit content hash, compare bytes inside groups.

Two texts are copies when they are identical after every space, tab, line feed, vertical tab,
form feed and carriage return is deleted. Everything here is DataFrame code.

* Narrow rows (id, 128-bit hash, digest, code points) give each group its best row in one
  aggregation that combines before the shuffle: a text that a third of all rows share costs one
  row per task.
* Bytes: rows are grouped by (hash, text) itself, again combined before the shuffle, so that a
  group's size counts equal bytes only. Two texts that share the 128-bit hash become two classes
  and are told apart by their digest in the narrow joins.

Defined cases: a null text is empty; texts that are empty or hold only white space are copies of
each other. A null id sorts after every other id. Rows that repeat an id all count in
``group_size`` and share that id's decision. An empty table gives no rows. Columns other than
the named id and text are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventlens.llm.common import text_of

#: The deleted characters.
BLANKS = (" ", "\t", "\n", "\x0b", "\x0c", "\r")


def squeezed(text: Column) -> Column:
    """The text without blanks. One byte search per blank is faster than a pattern here."""
    for blank in BLANKS:
        text = F.replace(text, F.lit(blank), F.lit(""))
    return text


def exact_groups(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``."""
    plain = squeezed(text_of(text_column))
    rows = docs.select(
        F.col(id_column).alias("doc_id"),
        F.char_length(text_of(text_column)).cast("long").alias("points"),
        plain.alias("plain"),
    )
    hashed = F.unhex(F.md5("plain")).alias("hash")
    digest = F.unhex(F.sha2("plain", 256)).alias("digest")
    narrow = rows.select("doc_id", "points", hashed, digest)
    # The complement turns the order of ids around without leaving their range.
    best = F.max(F.struct("points", F.bitwise_not("doc_id").alias("low")))
    keeps = narrow.groupBy("hash", "digest").agg(F.bitwise_not(best["low"]).alias("keep_id"))
    classes = (
        rows.select(hashed, "plain")
        .groupBy("hash", "plain")
        .agg(F.count(F.lit(1)).alias("group_size"))
        .select("hash", digest, "group_size")
    )
    groups = keeps.join(classes, ["hash", "digest"])
    return narrow.join(groups, ["hash", "digest"]).select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_exact(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, all columns kept; rows that repeat an id and its text stay
    together, and null ids are told apart by their texts."""
    groups = exact_groups(docs, id_column, text_column)
    out = groups.where(~F.col("kept")).select(
        F.col("doc_id").alias("_dropped_id"), F.col("text_sha256").alias("_dropped_text")
    ).distinct()
    same_id = docs[id_column].eqNullSafe(out["_dropped_id"])
    same_text = F.sha2(squeezed(text_of(text_column)), 256) == out["_dropped_text"]
    return docs.join(out, same_id & same_text, "left_anti")
