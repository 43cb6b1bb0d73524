"""Line dedup: a line that several documents hold stays in the one with the smallest id.

Documents are exploded to the keys of their lines, kept as two 64-bit hashes with different seeds.
Documents are counted per key in two steps, per ``(key, salt)`` and per key, both of which combine
before the shuffle; the salt comes from the document. A line that a third of all documents hold is
thus spread over ``SALTS`` groups, and the keys that several documents hold go back to the lines as
exactly the ``(key, salt)`` pairs that occur. Each text is then put together again by the positions
that stay. Everything here is DataFrame code.

Defined cases: a null or empty text is one empty line. Lines are counted per id, so a line that one
document repeats is not shared, and rows that repeat an id count as one document: all of them keep
the lines which that id keeps. A null id comes after every other id; rows with null ids count as
one document. Keys are compared by 128 bits of hash. An empty table gives no rows; other columns
are ignored by ``line_report`` and kept by ``drop_lines``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventlens.llm.common import quoted, text_of
from eventlens.session import cut, spread

#: What is stripped at the ends of a line, and the letters that are lowered.
BLANKS, CAPITALS = " \t\n\x0b\x0c\r", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: A key needs this many code points, and this many documents, for its lines to go.
LEAST_POINTS, LEAST_DOCUMENTS = 10, 2
#: Groups over which the documents of one key are spread.
SALTS = 64
#: Input up to this size, which may be one row group, is dealt out to all cores.
DEALT = 32 << 20


def line_key(line: Column) -> Column:
    """The line without blanks at both ends and with A-Z lowered. ``lower`` is the cheaper way where
    the line has ASCII characters only; elsewhere it would lower other letters too."""
    plain = F.btrim(line, F.lit(BLANKS))
    ascii_only = F.octet_length(plain) == F.char_length(plain)
    return F.when(ascii_only, F.lower(plain)).otherwise(F.translate(plain, CAPITALS, CAPITALS.lower()))


def _keyed(rows: DataFrame, least_points: int) -> DataFrame:
    """A row per line whose key is long enough: its document, row, position and key hashes."""
    lines = rows.select(
        "doc_id", "row_a", "row_b", F.posexplode(F.split("text", "\n", -1)).alias("place", "line")
    ).select("doc_id", "row_a", "row_b", "place", line_key(F.col("line")).alias("key"))
    return lines.where(F.char_length("key") >= least_points).select(
        "doc_id", "row_a", "row_b", "place",
        F.xxhash64("key").alias("key_a"),
        F.xxhash64(F.lit(11), "key").alias("key_b"),
        F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int").alias("salt"),
    )


def shared_keys(keyed: DataFrame, least_documents: int = LEAST_DOCUMENTS) -> DataFrame:
    """``(key_a, key_b, salt, keep_id)`` for the keys that enough documents hold, one row for each
    salt under which they occur."""
    once = keyed.select("key_a", "key_b", "salt", "doc_id")
    if least_documents > 2:  # documents are counted; for two, the smallest and largest id tell
        once = once.distinct()
    salted = once.groupBy("key_a", "key_b", "salt").agg(
        F.min("doc_id").alias("low"),
        F.max("doc_id").alias("high"),
        F.max(F.col("doc_id").isNull().cast("int")).alias("no_id"),
        F.count(F.lit(1)).alias("n"),
    )
    several = (F.col("low") < F.col("high")) | (F.col("no_id") + F.col("low").isNotNull().cast("int") > 1)
    groups = salted.groupBy("key_a", "key_b").agg(
        F.min("low").alias("low"),
        F.max("high").alias("high"),
        F.max("no_id").alias("no_id"),
        F.sum("n").alias("n"),
        F.collect_list("salt").alias("salts"),
    )
    enough = several if least_documents <= 2 else F.col("n") >= least_documents
    return groups.where(enough).select("key_a", "key_b", F.col("low").alias("keep_id"), F.explode("salts").alias("salt"))


def _told(docs: DataFrame, id_column: str, text_column: str, least_points: int, least_documents: int) -> DataFrame:
    """Each row's ``doc_id``, ``row_a``, ``row_b``, lines and the positions ``out`` that go."""
    text = text_of(text_column)
    rows = docs.select(
        F.col(id_column).cast("long").alias("doc_id"),
        F.xxhash64(id_column, text).alias("row_a"),
        F.xxhash64(F.lit(7), text, id_column).alias("row_b"),
        text.alias("text"),
    )
    keyed = cut(_keyed(spread(rows, DEALT), least_points))
    gone = (
        keyed.join(shared_keys(keyed, least_documents), ["key_a", "key_b", "salt"])
        .where(~F.col("doc_id").eqNullSafe(F.col("keep_id")))
        .groupBy("row_a", "row_b")
        .agg(F.collect_set("place").alias("out"))
    )
    split = rows.select("doc_id", "row_a", "row_b", F.split("text", "\n", -1).alias("lines"))
    return split.join(gone, ["row_a", "row_b"], "left")


def _kept_text() -> Column:
    """The lines that stay, in order. ``array_except`` works by hashing, so a text of many lines
    costs linear time."""
    places = F.sequence(F.lit(0), F.size("lines") - 1)
    kept = F.transform(F.array_except(places, F.col("out")), lambda k: F.get(F.col("lines"), k))
    return F.array_join(F.when(F.col("out").isNull(), F.col("lines")).otherwise(kept), "\n")


def line_report(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    least_points: int = LEAST_POINTS,
    least_documents: int = LEAST_DOCUMENTS,
) -> DataFrame:
    """One row per input row: ``doc_id, n_lines, n_dropped, kept_sha256``."""
    told = _told(docs, id_column, text_column, least_points, least_documents)
    return told.select(
        "doc_id",
        F.size("lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("out"), F.lit(0)).cast("long").alias("n_dropped"),
        F.sha2(_kept_text(), 256).alias("kept_sha256"),
    )


def drop_lines(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    least_points: int = LEAST_POINTS,
    least_documents: int = LEAST_DOCUMENTS,
) -> DataFrame:
    """``docs`` with shared lines taken out of the texts; all rows and columns stay, null texts too."""
    told = _told(docs, id_column, text_column, least_points, least_documents).where("out IS NOT NULL")
    changed = told.select(
        F.col("row_a").alias("_row_a"), F.col("row_b").alias("_row_b"), _kept_text().alias("_kept")
    ).dropDuplicates(["_row_a", "_row_b"])
    row_id, text = F.col(quoted(id_column)), text_of(quoted(text_column))
    same = (F.xxhash64(row_id, text) == F.col("_row_a")) & (F.xxhash64(F.lit(7), text, row_id) == F.col("_row_b"))
    columns = [
        F.coalesce(F.col("_kept"), F.col(quoted(c))).alias(c) if c == text_column else F.col(quoted(c))
        for c in docs.columns
    ]
    return docs.join(changed, same, "left").select(*columns)
