"""Preference formatting: shared turns once as prompt, then paired masked completions.

The input is two tables of turns, chosen and rejected, that share a pair id. The longest common
turn prefix of a pair ends before the first turn at which the two differ in role or text, or
which only one of them has. Its turns are rendered once (``part = 'prompt'``), the remaining
turns of both sides as ``'chosen'`` and ``'rejected'``. In completions the characters of
assistant turns and their end marker are trained; everything else is masked.

A result row is one rendered turn, so that no conversation is ever gathered into one task: the
prefix length is a minimum per pair, combined before the shuffle, and the turns of both sides
meet by (pair, turn). Concatenating ``piece`` by ``turn`` gives the texts. Only DataFrame
functions are used.

Defined cases: a null text is empty, a null role is ``unknown``; null pair ids form one pair and a
null turn precedes all others. Of rows that repeat a (pair, turn), the one with the smallest
(role, text) counts. A pair without difference is all prompt; a side that is a prefix of the other
has no completion rows. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The markers around a turn.
TURN_START, TURN_END = "<|im_start|>", "<|im_end|>\n"
TRAINED_ROLE = "assistant"


def _side(turns: DataFrame, name: str, pair: str, turn: str) -> DataFrame:
    said = F.struct(
        F.coalesce("role", F.lit("unknown")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    return turns.select(
        F.col(pair).alias("pair_id"), F.coalesce(turn, F.lit(-1)).alias("turn"), said.alias("said"),
        F.lit(name).alias("side"),
    )


def _piece(said: Column) -> tuple[Column, Column, Column]:
    """Rendered text, and where its trained characters would begin and end."""
    head = F.concat(F.lit(TURN_START), said["role"], F.lit("\n"))
    piece = F.concat(head, said["text"], F.lit(TURN_END))
    return piece, F.char_length(head), F.char_length(piece) - 1


def preference_turns(
    chosen: DataFrame, rejected: DataFrame, pair: str = "pair_id", turn: str = "turn"
) -> DataFrame:
    """``pair_id, part, turn, role, piece, trained_from, trained_to``; the trained
    characters of ``piece`` are ``[trained_from, trained_to)``, both 0 where all is masked."""
    both = _side(chosen, "chosen", pair, turn).unionByName(_side(rejected, "rejected", pair, turn))
    met = both.groupBy("pair_id", "turn").agg(
        F.min(F.when(F.col("side") == "chosen", F.col("said"))).alias("chosen"),
        F.min(F.when(F.col("side") == "rejected", F.col("said"))).alias("rejected"),
    )
    differs = ~F.col("chosen").eqNullSafe(F.col("rejected"))
    ends = met.groupBy("pair_id").agg(
        F.min(F.when(differs, F.col("turn"))).alias("first_difference"),
    )
    placed = met.join(
        ends.withColumnRenamed("pair_id", "_pair"), F.col("pair_id").eqNullSafe(F.col("_pair"))
    )
    in_prompt = F.col("first_difference").isNull() | (F.col("turn") < F.col("first_difference"))
    parts = F.when(
        in_prompt, F.array(F.struct(F.lit("prompt").alias("part"), F.col("chosen").alias("said")))
    ).otherwise(
        F.array(
            F.struct(F.lit("chosen").alias("part"), F.col("chosen").alias("said")),
            F.struct(F.lit("rejected").alias("part"), F.col("rejected").alias("said")),
        )
    )
    turns = placed.select("pair_id", "turn", F.inline(parts)).where(F.col("said").isNotNull())
    piece, start, stop = _piece(F.col("said"))
    trained = (F.col("part") != "prompt") & (F.col("said.role") == TRAINED_ROLE)
    return turns.select(
        "pair_id",
        "part",
        "turn",
        F.col("said.role").alias("role"),
        piece.alias("piece"),
        F.when(trained, start).otherwise(F.lit(0)).cast("long").alias("trained_from"),
        F.when(trained, stop).otherwise(F.lit(0)).cast("long").alias("trained_to"),
    )


def regenerated(conversations: DataFrame) -> DataFrame:
    """Rejected sides for a table of plain conversations, as ``conv_id, turn, role, text``.

    From turn ``conv_id % turns`` on, each assistant turn says what the assistant turn two before
    it said; a conversation without such a turn, or without an id, stays as it is.
    """
    sizes = conversations.groupBy(F.col("conv_id").alias("_sized")).agg(F.count(F.lit(1)).alias("turns"))
    before = conversations.where(F.col("role") == TRAINED_ROLE).select(
        F.col("conv_id").alias("_conv"), (F.col("turn") + 2).alias("_turn"), F.col("text").alias("_text")
    )
    late = F.col("turn") >= F.pmod("conv_id", "turns")
    swapped = (F.col("role") == TRAINED_ROLE) & late & F.col("_conv").isNotNull()
    return (
        conversations.select("conv_id", "turn", "role", "text")
        .join(sizes, F.col("conv_id").eqNullSafe(F.col("_sized")))
        .join(
            before,
            (F.col("conv_id") == F.col("_conv")) & (F.col("turn") == F.col("_turn")),
            "left",
        )
        .select(
            "conv_id", "turn", "role",
            F.when(swapped, F.col("_text")).otherwise(F.col("text")).alias("text"),
        )
    )
