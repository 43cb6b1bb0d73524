"""Running totals and extrema over long orders without a one-task window.

A global sort gives every row a position. Running values are computed inside each sort
partition and then shifted by the totals of the partitions before it, so no task ever holds
more than one sort partition, however many rows share a key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventlens.session import cut

POSITION = "_position"
AGGREGATES = {"sum": F.sum, "max": F.max, "min": F.min}


def positioned(df: DataFrame, order: Sequence[Column], name: str = POSITION) -> DataFrame:
    """Add a number that grows along ``order``; written out so that it never changes."""
    return cut(df.orderBy(*order).withColumn(name, F.monotonically_increasing_id()))


def _merge(how: str, left: Column, right: Column) -> Column:
    if how == "sum":
        return F.when(left.isNull(), right).otherwise(left + F.coalesce(right, F.lit(0)))
    better = left >= right if how == "max" else left <= right
    return F.when(right.isNull() | better, left).otherwise(right)


def running(
    df: DataFrame,
    keys: Sequence[str],
    values: dict[str, tuple[str, Column]],
    before: bool = False,
    descending: bool = False,
    position: str = POSITION,
) -> DataFrame:
    """Add running values per key along ``position``.

    ``values`` maps a new column to ``(how, value)`` with how in sum, max, min. ``before``
    leaves each row itself out; ``descending`` runs from the end.
    """
    part = "_part"
    direction = (lambda c: F.col(c).desc()) if descending else (lambda c: F.col(c).asc())
    keyed = df.select(
        "*",
        F.shiftright(position, 33).alias(part),
        *[value.alias(f"_v_{name}") for name, (_, value) in values.items()],
    )
    totals = keyed.groupBy(*keys, part).agg(
        *[AGGREGATES[how](f"_v_{name}").alias(f"_t_{name}") for name, (how, _) in values.items()]
    )
    across = Window.partitionBy(*keys).orderBy(direction(part)).rowsBetween(
        Window.unboundedPreceding, -1
    )
    shifts = totals.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys],
        F.col(part).alias("_k_part"),
        *[AGGREGATES[how](f"_t_{name}").over(across).alias(f"_s_{name}")
          for name, (how, _) in values.items()],
    )
    inside = Window.partitionBy(*keys, part).orderBy(direction(position)).rowsBetween(
        Window.unboundedPreceding, -1 if before else Window.currentRow
    )
    local = keyed.select(
        *df.columns,
        part,
        *[AGGREGATES[how](f"_v_{name}").over(inside).alias(f"_l_{name}")
          for name, (how, _) in values.items()],
    )
    condition = F.col(part) == F.col("_k_part")
    for key in keys:
        condition = condition & F.col(key).eqNullSafe(F.col(f"_k_{key}"))
    return local.join(shifts, condition, "left").select(
        *df.columns,
        *[_merge(how, F.col(f"_s_{name}"), F.col(f"_l_{name}")).alias(name)
          if how == "sum" else
          F.when(F.col(f"_s_{name}").isNull(), F.col(f"_l_{name}"))
          .otherwise(_merge(how, F.col(f"_s_{name}"), F.col(f"_l_{name}"))).alias(name)
          for name, (how, _) in values.items()],
    )


def prefix_within(
    df: DataFrame, keys: Sequence[str], amount: Column, limit, order: Sequence[Column]
) -> DataFrame:
    """The leading rows of every key whose running (non-negative) amount stays within ``limit``."""
    totals = running(positioned(df, order), keys, {"running_total": ("sum", amount)})
    return totals.where(F.col("running_total") <= limit).drop(POSITION)
