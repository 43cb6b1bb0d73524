"""Upserts and versioned snapshot tables.

No table format with MERGE is assumed. A write goes to a new version folder and becomes
visible when its success marker exists, so readers see whole snapshots only and a failed
writer leaves the previous one in place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def newest(updates: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row per key by ``order``, combined map side."""
    rest = [c for c in updates.columns if c not in keys]
    last = updates.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_last"))
    return last.select(*keys, "_last.*")


def upsert(target: DataFrame, updates: DataFrame, keys: list[str]) -> DataFrame:
    """``updates`` (unique per key) replace or extend the rows of ``target``."""
    kept = target.join(updates.select(*keys), keys, "left_anti")
    return kept.unionByName(updates, allowMissingColumns=True)


def _fs(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs
    root = hadoop.Path(path)
    return hadoop, root, root.getFileSystem(spark._jsc.hadoopConfiguration())


def versions(spark: SparkSession, path: str) -> list[int]:
    """Complete versions of a table, oldest first."""
    hadoop, root, fs = _fs(spark, path)
    if not fs.exists(root):
        return []
    found = []
    for entry in fs.listStatus(root):
        name = entry.getPath().getName()
        if name.startswith("version=") and fs.exists(hadoop.Path(entry.getPath(), "_SUCCESS")):
            found.append(int(name.removeprefix("version=")))
    return sorted(found)


def write_snapshot(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> int:
    """Write the next version and return its number."""
    done = versions(df.sparkSession, path)
    number = (done[-1] if done else 0) + 1
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(f"{path}/version={number}")
    return number


def read_snapshot(spark: SparkSession, path: str, version: int | None = None) -> DataFrame | None:
    """The given or newest complete version; None where there is none yet."""
    done = versions(spark, path)
    if not done:
        return None
    return spark.read.parquet(f"{path}/version={version or done[-1]}")


def drop_old(spark: SparkSession, path: str, keep: int = 2) -> None:
    hadoop, root, fs = _fs(spark, path)
    for number in versions(spark, path)[:-keep]:
        fs.delete(hadoop.Path(root, f"version={number}"), True)
