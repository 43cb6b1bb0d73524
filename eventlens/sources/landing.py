"""Landed payload files as a table and as a stream, through Spark's file sources.

A landing folder holds one file per downloaded payload under ``source_id=.../type=...``.
``landing`` is also registered as a data source, so that other readers can be plugged in
behind the same schema; each file is one partition and nothing is fetched.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "source_id string, type string, format string, rank bigint, payload_id string, base_url string, payload string"
_BINARY = "path string, modificationTime timestamp, length bigint, content binary"


def _shaped(files: DataFrame, sources: DataFrame | None) -> DataFrame:
    part = lambda key: F.regexp_extract("path", rf"/{key}=([^/]*)/", 1)
    rows = files.select(
        part("source_id").alias("source_id"),
        part("type").alias("type"),
        F.nullif(part("format"), F.lit("")).alias("format"),
        F.coalesce(F.regexp_extract("path", r"/(\d+)\.[^/]*$", 1).try_cast("bigint"), F.lit(0)).alias("rank"),
        F.col("path").alias("payload_id"),
        F.decode("content", "UTF-8").alias("payload"),
    )
    if sources is None:
        return rows.withColumn("base_url", F.lit(None).cast("string"))
    return rows.join(sources.select("source_id", F.col("url").alias("base_url")), "source_id", "left")


def read_landing(spark: SparkSession, path: str, sources: DataFrame | None = None) -> DataFrame:
    """All landed payloads below ``path``; whole files, read where they are stored."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return _shaped(files, sources)


def stream_landing(spark: SparkSession, path: str, sources: DataFrame | None = None) -> DataFrame:
    """New payload files as a stream."""
    files = (
        spark.readStream.schema(_BINARY)
        .format("binaryFile")
        .option("recursiveFileLookup", True)
        .load(path)
    )
    return _shaped(files, sources)


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, root: str):
        self.root = root

    def partitions(self):
        return [
            _File(os.path.join(folder, name))
            for folder, _, names in sorted(os.walk(self.root))
            for name in sorted(names)
        ]

    def read(self, partition):
        keys = dict(p.split("=", 1) for p in partition.path.split(os.sep) if "=" in p)
        stem = os.path.basename(partition.path).split(".")[0]
        with open(partition.path, encoding="utf-8") as handle:
            payload = handle.read()
        yield (
            keys.get("source_id"), keys.get("type"), keys.get("format"),
            int(stem) if stem.isdigit() else 0, partition.path, None, payload,
        )


class LandingSource(DataSource):
    """``spark.read.format("landing").load(path)`` over a folder every executor mounts."""

    @classmethod
    def name(cls):
        return "landing"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Reader(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(LandingSource)
