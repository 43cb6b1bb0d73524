"""Session defaults, durable lineage cuts, and size-checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RUNTIME_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}
STREAM_DEFAULTS = {
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
}
# A side above this many rows is joined by shuffle, whatever the caller expected of it.
BROADCAST_ROWS = 200_000


def session(cpus: str = "*", partitions: int = 8, memory: str = "20g") -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("eventlens")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
    )
    for key, value in {**RUNTIME_DEFAULTS, **STREAM_DEFAULTS}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings that results depend on (UTC) or plans rely on (AQE)."""
    for key, value in RUNTIME_DEFAULTS.items():
        spark.conf.set(key, value)
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder the cluster names; a private one only where none is named."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    return _private_root()


@cache
def _private_root() -> str:
    """One folder per process, for tests under a local master that name none."""
    return tempfile.mkdtemp(prefix="spark-checkpoint-")


_SCOPE: ContextVar[list[str] | None] = ContextVar("tables written by cut", default=None)


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back.

    Loops restart from files when executors are lost, every reader sees the same rows, and
    the file sizes give the planner true statistics. A plain table is used instead of
    ``checkpoint()`` because the latter carries the constraints of the old plan along, which
    multiply from round to round.
    """
    spark = df.sparkSession
    path = f"{checkpoint_root(spark).rstrip('/')}/eventlens-{uuid.uuid4().hex}"
    df.write.parquet(path)
    written = _SCOPE.get()
    if written is not None:
        written.append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Delete at the end the tables that ``cut`` writes inside, and no others: plans of other
    threads and queries keep theirs."""
    written: list[str] = []
    token = _SCOPE.set(written)
    try:
        yield
    finally:
        _SCOPE.reset(token)
        hadoop = spark._jvm.org.apache.hadoop.fs
        for name in written:
            path = hadoop.Path(name)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def intact(df: DataFrame) -> bool:
    """Whether the files of a written table are still there."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(next(iter(df.inputFiles()), "/missing"))
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def spread(df: DataFrame, most: int = 256 << 20) -> DataFrame:
    """Deal a small input, which may be one row group, out to all cores before costly
    per-row work. Larger inputs have enough splits of their own and stay where they are."""
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    if int(str(size)) > most:
        return df
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism)


def dealt(df: DataFrame) -> DataFrame:
    """A side that grows with the input and is joined again and again: shuffled, since every
    broadcast passes through the driver."""
    return df.hint("merge")


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only after counting that the side has at most ``limit`` rows."""
    rows = df.limit(limit + 1).count()
    return F.broadcast(df) if rows <= limit else df
