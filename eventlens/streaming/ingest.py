"""The ingest round as a stream: one round per micro-batch over the stored tables."""

from __future__ import annotations

from dataclasses import fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventlens.config import DEFAULTS, Settings
from eventlens.plans.ingest import IngestTables, empty_tables, run_ingest
from eventlens.session import cut, scope
from eventlens.sources.store import Store, changed_rows

#: The stored tables and their keys.
KEYS = {
    "articles": ["article_id"],
    "observations": ["source_id", "external_id"],
    "vectors": ["article_id"],
    "members": ["article_id"],
    "clusters": ["cluster_id"],
}
STORED = [f.name for f in fields(IngestTables) if f.name != "sources"]


def load_tables(spark: SparkSession, root: str, sources: DataFrame, version: int | None = None) -> IngestTables:
    """Stored tables of a finished round, or empty ones before the first."""
    store, blank = Store(spark, root, KEYS), empty_tables(spark, sources)
    found = {name: store.read(name, version) for name in STORED}
    return IngestTables(
        sources=sources, **{name: getattr(blank, name) if found[name] is None else found[name] for name in STORED}
    )


def finished_round(spark: SparkSession, root: str) -> int:
    """Number of the newest version, in which the last round is complete."""
    return Store(spark, root, KEYS).manifest().number


def store_round(store: Store, before: IngestTables, after: IngestTables, info: dict) -> int:
    """Make a round visible: the rows that it changed, all tables at once."""
    changes = {}
    for name in STORED:
        upserts, gone = changed_rows(getattr(before, name), getattr(after, name), KEYS[name])
        upserts, gone = cut(upserts), cut(gone)
        if not (upserts.isEmpty() and gone.isEmpty()):
            changes[name] = (upserts, gone)
    number = store.commit(changes, info)
    for name in changes:
        store.compact(name)
    return number


def ingest_stream(
    candidates: DataFrame,
    root: str,
    sources: DataFrame,
    checkpoint: str,
    as_of=None,
    settings: Settings = DEFAULTS,
):
    """Start a query that applies every micro-batch of candidates to the tables under ``root``.

    A batch that was already applied is skipped when it is delivered again after a failure,
    since its id is in the manifest of the round that applied it.
    """

    def apply(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        store = Store(spark, root, KEYS)
        if store.manifest().info.get("batch_id", -1) >= batch_id:
            return
        tables = load_tables(spark, root, sources)
        # One moment for all jobs of the round, stored with it.
        moment = as_of if as_of is not None else F.lit(spark.range(1).select(F.current_timestamp()).first()[0])
        with scope(spark):
            result = run_ingest(tables, batch, moment, settings)
            counts = result.metrics.first().asDict()
            store_round(store, tables, result.tables, {"batch_id": batch_id, "as_of": str(moment), "metrics": counts})

    return (
        candidates.writeStream.foreachBatch(apply)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
