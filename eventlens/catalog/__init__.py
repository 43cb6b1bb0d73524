"""Named queries over the test tables, each with the SQL that checks it where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(run: Query) -> Query:
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return register


def stamp(column: str) -> Column:
    """Timestamp as text, so that engines with different zone rules agree."""
    return F.date_format(F.col(column), "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(column)


def listed(column, name: str) -> Column:
    """Array of text as one text."""
    return F.array_join(column, "|").alias(name)


def big(*columns: str) -> list[Column]:
    return [F.col(c).cast("bigint").alias(c) for c in columns]


def load_all() -> None:
    from eventlens.catalog import documents, feeds, ledgers, people  # noqa: F401
