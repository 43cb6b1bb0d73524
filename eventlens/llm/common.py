"""Shared helpers: input tables, null handling, document identity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventlens.session import prepare


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """A test table by Spark's reader, so that any store Spark knows can hold it."""
    # Texts are long: small Arrow batches keep the Python workers small.
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    return prepare(spark).read.parquet(f"{directory.rstrip('/')}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """The text; null counts as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def quoted(column: str) -> str:
    """A column's name in back quotes, whatever characters it holds."""
    return "`" + column.replace("`", "``") + "`"


def tokenizer_path(name: str) -> str:
    """Place of a vocabulary file of the installed collection; operators take any path."""
    import public_tokenizers

    return public_tokenizers.path(name)
