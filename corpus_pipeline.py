"""A corpus pipeline of five training-data operators, each stage written and read again.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that the one before it kept. All but the
last return the columns of documents; the last returns the packed pieces. SQL cannot express the
stages (a learned score, signatures, suffix order, packing), so their tests use brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventlens.llm import bagminhash, exact_dedup, packing, suffixes, toxicity
from eventlens.llm.common import table, tokenizer_path
from eventlens.session import cut

TOKENIZER, END_ID = "word_bpe_49k.json", 2


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go; the lexicon is learned from the labels of what came in."""
    return toxicity.keep_clean(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one document stays."""
    return exact_dedup.drop_exact(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates one document stays."""
    return bagminhash.drop_near(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated 200-byte strings are cut out of the texts, and ``n_chars`` follows."""
    done = suffixes.drop_repeats(docs)
    if "n_chars" in done.columns:
        done = done.withColumn("n_chars", F.char_length("text").cast("long"))
    return done


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training sequences of what is left."""
    return packing.pack_documents(docs, tokenizer_path(TOKENIZER), END_ID)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("suffix_dedup", cut_repeats),
    ("packing", pack),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
