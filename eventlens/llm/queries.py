"""The registered queries of the training-data operators, each with SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from eventlens.llm import (
    bagminhash, exact_dedup, line_dedup, metric_join, packing, page_diff, preference, runs, segment_bpe, suffixes,
    token_align, token_files, toxicity,
)
from eventlens.llm.common import table, tokenizer_path

#: Vocabulary files of the tokenizer collection.
WORDS, BYTES, PIECES = "word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"
Query = Callable[[SparkSession, str], DataFrame]


def op9_exact_dedup(spark: SparkSession, directory: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, directory, "documents"))


OP9_SQL = r"""
WITH rows AS (
  SELECT doc_id, length(coalesce(text, '')) AS points,
    translate(coalesce(text, ''), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')
      AS plain
  FROM documents
), groups AS (
  SELECT plain, count(*) AS group_size,
    arg_min(doc_id, struct_pack(a := -points, b := doc_id)) AS keep_id
  FROM rows GROUP BY plain
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(plain) AS text_sha256
FROM rows JOIN groups USING (plain)
"""


def op5_preference_format(spark: SparkSession, directory: str) -> DataFrame:
    conversations = table(spark, directory, "conversations")
    return preference.preference_turns(
        conversations.withColumnRenamed("conv_id", "pair_id"),
        preference.regenerated(conversations).withColumnRenamed("conv_id", "pair_id"),
    )


OP5_SQL = r"""
WITH sizes AS (SELECT conv_id, count(*) AS turns FROM conversations GROUP BY conv_id),
sides AS (
  SELECT c.conv_id AS pair_id, c.turn, c.role, c.text AS chosen,
    CASE WHEN c.role = 'assistant' AND c.turn >= c.conv_id % s.turns AND b.conv_id IS NOT NULL
      THEN b.text ELSE c.text END AS rejected
  FROM conversations c JOIN sizes s ON s.conv_id = c.conv_id
  LEFT JOIN conversations b
    ON b.conv_id = c.conv_id AND b.turn = c.turn - 2 AND b.role = 'assistant'
), ends AS (
  SELECT pair_id, min(turn) FILTER (WHERE chosen <> rejected) AS cut FROM sides GROUP BY pair_id
), parts AS (
  SELECT pair_id, 'prompt' AS part, turn, role, chosen AS text FROM sides JOIN ends USING (pair_id)
  WHERE cut IS NULL OR turn < cut
  UNION ALL
  SELECT pair_id, 'chosen', turn, role, chosen FROM sides JOIN ends USING (pair_id) WHERE turn >= cut
  UNION ALL
  SELECT pair_id, 'rejected', turn, role, rejected FROM sides JOIN ends USING (pair_id)
  WHERE turn >= cut
), pieces AS (
  SELECT *, '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) AS piece,
    part <> 'prompt' AND role = 'assistant' AS trained
  FROM parts
)
SELECT pair_id, part, turn, role, piece,
  CASE WHEN trained THEN length('<|im_start|>' || role || chr(10)) ELSE 0 END::BIGINT AS trained_from,
  CASE WHEN trained THEN length(piece) - 1 ELSE 0 END::BIGINT AS trained_to
FROM pieces
"""

def op3_toxicity(spark: SparkSession, directory: str) -> DataFrame:
    docs = table(spark, directory, "documents")
    return toxicity.score(docs, toxicity.learn(docs, table(spark, directory, "labels")))


def op10_metric_join(spark: SparkSession, directory: str) -> DataFrame:
    return metric_join.range_join(table(spark, directory, "embeddings"))


def op1_page_diff(spark: SparkSession, directory: str) -> DataFrame:
    return page_diff.page_texts(table(spark, directory, "pages"))


def op2_simple8b_tokens(spark: SparkSession, directory: str) -> DataFrame:
    path = token_files.new_path(spark)
    token_files.write_tokens(table(spark, directory, "documents"), path, tokenizer_path(WORDS), end_id=1)
    return token_files.read_tokens(spark, path)


def op4_segment_bpe(spark: SparkSession, directory: str) -> DataFrame:
    return segment_bpe.coded(table(spark, directory, "documents"), tokenizer_path(BYTES))


def op6_bagminhash(spark: SparkSession, directory: str) -> DataFrame:
    return bagminhash.near_classes(table(spark, directory, "documents"))


def op7_vector_packing(spark: SparkSession, directory: str) -> DataFrame:
    return packing.pack_documents(table(spark, directory, "documents"), tokenizer_path(WORDS), end_id=2)


def op8_suffix_dedup(spark: SparkSession, directory: str) -> DataFrame:
    return suffixes.repeats_removed(table(spark, directory, "documents"))


def op11_line_dedup(spark: SparkSession, directory: str) -> DataFrame:
    return line_dedup.line_report(table(spark, directory, "documents"))


OP11_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
    unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS place
  FROM documents
), keyed AS (
  SELECT *, translate(
    trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
), shared AS (
  SELECT key, min(doc_id) AS keep_id FROM keyed WHERE length(key) >= 10
  GROUP BY key HAVING count(DISTINCT doc_id) >= 2
), told AS (
  SELECT doc_id, place, line, coalesce(doc_id <> keep_id, false) AS gone
  FROM keyed LEFT JOIN shared ON keyed.key = shared.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT gone), '')) AS kept_sha256
FROM told GROUP BY doc_id
"""


def op12_periodic_runs(spark: SparkSession, directory: str) -> DataFrame:
    return runs.run_report(table(spark, directory, "documents"), repeated=True)


def op13_token_alignment(spark: SparkSession, directory: str) -> DataFrame:
    return token_align.aligned(table(spark, directory, "documents"), tokenizer_path(BYTES), tokenizer_path(PIECES))


QUERIES: dict[str, Query] = {
    "op1_page_diff": op1_page_diff,
    "op2_simple8b_tokens": op2_simple8b_tokens,
    "op3_toxicity": op3_toxicity,
    "op4_segment_bpe": op4_segment_bpe,
    "op5_preference_format": op5_preference_format,
    "op6_bagminhash": op6_bagminhash,
    "op7_vector_packing": op7_vector_packing,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_metric_join": op10_metric_join,
    "op11_line_dedup": op11_line_dedup,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_token_alignment": op13_token_alignment,
}
ORACLES: dict[str, str] = {
    "op5_preference_format": OP5_SQL,
    "op9_exact_dedup": OP9_SQL,
    "op11_line_dedup": OP11_SQL,
}
