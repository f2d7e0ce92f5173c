"""The subpackage's queries, one for each operator, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hexloom.llm.decontam import decontaminate
from hexloom.llm.importance import importance_resample
from hexloom.llm.langid import identify
from hexloom.llm.linededup import dedup_lines
from hexloom.llm.packing import best_fit_packing
from hexloom.llm.pii import personal_data
from hexloom.llm.rules import quality_rules
from hexloom.llm.simjoin import similarity_components
from hexloom.llm.tokencount import token_counts
from hexloom.llm.warcbundle import read_bundles, write_bundles
from hexloom.session import table


def op1_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance_resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(table(spark, sf_dir, "documents"))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity_components(table(spark, sf_dir, "documents"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return found.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_removed").alias("n_removed"), F.length("text").cast("long").alias("n_chars"), F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


def op7_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_bundles(write_bundles(table(spark, sf_dir, "pages")))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing(table(spark, sf_dir, "documents"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_importance, op2_personal_data, op3_jaccard_join, op4_quality_rules, op5_token_counts, op6_line_dedup, op7_warc_bundles, op8_decontamination, op9_packing, op10_language_id)}


#: The contract's rows in DuckDB SQL, where SQL can express them over whole tables.
OP6_SQL = """
WITH lines AS (
  SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
gone AS (SELECT line FROM lines WHERE length(trim(line, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13)))) >= 1 AND source IS NOT NULL GROUP BY line HAVING count(DISTINCT source) >= 5),
marked AS (SELECT doc_id, pos, line, line IN (SELECT line FROM gone) AS dead FROM lines),
texts AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dead) AS n_removed,
    coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dead), '') AS text
  FROM marked GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed,
  CASE WHEN d.text IS NULL THEN NULL ELSE length(t.text) END::BIGINT AS n_chars,
  CASE WHEN d.text IS NULL THEN NULL ELSE sha256(t.text) END AS text_sha256
FROM documents d LEFT JOIN texts t USING (doc_id)
"""
OP7_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
q AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha256(html) AS payload_digest FROM p),
r AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM q)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id > first THEN first END AS refers_to
FROM r
"""


def oracle_sql() -> dict[str, str]:
    return {"op6_line_dedup": OP6_SQL, "op7_warc_bundles": OP7_SQL}
