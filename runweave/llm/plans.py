"""The pN_ queries of the subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runweave.llm import dedup, leakage, mojibake, quality, tokens
from runweave.session import table


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Stanzas that hold text decoded with a wrong encoding."""
    return p5_restored(spark, d).select("file_id", "seq")


def p5_restored(spark: SparkSession, d: str) -> DataFrame:
    """The same stanzas with the restored text and the chains that led to it."""
    return mojibake.restored(table(spark, d, "ujo_jil_stanza"), ["file_id", "seq"], "raw_text")


def _duplicates(spark: SparkSession, d: str) -> DataFrame:
    path = dedup.accepted(spark, f"{d}/job_runs.parquet")
    batches = table(spark, d, "run_batches").select("batch_row_id", "import_id", "job_name", "retry_count", "machine", "start_time")
    return dedup.duplicates(batches, dedup.stored(spark, path, batches))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Batch rows that report a run already known."""
    return _duplicates(spark, d).select("batch_row_id")


def p6_import_duplicates(spark: SparkSession, d: str) -> DataFrame:
    """n_rows_duplicate of each import that has any."""
    return _duplicates(spark, d).groupBy("import_id").agg(F.count("*").alias("n_rows_duplicate"))


_P6 = """
WITH k AS (SELECT lower(trim(job_name)) AS job, coalesce(retry_count, 0) AS attempt, split_part(lower(trim(coalesce(machine, ''))), '.', 1) AS host,
    epoch_us(start_time) AS t, -1 AS import_id, -1 AS id FROM job_runs WHERE start_time IS NOT NULL
  UNION ALL SELECT lower(trim(job_name)), coalesce(retry_count, 0), split_part(lower(trim(coalesce(machine, ''))), '.', 1), epoch_us(start_time), import_id, batch_row_id
    FROM run_batches WHERE start_time IS NOT NULL),
f AS (SELECT DISTINCT b.id, b.import_id FROM k b JOIN k a ON a.job = b.job AND a.attempt = b.attempt AND a.t // 5000000 BETWEEN b.t // 5000000 - 1 AND b.t // 5000000 + 1
  WHERE b.id >= 0 AND abs(a.t - b.t) <= 5000000 AND (a.host = b.host OR a.host = '' OR b.host = '')
    AND (a.import_id < b.import_id OR (a.import_id = b.import_id AND a.id < b.id)))
"""


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    """Token ids of every document."""
    return tokens.encode_corpus(table(spark, d, "documents"), "doc_id", "text")


def p8_token_counts(spark: SparkSession, d: str) -> DataFrame:
    """How often each token occurs in the corpus."""
    return tokens.token_counts(p8_ids(spark, d))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents with passages of evaluation items."""
    return leakage.leaks(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "eval_items"), "item_id", "text")


def p9_clean(spark: SparkSession, d: str) -> DataFrame:
    """Documents without the passages that evaluation items have."""
    return leakage.clean(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "eval_items"), "item_id", "text")


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that are not running prose."""
    return quality.not_prose(table(spark, d, "documents"), "doc_id", "text", "lang").select("doc_id")


def p10_statistics(spark: SparkSession, d: str) -> DataFrame:
    """Text statistics of every document with percentiles and robust z-scores by language."""
    return quality.statistics(table(spark, d, "documents"), "doc_id", "text", "lang")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p5_found": p5_found,
    "p5_restored": p5_restored,
    "p6_found": p6_found,
    "p6_import_duplicates": p6_import_duplicates,
    "p8_ids": p8_ids,
    "p8_token_counts": p8_token_counts,
    "p9_found": p9_found,
    "p9_clean": p9_clean,
    "p10_found": p10_found,
    "p10_statistics": p10_statistics,
}
_P9 = """
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
i AS (SELECT item_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM eval_items WHERE text IS NOT NULL),
dg AS (SELECT doc_id, unnest([array_to_string(w[n : n + 9], ' ') FOR n IN range(1, len(w) - 8)]) AS g FROM d WHERE len(w) >= 10),
ig AS (SELECT item_id, unnest([array_to_string(w[n : n + 9], ' ') FOR n IN range(1, len(w) - 8)]) AS g FROM i WHERE len(w) >= 10)
SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (g)"""
SQL: dict[str, str] = {
    "p9_found": _P9,
    "p6_found": _P6 + "SELECT id AS batch_row_id FROM f",
    "p6_import_duplicates": _P6 + "SELECT import_id, count(*) AS n_rows_duplicate FROM f GROUP BY import_id",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
