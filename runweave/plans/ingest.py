"""Queries over sources and sinks (S of the inventory) and definition text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runweave.operators import changefeed
from runweave.plans.estate import JOBS, jobs
from runweave.plans.registry import query
from runweave.session import table
from runweave.sources import files


@query("stanza_parse")
def stanza_parse(spark: SparkSession, d: str) -> DataFrame:
    """Archived stanzas parsed again: directive, object and number of attributes; tested against the archive's columns."""
    rows = files.parsed_texts(table(spark, d, "ujo_jil_stanza"), "stanza_id", "raw_text")
    return rows.select(F.col("path").cast("long").alias("stanza_id"), "seq", "directive", "object_name", "disposition", F.size("attrs").alias("n_attrs"))


@query("stanza_directives", r"""SELECT * FROM (SELECT stanza_id, lower(regexp_extract(raw_text, '(?m)^\s*((?:insert|update|delete|override)_(?:job|machine|box))\s*:', 1)) AS directive FROM ujo_jil_stanza
WHERE ujo_jil_stanza.directive IN ('insert_job', 'update_job', 'delete_job', 'override_job')) WHERE directive <> ''""")
def stanza_directives(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "ujo_jil_stanza").where("directive in ('insert_job', 'update_job', 'delete_job', 'override_job')")
    out = files.parsed_texts(rows, "stanza_id", "raw_text").where("directive is not null")
    return out.select(F.col("path").cast("long").alias("stanza_id"), "directive")


@query("definitions_from_text")
def definitions_from_text(spark: SparkSession, d: str) -> DataFrame:
    """Archived text parsed and applied in order: the definitions it leaves."""
    source = table(spark, d, "ujo_jil_stanza").where("directive is not null")
    parsed = files.parsed_texts(source, "stanza_id", "raw_text")
    order = source.select(F.col("stanza_id").cast("string").alias("path"), F.col("file_id").alias("import_seq"), F.col("start_line").alias("line"))
    rows = files.feed(parsed.join(order, "path"), F.col("import_seq"))
    return changefeed.attributes(changefeed.current_state(rows, "job_name", "op", "raw_attrs", ("import_seq", "source_line"), "op_id")).withColumnRenamed("key", "job_name")


@query("jil_writer", f"""WITH {JOBS} SELECT job_name, 'insert_job: ' || job_name || '   job_type: ' || coalesce(job_type, 'CMD') || chr(10) || 'n_retrys: ' || n_retrys || chr(10) || 'owner: ' || owner AS jil FROM j""")
def jil_writer(spark: SparkSession, d: str) -> DataFrame:
    rows = jobs(spark, d)
    attrs = F.create_map(F.lit("owner"), F.col("owner"), F.lit("n_retrys"), F.col("n_retrys").cast("string"))
    return files.jil_of(rows, F.col("job_name"), F.col("job_type"), attrs)


@query("prometheus_status", f"""WITH {JOBS} SELECT 'estate_jobs{{status="' || status || '"}} ' || count(*) AS value FROM j GROUP BY status""")
def prometheus_status(spark: SparkSession, d: str) -> DataFrame:
    return files.prometheus(jobs(spark, d).groupBy("status").agg(F.count("*").alias("n")), "estate_jobs", "n", ["status"])


@query("text_scan", "SELECT DISTINCT file_path FROM ujo_jil_stanza WHERE contains(raw_text, 'payroll')")
def text_scan(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "ujo_jil_stanza").where(F.col("raw_text").contains("payroll")).select("file_path").distinct()
