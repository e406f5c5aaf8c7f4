"""The estate's tables as the queries see them: one row per job, one per run, and what follows from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from runweave.session import table

#: The same tables in SQL, for the queries' counterparts.
JOBS = "j AS (SELECT * FROM jobs QUALIFY row_number() OVER (PARTITION BY job_name ORDER BY status) = 1)"
RUNS = "r AS (SELECT * FROM job_runs QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY job_name) = 1)"
ALARMS = """al AS (SELECT 'al:' || run_id AS alarm_id, run_id, job_name,
  CASE WHEN status = 5 THEN 'ALARM_IF_FAIL' ELSE 'ALARM_IF_TERMINATED' END AS alarm_type,
  coalesce(end_time, start_time) AS raised_at,
  CASE WHEN retry_count > 0 OR exit_code % 2 = 0 THEN coalesce(end_time, start_time) + INTERVAL 1 HOUR END AS cleared_at
  FROM r WHERE status IN (5, 6) AND coalesce(end_time, start_time) IS NOT NULL)"""
CONDITIONS = """jc AS (SELECT p_partkey AS k, 'job_' || lpad(CAST(p_partkey AS VARCHAR), 7, '0') AS job_name,
  CASE WHEN p_partkey % 10 = 0 THEN 'BOX' WHEN p_partkey % 10 = 7 THEN 'FILEWATCH' WHEN p_partkey % 50 = 3 THEN 'FTP' ELSE 'CMD' END AS job_type,
  CASE WHEN p_partkey % 100 = 0 THEN NULL WHEN p_partkey % 10 = 0 THEN 'job_' || lpad(CAST(p_partkey - p_partkey % 100 AS VARCHAR), 7, '0')
    ELSE 'job_' || lpad(CAST(p_partkey - p_partkey % 10 AS VARCHAR), 7, '0') END AS box_name,
  CASE WHEN p_partkey % 10 < 2 THEN NULL
    ELSE CASE WHEN p_partkey % 11 = 5 THEN 's(job_' || lpad(CAST(p_partkey - 1 AS VARCHAR), 7, '0') || ', 24)'
      WHEN p_partkey % 17 = 8 THEN 'success(job_' || lpad(CAST(p_partkey - 1 AS VARCHAR), 7, '0') || '^PRD)'
      ELSE 's(job_' || lpad(CAST(p_partkey - 1 AS VARCHAR), 7, '0') || ')' END
      || CASE WHEN p_partkey % 5 = 4 THEN ' & f(job_' || lpad(CAST(p_partkey - 2 AS VARCHAR), 7, '0') || ')' ELSE '' END
      || CASE WHEN p_partkey % 7 = 3 THEN ' & e(job_' || lpad(CAST(p_partkey - 1 AS VARCHAR), 7, '0') || ') = 0' ELSE '' END
      || CASE WHEN p_partkey % 13 = 6 THEN ' | v(REGION) = "EU"' ELSE '' END END AS condition,
  'run_' || p_size || CASE p_size % 4 WHEN 0 THEN '.ksh' WHEN 1 THEN '.sh' WHEN 2 THEN '.py' ELSE '' END
    || CASE WHEN p_partkey % 6 = 1 THEN ' %%REGION%%' ELSE '' END || CASE WHEN p_partkey % 4 = 1 THEN ' %%DATE%%' ELSE '' END AS command
  FROM part)"""
DATES = """cal AS (SELECT DISTINCT c.name AS calendar_name, d.run_date AS day FROM (SELECT DISTINCT run_date FROM job_runs WHERE run_date IS NOT NULL) d
  JOIN (VALUES ('bank_days'), ('week_ends'), ('close_days')) c(name) ON
    (c.name = 'bank_days' AND isodow(d.run_date) <= 5) OR (c.name = 'week_ends' AND isodow(d.run_date) > 5) OR (c.name = 'close_days' AND d.run_date = last_day(d.run_date)))"""


def jobs(spark: SparkSession, d: str) -> DataFrame:
    """One row per job: of repeated exports the one with the least status."""
    first = Window.partitionBy("job_name").orderBy(F.col("status").asc_nulls_last())
    return table(spark, d, "jobs").withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def runs(spark: SparkSession, d: str) -> DataFrame:
    """One row per run."""
    return table(spark, d, "job_runs").dropDuplicates(["run_id"])


def alarms(spark: SparkSession, d: str) -> DataFrame:
    """Alarms that failed and terminated runs raised; cleared after an hour if retried or left with an even code."""
    at = F.coalesce("end_time", "start_time")
    return (
        runs(spark, d)
        .where(F.col("status").isin(5, 6) & at.isNotNull())
        .select(
            F.concat(F.lit("al:"), "run_id").alias("alarm_id"), "run_id", "job_name",
            F.when(F.col("status") == 5, "ALARM_IF_FAIL").otherwise("ALARM_IF_TERMINATED").alias("alarm_type"), at.alias("raised_at"),
            F.when((F.col("retry_count") > 0) | (F.col("exit_code") % 2 == 0), at + F.expr("interval 1 hour")).alias("cleared_at"),
        )
    )


def conditions(spark: SparkSession, d: str) -> DataFrame:
    """Jobs with conditions, derived from the parts' keys: k, job_name, job_type, box_name, condition, command."""
    k = F.col("p_partkey")
    name = lambda c: F.concat(F.lit("job_"), F.lpad(c.cast("string"), 7, "0"))
    first = (
        F.when(k % 11 == 5, F.concat(F.lit("s("), name(k - 1), F.lit(", 24)")))
        .when(k % 17 == 8, F.concat(F.lit("success("), name(k - 1), F.lit("^PRD)")))
        .otherwise(F.concat(F.lit("s("), name(k - 1), F.lit(")")))
    )
    more = F.concat(
        F.when(k % 5 == 4, F.concat(F.lit(" & f("), name(k - 2), F.lit(")"))).otherwise(""),
        F.when(k % 7 == 3, F.concat(F.lit(" & e("), name(k - 1), F.lit(") = 0"))).otherwise(""),
        F.when(k % 13 == 6, ' | v(REGION) = "EU"').otherwise(""),
    )
    size = F.col("p_size")
    suffix = F.when(size % 4 == 0, ".ksh").when(size % 4 == 1, ".sh").when(size % 4 == 2, ".py").otherwise("")
    return table(spark, d, "part").select(
        k.alias("k"), name(k).alias("job_name"),
        F.when(k % 10 == 0, "BOX").when(k % 10 == 7, "FILEWATCH").when(k % 50 == 3, "FTP").otherwise("CMD").alias("job_type"),
        F.when(k % 100 == 0, None).when(k % 10 == 0, name(k - k % 100)).otherwise(name(k - k % 10)).alias("box_name"),
        F.when(k % 10 >= 2, F.concat(first, more)).alias("condition"),
        F.concat(F.lit("run_"), size.cast("string"), suffix, F.when(k % 6 == 1, " %%REGION%%").otherwise(""), F.when(k % 4 == 1, " %%DATE%%").otherwise("")).alias("command"),
    )


def calendars(spark: SparkSession, d: str) -> DataFrame:
    """(calendar_name, day) of three calendars over the days that have runs."""
    days = table(spark, d, "job_runs").where("run_date is not null").select(F.col("run_date").alias("day")).distinct()
    kinds = F.array(
        F.when(F.weekday("day") < 5, "bank_days"), F.when(F.weekday("day") >= 5, "week_ends"), F.when(F.col("day") == F.last_day("day"), "close_days")
    )
    return days.select(F.explode(F.array_compact(kinds)).alias("calendar_name"), "day")
