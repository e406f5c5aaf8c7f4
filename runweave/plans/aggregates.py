"""Aggregations, windows and joins over the estate (A, W, J of the inventory)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from runweave.functions import schedules
from runweave.functions.texts import name_key
from runweave.operators import concurrency
from runweave.plans.estate import ALARMS, CONDITIONS, JOBS, RUNS, alarms, conditions, jobs, runs
from runweave.plans.registry import query
from runweave.session import table

_STATS = """st AS (SELECT job_name, count(*) AS total_runs, count(*) FILTER (status = 5) AS failures, count(*) FILTER (status = 6) AS terminations,
  count(*) FILTER (retry_count > 0) AS retried_runs, min(start_time) AS first_run, max(start_time) AS last_run, sum(duration_secs) AS total_secs, count(duration_secs) AS timed
  FROM r WHERE source <> 'simulated' GROUP BY job_name)"""
_ALARM_STATS = """ast AS (SELECT job_name, count(*) FILTER (cleared_at IS NULL) AS active_alarms, count(*) FILTER (cleared_at IS NOT NULL) AS cleared_alarms FROM al GROUP BY job_name)"""
_US = lambda c: F.unix_micros(F.col(c).cast("timestamp"))


def run_stats(spark: SparkSession, d: str) -> DataFrame:
    """Run statistics per job over observed runs, in one map-side combined aggregation."""
    counted = lambda c: F.count(F.when(c, 1))
    return (
        runs(spark, d)
        .where("source != 'simulated'")
        .groupBy("job_name")
        .agg(
            F.count("*").alias("total_runs"), counted(F.col("status") == 5).alias("failures"), counted(F.col("status") == 6).alias("terminations"),
            counted(F.col("retry_count") > 0).alias("retried_runs"), F.min("start_time").alias("first_run"), F.max("start_time").alias("last_run"),
            F.sum("duration_secs").alias("total_secs"), F.count("duration_secs").alias("timed"),
        )
    )


def alarm_stats(spark: SparkSession, d: str) -> DataFrame:
    return alarms(spark, d).groupBy("job_name").agg(
        F.count(F.when(F.col("cleared_at").isNull(), 1)).alias("active_alarms"), F.count("cleared_at").alias("cleared_alarms")
    )


@query("run_stats_by_job", f"WITH {RUNS}, {_STATS} SELECT job_name, total_runs, failures, terminations, retried_runs, epoch_us(first_run) AS first_us, epoch_us(last_run) AS last_us, CAST(total_secs AS BIGINT) AS total_secs FROM st")
def run_stats_by_job(spark: SparkSession, d: str) -> DataFrame:
    out = run_stats(spark, d)
    return out.select("job_name", "total_runs", "failures", "terminations", "retried_runs", _US("first_run").alias("first_us"), _US("last_run").alias("last_us"), "total_secs")


@query(
    "alarm_stats_by_job",
    f"""WITH {RUNS}, {ALARMS}, {_STATS}, {_ALARM_STATS} SELECT coalesce(st.job_name, ast.job_name) AS job_name, coalesce(total_runs, 0) AS total_runs,
coalesce(active_alarms, 0) AS active_alarms, coalesce(cleared_alarms, 0) AS cleared_alarms FROM st FULL JOIN ast ON st.job_name = ast.job_name""",
)
def alarm_stats_by_job(spark: SparkSession, d: str) -> DataFrame:
    both = run_stats(spark, d).join(alarm_stats(spark, d), "job_name", "full")
    return both.select("job_name", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("total_runs", "active_alarms", "cleared_alarms")])


def risk(spark: SparkSession, d: str) -> DataFrame:
    """Risk level per job from observed runs and alarms."""
    rows = jobs(spark, d).select("job_name", "status").join(run_stats(spark, d), "job_name", "left").join(alarm_stats(spark, d), "job_name", "left")
    n, days = F.col("total_runs"), (_US("last_run") - _US("first_run")) / F.lit(86_400_000_000.0)
    enough = ((n >= 2) & (F.col("failures") == n)) | ((n >= 10) & (days.isNull() | (days >= 7)))
    rate = lambda c: F.col(c) / n
    active = F.coalesce("active_alarms", F.lit(0))
    high = (rate("failures") >= 0.3) | (active >= 2) | (F.col("terminations") >= 1) | F.col("status").isin(11, 17)
    medium = (rate("failures") >= 0.1) | (rate("retried_runs") >= 0.2) | (active == 1) | F.col("status").isin(7, 10)
    low = (F.coalesce("cleared_alarms", F.lit(0)) > 0) | (F.col("retried_runs") > 0)
    level = F.when(n.isNull() | ~enough, "NO_DATA").when(high, "HIGH").when(medium, "MEDIUM").when(low, "LOW").otherwise("NONE")
    return rows.withColumn("risk", level)


_RISK = f"""WITH {JOBS}, {RUNS}, {ALARMS}, {_STATS}, {_ALARM_STATS}, rk AS (
  SELECT j.job_name, CASE WHEN total_runs IS NULL OR NOT ((total_runs >= 2 AND failures = total_runs) OR (total_runs >= 10 AND (first_run IS NULL OR epoch_us(last_run) - epoch_us(first_run) >= 604800000000))) THEN 'NO_DATA'
    WHEN failures / total_runs >= 0.3 OR coalesce(active_alarms, 0) >= 2 OR terminations >= 1 OR status IN (11, 17) THEN 'HIGH'
    WHEN failures / total_runs >= 0.1 OR retried_runs / total_runs >= 0.2 OR coalesce(active_alarms, 0) = 1 OR status IN (7, 10) THEN 'MEDIUM'
    WHEN coalesce(cleared_alarms, 0) > 0 OR retried_runs > 0 THEN 'LOW' ELSE 'NONE' END AS risk
  FROM j LEFT JOIN st ON st.job_name = j.job_name LEFT JOIN ast ON ast.job_name = j.job_name)"""


@query("operational_risk", _RISK + " SELECT job_name, risk FROM rk")
def operational_risk(spark: SparkSession, d: str) -> DataFrame:
    return risk(spark, d).select("job_name", "risk")


@query("risk_counts", _RISK + " SELECT l.risk, count(rk.job_name) AS n_jobs FROM (VALUES ('HIGH'), ('MEDIUM'), ('LOW'), ('NONE'), ('NO_DATA')) l(risk) LEFT JOIN rk ON rk.risk = l.risk GROUP BY 1")
def risk_counts(spark: SparkSession, d: str) -> DataFrame:
    """Jobs by level, levels without jobs included."""
    levels = spark.range(1).select(F.explode(F.array(*[F.lit(x) for x in ("HIGH", "MEDIUM", "LOW", "NONE", "NO_DATA")])).alias("risk"))
    counts = risk(spark, d).groupBy("risk").agg(F.count("*").alias("n"))
    return levels.join(counts, "risk", "left").select("risk", F.coalesce("n", F.lit(0)).alias("n_jobs"))


@query("workload_totals", f"""WITH {RUNS}, t AS (SELECT source, count(*) AS total_runs, count(DISTINCT job_name) AS n_jobs, count(DISTINCT run_date) AS n_days, min(run_date) AS first_day, max(run_date) AS last_day,
  CAST(sum(duration_secs) AS BIGINT) AS secs, count(duration_secs) AS timed, max(duration_secs) AS longest FROM r GROUP BY source)
SELECT * EXCLUDE (secs, timed), CAST(round(total_runs / n_jobs / n_days * 10000) AS BIGINT) AS runs_per_job_day_e4, CAST(floor(secs * 10000.0::DOUBLE / timed / 60 + 0.5) AS BIGINT) AS avg_task_minutes_e4, n_days >= 7 AS sufficient_window FROM t""")
def workload_totals(spark: SparkSession, d: str) -> DataFrame:
    t = runs(spark, d).groupBy("source").agg(F.count("*").alias("total_runs"), F.countDistinct("job_name").alias("n_jobs"), F.countDistinct("run_date").alias("n_days"), F.min("run_date").alias("first_day"), F.max("run_date").alias("last_day"), F.sum("duration_secs").alias("secs"), F.count("duration_secs").alias("timed"), F.max("duration_secs").alias("longest"))
    per_day = F.col("total_runs") / F.col("n_jobs") / F.col("n_days")
    minutes = F.floor(F.col("secs") * F.lit(10000.0) / F.col("timed") / 60 + 0.5)
    return t.withColumns({"runs_per_job_day_e4": F.round(per_day * 10000).cast("long"), "avg_task_minutes_e4": minutes.cast("long"), "sufficient_window": F.col("n_days") >= 7}).drop("secs", "timed")


@query("first_source_with_runs", f"WITH {RUNS} SELECT source, count(*) AS n FROM r WHERE source IN ('imported', 'live') GROUP BY 1 ORDER BY CASE source WHEN 'imported' THEN 0 ELSE 1 END LIMIT 1")
def first_source_with_runs(spark: SparkSession, d: str) -> DataFrame:
    counts = runs(spark, d).where("source in ('imported', 'live')").groupBy("source").agg(F.count("*").alias("n"))
    return counts.orderBy(F.when(F.col("source") == "imported", 0).otherwise(1)).limit(1)


@query("busiest_hour", f"WITH {RUNS} SELECT hour(start_time) AS peak_hour, count(*) AS n_runs, CAST(round(count(*) * 10000 / (SELECT count(*) FROM r)) AS BIGINT) AS share_e4 FROM r WHERE start_time IS NOT NULL GROUP BY 1 ORDER BY n_runs DESC, peak_hour LIMIT 1")
def busiest_hour(spark: SparkSession, d: str) -> DataFrame:
    """The clock hour with most starts; the share is of all runs, those without start included."""
    by_hour = runs(spark, d).groupBy(F.hour("start_time").cast("long").alias("peak_hour")).agg(F.count("*").alias("n_runs"))
    shared = by_hour.crossJoin(F.broadcast(by_hour.agg(F.sum("n_runs").alias("all_runs"))))  # one row
    top = shared.where("peak_hour is not null").orderBy(F.desc("n_runs"), "peak_hour").limit(1)
    return top.select("peak_hour", "n_runs", F.round(F.col("n_runs") * 10000 / F.col("all_runs")).cast("long").alias("share_e4"))


_EVENTS = """ev AS (SELECT start_time AS t, 1 AS d FROM r WHERE start_time IS NOT NULL AND end_time IS NOT NULL
  UNION ALL SELECT end_time, -1 FROM r WHERE start_time IS NOT NULL AND end_time IS NOT NULL),
c AS (SELECT t, sum(d) OVER (ORDER BY t, d ROWS UNBOUNDED PRECEDING) AS n FROM ev)"""


@query("peak_concurrency", f"WITH {RUNS}, {_EVENTS} SELECT CAST(n AS BIGINT) AS in_flight, epoch_us(t) AS at_us FROM c ORDER BY n DESC, t LIMIT 1")
def peak_concurrency(spark: SparkSession, d: str) -> DataFrame:
    return concurrency.peak(runs(spark, d), F.col("start_time"), F.col("end_time"))


@query("peak_concurrency_by_machine", f"""WITH {RUNS}, ev AS (SELECT machine, start_time AS t, 1 AS d FROM r WHERE start_time IS NOT NULL AND end_time IS NOT NULL AND machine IS NOT NULL
  UNION ALL SELECT machine, end_time, -1 FROM r WHERE start_time IS NOT NULL AND end_time IS NOT NULL AND machine IS NOT NULL),
c AS (SELECT machine, t, sum(d) OVER (PARTITION BY machine ORDER BY t, d ROWS UNBOUNDED PRECEDING) AS n FROM ev)
SELECT machine, CAST(n AS BIGINT) AS in_flight, epoch_us(t) AS at_us FROM c QUALIFY row_number() OVER (PARTITION BY machine ORDER BY n DESC, t) = 1""")
def peak_concurrency_by_machine(spark: SparkSession, d: str) -> DataFrame:
    return concurrency.peak(runs(spark, d).where("machine is not null"), F.col("start_time"), F.col("end_time"), "machine")


@query("status_counts", f"WITH {JOBS} SELECT status, count(*) AS n_jobs FROM j GROUP BY status")
def status_counts(spark: SparkSession, d: str) -> DataFrame:
    return jobs(spark, d).groupBy("status").agg(F.count("*").alias("n_jobs"))


@query("job_report_range", f"WITH {RUNS} SELECT coalesce(CAST(status AS VARCHAR), 'all') AS status, count(*) AS n FROM r WHERE start_time BETWEEN TIMESTAMP '2025-09-01' AND TIMESTAMP '2025-10-01' GROUP BY ROLLUP (status)")
def job_report_range(spark: SparkSession, d: str) -> DataFrame:
    in_range = F.col("start_time").between(F.lit("2025-09-01").cast("timestamp_ntz"), F.lit("2025-10-01").cast("timestamp_ntz"))
    return runs(spark, d).where(in_range).rollup("status").agg(F.count("*").alias("n")).withColumn("status", F.coalesce(F.col("status").cast("string"), F.lit("all")))


@query("alarm_report_range", f"WITH {RUNS}, {ALARMS} SELECT alarm_type, count(*) AS n, count(cleared_at) AS cleared FROM al WHERE raised_at >= TIMESTAMP '2025-09-01' GROUP BY 1")
def alarm_report_range(spark: SparkSession, d: str) -> DataFrame:
    rows = alarms(spark, d).where(F.col("raised_at") >= F.lit("2025-09-01").cast("timestamp_ntz"))
    return rows.groupBy("alarm_type").agg(F.count("*").alias("n"), F.count("cleared_at").alias("cleared"))


@query("machine_concentration", f"WITH {JOBS} SELECT machine, count(*) AS n_jobs, CASE WHEN count(*) > 40 THEN 'XL' WHEN count(*) > 20 THEN 'L' WHEN count(*) > 10 THEN 'M' WHEN count(*) > 5 THEN 'S' ELSE 'XS' END AS score FROM j WHERE job_type = 'CMD' AND machine IS NOT NULL GROUP BY 1")
def machine_concentration(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("n_jobs")
    score = F.when(n > 40, "XL").when(n > 20, "L").when(n > 10, "M").when(n > 5, "S").otherwise("XS")
    return jobs(spark, d).where("job_type = 'CMD' and machine is not null").groupBy("machine").agg(F.count("*").alias("n_jobs")).withColumn("score", score)


@query("machine_group_size", f"WITH {JOBS} SELECT job_name, count(*) OVER (PARTITION BY machine) AS on_machine FROM j WHERE machine IS NOT NULL")
def machine_group_size(spark: SparkSession, d: str) -> DataFrame:
    """Group sizes brought back to the rows: aggregate and join, so a large group isn't gathered in one task."""
    rows = jobs(spark, d).where("machine is not null").select("job_name", "machine")
    return rows.join(rows.groupBy("machine").agg(F.count("*").alias("on_machine")), "machine").select("job_name", "on_machine")


@query("profile_sharing", f"WITH {JOBS}, g AS (SELECT extra_attrs['group_label'] AS label FROM j) SELECT label, count(*) AS n_jobs, count(*) > 1 AS shared FROM g WHERE label IS NOT NULL GROUP BY 1")
def profile_sharing(spark: SparkSession, d: str) -> DataFrame:
    rows = jobs(spark, d).select(F.try_element_at("extra_attrs", F.lit("group_label")).alias("label")).where("label is not null")
    return rows.groupBy("label").agg(F.count("*").alias("n_jobs")).withColumn("shared", F.col("n_jobs") > 1)


@query("burst_by_job", f"""WITH {JOBS}, t AS (SELECT job_name, unnest(start_times) AS t, generate_subscripts(start_times, 1) AS i FROM j), f AS (SELECT t, min(ROW(job_name, i)) AS first, count(DISTINCT job_name) AS n FROM t GROUP BY 1)
SELECT t.job_name, arg_max(f.t, f.first) AS start_time, arg_max(f.n, f.first) AS n_jobs FROM t JOIN f USING (t) GROUP BY 1""")
def burst_by_job(spark: SparkSession, d: str) -> DataFrame:
    """Jobs that start together: of several times of a job the one that comes up last in the estate's order of names counts."""
    rows = jobs(spark, d).select("job_name", F.posexplode("start_times").alias("i", "start_time"))
    first = rows.groupBy("start_time").agg(F.min(F.struct("job_name", "i")).alias("first"), F.countDistinct("job_name").alias("n"))
    return rows.select("job_name", "start_time").join(first, "start_time").groupBy("job_name").agg(F.max_by(F.struct("start_time", "n"), "first").alias("x")).select("job_name", "x.start_time", F.col("x.n").alias("n_jobs"))


@query("schedule_burst", f"WITH {JOBS}, t AS (SELECT job_name, unnest(start_times) AS t FROM j) SELECT t AS start_time, count(*) AS n_jobs, CASE WHEN count(*) > 30 THEN 'L' WHEN count(*) > 10 THEN 'M' WHEN count(*) > 5 THEN 'S' ELSE 'XS' END AS score FROM t GROUP BY 1")
def schedule_burst(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("n_jobs")
    score = F.when(n > 30, "L").when(n > 10, "M").when(n > 5, "S").otherwise("XS")
    return jobs(spark, d).select(F.explode("start_times").alias("start_time")).groupBy("start_time").agg(F.count("*").alias("n_jobs")).withColumn("score", score)


@query("owner_counts", f"WITH {JOBS} SELECT coalesce(nullif(owner, ''), 'unknown') AS owner, count(*) AS n_jobs FROM j GROUP BY 1")
def owner_counts(spark: SparkSession, d: str) -> DataFrame:
    return jobs(spark, d).groupBy(F.coalesce(F.nullif("owner", F.lit("")), F.lit("unknown")).alias("owner")).agg(F.count("*").alias("n_jobs"))


@query("box_children", f"WITH {JOBS} SELECT lower(trim(box_name, ' ' || chr(9) || chr(10) || chr(13))) AS box, count(*) AS n_children FROM j WHERE trim(coalesce(box_name, ''), ' ' || chr(9) || chr(10) || chr(13)) <> '' GROUP BY 1")
def box_children(spark: SparkSession, d: str) -> DataFrame:
    return jobs(spark, d).select(name_key(F.col("box_name")).alias("box")).where("box is not null").groupBy("box").agg(F.count("*").alias("n_children"))


@query("box_status_pivot", f"""WITH {JOBS} SELECT coalesce(lower(nullif(trim(box_name, ' ' || chr(9) || chr(10) || chr(13)), '')), '(top-level)') AS box, count(*) AS n_jobs, count(*) FILTER (status = 4) AS success, count(*) FILTER (status = 5) AS failure,
count(*) FILTER (status = 6) AS terminated FROM j GROUP BY 1""")
def box_status_pivot(spark: SparkSession, d: str) -> DataFrame:
    rows = jobs(spark, d).select(F.coalesce(name_key(F.col("box_name")), F.lit("(top-level)")).alias("box"), "status")
    counts = rows.groupBy("box").pivot("status", [4, 5, 6]).count()
    sizes = rows.groupBy("box").agg(F.count("*").alias("n_jobs"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return sizes.join(counts, "box").select("box", "n_jobs", zero("4").alias("success"), zero("5").alias("failure"), zero("6").alias("terminated"))


@query("estate_summary", f"WITH {JOBS} SELECT count(*) AS n_jobs, count(DISTINCT machine) AS n_machines, count(*) FILTER (alarm_if_fail) AS with_alarm, count(*) FILTER (date_conditions) AS with_dates, max(n_retrys) AS most_retries FROM j")
def estate_summary(spark: SparkSession, d: str) -> DataFrame:
    return jobs(spark, d).agg(F.count("*").alias("n_jobs"), F.countDistinct("machine").alias("n_machines"), F.count_if("alarm_if_fail").alias("with_alarm"), F.count_if("date_conditions").alias("with_dates"), F.max("n_retrys").alias("most_retries"))


@query("coverage", f"""WITH {JOBS}, {RUNS}, o AS (SELECT job_name, max(source <> 'simulated') AS seen FROM r GROUP BY 1)
SELECT count(*) FILTER (seen) AS observed, count(*) FILTER (NOT seen) AS simulated, count(*) FILTER (seen IS NULL) AS none, CAST(round(count(*) FILTER (seen) * 10000 / count(*)) AS BIGINT) AS observed_e4
FROM j LEFT JOIN o USING (job_name) WHERE coalesce(job_type, 'CMD') <> 'BOX'""")
def coverage(spark: SparkSession, d: str) -> DataFrame:
    seen = table(spark, d, "job_runs").groupBy("job_name").agg(F.max(F.col("source") != "simulated").alias("seen"))
    rows = jobs(spark, d).where(F.coalesce("job_type", F.lit("CMD")) != "BOX").join(seen, "job_name", "left")
    out = rows.agg(F.count_if("seen").alias("observed"), F.count_if(~F.col("seen")).alias("simulated"), F.count_if(F.col("seen").isNull()).alias("none"), F.count("*").alias("n"))
    return out.select("observed", "simulated", "none", F.round(F.col("observed") * 10000 / F.col("n")).cast("long").alias("observed_e4"))


@query("import_counters", "SELECT import_status, count(*) AS n_imports, CAST(sum(n_rows_read) AS BIGINT) AS n_read, CAST(sum(n_rows_loaded) AS BIGINT) AS n_loaded FROM history_imports GROUP BY 1")
def import_counters(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "history_imports").groupBy("import_status").agg(F.count("*").alias("n_imports"), F.sum("n_rows_read").alias("n_read"), F.sum("n_rows_loaded").alias("n_loaded"))


@query("issue_code_counts", "SELECT code, CAST(sum(n) AS BIGINT) AS n FROM (SELECT unnest(map_keys(issue_codes)) AS code, unnest(map_values(issue_codes)) AS n FROM history_imports) GROUP BY 1")
def issue_code_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "history_imports").select(F.explode("issue_codes").alias("code", "k")).groupBy("code").agg(F.sum("k").alias("n"))


@query("stanza_dispositions", "SELECT disposition, directive, count(*) AS n FROM ujo_jil_stanza GROUP BY ALL")
def stanza_dispositions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "ujo_jil_stanza").groupBy("disposition", "directive").agg(F.count("*").alias("n"))


@query("stanza_issue_codes", "SELECT i.code, i.severity, count(*) AS n FROM (SELECT unnest(issues) AS i FROM ujo_jil_stanza) GROUP BY ALL")
def stanza_issue_codes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "ujo_jil_stanza").select(F.explode("issues").alias("i")).groupBy("i.code", "i.severity").agg(F.count("*").alias("n"))


@query("file_worst_severity", """SELECT file_path, CASE max(CASE WHEN disposition = 'QUARANTINED' THEN 2 WHEN len(issues) > 0 THEN 1 ELSE 0 END) WHEN 2 THEN 'ERROR_RECOVERED' WHEN 1 THEN 'WARN' ELSE 'OK' END AS file_status
FROM ujo_jil_stanza GROUP BY 1""")
def file_worst_severity(spark: SparkSession, d: str) -> DataFrame:
    worst = F.max(F.when(F.col("disposition") == "QUARANTINED", 2).when(F.size("issues") > 0, 1).otherwise(0))
    label = F.when(F.col("w") == 2, "ERROR_RECOVERED").when(F.col("w") == 1, "WARN").otherwise("OK")
    return table(spark, d, "ujo_jil_stanza").groupBy("file_path").agg(worst.alias("w")).select("file_path", label.alias("file_status"))


@query("latest_exit_code", f"WITH {RUNS} SELECT job_name, run_id, exit_code FROM r WHERE start_time IS NOT NULL QUALIFY row_number() OVER (PARTITION BY job_name ORDER BY start_time DESC, run_id DESC) = 1")
def latest_exit_code(spark: SparkSession, d: str) -> DataFrame:
    """Latest run per job by max_by, which combines map-side, so a job with very many runs is no hot group."""
    last = F.max_by(F.struct("run_id", "exit_code"), F.struct("start_time", "run_id")).alias("x")
    return table(spark, d, "job_runs").where("start_time is not null").groupBy("job_name").agg(last).select("job_name", "x.run_id", "x.exit_code")


_NTH = "WITH {r} SELECT job_name, run_id FROM r WHERE start_time IS NOT NULL QUALIFY row_number() OVER (PARTITION BY job_name ORDER BY start_time {o}, run_id {o}) = {n}"


def nth(rows: DataFrame, n: int) -> DataFrame:
    """The n-th row of each job by start, the first being 1; negative numbers count from the end; 0 is the last. The limit on ranks is pushed below the shuffle as a group limit."""
    back = n <= 0
    place = max(abs(n), 1)
    by = Window.partitionBy("job_name").orderBy(*([F.desc("start_time"), F.desc("run_id")] if back else ["start_time", "run_id"]))
    return rows.where("start_time is not null").withColumn("_n", F.row_number().over(by)).where(F.col("_n") <= place).where(F.col("_n") == place).drop("_n")


@query("nth_run", _NTH.format(r=RUNS, o="", n=3))
def nth_run(spark: SparkSession, d: str) -> DataFrame:
    """The third run of each job."""
    return nth(runs(spark, d).select("job_name", "run_id", "start_time"), 3).select("job_name", "run_id")


@query("nth_run_from_end", _NTH.format(r=RUNS, o="DESC", n=2))
def nth_run_from_end(spark: SparkSession, d: str) -> DataFrame:
    """The last run but one of each job."""
    return nth(runs(spark, d).select("job_name", "run_id", "start_time"), -2).select("job_name", "run_id")


_POLICY = "SELECT object_name, file_id, seq FROM ujo_jil_stanza WHERE directive = 'insert_job' AND object_name IS NOT NULL QUALIFY row_number() OVER (PARTITION BY object_name ORDER BY file_id {o}, seq {o}) = 1"


def _policy(spark: SparkSession, d: str, pick) -> DataFrame:
    rows = table(spark, d, "ujo_jil_stanza").where("directive = 'insert_job' and object_name is not null")
    return rows.groupBy("object_name").agg(pick(F.struct("file_id", "seq")).alias("x")).select("object_name", "x.file_id", "x.seq")


@query("duplicate_policy_first", _POLICY.format(o=""))
def duplicate_policy_first(spark: SparkSession, d: str) -> DataFrame:
    return _policy(spark, d, F.min)


@query("duplicate_policy_last", _POLICY.format(o="DESC"))
def duplicate_policy_last(spark: SparkSession, d: str) -> DataFrame:
    return _policy(spark, d, F.max)


@query("status_changes", f"""WITH {RUNS}, p AS (SELECT job_name, status, lag(status) OVER (PARTITION BY job_name ORDER BY start_time, run_id) AS old FROM r WHERE start_time IS NOT NULL)
SELECT job_name, count(*) AS n_changes FROM p WHERE old <> status GROUP BY 1""")
def status_changes(spark: SparkSession, d: str) -> DataFrame:
    rows = runs(spark, d).where("start_time is not null").select("job_name", "status", "start_time", "run_id")
    rows = concurrency.previous_value(rows, "job_name", F.col("start_time"), "run_id", "status")
    return rows.where("previous != status").groupBy("job_name").agg(F.count("*").alias("n_changes"))


@query("min_run_candidates", f"""WITH {JOBS}, {RUNS}, l AS (SELECT max(end_time) AS t FROM r) SELECT r.run_id, r.job_name FROM r JOIN j USING (job_name), l
WHERE j.term_run_time > 0 AND epoch_us(r.end_time) - epoch_us(r.start_time) < CAST(j.term_run_time AS BIGINT) * 15000000 AND r.end_time >= l.t - INTERVAL 7 DAY""")
def min_run_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Runs of the last week that ended sooner than their job's least run time (a quarter of its limit in minutes)."""
    limited = jobs(spark, d).where("term_run_time > 0").select("job_name", (F.col("term_run_time").cast("long") * 15_000_000).alias("least"))
    rows = runs(spark, d).where("end_time is not null")
    last = rows.agg(F.max("end_time").alias("_t"))  # one row
    rows = rows.crossJoin(F.broadcast(last)).where(F.col("end_time") >= F.col("_t") - F.expr("interval 7 day"))
    return rows.join(limited, "job_name").where(_US("end_time") - _US("start_time") < F.col("least")).select("run_id", "job_name")


@query("auto_resolve", f"WITH {JOBS}, {RUNS}, {ALARMS} SELECT al.alarm_id FROM al JOIN j USING (job_name) WHERE al.cleared_at IS NULL AND al.alarm_type = 'ALARM_IF_FAIL' AND j.status = 4")
def auto_resolve(spark: SparkSession, d: str) -> DataFrame:
    good = jobs(spark, d).where("status = 4").select("job_name")
    return alarms(spark, d).where("cleared_at is null and alarm_type = 'ALARM_IF_FAIL'").join(good, "job_name").select("alarm_id")


@query("alarm_if_fail", f"WITH {JOBS}, {RUNS}, {ALARMS} SELECT job_name FROM j WHERE status = 5 AND alarm_if_fail AND job_name NOT IN (SELECT job_name FROM al WHERE cleared_at IS NULL AND alarm_type = 'ALARM_IF_FAIL')")
def alarm_if_fail(spark: SparkSession, d: str) -> DataFrame:
    """New alarms: an anti join leaves out jobs with an open one."""
    open_ = alarms(spark, d).where("cleared_at is null and alarm_type = 'ALARM_IF_FAIL'").select("job_name")
    return jobs(spark, d).where("status = 5 and alarm_if_fail").join(open_, "job_name", "left_anti").select("job_name")


@query("alarm_if_terminated", f"WITH {JOBS}, {RUNS}, {ALARMS} SELECT job_name FROM j WHERE status = 6 AND alarm_if_fail AND job_name NOT IN (SELECT job_name FROM al WHERE cleared_at IS NULL AND alarm_type = 'ALARM_IF_TERMINATED')")
def alarm_if_terminated(spark: SparkSession, d: str) -> DataFrame:
    open_ = alarms(spark, d).where("cleared_at is null and alarm_type = 'ALARM_IF_TERMINATED'").select("job_name")
    return jobs(spark, d).where("status = 6 and alarm_if_fail").join(open_, "job_name", "left_anti").select("job_name")


@query("must_complete_alarm", f"""WITH {JOBS}, s AS (SELECT job_name, status, last_start, unnest(start_times) AS t FROM j) SELECT DISTINCT job_name FROM s WHERE status NOT IN (4, 5, 6) AND last_start IS NOT NULL
AND CAST(split_part(t, ':', 1) AS INT) * 60 + CAST(split_part(t, ':', 2) AS INT) <= 720 GROUP BY job_name HAVING max(CAST(split_part(t, ':', 1) AS INT) * 60 + CAST(split_part(t, ':', 2) AS INT)) + 30 <= 720""")
def must_complete_alarm(spark: SparkSession, d: str) -> DataFrame:
    """Started jobs that aren't final half an hour after the start time before noon."""
    at = F.lit("2025-10-15 12:00:00").cast("timestamp")
    late = schedules.deadline_passed(F.lit("+30"), F.col("start_times"), at)
    return jobs(spark, d).where(~F.col("status").isin(4, 5, 6) & F.col("last_start").isNotNull() & F.coalesce(late, F.lit(False))).select("job_name")


@query("max_run_alarm", f"WITH {JOBS} SELECT job_name FROM j WHERE status = 1 AND last_start IS NOT NULL AND epoch_us(TIMESTAMP '2025-10-15 12:00:00') - epoch_us(last_start) > CAST(max_run_alarm AS BIGINT) * 60000000")
def max_run_alarm(spark: SparkSession, d: str) -> DataFrame:
    now = F.unix_micros(F.lit("2025-10-15 12:00:00").cast("timestamp"))
    return jobs(spark, d).where((F.col("status") == 1) & (now - _US("last_start") > F.col("max_run_alarm").cast("long") * 60_000_000)).select("job_name")


@query("term_run_time_watchdog", f"WITH {JOBS} SELECT job_name FROM j WHERE status = 1 AND epoch_us(TIMESTAMP '2025-10-15 12:00:00') - epoch_us(last_start) > CAST(term_run_time AS BIGINT) * 60000000")
def term_run_time_watchdog(spark: SparkSession, d: str) -> DataFrame:
    now = F.unix_micros(F.lit("2025-10-15 12:00:00").cast("timestamp"))
    return jobs(spark, d).where((F.col("status") == 1) & (now - _US("last_start") > F.col("term_run_time").cast("long") * 60_000_000)).select("job_name")


@query("must_start_alarm", f"""WITH {JOBS}, s AS (SELECT job_name, unnest(start_times) AS t, last_run_date FROM j)
SELECT job_name, max(CAST(split_part(t, ':', 1) AS INT) * 60 + CAST(split_part(t, ':', 2) AS INT)) AS due_minute FROM s
WHERE CAST(split_part(t, ':', 1) AS INT) * 60 + CAST(split_part(t, ':', 2) AS INT) <= 720 AND (last_run_date IS NULL OR last_run_date <> DATE '2025-10-15') GROUP BY 1""")
def must_start_alarm(spark: SparkSession, d: str) -> DataFrame:
    """Jobs whose nearest start time before now has passed without a run today."""
    due = schedules.preceding_start(F.col("start_times"), F.lit("2025-10-15 12:00:00").cast("timestamp"))
    rows = jobs(spark, d).where(~F.coalesce(F.col("last_run_date") == F.lit("2025-10-15").cast("date"), F.lit(False)))
    return rows.select("job_name", due.alias("due_minute")).where("due_minute is not null")


@query("heartbeat_alarm", f"""WITH {JOBS}, m AS (SELECT machine, max(created_at) AS beat FROM job_runs WHERE machine IS NOT NULL GROUP BY 1)
SELECT j.job_name, j.machine FROM j JOIN m ON m.machine = j.machine WHERE j.status IN (1, 3) AND m.beat < TIMESTAMP '2025-11-17 12:00:00'""")
def heartbeat_alarm(spark: SparkSession, d: str) -> DataFrame:
    beats = table(spark, d, "job_runs").where("machine is not null").groupBy("machine").agg(F.max("created_at").alias("beat"))
    stale = beats.where(F.col("beat") < F.lit("2025-11-17 12:00:00").cast("timestamp_ntz"))
    return jobs(spark, d).where("status in (1, 3)").join(stale, "machine").select("job_name", "machine")


@query("job_machine_navigation", f"WITH {JOBS}, m AS (SELECT machine, count(*) AS n_runs FROM r WHERE machine IS NOT NULL GROUP BY 1), r AS (SELECT DISTINCT run_id, machine FROM job_runs) SELECT j.job_name, m.n_runs FROM j LEFT JOIN m USING (machine)".replace(f"WITH {JOBS}, m", f"WITH {JOBS}, {RUNS}, m").replace(", r AS (SELECT DISTINCT run_id, machine FROM job_runs)", ""))
def job_machine_navigation(spark: SparkSession, d: str) -> DataFrame:
    per = runs(spark, d).where("machine is not null").groupBy("machine").agg(F.count("*").alias("n_runs"))
    return jobs(spark, d).join(per, "machine", "left").select("job_name", "n_runs")


@query("box_self_join", f"WITH {JOBS} SELECT c.job_name, p.job_name AS box, p.status AS box_status FROM j c JOIN j p ON lower(trim(c.box_name, ' ' || chr(9) || chr(10) || chr(13))) = lower(p.job_name)")
def box_self_join(spark: SparkSession, d: str) -> DataFrame:
    rows = jobs(spark, d).select("job_name", "status", name_key(F.col("box_name")).alias("key"))
    boxes = rows.select(F.col("job_name").alias("box"), F.col("status").alias("box_status"), F.lower("job_name").alias("key"))
    return rows.select("job_name", "key").join(boxes, "key").select("job_name", "box", "box_status")


@query("known_job_check", f"""WITH {JOBS} SELECT b.batch_row_id, e.job_name IS NOT NULL AS exact, coalesce(e.job_name, l.job_name) AS known_as FROM run_batches b LEFT JOIN j e ON e.job_name = b.job_name
LEFT JOIN j l ON lower(l.job_name) = lower(trim(b.job_name, ' ' || chr(9) || chr(10) || chr(13)))""")
def known_job_check(spark: SparkSession, d: str) -> DataFrame:
    """Exact names first, then without case; no two jobs differ by case only."""
    names = jobs(spark, d).select("job_name")
    rows = table(spark, d, "run_batches").select("batch_row_id", "job_name")
    exact = names.select(F.col("job_name").alias("e"))
    loose = names.select(F.col("job_name").alias("l"), F.lower("job_name").alias("k"))
    out = rows.join(exact, rows["job_name"] == exact["e"], "left").withColumn("k", name_key(F.col("job_name"))).join(loose, "k", "left")
    return out.select("batch_row_id", F.col("e").isNotNull().alias("exact"), F.coalesce("e", "l").alias("known_as"))


@query("event_run_interval_join", f"""WITH {RUNS}, e AS (SELECT alarm_id, job_name, raised_at FROM al), {ALARMS}
SELECT e.alarm_id, count(*) AS n_runs FROM e JOIN r ON r.job_name = e.job_name AND e.raised_at BETWEEN r.start_time AND coalesce(r.end_time, TIMESTAMP '2025-11-18') GROUP BY 1""".replace(", e AS (SELECT alarm_id, job_name, raised_at FROM al), ", ", ").replace("\nSELECT", ", e AS (SELECT alarm_id, job_name, raised_at FROM al)\nSELECT"))
def event_run_interval_join(spark: SparkSession, d: str) -> DataFrame:
    """Alarms with the runs of their job that were active when they were raised, counted without listing the pairs."""
    at = lambda c: F.unix_micros(c.cast("timestamp"))
    last = F.lit("2025-11-18 00:00:00").cast("timestamp_ntz")
    points = alarms(spark, d).select(F.col("alarm_id").alias("id"), F.col("job_name").alias("key"), at(F.col("raised_at")).alias("at"))
    spans = runs(spark, d).where("start_time is not null").select(F.col("job_name").alias("key"), at(F.col("start_time")).alias("a"), at(F.coalesce(F.col("end_time"), last)).alias("b"))
    out = concurrency.count_covering(points, spans.where("b >= a"))
    return out.where("n > 0").select(F.col("id").alias("alarm_id"), F.col("n").alias("n_runs"))


@query("nearest_preceding_run", f"""WITH {RUNS}, a AS (SELECT batch_row_id, lower(trim(job_name, ' ' || chr(9) || chr(10) || chr(13))) AS k, start_time AS t FROM run_batches WHERE start_time IS NOT NULL),
h AS (SELECT lower(job_name) AS k, start_time AS t FROM r WHERE start_time IS NOT NULL)
SELECT batch_row_id, epoch_us(max(h.t)) AS previous_us FROM a JOIN h ON h.k = a.k AND h.t <= a.t GROUP BY 1""")
def nearest_preceding_run(spark: SparkSession, d: str) -> DataFrame:
    """As-of join: the last run of the same job that had started when a batch row did."""
    at = F.unix_micros(F.col("start_time").cast("timestamp"))
    left = table(spark, d, "run_batches").where("start_time is not null").select(F.col("batch_row_id").alias("id"), name_key(F.col("job_name")).alias("key"), at.alias("at"))
    right = table(spark, d, "job_runs").where("start_time is not null").select(name_key(F.col("job_name")).alias("key"), at.alias("at"))
    return concurrency.as_of(left, right).where("previous is not null").select(F.col("id").alias("batch_row_id"), F.col("previous").alias("previous_us"))


@query("fan_in", f"""WITH {CONDITIONS}, e AS (SELECT DISTINCT job_name, unnest(regexp_extract_all(condition, '[a-z]\\((job_[0-9]+)[,) ]', 1)) AS dep FROM jc)
SELECT jc.job_name, count(e.job_name) AS n_dependents FROM jc LEFT JOIN e ON e.dep = jc.job_name AND e.job_name <> jc.job_name GROUP BY 1""")
def fan_in(spark: SparkSession, d: str) -> DataFrame:
    """How many other jobs refer to each job in their conditions, cross-instance references aside."""
    from runweave.conditions.columns import edges

    rows = conditions(spark, d)
    dep = edges(rows, "job_name", "condition").where("job != dep").groupBy(F.col("dep").alias("job_name")).agg(F.count("*").alias("n"))
    return rows.select("job_name").join(dep, "job_name", "left").select("job_name", F.coalesce("n", F.lit(0)).alias("n_dependents"))
