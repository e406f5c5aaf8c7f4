"""Scans, filters, sorts, limits and set operations (S, F, L, U, R of the inventory)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runweave.functions import schedules
from runweave.functions.statuses import STATUS_CODES, is_counted, status_abbrev, status_code, status_name
from runweave.functions.texts import name_key
from runweave.operators import concurrency
from runweave.plans.estate import ALARMS, DATES, JOBS, RUNS, alarms, calendars, jobs, runs
from runweave.plans.registry import query
from runweave.session import table

NOW = "TIMESTAMP '2025-10-15 12:00:00'"


@query("jobs_by_key", f"WITH {JOBS} SELECT job_name, job_type, status FROM j")
def jobs_by_key(spark: SparkSession, d: str) -> DataFrame:
    return jobs(spark, d).select("job_name", "job_type", "status").orderBy("job_name")


@query("status_scan", "SELECT job_name, status FROM jobs")
def status_scan(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "jobs").select("job_name", "status")


@query("last_end_scan", "SELECT job_name, epoch_us(last_end) AS last_end_us FROM jobs")
def last_end_scan(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "jobs").select("job_name", F.unix_micros(F.col("last_end").cast("timestamp")).alias("last_end_us"))


@query("status_of_names", f"WITH {JOBS} SELECT job_name, status FROM j WHERE job_name IN (SELECT job_name FROM run_batches)")
def status_of_names(spark: SparkSession, d: str) -> DataFrame:
    """Status restricted to a set of names of any size: a semi join takes the place of lists of keys."""
    return jobs(spark, d).select("job_name", "status").join(table(spark, d, "run_batches").select("job_name"), "job_name", "left_semi")


@query("point_lookup", f"WITH {JOBS} SELECT job_name, owner, machine FROM j WHERE job_name = (SELECT min(job_name) FROM jobs)")
def point_lookup(spark: SparkSession, d: str) -> DataFrame:
    least = table(spark, d, "jobs").agg(F.min("job_name").alias("job_name"))
    return jobs(spark, d).join(least, "job_name").select("job_name", "owner", "machine")


@query(
    "table_counts",
    " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n_rows FROM {t}" for t in ("jobs", "job_runs", "run_batches", "history_rows", "history_imports")),
)
def table_counts(spark: SparkSession, d: str) -> DataFrame:
    out = None
    for t in ("jobs", "job_runs", "run_batches", "history_rows", "history_imports"):
        one = table(spark, d, t).agg(F.count("*").alias("n_rows")).select(F.lit(t).alias("table_name"), "n_rows")
        out = one if out is None else out.unionByName(one)
    return out


@query("like_filter", rf"WITH {JOBS} SELECT job_name FROM j WHERE job_name LIKE '%\_load\_%' ESCAPE '\'")
def like_filter(spark: SparkSession, d: str) -> DataFrame:
    return jobs(spark, d).where(F.col("job_name").like(r"%\_load\_%")).select("job_name")


@query(
    "box_pattern_filter",
    rf"""WITH {JOBS}, b AS (SELECT job_name FROM j WHERE job_type = 'BOX' AND regexp_full_match(lower(job_name), 'crm_.*'))
SELECT job_name FROM j WHERE job_name IN (SELECT job_name FROM b) OR lower(trim(box_name, ' ' || chr(9) || chr(10) || chr(13))) IN (SELECT lower(job_name) FROM b)""",
)
def box_pattern_filter(spark: SparkSession, d: str) -> DataFrame:
    """Boxes by pattern (% any text, _ itself, without case) and their direct children."""
    rows = jobs(spark, d).select("job_name", "job_type", "box_name")
    boxes = rows.where((F.col("job_type") == "BOX") & schedules.box_pattern(F.col("job_name"), "crm_%")).select("job_name")
    children = rows.withColumn("_b", name_key(F.col("box_name"))).join(boxes.select(F.lower("job_name").alias("_b")), "_b", "left_semi")
    return boxes.union(children.select("job_name")).distinct()


@query("machine_wildcard", "SELECT DISTINCT machine FROM jobs WHERE lower(machine) LIKE 'agt-lnx_00%'")
def machine_wildcard(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "jobs").where(F.lower("machine").like("agt-lnx_00%")).select("machine").distinct()


@query("substring_filter", f"WITH {JOBS} SELECT job_name, machine FROM j WHERE contains(lower(job_name), 'ledger') AND contains(lower(machine), 'etl') AND status = 4")
def substring_filter(spark: SparkSession, d: str) -> DataFrame:
    rows = jobs(spark, d).where(F.lower("job_name").contains("ledger") & F.lower("machine").contains("etl") & (F.col("status") == 4))
    return rows.select("job_name", "machine")


@query("status_filter", f"WITH {JOBS} SELECT job_name FROM j WHERE coalesce(status, 8) = 8")
def status_filter(spark: SparkSession, d: str) -> DataFrame:
    """By name, two-letter code or number; no status counts as INACTIVE."""
    return jobs(spark, d).where(F.coalesce("status", F.lit(STATUS_CODES["INACTIVE"])) == status_code(F.lit("inactive"))).select("job_name")


@query("active_alarms", f"WITH {RUNS}, {ALARMS} SELECT alarm_id, job_name FROM al WHERE cleared_at IS NULL")
def active_alarms(spark: SparkSession, d: str) -> DataFrame:
    return alarms(spark, d).where("cleared_at is null").select("alarm_id", "job_name")


@query("runs_in_range", f"WITH {RUNS} SELECT run_id FROM r WHERE start_time BETWEEN TIMESTAMP '2025-10-01' AND TIMESTAMP '2025-10-02'")
def runs_in_range(spark: SparkSession, d: str) -> DataFrame:
    in_range = F.col("start_time").between(F.lit("2025-10-01").cast("timestamp_ntz"), F.lit("2025-10-02").cast("timestamp_ntz"))
    return table(spark, d, "job_runs").where(in_range).dropDuplicates(["run_id"]).select("run_id")


@query("running_boxes", f"WITH {JOBS} SELECT job_name FROM j WHERE job_type = 'BOX' AND status IN (1, 9)")
def running_boxes(spark: SparkSession, d: str) -> DataFrame:
    return jobs(spark, d).where("job_type = 'BOX' and status in (1, 9)").select("job_name")


@query("stuck_or_running", f"WITH {JOBS} SELECT job_name, status FROM j WHERE job_type <> 'BOX' AND status IN (1, 3)")
def stuck_or_running(spark: SparkSession, d: str) -> DataFrame:
    return jobs(spark, d).where("job_type != 'BOX' and status in (1, 3)").select("job_name", "status")


@query("schedulable", f"WITH {JOBS} SELECT job_name FROM j WHERE start_times IS NOT NULL")
def schedulable(spark: SparkSession, d: str) -> DataFrame:
    return jobs(spark, d).where("start_times is not null").select("job_name")


@query(
    "alarm_candidates",
    f"WITH {JOBS} SELECT job_name FROM j WHERE (status = 5 AND alarm_if_fail) OR (status = 6 AND alarm_if_fail) OR (status = 1 AND max_run_alarm IS NOT NULL)",
)
def alarm_candidates(spark: SparkSession, d: str) -> DataFrame:
    return jobs(spark, d).where("(status = 5 and alarm_if_fail) or (status = 6 and alarm_if_fail) or (status = 1 and max_run_alarm is not null)").select("job_name")


@query(
    "plausible_window",
    f"""WITH {RUNS} SELECT source, count(*) AS n, epoch_us(min(CASE WHEN year(start_time) BETWEEN 2000 AND 2026 THEN start_time END)) AS first_us,
epoch_us(max(CASE WHEN year(start_time) BETWEEN 2000 AND 2026 THEN start_time END)) AS last_us FROM r GROUP BY source""",
)
def plausible_window(spark: SparkSession, d: str) -> DataFrame:
    plausible = F.when(F.year("start_time").between(2000, 2026), F.col("start_time"))
    us = lambda c: F.unix_micros(c.cast("timestamp"))
    return runs(spark, d).groupBy("source").agg(F.count("*").alias("n"), us(F.min(plausible)).alias("first_us"), us(F.max(plausible)).alias("last_us"))


@query(
    "run_window_filter",
    f"WITH {RUNS} SELECT run_id FROM r WHERE hour(start_time) * 60 + minute(start_time) >= 1320 OR hour(start_time) * 60 + minute(start_time) <= 240",
)
def run_window_filter(spark: SparkSession, d: str) -> DataFrame:
    """Starts within a window that wraps over midnight, bounds included."""
    return runs(spark, d).where(schedules.in_run_window(F.lit("22:00-04:00"), F.col("start_time"))).select("run_id")


@query(
    "day_of_week_filter",
    f"""WITH {JOBS} SELECT job_name FROM j WHERE days_of_week IS NULL OR len(days_of_week) = 0 OR list_contains(days_of_week, 'all') OR list_contains(days_of_week, 'we')""",
)
def day_of_week_filter(spark: SparkSession, d: str) -> DataFrame:
    now = F.lit("2025-10-15 12:00:00").cast("timestamp")  # a Wednesday
    return jobs(spark, d).where(schedules.on_day(F.col("days_of_week"), now)).select("job_name")


@query("start_time_trigger", f"WITH {JOBS} SELECT job_name FROM j WHERE list_contains([lpad(trim(x), 5, '0') FOR x IN start_times], '12:00')")
def start_time_trigger(spark: SparkSession, d: str) -> DataFrame:
    return jobs(spark, d).where(schedules.starts_at(F.col("start_times"), F.lit("2025-10-15 12:00:00").cast("timestamp"))).select("job_name")


@query(
    "calendar_filter",
    f"""WITH {JOBS}, {DATES} SELECT job_name FROM j WHERE run_calendar IS NULL OR EXISTS (SELECT 1 FROM cal WHERE calendar_name = j.run_calendar AND day = DATE '2025-10-15')""",
)
def calendar_filter(spark: SparkSession, d: str) -> DataFrame:
    """Jobs whose calendar has the day; a calendar that doesn't exist has no days."""
    rows = jobs(spark, d).select("job_name", "run_calendar")
    today = calendars(spark, d).where(F.col("day") == F.lit("2025-10-15").cast("date")).select(F.col("calendar_name").alias("run_calendar"))
    return rows.where("run_calendar is null").unionByName(rows.join(today, "run_calendar", "left_semi").select("job_name", "run_calendar")).select("job_name")


@query(
    "calendar_exclusion",
    f"WITH {JOBS}, {DATES} SELECT job_name FROM j WHERE NOT EXISTS (SELECT 1 FROM cal WHERE calendar_name = j.run_calendar AND day = DATE '2025-10-15')",
)
def calendar_exclusion(spark: SparkSession, d: str) -> DataFrame:
    today = calendars(spark, d).where(F.col("day") == F.lit("2025-10-15").cast("date")).select(F.col("calendar_name").alias("run_calendar"))
    return jobs(spark, d).join(today, "run_calendar", "left_anti").select("job_name")


@query(
    "is_triggered",
    f"""WITH {JOBS}, {DATES} SELECT job_name FROM j WHERE status IN (4, 5, 6, 8) AND date_conditions AND start_times IS NOT NULL
AND (run_calendar IS NULL OR EXISTS (SELECT 1 FROM cal WHERE calendar_name = j.run_calendar AND day = DATE '2025-10-15'))
AND (days_of_week IS NULL OR len(days_of_week) = 0 OR list_contains(days_of_week, 'all') OR list_contains(days_of_week, 'we'))
AND list_contains([lpad(trim(x), 5, '0') FOR x IN start_times], '12:00')
AND (last_start IS NULL OR date_trunc('minute', last_start) <> {NOW})""",
)
def is_triggered(spark: SparkSession, d: str) -> DataFrame:
    now = F.lit("2025-10-15 12:00:00").cast("timestamp")
    today = calendars(spark, d).where(F.col("day") == F.to_date(now)).select(F.col("calendar_name").alias("_c"), F.lit(True).alias("_in"))
    rows = jobs(spark, d).where(F.col("status").isin(4, 5, 6, 8) & F.col("date_conditions") & F.col("start_times").isNotNull())
    rows = rows.join(today, rows["run_calendar"] == today["_c"], "left").where("run_calendar is null or _in")
    fired = F.coalesce(F.date_trunc("minute", F.col("last_start").cast("timestamp")) == now, F.lit(False))
    return rows.where(schedules.on_day(F.col("days_of_week"), now) & schedules.starts_at(F.col("start_times"), now) & ~fired).select("job_name")


@query(
    "start_time_validation",
    f"""WITH {JOBS}, t AS (SELECT job_name, unnest(start_times) AS t FROM j) SELECT job_name, t AS start_time, regexp_full_match(trim(t), '([01]?[0-9]|2[0-3]):[0-5][0-9]') AS valid FROM t""",
)
def start_time_validation(spark: SparkSession, d: str) -> DataFrame:
    rows = jobs(spark, d).select("job_name", F.explode("start_times").alias("start_time"))
    return rows.withColumn("valid", F.trim("start_time").rlike("^([01]?[0-9]|2[0-3]):[0-5][0-9]$"))


@query("name_charset", f"WITH {JOBS} SELECT job_name FROM j WHERE NOT regexp_full_match(replace(job_name, 'load', 'lo ad'), '[A-Za-z0-9_.:#@-]+')")
def name_charset(spark: SparkSession, d: str) -> DataFrame:
    return jobs(spark, d).where(~F.replace("job_name", F.lit("load"), F.lit("lo ad")).rlike("^[A-Za-z0-9_.:#@-]+$")).select("job_name")


@query(
    "status_classes",
    """SELECT status AS code, CASE WHEN status IN (4, 5, 6, 7, 16) THEN 'counted' WHEN status IN (1, 3, 8, 9, 10, 11, 12, 13, 14, 15, 17, 99) THEN 'non_terminal' ELSE 'unknown' END AS class,
count(*) AS n FROM run_batches GROUP BY status""",
)
def status_classes(spark: SparkSession, d: str) -> DataFrame:
    code = status_code(F.col("status").cast("string"))
    kind = F.when(code.isNull(), "unknown").when(is_counted(code), "counted").otherwise("non_terminal")
    return table(spark, d, "run_batches").groupBy(F.col("status").alias("code"), kind.alias("class")).agg(F.count("*").alias("n"))


@query("status_labels", "SELECT DISTINCT status, CASE status WHEN 1 THEN 'RU' WHEN 4 THEN 'SU' WHEN 5 THEN 'FA' WHEN 6 THEN 'TE' END AS abbrev, "
       "CASE status WHEN 1 THEN 'RUNNING' WHEN 4 THEN 'SUCCESS' WHEN 5 THEN 'FAILURE' WHEN 6 THEN 'TERMINATED' END AS name FROM job_runs")  # fmt: skip
def status_labels(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "job_runs").select("status").distinct()
    return rows.select("status", status_abbrev(F.col("status")).alias("abbrev"), status_name(F.col("status")).alias("name"))


@query(
    "fsm_transition_check",
    f"""WITH {RUNS}, p AS (SELECT job_name, status AS new, lag(status) OVER (PARTITION BY job_name ORDER BY start_time, run_id) AS old FROM r WHERE start_time IS NOT NULL),
t(old, new) AS (VALUES (1, 4), (1, 5), (1, 6))
SELECT p.old, p.new, EXISTS (SELECT 1 FROM t WHERE t.old = p.old AND t.new = p.new) AS allowed, count(*) AS n FROM p WHERE p.old IS NOT NULL GROUP BY ALL""",
)
def fsm_transition_check(spark: SparkSession, d: str) -> DataFrame:
    rows = runs(spark, d).where("start_time is not null").select("job_name", "status", "start_time", "run_id")
    pairs = concurrency.previous_value(rows, "job_name", F.col("start_time"), "run_id", "status").where("previous is not null").select(F.col("previous").alias("old"), F.col("status").alias("new"))
    return pairs.groupBy("old", "new", schedules.can_move(F.col("old"), F.col("new")).alias("allowed")).agg(F.count("*").alias("n"))


@query("exit_code_status", f"WITH {RUNS} SELECT CASE WHEN exit_code <= 1 THEN 4 ELSE 5 END AS code_status, count(*) AS n FROM r WHERE exit_code IS NOT NULL GROUP BY 1")
def exit_code_status(spark: SparkSession, d: str) -> DataFrame:
    rows = runs(spark, d).where("exit_code is not null")
    return rows.groupBy(schedules.status_of_exit(F.col("exit_code"), F.lit(1)).alias("code_status")).agg(F.count("*").alias("n"))


@query("newest_runs", f"WITH {RUNS} SELECT run_id, job_name FROM r WHERE start_time IS NOT NULL ORDER BY start_time DESC, run_id LIMIT 20")
def newest_runs(spark: SparkSession, d: str) -> DataFrame:
    return runs(spark, d).where("start_time is not null").orderBy(F.desc("start_time"), "run_id").limit(20).select("run_id", "job_name")


@query("last_finished", f"WITH {RUNS} SELECT run_id FROM r WHERE end_time IS NOT NULL ORDER BY end_time DESC, run_id LIMIT 100")
def last_finished(spark: SparkSession, d: str) -> DataFrame:
    return runs(spark, d).where("end_time is not null").orderBy(F.desc("end_time"), "run_id").limit(100).select("run_id")


@query("paged_lines", "SELECT import_id, line_no, raw_line FROM history_rows ORDER BY import_id, line_no LIMIT 50 OFFSET 100")
def paged_lines(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "history_rows").select("import_id", "line_no", "raw_line").orderBy("import_id", "line_no").offset(100).limit(50)


@query("newest_alarms", f"WITH {RUNS}, {ALARMS} SELECT alarm_id FROM al ORDER BY raised_at DESC, alarm_id LIMIT 200")
def newest_alarms(spark: SparkSession, d: str) -> DataFrame:
    return alarms(spark, d).orderBy(F.desc("raised_at"), "alarm_id").limit(200).select("alarm_id")


@query("newest_events", "SELECT event_id, event_type FROM events ORDER BY ts DESC, event_id LIMIT 500")
def newest_events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").orderBy(F.desc("ts"), "event_id").limit(500).select("event_id", "event_type")


@query("precedence_union", f"""WITH {RUNS}, s AS (SELECT job_name, source, count(*) AS n FROM r GROUP BY 1, 2)
SELECT job_name, source, n FROM s QUALIFY row_number() OVER (PARTITION BY job_name ORDER BY CASE source WHEN 'imported' THEN 0 WHEN 'live' THEN 1 ELSE 2 END) = 1""")
def precedence_union(spark: SparkSession, d: str) -> DataFrame:
    """Per job the counts of the best source that has any: imported before live before simulated."""
    rank = F.when(F.col("source") == "imported", 0).when(F.col("source") == "live", 1).otherwise(2)
    counts = runs(spark, d).groupBy("job_name", "source").agg(F.count("*").alias("n"))
    return counts.groupBy("job_name").agg(F.min_by(F.struct("source", "n"), rank).alias("x")).select("job_name", "x.source", "x.n")


@query("removed_jobs", "SELECT DISTINCT lower(trim(job_name)) AS job_name FROM run_batches WHERE job_name IS NOT NULL AND lower(trim(job_name)) NOT IN (SELECT lower(job_name) FROM jobs WHERE job_type = 'CMD')")
def removed_jobs(spark: SparkSession, d: str) -> DataFrame:
    """Names of a new export that the estate's command jobs lack."""
    known = table(spark, d, "jobs").where("job_type = 'CMD'").select(F.lower("job_name").alias("job_name"))
    return table(spark, d, "run_batches").select(F.lower(F.trim("job_name")).alias("job_name")).where("job_name is not null").join(known, "job_name", "left_anti").distinct()


@query("calendar_dates", f"WITH {DATES} SELECT calendar_name, array_to_string(list_sort(list(DISTINCT CAST(day AS VARCHAR))), ',') AS dates FROM cal GROUP BY 1")
def calendar_dates(spark: SparkSession, d: str) -> DataFrame:
    days = calendars(spark, d).groupBy("calendar_name").agg(F.array_sort(F.collect_set(F.col("day").cast("string"))).alias("ds"))
    return days.select("calendar_name", F.array_join("ds", ",").alias("dates"))


@query("distinct_machines", "SELECT DISTINCT split_part(lower(trim(machine)), '.', 1) AS host FROM job_runs WHERE trim(coalesce(machine, '')) <> ''")
def distinct_machines(spark: SparkSession, d: str) -> DataFrame:
    from runweave.functions.texts import host_key

    return table(spark, d, "job_runs").select(host_key(F.col("machine")).alias("host")).where("host is not null").distinct()
