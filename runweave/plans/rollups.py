"""Roll-ups through nested boxes, report order, unions of alarm rules, machine load."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runweave.functions.texts import host_key, name_key
from runweave.operators import hierarchy
from runweave.plans import aggregates
from runweave.plans.estate import CONDITIONS, JOBS, RUNS, conditions, jobs, runs
from runweave.plans.problems import P3_BASE
from runweave.plans.registry import SQL, query
from runweave.session import table

_WORST = "CASE status WHEN 5 THEN 3 WHEN 6 THEN 2 WHEN 1 THEN 1 ELSE 0 END"


@query("box_worst_status", P3_BASE + f""", s AS (SELECT lower(job_name) AS k, max({_WORST}) AS w FROM jobs GROUP BY 1)
SELECT p.name AS box, max(s.w) AS worst, count(*) AS n_below FROM m JOIN j p ON p.k = m.ancestor JOIN s ON s.k = m.node GROUP BY 1""")
def box_worst_status(spark: SparkSession, d: str) -> DataFrame:
    """Worst status among all jobs below each box, at any depth, with their number."""
    rows = table(spark, d, "jobs").select("job_name", "box_name", "status")
    s = F.col("status")
    worst = rows.groupBy(name_key(F.col("job_name")).alias("node")).agg(F.max(F.when(s == 5, 3).when(s == 6, 2).when(s == 1, 1).otherwise(0)).alias("w"))
    tree = hierarchy.cut(hierarchy.edges(rows, F.col("job_name"), F.col("box_name")))
    pairs = hierarchy.ancestors(tree)
    return pairs.join(worst, "node").groupBy(F.col("ancestor_name").alias("box")).agg(F.max("w").alias("worst"), F.count("*").alias("n_below"))


@query("machine_load", f"""WITH {JOBS} SELECT machine, count(*) FILTER (status IN (1, 3)) AS active, greatest(10 - count(*) FILTER (status IN (1, 3)), 0) AS available, count(*) FILTER (status IN (1, 3)) >= 10 AS saturated
FROM j WHERE machine IS NOT NULL GROUP BY 1""")
def machine_load(spark: SparkSession, d: str) -> DataFrame:
    """Active jobs of each machine against a load limit of ten."""
    n = F.col("active")
    per = jobs(spark, d).where("machine is not null").groupBy("machine").agg(F.count_if(F.col("status").isin(1, 3)).alias("active"))
    return per.select("machine", "active", F.greatest(F.lit(10) - n, F.lit(0)).alias("available"), (n >= 10).alias("saturated"))


_RULES = ("alarm_if_fail", "alarm_if_terminated", "max_run_alarm", "min_run_candidates", "must_start_alarm", "must_complete_alarm", "heartbeat_alarm")


@query("alarm_rules", " UNION ALL ".join(f"SELECT job_name, '{r}' AS rule FROM ({SQL[r]}) {r}_rows" for r in _RULES))
def alarm_rules(spark: SparkSession, d: str) -> DataFrame:
    """All alarms of one tick: the rules' rows put together."""
    out = None
    for r in _RULES:
        one = getattr(aggregates, r)(spark, d).select("job_name", F.lit(r).alias("rule"))
        out = one if out is None else out.unionByName(one)
    return out


@query("runs_by_hour", f"WITH {RUNS} SELECT hour(start_time) AS start_hour, count(*) AS n_runs, CAST(sum(duration_secs) AS BIGINT) AS secs FROM r WHERE start_time IS NOT NULL GROUP BY 1")
def runs_by_hour(spark: SparkSession, d: str) -> DataFrame:
    rows = runs(spark, d).where("start_time is not null")
    return rows.groupBy(F.hour("start_time").cast("long").alias("start_hour")).agg(F.count("*").alias("n_runs"), F.sum("duration_secs").alias("secs"))


@query("busy_share", f"""WITH {RUNS} SELECT split_part(lower(trim(machine)), '.', 1) AS host, CAST(sum(epoch_us(end_time) - epoch_us(start_time)) AS BIGINT) AS run_us FROM r
WHERE trim(coalesce(machine, '')) <> '' AND end_time > start_time GROUP BY 1""")
def busy_share(spark: SparkSession, d: str) -> DataFrame:
    """Time that runs took on each host, overlaps counted as often as they occur."""
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    rows = runs(spark, d).where("end_time > start_time").select(host_key(F.col("machine")).alias("host"), (us("end_time") - us("start_time")).alias("u")).where("host is not null")
    return rows.groupBy("host").agg(F.sum("u").alias("run_us"))


@query("weekly_cube", f"WITH {RUNS} SELECT coalesce(source, 'all') AS source, coalesce(CAST(isodow(start_time) AS VARCHAR), 'all') AS weekday, count(*) AS n FROM r WHERE start_time IS NOT NULL GROUP BY CUBE (source, isodow(start_time))")
def weekly_cube(spark: SparkSession, d: str) -> DataFrame:
    rows = runs(spark, d).where("start_time is not null").select("source", (F.weekday("start_time") + 1).cast("string").alias("weekday"))
    return rows.cube("source", "weekday").agg(F.count("*").alias("n")).select(F.coalesce("source", F.lit("all")).alias("source"), F.coalesce("weekday", F.lit("all")).alias("weekday"), "n")
