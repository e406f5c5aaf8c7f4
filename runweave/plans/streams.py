"""Queries over the event stream, in their batch form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runweave.plans.registry import query
from runweave.session import table
from runweave.streaming import events as E
from runweave.streaming import timers


def log(spark: SparkSession, d: str) -> DataFrame:
    """The events table as job events: job by user, type by kind."""
    rows = table(spark, d, "events")
    return rows.select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.concat(F.lit("job_"), F.col("user_id").cast("string")).alias("job_name"), E.event_of(F.col("event_type")).alias("event"), F.lit("SUCCESS").alias("new_status"))


@query("stream_fsm")
def stream_fsm(spark: SparkSession, d: str) -> DataFrame:
    """Transitions of every job; tested to equal the stream's, and a plain replay."""
    return E.batch_states(log(spark, d))


@query("stream_window_counts", """SELECT epoch_us(time_bucket(INTERVAL 5 MINUTE, ts)) AS from_us, CASE event_type WHEN 'click' THEN 'STARTJOB' WHEN 'view' THEN 'RUNNING' WHEN 'purchase' THEN 'CHANGE_STATUS' WHEN 'signup' THEN 'JOB_ON_HOLD' ELSE 'JOB_OFF_HOLD' END AS event,
count(*) AS n FROM events GROUP BY ALL""")
def stream_window_counts(spark: SparkSession, d: str) -> DataFrame:
    return E.windowed_counts(log(spark, d)).select(F.unix_micros("from_ts").alias("from_us"), "event", "n")


@query("overdue_runs", """WITH e AS (SELECT 'job_' || user_id AS job_name, epoch_us(ts) AS us, event_type IN ('click', 'view') AS opens, lead(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next FROM events),
n AS (SELECT *, coalesce(next, (SELECT max(us) FROM e)) AS until FROM e) SELECT job_name, us AS started_us, us + 3600000000 AS overdue_us FROM n WHERE opens AND until - us > 3600000000""")
def overdue_runs(spark: SparkSession, d: str) -> DataFrame:
    """Runs whose clock isn't touched within an hour; the stream with timers gives the same rows."""
    return timers.overdue_batch(log(spark, d), 3600)


@query("event_board", """SELECT CASE event_type WHEN 'click' THEN 'STARTJOB' WHEN 'view' THEN 'RUNNING' WHEN 'purchase' THEN 'CHANGE_STATUS' WHEN 'signup' THEN 'JOB_ON_HOLD' ELSE 'JOB_OFF_HOLD' END AS event, count(*) AS n, epoch_us(max(ts)) AS last_us FROM events GROUP BY 1""")
def event_board(spark: SparkSession, d: str) -> DataFrame:
    """The whole board that the stream pushes in complete mode."""
    return timers.counts_by_status(log(spark, d)).select("event", "n", F.unix_micros("last_ts").alias("last_us"))
