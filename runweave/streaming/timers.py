"""Timers over job events: runs that take too long, by event-time timeouts on a stream and by one comparison of neighbours in batch.

An event that opens a run (re)starts its job's clock, any other stops it. A run
is overdue when the clock isn't touched within the limit. State is one time
for each job with an open run and is removed when the run ends or is overdue, so
jobs that fall silent leave nothing behind.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from runweave.conditions import columns
from runweave.operators.concurrency import previous_value

OPENING = ("STARTJOB", "FORCE_STARTJOB", "RUNNING")
_OUT = "job_name string, started_us long, overdue_us long"


def overdue(events: DataFrame, limit_seconds: int, watermark: str = "10 minutes") -> DataFrame:
    """(job_name, started_us, overdue_us) of a stream of (event_id, ts, job_name, event), in append mode, as soon as the watermark passes the limit."""
    limit = limit_seconds * 1_000_000

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        opened = state.get[0] if state.exists else None
        found = []
        if state.hasTimedOut:
            found.append((key[0], opened, opened + limit))
            opened = None
        else:
            for e in pd.concat(list(batches)).sort_values(["us", "event_id"]).itertuples(index=False):
                if opened is not None and e.us - opened > limit:
                    found.append((key[0], opened, opened + limit))
                opened = int(e.us) if e.event in OPENING else None
        if opened is None:
            if state.exists:
                state.remove()
        else:
            state.update((opened,))
            # the timer must lie beyond the watermark; an event at the limit itself is still in time
            state.setTimeoutTimestamp(max((opened + limit) // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(found, columns=["job_name", "started_us", "overdue_us"])

    once = events.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(["event_id"])
    keyed = once.select("event_id", "ts", "job_name", "event", F.unix_micros("ts").alias("us"))
    return keyed.groupBy("job_name").applyInPandasWithState(run, _OUT, "opened long", "append", GroupStateTimeout.EventTimeTimeout)


def overdue_batch(events: DataFrame, limit_seconds: int, now: Column | None = None) -> DataFrame:
    """The same runs over a whole log; open ones at its end are overdue if the limit passed before now (the last event of all).

    Rows without job or time are left out; repeated events count once.
    """
    limit = limit_seconds * 1_000_000
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = events.where("job_name is not null and ts is not null").dropDuplicates(["event_id"])
    rows = rows.select("event_id", "ts", "job_name", F.when(F.col("event").isin(*OPENING), us).alias("opened"))
    last = rows.groupBy("job_name").agg(F.max_by("opened", F.struct("ts", "event_id")).alias("previous")).where("previous is not null")
    end = rows.agg(F.max(us).alias("at"))  # one row
    last = last.crossJoin(F.broadcast(end)) if now is None else last.withColumn("at", F.unix_micros(now))
    between = previous_value(rows, "job_name", F.col("ts"), "event_id", "opened").where("previous is not null").select("job_name", "previous", us.alias("at"))
    both = between.unionByName(last.select("job_name", "previous", "at")).where(F.col("at") - F.col("previous") > limit)
    return both.select("job_name", F.col("previous").alias("started_us"), (F.col("previous") + limit).alias("overdue_us"))


def counts_by_status(events: DataFrame) -> DataFrame:
    """Events by kind since the beginning: the whole board in complete mode, what changed in update mode."""
    return events.groupBy("event").agg(F.count("*").alias("n"), F.max("ts").alias("last_ts"))


def ready_jobs(jobs: DataFrame, changed: DataFrame, states: DataFrame, globals_: DataFrame, now: Column) -> DataFrame:
    """(job): jobs (job_name, condition) whose condition refers to one that changed (job_name) and holds in the states; what a micro-batch makes ready."""
    edges = columns.edges(jobs, "job_name", "condition", runtime=True)
    touched = edges.join(changed.select(F.col("job_name").alias("dep")), "dep", "left_semi").select(F.col("job").alias("job_name")).distinct()
    asked = jobs.join(touched, "job_name", "left_semi")
    return columns.evaluate(asked, "job_name", "condition", states, globals_, now).where("satisfied").select("job")


def propagate(changes: DataFrame, jobs: DataFrame, states_path: str, out_path: str, checkpoint: str):
    """Starts a stream that writes the jobs each micro-batch of status changes makes ready.

    changes: job_name, status, ts. States are appended to a table and read as
    latest wins, so a batch that is run again after a failure changes nothing: its
    rows are written under its number and replace themselves.
    """
    spark = jobs.sparkSession

    def batch(rows: DataFrame, number: int) -> None:
        rows = rows.groupBy("job_name").agg(F.max_by("status", "ts").alias("status"), F.max("ts").alias("ts"))
        rows.write.mode("overwrite").parquet(f"{states_path}/batch={number}")
        known = spark.read.schema("job_name string, status string, ts timestamp, batch long").parquet(states_path)
        states = known.groupBy(F.col("job_name").alias("name")).agg(F.max_by("status", F.struct("batch", "ts")).alias("status"), F.max("ts").alias("last_end"))
        changed = spark.read.parquet(f"{states_path}/batch={number}")
        none = spark.createDataFrame([], "name string, value string")
        ready = ready_jobs(jobs, changed, states.withColumn("exit_code", F.lit(None).cast("int")), none, F.current_timestamp())
        ready.write.mode("overwrite").parquet(f"{out_path}/batch={number}")

    return changes.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
