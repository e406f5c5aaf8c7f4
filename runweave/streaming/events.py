"""Job events as a stream: a keyed state machine, windowed counts, and propagation to dependents.

The state machine is one stateful operator keyed by job; its batch form replays
the same rule over a whole log, and both give the same states. Events of a key
are applied in the order of their time within a micro-batch; a repeated event
id is dropped within the watermark.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from runweave.functions.statuses import STATUS_CODES
from runweave.functions.schedules import TRANSITIONS
from runweave.session import cut

# The status each event leads to, and the statuses it applies to (None: by the state machine's moves).
EVENTS = {
    "STARTJOB": ("STARTING", None),
    "FORCE_STARTJOB": ("STARTING", None),
    "RUNNING": ("RUNNING", None),
    "KILLJOB": ("TERMINATED", None),
    "JOB_ON_HOLD": ("ON_HOLD", None),
    "JOB_OFF_HOLD": ("INACTIVE", ("ON_HOLD",)),
    "JOB_ON_ICE": ("ON_ICE", None),
    "JOB_OFF_ICE": ("INACTIVE", ("ON_ICE",)),
    "JOB_ON_NOEXEC": ("ON_NOEXEC", None),
    "JOB_OFF_NOEXEC": ("INACTIVE", ("ON_NOEXEC",)),
}
OUT = "job_name string, event_id long, old_status string, new_status string, applied boolean"
STATE = "status string"


def step(status: str, event: str, new: str | None = None) -> str:
    """The status after an event; CHANGE_STATUS forces any."""
    if event == "CHANGE_STATUS":
        return new if new in STATUS_CODES else status
    to, only = EVENTS.get(event, (None, None))
    if to is None:
        return status
    allowed = status in only if only else to in TRANSITIONS.get(status, ())
    return to if allowed else status


def _apply(status: str, pdf: pd.DataFrame) -> tuple[str, list[tuple]]:
    rows = []
    for e in pdf.sort_values(["ts", "event_id"]).itertuples(index=False):
        new = step(status, e.event, e.new_status)
        rows.append((e.job_name, e.event_id, status, new, new != status))
        status = new
    return status, rows


def stream_states(events: DataFrame, watermark: str = "10 minutes") -> DataFrame:
    """Transitions of a stream of (event_id, ts, job_name, event, new_status), in append mode."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        status = state.get[0] if state.exists else "INACTIVE"
        status, rows = _apply(status, pd.concat(list(batches)))
        state.update((status,))
        yield pd.DataFrame(rows, columns=["job_name", "event_id", "old_status", "new_status", "applied"])

    once = events.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(["event_id"])
    return once.groupBy("job_name").applyInPandasWithState(run, OUT, STATE, "append", GroupStateTimeout.NoTimeout)


def batch_states(events: DataFrame) -> DataFrame:
    """The same transitions over a whole log.

    The log is range-partitioned by (job, time, id) and sorted, which may cut a
    job with very many events into several runs. Each run is reduced to a table
    from every status to the status after it; where a job has more than one run
    (at most one more for each partition), the tables are composed in order to
    find the status that each run starts from. The runs are then replayed.
    """
    names = list(STATUS_CODES)
    order = ["job_name", "ts", "event_id"]
    log = events.where("job_name is not null and ts is not null").dropDuplicates(["event_id"]).select(*order, "event", "new_status")
    log = cut(log.withColumn("ts", F.unix_micros(F.col("ts").cast("timestamp"))).repartitionByRange(*order).sortWithinPartitions(*order))

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        """(job, first ts, first id, events) of each run of a partition; at most a batch of events at a time."""
        job = None
        for b in batches:
            part: list[tuple] = []
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if row[0] != job and part:
                    yield part
                    part = []
                job = row[0]
                part.append(row)
            if part:
                yield part

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        job, first, at, out = None, None, {}, []
        for part in runs(batches):
            if part[0][0] != job:
                if job is not None:
                    out.append((job, *first, list(at.items())))
                job, first, at = part[0][0], part[0][1:3], {s: s for s in names}
            if len(out) >= 500:
                yield tables_of(out)
                out = []
            for _, _, _, event, new in part:
                at = {s: step(v, event, new) for s, v in at.items()}
        if job is not None:
            yield tables_of([*out, (job, *first, list(at.items()))])

    def tables_of(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.map_(pa.string(), pa.string())]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["job_name", "ts", "event_id", "moves"])

    tables = log.mapInArrow(reduce, "job_name string, ts long, event_id long, moves map<string,string>")
    # whole jobs need no table: only those that lie in more than one partition come to the driver
    listed = tables.groupBy("job_name").agg(F.sort_array(F.collect_list(F.struct("ts", "event_id", F.map_entries("moves").alias("moves")))).alias("runs"))
    starts = {}
    for r in listed.where("size(runs) > 1").toLocalIterator():
        status = "INACTIVE"
        for x in r["runs"]:
            starts[(r["job_name"], x["ts"], x["event_id"])] = status
            status = {m["key"]: m["value"] for m in x["moves"]}[status]
    shared = events.sparkSession.sparkContext.broadcast(starts)

    def replay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        job, status = None, "INACTIVE"
        for part in runs(batches):
            if part[0][0] != job:
                job, status = part[0][0], shared.value.get(part[0][:3], "INACTIVE")
            rows = []
            for _, _, event_id, event, new in part:
                after = step(status, event, new)
                rows.append((job, event_id, status, after, after != status))
                status = after
            kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["job_name", "event_id", "old_status", "new_status", "applied"])

    return log.mapInArrow(replay, OUT)


def windowed_counts(events: DataFrame, width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Events by type in tumbling windows; on a stream, late ones are dropped beyond the watermark."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(F.window("ts", width), "event").agg(F.count("*").alias("n")).select(F.col("window.start").alias("from_ts"), "event", "n")


def changed_dependents(changes: DataFrame, edges: DataFrame) -> DataFrame:
    """(job): jobs whose conditions refer to a job that changed; for use in foreachBatch before conditions are evaluated."""
    return edges.join(changes.where("applied").select(F.col("job_name").alias("dep")), "dep", "left_semi").select("job").distinct()


def event_of(kind: Column) -> Column:
    """Job event of the test stream's event types."""
    return F.when(kind == "click", "STARTJOB").when(kind == "view", "RUNNING").when(kind == "purchase", "CHANGE_STATUS").when(kind == "signup", "JOB_ON_HOLD").otherwise("JOB_OFF_HOLD")
