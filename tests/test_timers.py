import datetime as dt
import random

from runweave.streaming import events as E
from runweave.streaming import timers

SCHEMA = "event_id long, ts timestamp, job_name string, event string"
T0 = dt.datetime(2025, 1, 1)


def fed(spark, tmp_path, parts, schema=SCHEMA):
    """A stream over files, one a micro-batch."""
    src = tmp_path / "in"
    for i, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(src / f"p{i:03d}"))
    return spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(src))


def ended(writer, tmp_path, name):
    q = writer.option("checkpointLocation", str(tmp_path / f"c-{name}")).trigger(availableNow=True).start()
    q.awaitTermination(240)
    assert q.exception() is None


def test_timers_equal_the_batch_form(spark, tmp_path):
    rnd = random.Random(2)
    at, rows = T0, []
    for i in range(240):
        at += dt.timedelta(minutes=rnd.choice([1, 2, 30]))
        rows.append((i, at, f"j{rnd.randrange(6)}", rnd.choice(["STARTJOB", "RUNNING", "KILLJOB", "COMMENT"])))
    end = [(1000 + i, at + dt.timedelta(hours=3 + i), "clock", "COMMENT") for i in range(3)]
    rows += end
    parts = [rows[i : i + 60] + rows[i : i + 3] for i in range(0, len(rows), 60)]
    stream = timers.overdue(fed(spark, tmp_path, parts), 1800, "1 minute")
    ended(stream.writeStream.format("memory").queryName("late").outputMode("append"), tmp_path, "late")
    got = sorted(tuple(r) for r in spark.sql("select * from late").collect())
    df = spark.createDataFrame(rows, SCHEMA)
    want = sorted(tuple(r) for r in timers.overdue_batch(df, 1800).collect())
    assert got == want and len(want) > 20
    assert timers.overdue_batch(df.limit(0), 1800).count() == 0


def test_board_in_complete_and_update_mode(spark, tmp_path):
    rows = [(i, T0 + dt.timedelta(seconds=i), "j", "STARTJOB" if i % 3 else "COMMENT") for i in range(90)]
    parts = [rows[:40], rows[40:]]
    board = timers.counts_by_status(fed(spark, tmp_path, parts))
    ended(board.writeStream.format("memory").queryName("board").outputMode("complete"), tmp_path, "board")
    assert {r["event"]: r["n"] for r in spark.sql("select * from board").collect()} == {"STARTJOB": 60, "COMMENT": 30}
    seen = []
    ended(board.writeStream.outputMode("update").foreachBatch(lambda df, n: seen.append((n, {r["event"]: r["n"] for r in df.collect()}))), tmp_path, "update")
    assert seen[-1][1] == {"STARTJOB": 60, "COMMENT": 30} and len(seen) == 2


def test_late_events_are_dropped_beyond_the_watermark(spark, tmp_path):
    on = lambda m: T0 + dt.timedelta(minutes=m)
    parts = [[(1, on(0), "j", "RUNNING"), (2, on(60), "j", "RUNNING")], [(3, on(52), "j", "RUNNING")], [(4, on(1), "j", "RUNNING"), (5, on(300), "j", "RUNNING")], [(6, on(301), "j", "RUNNING")]]
    counts = E.windowed_counts(fed(spark, tmp_path, parts), "5 minutes", "10 minutes")
    ended(counts.writeStream.format("memory").queryName("windows").outputMode("append"), tmp_path, "windows")
    got = {r["from_ts"]: r["n"] for r in spark.sql("select * from windows").collect()}
    assert got == {on(0): 1, on(50): 1, on(60): 1}


def test_changes_make_dependents_ready(spark, tmp_path):
    jobs = spark.createDataFrame([("b", "s(a)"), ("c", "s(a) & s(b)"), ("d", "f(a)"), ("e", None)], "job_name string, condition string")
    schema = "job_name string, status string, ts timestamp"
    parts = [[("a", "RUNNING", T0), ("a", "SUCCESS", T0 + dt.timedelta(seconds=1))], [("b", "SUCCESS", T0 + dt.timedelta(seconds=2))]]
    out, states = str(tmp_path / "ready"), str(tmp_path / "states")
    ended(timers.propagate(fed(spark, tmp_path, parts, schema), jobs, states, out, str(tmp_path / "c")), tmp_path, "p")
    got = {(r["batch"], r["job"]) for r in spark.read.schema("job string, batch long").parquet(out).collect()}
    assert got == {(0, "b"), (1, "c")}
    assert {r[0] for r in E.changed_dependents(spark.createDataFrame([("a", True), ("x", True), ("b", False)], "job_name string, applied boolean"), spark.createDataFrame([("p", "a"), ("q", "b")], "job string, dep string")).collect()} == {"p"}
