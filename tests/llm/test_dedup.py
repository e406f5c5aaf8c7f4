import datetime as dt
import random

from runweave.llm import dedup

T0 = dt.datetime(2025, 1, 1)
HISTORY = "job_name string, retry_count int, machine string, start_time timestamp_ntz, job string, host string"
BATCH = "batch_row_id long, import_id long, job_name string, retry_count int, machine string, start_time timestamp_ntz, ord long"


def norm(job, retry, machine):
    m = (machine or "").strip().lower().split(".")[0]
    return (job or "").strip().lower(), retry or 0, m


def brute(history, batches):
    seen = [(norm(j, r, m), t) for j, r, m, t, *_ in history if t is not None and norm(j, r, m)[0]]
    out = set()
    for b, i, j, r, m, t, _ in sorted(batches, key=lambda x: (x[1], x[0])):
        k = norm(j, r, m)
        if t is None or not k[0]:
            continue
        if any(k[:2] == s[:2] and abs(t - u) <= dt.timedelta(seconds=5) and (k[2] == s[2] or not k[2] or not s[2]) for s, u in seen):
            out.add(b)
        seen.append((k, t))
    return out


def case(seed, n):
    rnd = random.Random(seed)
    job = lambda: rnd.choice(["hot", "hot", " HOT ", "a", "B", None, " "])
    host = lambda: rnd.choice(["h1", "H1.example.org", "h2", None, " "])
    when = lambda: None if rnd.random() < 0.05 else T0 + dt.timedelta(milliseconds=rnd.choice([1, 500, 5000]) * rnd.randrange(600))
    history = [(job(), rnd.choice([0, 0, 1, None]), host(), when(), "c", "c") for _ in range(n)]
    batches = [(k, rnd.randrange(5), job(), rnd.choice([0, 0, 1, None]), host(), when(), 0) for k in range(n)]
    return history, batches + [(n + k, 9, "hot", 0, "h1", T0, 0) for k in range(50)]


def test_equals_brute_force(spark):
    for seed, n in ((1, 60), (2, 250)):
        history, batches = case(seed, n)
        h, b = spark.createDataFrame(history, HISTORY), spark.createDataFrame(batches, BATCH)
        got = [r["batch_row_id"] for r in dedup.duplicates(b, dedup.pivot_table(h)).collect()]
        assert len(got) == len(set(got)) and set(got) == brute(history, batches)


def test_exactly_five_seconds(spark):
    s = dt.timedelta(seconds=5)
    rows = [(1, 1, "a", 0, "m", T0, 0), (2, 1, "a", 0, "m", T0 + s, 0), (3, 1, "a", 0, "m", T0 + 2 * s + dt.timedelta(microseconds=1), 0)]
    b = spark.createDataFrame(rows, BATCH)
    assert {r[0] for r in dedup.duplicates(b, dedup.pivot_table(spark.createDataFrame([], HISTORY))).collect()} == {2}


def test_stored_table_grows_by_batches(spark, tmp_path):
    history, batches = case(3, 120)
    path = str(tmp_path / "pivots")
    dedup.append(path, spark.createDataFrame(history, HISTORY))
    got, have = set(), []
    for i in sorted({b[1] for b in batches}):
        batch = spark.createDataFrame([b for b in batches if b[1] == i], BATCH)
        got |= {r[0] for r in dedup.duplicates(batch, dedup.stored(spark, path, batch)).collect()}
        dedup.append(path, batch)
        have += [b for b in batches if b[1] == i]
    assert got == brute(history, batches)


def test_history_is_read_once_and_then_only_folders_in_reach(spark, tmp_path):
    day = dt.timedelta(days=1)
    noon = T0 + day / 2
    history = [("a", 0, "m", noon + i * day, "c", "c") for i in range(30)]
    source = str(tmp_path / "job_runs.parquet")
    spark.createDataFrame(history, HISTORY).write.parquet(source)
    path = dedup.accepted(spark, source)
    assert dedup.accepted(spark, source) == path
    batch = spark.createDataFrame([(1, 1, "a", 0, "m", noon + 3 * day, 0), (2, 1, "a", 0, "m", noon + 3 * day + dt.timedelta(hours=1), 0), (3, 1, "a", 0, None, noon + 9 * day, 0)], BATCH)
    known = dedup.stored(spark, path, batch)
    assert {r["range"] // dedup.RANGES_A_FOLDER for r in known.collect()} == {r["range"] // dedup.RANGES_A_FOLDER for r in dedup._keyed(batch.where("batch_row_id != 2")).collect()}
    assert {r[0] for r in dedup.duplicates(batch, known).collect()} == {1, 3}
    plan = known._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "job_runs" not in plan
    spark.createDataFrame(history[:1], HISTORY).write.mode("append").parquet(source)
    assert dedup.accepted(spark, source) != path


def test_no_rows(spark):
    h, b = spark.createDataFrame([], HISTORY), spark.createDataFrame([], BATCH)
    assert dedup.duplicates(b, dedup.pivot_table(h)).count() == 0
