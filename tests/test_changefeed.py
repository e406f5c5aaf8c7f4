import random

from pyspark.sql import functions as F

from runweave.operators import changefeed

SCHEMA = "op_id long, import_seq long, source_line int, op string, job_name string, raw_attrs map<string,string>, state string, key string"


def replay(rows):
    """The rule, plainly."""
    seen, out = set(), {}
    for r in sorted(rows, key=lambda r: (r[1] if r[1] is not None else -1, r[2] if r[2] is not None else -1, r[0])):
        _, seq, line, op, job, attrs, *_ = r
        if seq is None or line is None or job is None or (seq, line) in seen:
            continue
        op = (op or "").strip().lower().removesuffix("_job")
        if op not in ("insert", "update", "override", "delete"):
            continue
        seen.add((seq, line))
        new = {k.lower(): (None if v is None or v.strip().upper() == "NULL" else v) for k, v in (attrs or {}).items()}
        if op == "insert":
            out[job] = {k: v for k, v in new.items() if v is not None}
        elif op == "delete":
            out.pop(job, None)
        elif job in out or new.get("job_type") is not None:
            have = out.setdefault(job, {})
            for k, v in new.items():
                if v is None:
                    have.pop(k, None)
                else:
                    have[k] = v
    return {(j, k, v) for j, a in out.items() for k, v in a.items()}


def run(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    state = changefeed.current_state(df, "job_name", "op", "raw_attrs", ("import_seq", "source_line"), "op_id")
    return {tuple(r) for r in changefeed.attributes(state).collect()}


def test_random_feed_with_a_hot_key_equals_replay(spark):
    rnd = random.Random(3)
    rows = []
    for i in range(3000):
        job = "hot" if rnd.random() < 0.4 else f"j{rnd.randrange(60)}"
        op = rnd.choice(["insert", "update", " Update ", "UPDATE_JOB", "override", "delete", "Insert_job", "noise", None])
        attrs = {rnd.choice(["owner", "OWNER", "job_type", "command", "machine"]): rnd.choice(["a", "b", "NULL", " null", "", "é"]) for _ in range(rnd.randrange(4))}
        lower = {}
        for k, v in attrs.items():
            lower.setdefault(k.lower(), (k, v))
        rows.append((i, i // 20, i % 20, op, job, {k: v for k, v in lower.values()}, None, "x"))
    rows += rnd.sample(rows, 200)
    rows = [(n, *r[1:]) for n, r in enumerate(rows)]
    rnd.shuffle(rows)
    first = {}
    for r in rows:
        k = (r[1], r[2])
        if k not in first or r[0] < first[k][0]:
            first[k] = r
    assert run(spark, rows) == replay(list(first.values()))


def test_nulls_empty_and_no_rows(spark):
    assert run(spark, []) == set()
    rows = [
        (1, None, 1, "insert", "a", {"job_type": "CMD"}, None, None),
        (2, 1, 1, "insert", None, {"job_type": "CMD"}, None, None),
        (3, 1, 2, "insert", "b", None, None, None),
        (4, 1, 3, "update", "c", {"owner": "x"}, None, None),
        (5, 1, 4, "update", "c", {"job_type": "CMD", "owner": None}, None, None),
        (6, 1, 5, "update", "d", {"job_type": "NULL"}, None, None),
    ]
    assert run(spark, rows) == {("c", "job_type", "CMD")}


def test_runs_compose_over_partitions(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = [(i, i, 1, "insert" if i == 0 else "update", "one", {f"a{i % 7}": str(i)} if i % 50 else {f"a{i % 7}": "NULL"}, None, None) for i in range(400)]
        assert run(spark, rows) == replay(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_ops_are_normalised(spark):
    df = spark.createDataFrame([(" Insert_JOB ",), ("DELETE",)], "op string")
    assert [r[0] for r in df.select(changefeed.normalise_op(F.col("op"))).collect()] == ["insert", "delete"]
