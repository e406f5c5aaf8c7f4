import datetime as dt
import random

from pyspark.sql import functions as F

from runweave.functions import schedules, strings
from runweave.operators import rejects
from runweave.sources import files, jil_text
from runweave.streaming import events as E

TEXT = """/* a file
   over lines */
insert_job: one   job_type: CMD
command: /bin/ls /tmp/*/x  machine: m1
description: "says: \\"hi\\", /* no comment */ owner: nobody"
condition: s(a) &
   s(b)
envvars: A=1
envvars: B=2
owner: x
owner: y
# note
update_job: one
strange_word: 5
stray text
insert_blob: b
blob_input: <auto_blobt>line one
owner: not me</auto_blobt>

upgrade_job: nothing
insert_bogus: q
"""


def test_stanzas_and_conservation():
    out = jil_text.parse(TEXT)
    assert "".join(s.raw for s in out) == TEXT
    one = out[0].merged()
    assert (out[0].directive, out[0].name) == ("insert_job", "one")
    assert one["job_type"] == "CMD" and one["command"] == "/bin/ls /tmp/*/x" and one["machine"] == "m1"
    assert one["description"] == 'says: "hi", /* no comment */ owner: nobody'
    assert one["condition"] == "s(a) & s(b)" and one["envvars"] == "A=1, B=2" and one["owner"] == "y"
    assert out[0].disposition() == "LOADED_WITH_WARNINGS"
    assert {i[1] for i in out[1].issues} >= {"unknown_attribute", "stray_line"}
    assert out[2].merged()["blob_input"].endswith("not me</auto_blobt>")
    assert out[3].disposition() == "QUARANTINED"


def test_random_texts_are_kept_whole():
    rnd = random.Random(8)
    bits = ["insert_job: a", "update_job: b", "owner: x", '"', "/*", "*/", "\n", " ", "#", "command: y", "<auto_blobt>", "</auto_blobt>", "é", "delete_job:", "\t"]
    for _ in range(500):
        t = "".join(rnd.choice(bits) for _ in range(rnd.randrange(40)))
        assert "".join(s.raw for s in jil_text.parse(t)) == t
    assert jil_text.parse("") == []
    assert len(jil_text.parse("insert_job: a\n" + "envvars: A=1\n" * 10_000)[0].attrs) == 10_000


def test_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.jil").write_bytes(TEXT.replace("\n", "\r\n").encode())
    (tmp_path / "sub" / "b.jil").write_bytes("insert_job: zwölf\nowner: ü\n".encode("cp1252"))
    (tmp_path / "sub" / "c.jil").write_bytes("insert_job: x\n".encode("utf-16"))
    (tmp_path / "us.cal").write_text("# days\n2025-01-01  # new year\nnonsense\n2025-07-04\n2025-07-04\n")
    (tmp_path / "g.txt").write_text('sendevent -E SET_GLOBAL -G "REGION=EU west"\nsendevent -E SET_GLOBAL -G N=5\n')
    (tmp_path / "x.asc").write_text("calendar: c1\n01/02/2025 00:00\n2025-01-03\nbad\nextended_calendar: e1\nworkday: mo,tu\n")
    rows = files.stanzas(files.read_files(spark, str(tmp_path), "*.jil")).collect()
    assert {r["encoding"] for r in rows} == {"utf-8", "cp1252", "utf-16"}
    assert {r["object_name"] for r in rows if r["seq"] == 1} == {"one", "zwölf", "x"}
    days = {(r[0], str(r[1])) for r in files.calendar_files(files.read_files(spark, str(tmp_path), "*.cal")).collect()}
    assert days == {("us", "2025-01-01"), ("us", "2025-07-04")}
    g = {tuple(r) for r in files.global_exports(files.read_files(spark, str(tmp_path), "g.txt")).collect()}
    assert g == {("REGION", "EU west"), ("N", "5")}
    c = {(r["calendar_name"], str(r["day"])) for r in files.calendar_exports(files.read_files(spark, str(tmp_path), "*.asc")).collect()}
    assert c == {("c1", "2025-01-02"), ("c1", "2025-01-03"), ("e1", "None")}
    assert jil_text.kind_of("\n# x\ncalendar: a\n") == "calendars" and jil_text.kind_of("insert_job: a") == "jil"
    assert jil_text.parse_globals("Global Name   Value\n___________   _____\nREGION        EU\n") == [("REGION", "EU")]


def test_history_file(spark, tmp_path):
    p = tmp_path / "runs.tsv"
    p.write_text("\njob\tstatus\tstart\nA\tSU\t2025-01-02 03:04:05\nB\tRU\t2025-01-02 03:04:05\n")
    lines, imports = files.history_lines(spark, str(p), 7, "Europe/Berlin")
    got = rejects.loaded(lines, imports).select("job_name", F.unix_seconds("start_time").alias("t")).collect()
    assert [(r[0], r[1]) for r in got] == [("A", int(dt.datetime(2025, 1, 2, 2, 4, 5, tzinfo=dt.UTC).timestamp()))]
    have = spark.createDataFrame([("1", "a"), ("2", "b")], "run_id string, v string")
    new = spark.createDataFrame([("2", "B"), ("3", "C")], "run_id string, v string")
    assert {tuple(r) for r in files.idempotent_append(have, new, "run_id").collect()} == {("1", "a"), ("2", "b"), ("3", "C")}
    assert {tuple(r) for r in files.idempotent_append(have, new, "run_id", True).collect()} == {("1", "a"), ("2", "B"), ("3", "C")}


def test_columns(spark):
    at = F.lit("2025-10-15 03:30:00").cast("timestamp")
    one = spark.range(1).select(
        schedules.in_run_window(F.lit("22:00-04:00"), at).alias("wraps"), schedules.in_run_window(F.lit("04:00-22:00"), at).alias("out"), schedules.in_run_window(F.lit("18:30,23:30"), at).alias("bad"),
        schedules.in_run_window(F.lit(None).cast("string"), at).alias("none"), schedules.on_day(F.array(F.lit("we")), at).alias("day"), schedules.starts_at(F.array(F.lit('"3:30"')), at).alias("start"),
        schedules.starts_at_minute(F.array(F.lit("x"), F.lit(" 30")), at).alias("minute"), schedules.preceding_start(F.array(F.lit("03:00"), F.lit("04:00")), at).alias("due"),
        strings.size_in_bytes(F.lit("10mb")).alias("mb"), strings.size_in_bytes(F.lit("5")).alias("kb"), strings.size_in_bytes(F.lit("x")).alias("nosize"), strings.clipped(F.lit("abcdef"), 4).alias("clip"),
        strings.pairs(F.lit('A=1, B="x y", A=2')).alias("pairs"), strings.tolerant_int(F.lit("3.7")).alias("int"), strings.truth(F.lit(" Y ")).alias("yes"), strings.listed(F.lit("a,, b ")).alias("list"),
    ).head().asDict()
    assert one == {
        "wraps": True, "out": False, "bad": False, "none": True, "day": True, "start": True, "minute": True, "due": 180, "mb": 10 << 20, "kb": 5 << 10, "nosize": None, "clip": "abc…",
        "pairs": {"A": "2", "B": "x y"}, "int": 3, "yes": True, "list": ["a", "b"],
    }


def _log(seed, n):
    rnd = random.Random(seed)
    kinds = [*E.EVENTS, "CHANGE_STATUS", "COMMENT"]
    t0 = dt.datetime(2025, 1, 1)
    return [(i, t0 + dt.timedelta(seconds=i), "hot" if rnd.random() < 0.5 else f"j{rnd.randrange(5)}", rnd.choice(kinds), rnd.choice(["SUCCESS", "RUNNING", "NOWHERE", None])) for i in range(n)]


def _replay(rows):
    at, out = {}, set()
    for i, _, job, event, new in sorted(rows, key=lambda r: (r[1], r[0])):
        old = at.get(job, "INACTIVE")
        at[job] = E.step(old, event, new)
        out.add((job, i, old, at[job], at[job] != old))
    return out


def test_stream_batch_and_replay_agree(spark, tmp_path):
    schema = "event_id long, ts timestamp, job_name string, event string, new_status string"
    rows = _log(5, 300)
    df = spark.createDataFrame(rows + rows[:20], schema)
    assert {tuple(r) for r in E.batch_states(df).collect()} == _replay(rows)
    assert E.batch_states(df.limit(0)).count() == 0
    src = str(tmp_path / "in")
    for part in (rows[:150], rows[150:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(schema).parquet(src)
    q = E.stream_states(stream).writeStream.format("memory").queryName("fsm").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(180)
    assert {tuple(r) for r in spark.sql("select * from fsm").collect()} == _replay(rows)


def test_simulation_is_reproducible(spark):
    from runweave.operators import simulation

    jobs = spark.createDataFrame([(f"n{i}", i % 4) for i in range(40)], "job_name string, n_retrys int")
    e = spark.createDataFrame([(f"n{i}", f"n{i // 2}") for i in range(1, 40)], "job string, dep string")
    a = {tuple(r) for r in simulation.simulate(jobs, e, 5, 42).collect()}
    b = {tuple(r) for r in simulation.simulate(jobs.repartition(3), e, 5, 42).collect()}
    assert a == b and len(a) == 200
    bad = {(c, j) for c, j, o in a if o != "SUCCESS"}
    assert all((c, f"n{i}") in bad for c, j in bad for i in range(1, 40) if f"n{i // 2}" == j and i // 2 != i)


def test_history_folders_number_lines_by_file(spark, tmp_path):
    d = tmp_path / "exports"
    d.mkdir()
    (d / "a.csv").write_text("\nJob,Status,Start\n" + "".join(f"j{i},SU,2025-01-01T00:00:00Z\n" for i in range(500)))
    (d / "b.txt").write_text("job|status|start\nj|SU|x\n")
    (d / "c.jsonl").write_text('{"job":"j"}\n\n{"job":"k"}\n')
    (d / "empty.csv").write_text("")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")  # files in parts
    try:
        lines, imports = files.history_lines(spark, str(d), 7, "UTC")
        got = {(r["import_id"], r["line_no"]): r["raw_line"] for r in lines.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert {r["import_id"]: (r["file_format"], r["header_line"]) for r in imports.collect()} == {7: ("csv", "Job,Status,Start"), 8: ("pipe", "job|status|start"), 9: ("jsonl", None)}
    assert all(got[7, i + 3] == f"j{i},SU,2025-01-01T00:00:00Z" for i in range(500))
    assert {k: v for k, v in got.items() if k[0] > 7} == {(8, 2): "j|SU|x", (9, 1): '{"job":"j"}', (9, 2): "", (9, 3): '{"job":"k"}'}


def test_attributes_in_one_line_and_long_quotes():
    one = jil_text.parse("insert_job: a   job_type: CMD\nip_host: h1  ip_port: 80\nURL: http://x\ncommand: echo \\\"hi\\\" my_own: 1\ndescription: Server type: web\nmy_own: 2\n")[0]
    assert one.attrs == [("job_type", "CMD"), ("ip_host", "h1"), ("ip_port", "80"), ("URL", "http://x"), ("command", 'echo \\"hi\\"'), ("my_own", "1"), ("description", "Server type: web"), ("my_own", "2")]
    assert [i[1] for i in one.issues] == ["unknown_attribute", "unknown_attribute", "repeated_attribute"]
    assert not [i for i in jil_text.parse("insert_job: a\nmy_own: 2\n", frozenset(["my_own"]))[0].issues]
    text = 'insert_job: a\ndescription: "x\n' + "l\n" * 260 + 'end"\nowner: z\ninsert_job: b\ndescription: "open\nowner: q\n'
    a, b = jil_text.parse(text)
    assert a.merged()["description"].count("\n") == 261 and a.merged()["owner"] == "z" and not a.issues
    assert b.merged()["owner"] == "q" and b.issues[0][1] == "unbalanced_quote"
    assert jil_text.parse("insert_job: a\nsap_step_parms: x\nsap_step_parms: y\ni5_params: p\ni5_params: q\n")[0].merged() == {"sap_step_parms": "x\ny", "i5_params": "q"}


def test_rows_are_numbered_in_order(spark):
    from runweave.operators.numbering import numbered

    rows = [(f"n{i:04d}", i) for i in random.Random(1).sample(range(1000), 1000)]
    df = spark.createDataFrame(rows, "name string, position int")
    assert {r["name"]: r["position"] for r in numbered(df, [F.col("name")]).collect()} == {n: i + 1 for n, i in rows}
    assert numbered(df.limit(0), [F.col("name")]).count() == 0
