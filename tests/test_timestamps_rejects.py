import datetime as dt

from pyspark.sql import functions as F

from runweave.operators import rejects, timestamps


def us(*a):
    return (dt.datetime(*a) - dt.datetime(1970, 1, 1)) // dt.timedelta(microseconds=1)


def test_texts_zones_and_changes_of_time(spark):
    cases = [
        ("2025-03-09T02:30:00", "America/New_York", us(2025, 3, 9, 7, 30)),  # skipped: offset before the change
        ("2025-11-02 01:30:00", "America/New_York", us(2025, 11, 2, 5, 30)),  # twice: the first
        ("2025-01-02T03:04:05.123456789Z", None, us(2025, 1, 2, 3, 4, 5, 123456)),
        ("2025-01-02 03:04:05+0530", "Asia/Tokyo", us(2025, 1, 1, 21, 34, 5)),
        ("2025-01-02 03:04:05[Europe/Berlin]", None, us(2025, 1, 2, 2, 4, 5)),
        ("2025-07-02 03:04:05 BST", None, us(2025, 7, 2, 2, 4, 5)),
        ("07/04/2025 3:04:05 PM", "UTC", us(2025, 7, 4, 15, 4, 5)),
        ("07/04/2025 12:04:05 AM", "UTC", us(2025, 7, 4, 0, 4, 5)),
        ("31.12.2025 23:59", "UTC", us(2025, 12, 31, 23, 59)),
        ("08-Mar-2026 00:13:26", "UTC", us(2026, 3, 8, 0, 13, 26)),
        ("Sun, 30 Mar 2025 03:27:20 +0100", None, us(2025, 3, 30, 2, 27, 20)),
        ("20251004T173521Z", None, us(2025, 10, 4, 17, 35, 21)),
        (" 1756569155 ", None, 1756569155 * 10**6),
        ("1706744151000", None, 1706744151000 * 1000),
        ("1730915763000000", None, 1730915763000000),
        ("20261101111713", "UTC", us(2026, 11, 1, 11, 17, 13)),
        ("20261101111713", None, None),
        ("2025-02-29T00:00:00Z", None, None),
        ("13/01/2025 00:00:00", "UTC", None),
        ("2025-01-02 24:00:00", "UTC", None),
        ("2025-01-02 03:04:05 Mars/Crater", "UTC", None),
        ("pending", "UTC", None),
        ("", "UTC", None),
        (None, "UTC", None),
        ("x" * 100_000, "UTC", None),
        ("2025-01-02 03:04:05", "No/Where", None),
    ]
    df = spark.createDataFrame([(i, i % 3, t, z) for i, (t, z, _) in enumerate(cases)], "id int, src long, t string, z string")
    got = {r["id"]: r["utc_us"] for r in timestamps.normalise(df, "src", "t", "z").collect()}
    assert [(cases[i][0], got[i]) for i in range(len(cases))] == [(c[0], c[2]) for c in cases]
    assert timestamps.normalise(df.limit(0), "src", "t", "z").count() == 0


def test_mixtures_decide_between_readings(spark):
    rows = [("us", f"{m:02d}/{d:02d}/2025 10:00:00") for m in (1, 2, 3) for d in range(13, 28)] + [("us", "03/04/2025 10:00:00")]
    rows += [("eu", f"{d:02d}/{m:02d}/2025 10:00:00") for m in (1, 2, 3) for d in range(13, 28)] + [("eu", "03/04/2025 10:00:00")]
    rows += [("unclear", "03/04/2025 10:00:00"), ("unclear", "05/05/2025 10:00:00")]
    df = spark.createDataFrame([(s, t, "UTC", "clash", "clash") for s, t in rows], "src string, t string, z string, outcome string, _us string")
    out = timestamps.normalise(df, "src", "t", "z", timestamps.Policy())
    got = {(r["src"], r["t"]): (r["outcome"], r["utc_us"]) for r in out.collect()}
    assert got["us", "03/04/2025 10:00:00"] == ("time", us(2025, 3, 4, 10))
    assert got["eu", "03/04/2025 10:00:00"] == ("time", us(2025, 4, 3, 10))
    assert got["unclear", "03/04/2025 10:00:00"] == ("ambiguous", None)
    assert got["unclear", "05/05/2025 10:00:00"] == ("time", us(2025, 5, 5, 10))


def test_conventions_are_priors_of_the_same_estimate(spark):
    rows = [("eu", f"{d:02d}/{m:02d}/2025 10:00:00") for m in (1, 2, 3) for d in range(1, 28)] + [("eu", "03.04.2025 10:00"), ("eu", "04.13.2025 10:00"), (None, "03/04/2025 10:00")]
    df = spark.createDataFrame([(s, t, "UTC") for s, t in rows], "src string, t string, z string")
    got = {r["t"]: r for r in timestamps.normalise(df, "src", "t", "z").collect()}
    assert got["03/02/2025 10:00:00"]["utc_us"] == us(2025, 3, 2, 10) and got["03/02/2025 10:00:00"]["posterior"] == 1.0
    assert got["03.04.2025 10:00"]["utc_us"] == us(2025, 4, 3, 10) and got["03/04/2025 10:00"]["reading"] == "slash_mdy"
    for t in ("27/03/2025 10:00:00", "04.13.2025 10:00"):
        assert (got[t]["outcome"], got[t]["utc_us"], got[t]["reading"], got[t]["posterior"]) == ("no_time", None, None, None)
    mixed = timestamps._mixture(["slash_mdy|slash_dmy", "slash_dmy", "iso", ""], [5, 900, 1, 2], timestamps.FIXED_CONVENTIONS, {r.name: timestamps.FIXED_CONVENTIONS.priors.get(r.name, 1.0) for r in timestamps.READINGS})
    assert mixed == [("slash_mdy", 1.0), (None, None), ("iso", 1.0), (None, None)]


def test_estimates_are_made_only_where_they_choose(spark):
    rows = [(s, t, "UTC") for s, t in [("eu", "27/03/2025 10:00"), ("eu", "26/03/2025 10:00"), ("eu", "03/04/2025 10:00"), ("us", "03/27/2025 10:00"), ("us", "03/04/2025 10:00"), (None, "x")]]
    df = spark.createDataFrame(rows, "src string, t string, z string")

    def found(policy):
        spark.sparkContext.setJobGroup(f"p4-{id(policy)}", "")
        try:
            out = timestamps.normalise(df, "src", "t", "z", policy)
            ran = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"p4-{id(policy)}"))
        finally:
            spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return ran, {(r["src"], r["t"]): (r["outcome"], r["reading"], r["posterior"], r["utc_us"]) for r in out.collect()}

    ran, fixed = found(timestamps.FIXED_CONVENTIONS)
    assert ran == 0
    fourth = ("time", "slash_mdy", 1.0, us(2025, 3, 4, 10))
    assert fixed["eu", "03/04/2025 10:00"] == fixed["us", "03/04/2025 10:00"] == fourth
    assert fixed["eu", "27/03/2025 10:00"] == fixed[None, "x"] == ("no_time", None, None, None)
    ran, still = found(timestamps.Policy(priors={"slash_dmy": 0.0, "dot_mdy": 0.0}, rounds=0))
    assert ran == 0 and still == fixed
    # two open readings: the rounds choose by source
    ran, seen = found(timestamps.Policy(decide=0.6))
    assert ran > 0 and seen["eu", "03/04/2025 10:00"][:2] == ("time", "slash_dmy") and seen["us", "03/04/2025 10:00"][:2] == ("time", "slash_mdy")
    assert found(timestamps.Policy(decide=0.6, rounds=0))[1]["eu", "03/04/2025 10:00"][0] == "ambiguous"


def test_lookup_of_hot_and_cold_keys(spark):
    from runweave.operators.joins import lookup

    rows = spark.createDataFrame([("hot", 1, i, "clash") for i in range(500)] + [(None, 2, 7, "clash"), ("a", 1, 8, "x"), ("b", 1, 9, "x")], "k string, j int, i int, v string")
    facts = spark.createDataFrame([("hot", 1, "h", 500), (None, 2, "n", 1), ("a", 1, "a", 1), ("a", 2, "z", 1)], "fk string, fj int, v string, n long")
    for hot in (0.0, 0.1, 1.0):
        out = lookup(rows, facts, {"k": "fk", "j": "fj"}, "n", ["v"], hot)
        assert out.columns == ["k", "j", "i", "v"] and {(r["k"], r["v"]) for r in out.collect()} == {("hot", "h"), (None, "n"), ("a", "a"), ("b", None)} and out.count() == 503
    strict = {(r["k"], r["v"]) for r in lookup(rows, facts, {"k": "fk", "j": "fj"}, "n", ["v"], 1.0, nulls=False).collect()}
    assert strict == {("hot", "h"), (None, None), ("a", "a"), ("b", None)}
    assert lookup(rows.limit(0), facts.limit(0), {"k": "fk", "j": "fj"}, "n", ["v"]).count() == 0


def test_quoting(spark):
    cases = {
        'a,b': (["a", "b"], True), '"a,b",c': (["a,b", "c"], True), '"a ""b""",c': (['a "b"', "c"], True), '"""x"""': (['"x"'], True), '""': ([""], True),
        'a"b,c': (None, False), '"a"b,c': (None, False), '"a': (None, False), 'a,"b" ,c': (None, False), '""a': (None, False), ",,": (["", "", ""], True),
        '"' + 'x""' * 5000 + '"': (['' + 'x"' * 5000], True),
    }
    df = spark.createDataFrame([(k,) for k in cases], "line string")
    f, w = rejects.split_quoted(F.col("line"), F.lit(","))
    for r in df.select("line", f.alias("f"), w.alias("w")).collect():
        want, ok = cases[r["line"]]
        assert r["w"] == ok, r["line"][:40]
        if ok:
            assert r["f"] == want


def test_reasons(spark):
    head = "Job Name,result,started_at,End,rc,retry,note"
    imports = [(1, "csv", head, "UTC"), (2, "jsonl", None, None), (3, "csv", "a,b", "UTC"), (4, "pipe", "job|status|start", None)]
    good = "2025-01-02T03:04:05Z"
    lines = [
        (1, 2, f"a,su,{good},,,,", None), (1, 3, f"a,4,{good}", "column_count"), (1, 4, f",su,{good},,,,", "missing_job_name"), (1, 5, f"a,,{good},,,,", "unknown_status"),
        (1, 6, f"a,ru,{good},,,,", "non_terminal_status"), (1, 7, "a,su,,,,,", "missing_start_time"), (1, 8, f"a,su,{good},2025-02-30 00:00:00,,,", "bad_timestamp"),
        (1, 9, f"a,su,{good},,x,,", "bad_number"), (1, 10, "   ", None), (1, 11, None, None), (1, 12, f'a,su,{good},,,,"x', "bad_quoting"), (1, 13, "a,su,1/2/2025 3:04:05,,,,", None),
        (2, 1, '{"job_name":"a","status":4,"start_time":"%s"}' % good, None), (2, 2, '{"a":1}}', "bad_json"), (2, 3, '[{"a":1}]', "bad_json"), (2, 4, "{'a':1}", "bad_json"),
        (2, 5, '{"a":1},"q":2', "bad_json"), (2, 6, '{"a":1}] [', "bad_json"), (2, 7, '"x"', "bad_json"), (2, 8, '{"job_name":null,"status":"su"}', "missing_job_name"),
        (3, 1, "x,y", "missing_column"), (3, 2, "", None), (4, 1, f"a|su|{good}", "naive_no_tz"), (4, 2, "a|su|2025-01-02 03:04:05", "naive_no_tz"), (9, 1, "x", "missing_column"),
    ]
    i = spark.createDataFrame([(*x, "extra") for x in imports], "import_id long, file_format string, header_line string, declared_timezone string, reason string")
    l = spark.createDataFrame([(n, a, b, c, "extra") for n, (a, b, c, _) in enumerate(lines)], "row_id long, import_id long, line_no int, raw_line string, reason string")
    got = {(r[0], r[1]): r[2] for r in rejects.rejected(l, i).select("import_id", "line_no", "reason").collect()}
    assert got == {(a, b): why for a, b, _, why in lines if why}
    assert {(r["import_id"], r["line_no"]) for r in rejects.loaded(l, i).collect()} == {(1, 2), (1, 13), (2, 1)}
    assert rejects.rejected(l.limit(0), i).count() == rejects.rejected(l, i.limit(0)).where("reason != 'missing_column'").count() == 0
