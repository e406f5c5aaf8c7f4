import pytest
from pyspark.sql import functions as F

from runweave.functions import schedules
from runweave.functions import strings as X
from runweave.operators import concurrency, merge


def one(spark, *cols):
    return list(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).head())


def test_variables_are_expanded_once(spark):
    values = {"A": F.lit("%%B%%"), "B": F.lit("$1\\2"), "C": F.lit(None).cast("string")}
    text, left = X.expanded(F.lit("x %%a%%-%%B%% %%C%% %%Z%%%%A%%"), values)
    assert one(spark, text, left) == ["x %%B%%-$1\\2 %%C%% %%Z%%%%B%%", ["C", "Z"]]
    for t in ("", "none", "%%", "%%A"):
        assert one(spark, X.expanded(F.lit(t), values)[0]) == [t]
    assert one(spark, X.expanded(F.lit(None).cast("string"), values)[0]) == [None]
    assert one(spark, X.expanded(F.lit("%%A%%"), {})[1]) == [["A"]]
    now = F.lit("2025-03-09 08:07:06").cast("timestamp")
    assert one(spark, X.expanded(F.lit("%%DATE%% %%YYYY%%/%%MM%%/%%DD%% %%TIME%% %%AUTORUN%%"), X.builtins(now, now, False))[0]) == ["03092025 2025/03/09 0807 N"]
    assert one(spark, X.expanded(F.lit("%%GLOB:a%% {JOB} {no}"), {"a": F.lit("T")}, X.GLOB, False)[0], X.expanded(F.lit("{JOB} {X}"), {"JOB": F.lit("j")}, X.TEMPLATE, False)[1]) == ["T {JOB} {no}", ["X"]]


def test_business_globals_are_no_dates(spark):
    assert one(spark, X.business_globals(F.lit("%%ODATE%% %%MIN%% %%AUTORUN%% %%YYYY%% %%DESK%% %%DESK%% %%TIMESTAMP%%"))) == [["AUTORUN", "YYYY", "DESK", "DESK"]]


def test_nul_escapes_and_limits(spark):
    for t in ("a\\b", "a\0b", "\\0\0\\\\0", "\0", ""):
        made, back = one(spark, X.nul_escaped(F.lit(t)), X.nul_restored(X.nul_escaped(F.lit(t))))
        assert "\0" not in made and (back == t if "\0" in t else made == t)
    assert one(spark, X.limits(F.lit('n="1, 2", T="unlimited", n="3", c=""'))) == [{"t": "unlimited,unlimited", "n": "3,3"}]


def test_types_times_and_estimates(spark):
    assert one(spark, *[X.job_type(F.lit(t)) for t in (" b ", "fw", "", "ftp", None)]) == ["BOX", "FILEWATCH", "CMD", "FTP", "CMD"]
    assert one(spark, *[X.like_built_in(F.lit(t)) for t in ("FILEWACH", "CMD", "XYZ")]) == ["FILEWATCH", None, None]
    at = F.lit("2025-10-15 12:45:00").cast("timestamp")
    starts = F.array(F.lit("12:00"), F.lit("12:30"))
    assert one(spark, *[schedules.deadline_passed(F.lit(t), starts, at) for t in ("12:45", "+15", "+16", "13:00, 9:00", "x", "", None)]) == [True, True, False, True, False, False, False]
    assert one(spark, X.failure_chance(F.lit(3), F.lit(None).cast("int"), F.lit("")), X.estimated_seconds(F.lit(0), F.lit(4)), X.estimated_seconds(F.lit(None).cast("int"), F.lit(None).cast("int"))) == [0.25, 120, 60]


def test_latest_patched_upsert_replaced(spark):
    log = spark.createDataFrame([("a", 1, "x", False), ("a", 3, "z", False), ("a", 2, "y", True), ("b", 1, "x", False), ("b", 2, "y", True), (None, 1, "n", False), ("a", 3, "z", False)], "k string, seq int, v string, gone boolean")
    got = {(r["k"], r["v"]) for r in merge.latest(log, ["k"], ["seq"], F.col("gone")).collect()}
    assert got == {("a", "z"), (None, "n")} and merge.latest(log.limit(0), ["k"], ["seq"]).count() == 0
    parts = spark.createDataFrame([("m", 1, True, 5, None), ("m", 2, False, None, 7), ("m", 3, False, 6, None), ("n", 1, False, 1, 1), ("m", 0, False, 9, 9)], "k string, seq int, ins boolean, p int, q int")
    assert [tuple(r) for r in merge.patched(parts, ["k"], "seq", F.col("ins"), ["p", "q"]).collect()] == [("m", 6, 7)]
    old = spark.createDataFrame([("a", "def1", 4), ("b", "def2", 5)], "k string, d string, s int")
    new = spark.createDataFrame([("b", None), ("c", "def3")], "k string, d string")
    assert {tuple(r) for r in merge.upsert(old, new, "k", {"s": F.lit(8)}).collect()} == {("a", "def1", 4), ("b", None, 5), ("c", "def3", 8)}
    assert {tuple(r) for r in merge.replaced(old, spark.createDataFrame([("a", "n", 1), ("a", "m", 2)], "k string, d string, s int"), "k").collect()} == {("a", "n", 1), ("a", "m", 2), ("b", "def2", 5)}


@pytest.mark.parametrize("hot", [0, 3000])
def test_previous_values_equal_a_lag(spark, hot):
    import random

    rnd = random.Random(hot)
    rows = [("hot" if i < hot else f"k{rnd.randrange(5)}", rnd.randrange(200_000), i, rnd.choice([1, 2, None])) for i in range(hot + 200)]
    df = spark.createDataFrame(rows, "k string, t long, id int, v int").withColumn("at", F.timestamp_seconds("t"))
    got = {r["id"]: r["previous"] for r in concurrency.previous_value(df, "k", F.col("at"), "id", "v").collect()}
    want, last = {}, {}
    for k, t, i, v in sorted(rows, key=lambda r: (r[1], r[2])):
        want[i] = last.get(k)
        last[k] = v
    assert got == want
