import pytest
from pyspark.sql import functions as F

from runweave.conditions import columns
from runweave.conditions.language import ConditionError, parse, references, render, renamed

REFS = [
    ("s(a)", ["a"]), ("success(a) & f(b)", ["a", "b"]), ("d(a) AND t(b) or n(c)", ["a", "b", "c"]), ("(s(a) | s(b)) & s(a)", ["a", "b"]), ("e(a) = 0", ["a"]),
    ('v(G) = "x y"', []), ("s(a, 24)", ["a"]), ("!s(a)", ["a"]), ("s(a.b-c#d:e)", ["a.b-c#d:e"]), ("activated(box)", ["box"]), ("exitcode(a) >= 4 & value(G) != 3", ["a"]),
]


@pytest.mark.parametrize(("text", "want"), REFS)
def test_references(text, want):
    assert [n for n, _ in references(text)] == want


@pytest.mark.parametrize("text", ["", "s(", "s(a) &", "s(a) s(b)", "& s(a)", "x(a)", "s(a))", "e(a)", "v(G) = ", "S(a)", "s(a, b)", "s(a) $"])
def test_no_conditions(text):
    with pytest.raises(ConditionError):
        parse(text)


def test_rendering_comes_back():
    for text in ("(success(a) | failure(b)) & done(c)", "success(a) & (failure(b) & done(c))", "!(success(a) | success(b))", 'exitcode(a) >= 4 | value(G) = "x"', "success(a^PRD, 24)"):
        steps = parse(text)
        assert parse(render(steps)) == steps == parse(render(steps, "short"))
    assert parse("!" * 3000 + "s(a)")[0].name == "a"
    assert len(parse("(" * 3000 + "s(a)" + ")" * 3000)) == 1


def test_evaluation(spark):
    cases = [
        ("s(ok)", True), ("f(ok)", False), ("s(ice) & d(ice)", True), ("n(unknown)", True), ("s(unknown)", False), ("n(run)", False), ("t(term) | s(none)", True), ("e(ok) = 0", True),
        ("e(none) = 0", False), ("e(ok) < 5 & e(ok) >= 0", True), ('v(REGION) = "EU"', True), ('v(nothing) = ""', True), ("v(N) > 9", True), ("s(ok, 1)", False), ("s(ok, 3)", True), ("s(ok, 0)", True),
        ("s(ok) & (f(ok) | d(ok))", True), ("!s(ok)", False), ("broken(", False), ("", True), (None, True), ("  ", True),
    ]
    df = spark.createDataFrame([(f"j{i}", c, "clash") for i, (c, _) in enumerate(cases)], "job string, condition string, status string")
    states = spark.sql(
        "select * from values ('ok', 'SUCCESS', 0, timestamp'2025-01-01 10:00:00'), ('ice', 'ON_ICE', null, null), ('run', 'RUNNING', null, null), ('term', 'TERMINATED', 1, null) as t(name, status, exit_code, last_end)"
    )
    g = spark.createDataFrame([("REGION", "EU"), ("N", "10")], "name string, value string")
    out = columns.evaluate(df, "job", "condition", states, g, F.lit("2025-01-01 12:00:00"))
    got = {r["job"]: r["satisfied"] for r in out.collect()}
    assert [(c, got[f"j{i}"]) for i, (c, _) in enumerate(cases)] == cases
    assert columns.evaluate(df.limit(0), "job", "condition", states, g, F.lit("2025-01-01 12:00:00")).count() == 0


def test_one_condition_as_a_column(spark):
    status = {"a": "SUCCESS", "b": "FAILURE"}
    c = columns.as_column("s(a) & f(b) & e(a) <= 3 & !v(X)=1", lambda n: F.lit(status.get(n)), lambda n: F.lit("2"), lambda n: F.lit(None).cast("string"))
    assert spark.range(1).select(c.alias("x")).head()["x"] is True


def test_edges(spark):
    df = spark.createDataFrame([("j1", "s(a) & s(b^PRD) & s(a)"), ("j2", "s(c) & & f(d)"), ("j3", None)], "job string, condition string")
    assert {tuple(r) for r in columns.edges(df, "job", "condition").collect()} == {("j1", "a"), ("j2", "c"), ("j2", "d")}
    assert {tuple(r) for r in columns.edges(df, "job", "condition", runtime=True).collect()} == {("j1", "a"), ("j1", "b")}


def test_renaming_changes_whole_names_only():
    assert renamed("s(a) & f(ab) & d(a^PRD) & v(a) = 1", {"a": "z"}) == "success(z) & failure(ab) & done(a^PRD) & value(a) = 1"
