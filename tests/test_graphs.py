import random

import pytest

from runweave.operators import graphs


def longest(scope, deps, job, path=()):
    inside = [d for d in deps.get(job, ()) if d in scope and d != job]
    return 1 + max((longest(scope, deps, d) for d in inside), default=0)


@pytest.mark.parametrize("co_locate", [1, 60, 50_000])
def test_waves_equal_walks(spark, co_locate):
    rnd = random.Random(3)
    names = [f"j{i}" for i in range(40)]
    edges = [(names[i], names[rnd.randrange(i)]) for i in range(1, 40) for _ in range(rnd.randrange(3))] + [("j5", "j5"), ("j9", "gone")]
    scopes = [("all", n) for n in names] + [("part", n) for n in names if rnd.random() < 0.5]
    got = {(r["scope"], r["job"]): r["wave"] for r in graphs.waves(spark.createDataFrame(scopes, "scope string, job string"), spark.createDataFrame(edges, "job string, dep string"), co_locate).collect()}
    deps = {}
    for j, d in edges:
        deps.setdefault(j, set()).add(d)
    assert got == {(s, n): longest({m for t, m in scopes if t == s}, deps, n) for s, n in scopes}


@pytest.mark.parametrize("co_locate", [1, 50_000])
def test_chains_that_lead_into_cycles_end(spark, co_locate):
    edges = spark.createDataFrame([("a", "b"), ("b", "a"), ("c", "b"), ("d", "e"), ("b", "f"), ("f", "g")], "job string, dep string")
    scopes = spark.createDataFrame([("s", x) for x in "abcdefg"], "scope string, job string")
    got = {r["job"]: r["wave"] for r in graphs.waves(scopes, edges, co_locate).collect()}
    assert got == {"a": 1, "b": 3, "c": 1, "d": 2, "e": 1, "f": 2, "g": 1}
    assert graphs.waves(scopes.limit(0), edges.limit(0), co_locate).count() == 0


def test_plans_do_not_grow_with_the_rounds(spark):
    def plan(n):
        scopes = spark.createDataFrame([("s", i) for i in range(n)], "scope string, job long")
        edges = spark.createDataFrame([(i, i - 1) for i in range(1, n)], "job long, dep long")
        out = graphs.waves(scopes, edges, 1)
        assert {r["job"]: r["wave"] for r in out.collect()} == {i: i + 1 for i in range(n)}
        return out._jdf.queryExecution().optimizedPlan().toString().count("\n")

    assert plan(9) == plan(3)


@pytest.mark.parametrize("co_locate", [1, 50_000])
def test_finish_times(spark, co_locate):
    scopes = spark.createDataFrame([("s", "a", 5), ("s", "b", 2), ("s", "c", 1), ("s", "x", 1), ("s", "y", 1), ("s", "z", 1), ("s", "a", 3)], "scope string, job string, secs int")
    edges = spark.createDataFrame([("c", "a"), ("c", "b"), ("b", "a"), ("x", "y"), ("y", "x"), ("z", "x"), ("z", "c")], "job string, dep string")
    got = {r["job"]: (r["start"], r["finish"]) for r in graphs.finish_times(scopes, edges, co_locate).collect()}
    assert got == {"a": (0, 5), "b": (5, 7), "c": (7, 8), "x": (None, None), "y": (None, None), "z": (None, None)}
