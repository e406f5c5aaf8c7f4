import random

import pytest
from pyspark.sql import functions as F

from runweave.operators import graphs, hierarchy

SCHEMA = "job_name string, box_name string, node string, component string"


def closure(rows):
    name, up = {}, {}
    for j, b, *_ in rows:
        if j is None or not j.strip():
            continue
        k = j.strip().lower()
        name[k] = min(j, name.get(k, j))
        if b and b.strip():
            up[k] = min(b.strip().lower(), up.get(k, "￿"))
    out = set()
    for k in name:
        seen, a, d = set(), up.get(k), 1
        while a in name and a not in seen:
            seen.add(a)
            out.add((name[a], name[k], d))
            a, d = up.get(a), d + 1
    return out


def run(spark, rows, limit):
    df = spark.createDataFrame(rows, SCHEMA)
    return {tuple(r) for r in hierarchy.named_ancestors(df, F.col("job_name"), F.col("box_name"), limit).collect()}


@pytest.mark.parametrize("limit", [50_000, 3])
def test_trees_cycles_and_dirt_equal_walks(spark, limit):
    rnd = random.Random(limit)
    rows = [(f"J{i}", f" j{rnd.randrange(i)}\t" if i and rnd.random() < 0.8 else None, None, None) for i in range(120)]
    rows += [(f"c{i}", f"C{(i + 1) % 5}", None, None) for i in range(5)] + [("t1", "c2", None, None), ("t2", "t1", None, None), ("self", "SELF", None, None)]
    rows += [(f"deep{i}", f"deep{i - 1}" if i else "", None, None) for i in range(40)]
    rows += [("lost", "nowhere", None, None), (None, "J1", None, None), ("  ", "J1", None, None), ("J5", rows[5][1], None, None)]
    assert run(spark, rows, limit) == closure(rows)


def test_no_rows_and_paths(spark):
    assert run(spark, [], 10) == set()
    df = spark.createDataFrame([("a", None, None, None), ("b", "A", None, None), ("c", "b", None, None), ("x", "y", None, None), ("y", "x", None, None)], SCHEMA)
    p = {r["name"]: r for r in hierarchy.paths(df, F.col("job_name"), F.col("box_name")).collect()}
    assert (p["c"]["path"], p["c"]["depth"], p["c"]["root"], p["c"]["in_cycle"]) == ("a/b/c", 2, "a", False)
    assert p["x"]["in_cycle"] and p["x"]["root"] is None and p["x"]["depth"] == 1
    assert {r[0]: r[1] for r in hierarchy.cycles(df, F.col("job_name"), F.col("box_name")).collect()} == {"x": 2, "y": 2}


def test_waves_equal_longest_paths(spark):
    rnd = random.Random(1)
    n = 25
    edges = [(f"n{i}", f"n{rnd.randrange(i)}") for i in range(1, n) for _ in range(rnd.randrange(4))]
    s = spark.createDataFrame([("s", f"n{i}") for i in range(n)], "scope string, job string")
    e = spark.createDataFrame([*edges, ("n1", "n1"), ("n2", "elsewhere")], "job string, dep string")
    wave = {}
    for i in range(n):
        wave[f"n{i}"] = 1 + max((wave[d] for j, d in edges if j == f"n{i}"), default=0)
    assert {r["job"]: r["wave"] for r in graphs.waves(s, e).collect()} == wave


def test_closure_of_seeds(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "a")], "job string, dep string")
    got = {r[0] for r in graphs.closure(spark.createDataFrame([("x",)], "job string"), e).collect()}
    assert got == {"a", "b", "c"}


def test_chains_with_more_ancestors_than_a_task_may_give(spark):
    rows = [(f"n{i}", f"n{i - 1}" if i else None, None, None) for i in range(60)] + [(f"r{i}", f"r{(i + 1) % 30}", None, None) for i in range(30)] + [("a", None, None, None), ("b", "a", None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    tree = hierarchy.cut(hierarchy.edges(df, F.col("job_name"), F.col("box_name")))
    for pairs in (10, 1000, 5_000_000):
        got = {tuple(r) for r in hierarchy.ancestors(tree, pairs=pairs).select("ancestor_name", "name", "distance").collect()}
        assert got == closure(rows)


@pytest.mark.parametrize("inner", [200_000, 2])
def test_inner_nodes_in_one_task_or_in_rounds(spark, inner):
    rnd = random.Random(inner)
    rows = [(f"J{i}", f" j{rnd.randrange(i)}\t" if i and rnd.random() < 0.8 else "nowhere", None, None) for i in range(80)]
    rows += [(f"c{i}", f"C{(i + 1) % 5}", None, None) for i in range(5)] + [("t1", "c2", None, None), ("t2", "t1", None, None), ("self", "SELF", None, None), ("lone", None, None, None)]
    rows += [(f"deep{i}", f"deep{i - 1}" if i else "", None, None) for i in range(40)] + [(None, "J1", None, None), ("J5", rows[5][1], None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    tree = hierarchy.cut(hierarchy.edges(df, F.col("job_name"), F.col("box_name")))
    facts = hierarchy.inner_facts(tree, inner)
    up = {r["node"]: r["parent"] for r in tree.collect()}

    def above(node):
        seen = []
        while node in up and node not in seen:
            seen.append(node)
            node = up[node]
        return (min(seen[seen.index(node) :]), None) if node in seen else (seen[-1], len(seen) - 1)

    got = {r["node"]: (r["component"], r["depth"]) for r in hierarchy.components(tree, facts).collect()}
    assert got == {k: above(k) for k in up}
    assert {r["node"]: r["n"] for r in facts.collect()} == {k: n for k in up if (n := list(up.values()).count(k))}
    for limit in (50_000, 3):
        got = {tuple(r) for r in hierarchy.named_ancestors(df, F.col("job_name"), F.col("box_name"), limit, inner).collect()}
        assert got == closure(rows)


def test_small_trees_take_few_jobs(spark):
    """Plans of many jobs and checkpoints filled the driver's memory."""
    df = spark.createDataFrame([(f"n{i}", f"n{i - 1}" if i % 40 else None, None, None) for i in range(200)], SCHEMA)
    spark.sparkContext.setJobGroup("few-jobs", "")
    try:
        assert len(hierarchy.named_ancestors(df, F.col("job_name"), F.col("box_name")).collect()) == 5 * 40 * 39 // 2
        jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("few-jobs")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert 0 < len(jobs) <= 25
