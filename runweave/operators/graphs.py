"""Dependency graphs: longest chains and run times within scopes, and transitive closure from seeds.

A scope of up to `co_locate` jobs and dependencies goes whole to one task, which
peels it off from the jobs without dependencies on. A larger one may hold a third of
all rows and must not: it is peeled off in rounds of joins that follow its longest
chain. Both ways give the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runweave.session import Pile, cut, together

#: Jobs and dependencies of a scope that one task may hold.
CO_LOCATE = 50_000


def waves(scopes: DataFrame, edges: DataFrame, co_locate: int = CO_LOCATE) -> DataFrame:
    """(scope, job, wave): the length of the longest chain of dependencies that a job ends within its scope; 1 without any.

    scopes: scope, job. edges: job, dep. Dependencies outside the scope and on
    itself don't count. Jobs on a cycle, and those that depend on one, keep the
    longest chain that is free of it.
    """
    out = _schedule(scopes.select("scope", "job", F.lit(1).cast("long").alias("secs")), edges, co_locate)
    return out.select("scope", "job", F.coalesce("finish", F.col("ready") + 1).cast("int").alias("wave"))


def finish_times(scopes: DataFrame, edges: DataFrame, co_locate: int = CO_LOCATE) -> DataFrame:
    """(scope, job, start, finish): when each job of a scope runs if it starts as soon as all its dependencies in the scope have finished.

    scopes: scope, job, secs (how long a job takes; of repeated rows the most
    counts). The critical path of a scope ends at its greatest finish. Jobs on
    cycles, and those that wait for one, never start: NULL.
    """
    out = _schedule(scopes.select("scope", "job", F.col("secs").cast("long").alias("secs")), edges, co_locate)
    return out.select("scope", "job", F.when(F.col("finish").isNotNull(), F.col("ready")).alias("start"), "finish")


def _schedule(scopes: DataFrame, edges: DataFrame, co_locate: int) -> DataFrame:
    """(scope, job, ready, finish): ready is the latest known finish of the dependencies, finish is NULL of jobs that never start."""
    kinds = dict(scopes.dtypes)
    s = cut(scopes.groupBy("scope", "job").agg(F.max("secs").alias("secs")))
    inner = edges.where("job != dep").join(s.select("scope", "job"), "job").join(s.select("scope", F.col("job").alias("dep")), ["scope", "dep"])
    inner = cut(inner.select("scope", "job", "dep").distinct())
    # a job's own row names itself as what it needs
    rows = s.withColumn("dep", F.col("job")).unionByName(inner.withColumn("secs", F.lit(None).cast("long")))
    sizes = rows.groupBy("scope").agg(F.count("*").alias("n"))
    schema = f"scope {kinds['scope']}, job {kinds['job']}, ready long, finish long"
    local = lambda df: together(df.select("scope", "job", "dep", "secs"), "scope").mapInArrow(_peeled, schema)
    if (sizes.agg(F.max("n")).head()[0] or 0) <= co_locate:
        return local(rows)
    large = cut(sizes.where(F.col("n") > co_locate).select("scope"))
    return local(rows.join(large, "scope", "left_anti")).unionByName(_by_rounds(s.join(large, "scope", "left_semi"), inner.join(large, "scope", "left_semi"), schema))


def _peel(secs: dict, needs: dict) -> Iterator[tuple]:
    """(job, ready, finish) of one scope: jobs are done when all their dependencies are."""
    waiting = {job: len(deps) for job, deps in needs.items()}
    used: dict = {}
    for job, deps in needs.items():
        for d in deps:
            used.setdefault(d, []).append(job)
    ready, done = dict.fromkeys(secs, 0), {}
    free = [job for job in secs if not waiting.get(job)]
    while free:
        job = free.pop()
        done[job] = ready[job] + secs[job]
        for j in used.get(job, ()):
            ready[j] = max(ready[j], done[job])
            waiting[j] -= 1
            if not waiting[j]:
                free.append(j)
    return ((job, ready[job], done.get(job)) for job in secs)


def _peeled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """_peel() of each scope in a partition sorted by scope: rows (scope, job, dep, secs), in a job's own row dep is the job."""

    def batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
        kinds = [schema.field(0).type, schema.field(1).type, pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["scope", "job", "ready", "finish"])

    scope, secs, needs, out, schema = None, {}, {}, [], None
    for b in batches:
        schema = b.schema
        for at, job, dep, own in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if at != scope:
                out += [(scope, *r) for r in _peel(secs, needs)]
                scope, secs, needs = at, {}, {}
                if len(out) > 20_000:
                    yield batch(out, schema)
                    out = []
            if dep == job:
                secs[job] = own
            else:
                needs.setdefault(job, set()).add(dep)
    out += [(scope, *r) for r in _peel(secs, needs)]
    if out:
        yield batch(out, schema)


def _by_rounds(s: DataFrame, inner: DataFrame, schema: str) -> DataFrame:
    """The same of scopes too large for one task. Each round relaxes only what changed; fronts go to one folder, so plans don't grow."""
    key = schema.split(", ready")[0]
    s, waiting = cut(s), cut(inner)
    free = s.join(waiting.select("scope", "job"), ["scope", "job"], "left_anti")
    front = cut(free.select("scope", "job", F.lit(0).cast("long").alias("ready"), F.col("secs").alias("finish")))
    done, known = Pile(s.sparkSession, "finish", schema), Pile(s.sparkSession, "ready", f"{key}, ready long")
    while not front.isEmpty():
        done.add(front)
        open_ = cut(waiting.join(front.select("scope", F.col("job").alias("dep"), "finish"), ["scope", "dep"], "left"))
        reached = open_.where("finish is not null")
        known.add(reached.groupBy("scope", "job").agg(F.max("finish").alias("ready")))
        waiting = open_.where("finish is null").select("scope", "job", "dep")
        free = reached.select("scope", "job").distinct().join(waiting.select("scope", "job").distinct(), ["scope", "job"], "left_anti")
        ready = known.rows().join(free, ["scope", "job"]).groupBy("scope", "job").agg(F.max("ready").alias("ready"))
        front = cut(ready.join(s, ["scope", "job"]).select("scope", "job", "ready", (F.col("ready") + F.col("secs")).alias("finish")))
    late = known.rows().groupBy("scope", "job").agg(F.max("ready").alias("ready"))
    rest = s.join(done.rows().select("scope", "job"), ["scope", "job"], "left_anti").join(late, ["scope", "job"], "left")
    return done.rows().unionByName(rest.select("scope", "job", F.coalesce("ready", F.lit(0).cast("long")).alias("ready"), F.lit(None).cast("long").alias("finish")))


def closure(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """(job): all that the seeds depend on, directly or through others; a seed only if another one leads to it or it lies on a cycle.

    Each round follows only what was new in the last one.
    """
    e = cut(edges.where("job != dep").select("job", "dep").distinct())
    seen = Pile(seeds.sparkSession, "closure", f"job {dict(edges.dtypes)['job']}")
    new = cut(seeds.distinct().join(e, "job").select(F.col("dep").alias("job")).distinct())
    while not new.isEmpty():
        seen.add(new)
        step = new.join(e, "job").select(F.col("dep").alias("job")).distinct()
        new = cut(step.join(seen.rows(), "job", "left_anti"))
    return seen.rows()
