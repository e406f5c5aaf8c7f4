"""Simulation of many cycles of an estate, wave by wave, with outcomes drawn from hashes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runweave.operators.graphs import waves
from runweave.session import Pile, cut


def simulate(jobs: DataFrame, edges: DataFrame, cycles: int, seed: int) -> DataFrame:
    """(cycle, job, outcome): SUCCESS, FAILURE, or BLOCKED below a failure, for each job in each cycle.

    jobs: job_name, n_retrys. A job fails by a draw that depends on seed, job
    and cycle only, so results don't depend on order or partitioning; the
    chance is .25, .10 or .03 for three or more, one or two, or no retries.
    """
    rows = jobs.select(F.col("job_name").alias("job"), "n_retrys")
    levels = cut(waves(rows.select(F.lit("all").alias("scope"), "job"), edges).select("job", "wave"))
    chance = F.when(F.col("n_retrys") >= 3, 0.25).when(F.col("n_retrys") >= 1, 0.10).otherwise(0.03)
    draw = F.pmod(F.xxhash64(F.lit(seed), "job", "cycle"), F.lit(1_000_000)) / F.lit(1_000_000.0)
    tried = rows.join(levels, "job").withColumn("cycle", F.explode(F.sequence(F.lit(1), F.lit(cycles))))
    tried = cut(tried.select("cycle", "job", "wave", (draw < chance).alias("fails")))
    # what a failure blocks: everything that depends on it, directly or through others, in its cycle
    e = edges.where("job != dep").select(F.col("dep").alias("from"), F.col("job").alias("to"))
    front = cut(tried.where("fails").select("cycle", F.col("job").alias("from")).join(e, "from").select("cycle", F.col("to").alias("job")).distinct())
    pile = Pile(jobs.sparkSession, "blocked", f"cycle int, job {dict(rows.dtypes)['job']}")
    while not front.isEmpty():
        pile.add(front)
        step = front.withColumnRenamed("job", "from").join(e, "from").select("cycle", F.col("to").alias("job")).distinct()
        front = cut(step.join(pile.rows(), ["cycle", "job"], "left_anti"))
    blocked = pile.rows()
    out = tried.join(blocked.withColumn("stopped", F.lit(True)), ["cycle", "job"], "left")
    outcome = F.when(F.col("stopped"), "BLOCKED").when(F.col("fails"), "FAILURE").otherwise("SUCCESS")
    return out.select("cycle", "job", outcome.alias("outcome"))
