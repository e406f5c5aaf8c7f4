"""Boxes at one instant: completion, children that can't start any more, terminations, and what a change of status makes ready.

All conditions are evaluated in one pass over a snapshot, so results don't depend on the order of siblings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runweave.conditions import columns
from runweave.functions.statuses import STATUS_CODES, status_name
from runweave.plans.assessment import _REFS, JX, estate
from runweave.plans.registry import query
from runweave.session import cut

_NOW = "2025-10-15 12:00:00"
_CODE = STATUS_CODES
_FINAL = [_CODE[s] for s in ("SUCCESS", "FAILURE", "TERMINATED")]
_GOOD = "(4, 7)"
_TRUTH = f"""tr AS (SELECT j.job_name, CASE WHEN j.condition IS NULL THEN TRUE WHEN contains(j.condition, '& &') THEN FALSE ELSE
  CASE WHEN contains(j.condition, '| v(') THEN (coalesce(p.status IN {_GOOD}, FALSE) AND (NOT contains(j.condition, 'f(job') OR coalesce(f.status = 5, FALSE)) AND (NOT contains(j.condition, 'e(job') OR coalesce(x.k % 3 = 0, FALSE)))
      OR ((NOT contains(j.condition, 'n(job') OR coalesce(n.status NOT IN (1, 3, 10), TRUE)) AND (NOT contains(j.condition, 'd(job') OR coalesce(q.status IN (4, 5, 6, 7), FALSE)))
    ELSE coalesce(p.status IN {_GOOD}, FALSE) AND (NOT contains(j.condition, 'f(job') OR coalesce(f.status = 5, FALSE)) AND (NOT contains(j.condition, 'e(job') OR coalesce(x.k % 3 = 0, FALSE))
      AND (NOT contains(j.condition, 'n(job') OR coalesce(n.status NOT IN (1, 3, 10), TRUE)) AND (NOT contains(j.condition, 'd(job') OR coalesce(q.status IN (4, 5, 6, 7), FALSE)) END END AS ok
  FROM jx j LEFT JOIN jx p ON p.job_name = regexp_extract(j.condition, '^[a-z]+\\((job_[0-9]+)', 1) LEFT JOIN jx f ON f.job_name = regexp_extract(j.condition, 'f\\((job_[0-9]+)', 1)
    LEFT JOIN jx x ON x.job_name = regexp_extract(j.condition, 'e\\((job_[0-9]+)', 1) LEFT JOIN jx n ON n.job_name = regexp_extract(j.condition, 'n\\((job_[0-9]+)', 1) LEFT JOIN jx q ON q.job_name = regexp_extract(j.condition, 'd\\((job_[0-9]+)', 1)),
rr AS (SELECT DISTINCT job_name AS job, dep FROM (SELECT job_name, unnest(regexp_extract_all(condition, '[a-z]\\((job_[0-9]+)', 1)) AS dep FROM jx WHERE NOT contains(condition, '& &'))),
un AS (SELECT j.job_name, j.box_name FROM jx j JOIN tr USING (job_name) WHERE j.status = 8 AND j.condition IS NOT NULL AND NOT tr.ok AND EXISTS (SELECT 1 FROM rr WHERE rr.job = j.job_name)
  AND NOT EXISTS (SELECT 1 FROM rr JOIN jx d ON d.job_name = rr.dep WHERE rr.job = j.job_name AND d.status NOT IN (4, 5, 6, 7)))"""
_DONE = f"""{_TRUTH}, kd AS (SELECT c.box_name AS box, bool_or(c.box_terminator AND c.status IN (5, 6)) AS ends, bool_or(c.status = 5) AS failed, bool_or(c.status = 6) AS terminated,
    bool_or(c.status NOT IN (4, 5, 6, 7) AND un.job_name IS NULL) AS open FROM jx c LEFT JOIN un ON un.job_name = c.job_name WHERE c.box_name IS NOT NULL GROUP BY 1),
bx AS (SELECT b.job_name AS box, CASE WHEN kd.box IS NULL THEN 'SUCCESS' WHEN kd.ends THEN 'TERMINATED' WHEN b.box_failure IS NOT NULL AND coalesce(bf.status = 5, FALSE) THEN 'FAILURE'
    WHEN b.box_success IS NOT NULL AND coalesce(bs.status IN {_GOOD}, FALSE) THEN 'SUCCESS' WHEN b.box_failure IS NULL AND kd.failed THEN 'FAILURE' WHEN kd.open THEN 'RUNNING'
    WHEN kd.terminated THEN 'TERMINATED' WHEN kd.failed THEN 'FAILURE' ELSE 'SUCCESS' END AS outcome
  FROM jx b LEFT JOIN kd ON kd.box = b.job_name LEFT JOIN jx bf ON bf.job_name = regexp_extract(b.box_failure, '(job_[0-9]+)', 1) LEFT JOIN jx bs ON bs.job_name = regexp_extract(b.box_success, '(job_[0-9]+)', 1) WHERE b.job_type = 'BOX')"""


def _holds(rows: DataFrame, condition: str, name: str) -> DataFrame:
    """(job_name, name): whether a condition of each job holds in the estate's snapshot."""
    states = rows.select(F.col("job_name").alias("name"), status_name(F.col("status")).alias("status"), (F.col("k") % 3).alias("exit_code"), F.lit("2025-10-15 11:00:00").cast("timestamp").alias("last_end"))
    globals_ = rows.sparkSession.range(1).select(F.lit("REGION").alias("name"), F.lit("EU").alias("value"))
    return columns.evaluate(rows.where(F.col(condition).isNotNull()), "job_name", condition, states, globals_, F.lit(_NOW)).select(F.col("job").alias("job_name"), F.col("satisfied").alias(name))


def unreachable(rows: DataFrame, holds: DataFrame) -> DataFrame:
    """(job_name, box_name): inactive jobs whose condition doesn't hold and refers only to jobs that are settled or don't exist."""
    refs = columns.edges(rows, "job_name", "condition", runtime=True).select(F.col("job").alias("job_name"), "dep")
    known = rows.select(F.col("job_name").alias("dep"), (~F.col("status").isin(*_FINAL, _CODE["ON_ICE"])).alias("moves"))
    may = refs.join(known, "dep", "left").groupBy("job_name").agg(F.bool_or(F.coalesce("moves", F.lit(False))).alias("moves"))
    waiting = rows.where(F.col("status") == _CODE["INACTIVE"]).select("job_name", "box_name")
    return waiting.join(may.where("not moves"), "job_name").join(holds.where("not ok"), "job_name").select("job_name", "box_name")


def completion(rows: DataFrame, holds: DataFrame) -> DataFrame:
    """(box, outcome) of every box from its children: terminators, own conditions, fail-fast, then all children settled; RUNNING while one may still run."""
    stuck = unreachable(rows, holds).select("job_name", F.lit(True).alias("stuck"))
    s, settled = F.col("status"), F.col("status").isin(*_FINAL, _CODE["ON_ICE"])
    kids = rows.where("box_name is not null").join(stuck, "job_name", "left").groupBy(F.col("box_name").alias("box")).agg(
        F.bool_or(F.col("box_terminator") & s.isin(5, 6)).alias("ends"), F.bool_or(s == 5).alias("failed"), F.bool_or(s == 6).alias("terminated"), F.bool_or(~settled & F.col("stuck").isNull()).alias("open"), F.lit(True).alias("any")
    )
    boxes = rows.where("job_type = 'BOX'").select("job_name", "box_failure", "box_success")
    boxes = boxes.join(_holds(rows, "box_failure", "fails"), "job_name", "left").join(_holds(rows, "box_success", "succeeds"), "job_name", "left").withColumnRenamed("job_name", "box").join(kids, "box", "left")
    yes = lambda c: F.coalesce(c, F.lit(False))
    outcome = (
        F.when(F.col("any").isNull(), "SUCCESS").when(F.col("ends"), "TERMINATED").when(yes("fails"), "FAILURE").when(yes("succeeds"), "SUCCESS")
        .when(F.col("box_failure").isNull() & F.col("failed"), "FAILURE").when(F.col("open"), "RUNNING").when(F.col("terminated"), "TERMINATED").when(F.col("failed"), "FAILURE").otherwise("SUCCESS")
    )
    return boxes.select("box", outcome.alias("outcome"))


def _snapshot(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = estate(spark, d)
    return rows, cut(_holds(rows, "condition", "ok"))


@query("snapshot_truth", f"WITH {JX}, {_TRUTH} SELECT job_name, ok FROM tr JOIN jx USING (job_name) WHERE condition IS NOT NULL")
def snapshot_truth(spark: SparkSession, d: str) -> DataFrame:
    """Which conditions hold in the estate's snapshot, exit codes, globals and look-backs included."""
    return _holds(estate(spark, d), "condition", "ok")


@query("unreachable_children", f"WITH {JX}, {_TRUTH} SELECT job_name, box_name FROM un")
def unreachable_children(spark: SparkSession, d: str) -> DataFrame:
    return unreachable(*_snapshot(spark, d))


@query("box_outcomes", f"WITH {JX}, {_DONE} SELECT box, outcome FROM bx")
def box_outcomes(spark: SparkSession, d: str) -> DataFrame:
    return completion(*_snapshot(spark, d))


@query("job_terminator_kills", f"WITH {JX}, {_DONE} SELECT c.job_name, c.box_name, bx.outcome FROM jx c JOIN bx ON bx.box = c.box_name WHERE bx.outcome IN ('FAILURE', 'TERMINATED') AND c.job_terminator AND c.status NOT IN (4, 5, 6)")
def job_terminator_kills(spark: SparkSession, d: str) -> DataFrame:
    """Children that end with their failed box."""
    rows, holds = _snapshot(spark, d)
    bad = completion(rows, holds).where("outcome in ('FAILURE', 'TERMINATED')").withColumnRenamed("box", "box_name")
    return rows.where(F.col("job_terminator") & ~F.col("status").isin(*_FINAL)).join(bad, "box_name").select("job_name", "box_name", "outcome")


@query("children_after_kill_or_restart", f"""WITH {JX} SELECT c.job_name, CASE WHEN b.k % 20 = 0 THEN 'TERMINATED' ELSE 'INACTIVE' END AS new_status, c.status IN (1, 3) AS was_active FROM jx c JOIN jx b ON b.job_name = c.box_name
WHERE b.status IN (1, 9) AND (b.k % 20 <> 0 OR c.status NOT IN (4, 5, 6))""")
def children_after_kill_or_restart(spark: SparkSession, d: str) -> DataFrame:
    """Children of running boxes when every second box is killed (what isn't final ends) and the others are restarted (all are reset)."""
    rows = estate(spark, d)
    boxes = rows.where("status in (1, 9)").select(F.col("job_name").alias("box_name"), (F.col("k") % 20 == 0).alias("killed"))
    out = rows.join(boxes, "box_name").where(~F.col("killed") | ~F.col("status").isin(*_FINAL))
    return out.select("job_name", F.when(F.col("killed"), "TERMINATED").otherwise("INACTIVE").alias("new_status"), F.col("status").isin(1, 3).alias("was_active"))


@query("cascade", f"""WITH {JX}, {_TRUTH} SELECT c.job_name, CASE WHEN c.job_type = 'BOX' THEN 'ACTIVATED' ELSE 'STARTING' END AS new_status FROM jx c JOIN jx b ON b.job_name = c.box_name JOIN tr ON tr.job_name = c.job_name
WHERE b.status IN (1, 9) AND c.status = 8 AND tr.ok""")
def cascade(spark: SparkSession, d: str) -> DataFrame:
    """Inactive children of running boxes whose conditions hold: boxes are activated, others start."""
    rows, holds = _snapshot(spark, d)
    boxes = rows.where("job_type = 'BOX' and status in (1, 9)").select(F.col("job_name").alias("box_name"))
    able = rows.where(F.col("status") == _CODE["INACTIVE"]).join(boxes, "box_name", "left_semi").join(holds, "job_name", "left").where(F.coalesce("ok", F.lit(True)))
    return able.select("job_name", F.when(F.col("job_type") == "BOX", "ACTIVATED").otherwise("STARTING").alias("new_status"))


def _is_startable() -> Column:
    return F.col("status").isin(*_FINAL, _CODE["INACTIVE"], _CODE["ON_NOEXEC"])


@query("ready_dependents", f"""WITH {JX}, {_REFS}, {_TRUTH} SELECT j.job_name FROM jx j JOIN tr USING (job_name) WHERE j.condition IS NOT NULL AND j.status IN (4, 5, 6, 8, 16) AND tr.ok AND j.k % 300 <> 0
AND EXISTS (SELECT 1 FROM rr JOIN jx p ON p.job_name = rr.dep WHERE rr.job = j.job_name AND p.k % 4 = 0)""")
def ready_dependents(spark: SparkSession, d: str) -> DataFrame:
    """Startable jobs whose condition holds and refers to a job that changed since the last tick, unless they are queued already."""
    rows, holds = _snapshot(spark, d)
    changed = rows.where("k % 4 = 0").select(F.col("job_name").alias("dep"))
    queued = rows.where("k % 300 = 0").select("job_name")
    touched = columns.edges(rows, "job_name", "condition", runtime=True).join(changed, "dep", "left_semi").select(F.col("job").alias("job_name")).distinct()
    able = rows.where(_is_startable()).join(touched, "job_name", "left_semi").join(queued, "job_name", "left_anti")
    return able.join(holds.where("ok"), "job_name").select("job_name")
