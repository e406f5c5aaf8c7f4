"""Dependency, containment and migration analytics (D of the inventory), scalar functions (X) and small jobs (E, M)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from runweave.conditions import columns
from runweave.functions import schedules
from runweave.functions import strings as X
from runweave.functions.texts import host_key, name_key
from runweave.operators import graphs, hierarchy
from runweave.plans.estate import CONDITIONS, JOBS, RUNS, conditions, jobs, runs
from runweave.plans.problems import P3_BASE
from runweave.plans.registry import query
from runweave.session import table

_EDGES = """e AS (SELECT DISTINCT job_name AS job, dep FROM (SELECT job_name, unnest(regexp_extract_all(condition, '[a-z]\\((job_[0-9]+)[,) ]', 1)) AS dep FROM jc))"""
_US = lambda c: F.unix_micros(F.col(c).cast("timestamp"))


def _edges(spark: SparkSession, d: str) -> DataFrame:
    return columns.edges(conditions(spark, d), "job_name", "condition")


@query("condition_refs", f"WITH {CONDITIONS}, {_EDGES} SELECT job, dep FROM e")
def condition_refs(spark: SparkSession, d: str) -> DataFrame:
    return _edges(spark, d)


@query("condition_refs_runtime", f"""WITH {CONDITIONS} SELECT DISTINCT job_name AS job, unnest(regexp_extract_all(condition, '[a-z]\\((job_[0-9]+)', 1)) AS dep FROM jc""")
def condition_refs_runtime(spark: SparkSession, d: str) -> DataFrame:
    """References at run time: instances are ignored."""
    return columns.edges(conditions(spark, d), "job_name", "condition", runtime=True)


@query("condition_operators", f"""WITH {CONDITIONS} SELECT job_name, len(condition) - len(translate(condition, '&|', '')) AS n_operators, contains(condition, '^') AS cross_instance,
regexp_matches(condition, '\\(\\s*\\w[\\w_]+\\s*,\\s*[0-9]+') AS look_back FROM jc WHERE condition IS NOT NULL""")
def condition_operators(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("condition")
    rows = conditions(spark, d).where("condition is not null")
    return rows.select("job_name", X.operator_count(c).cast("long").alias("n_operators"), c.contains("^").alias("cross_instance"), X.has_look_back(c).alias("look_back"))


@query("condition_eval", f"""WITH {CONDITIONS}, s AS (SELECT job_name, CASE k % 4 WHEN 0 THEN 'SUCCESS' WHEN 1 THEN 'SUCCESS' WHEN 2 THEN 'FAILURE' ELSE 'ON_ICE' END AS status, k % 3 AS exit_code FROM jc),
t AS (SELECT c.k, c.job_name, c.condition,
  (SELECT status FROM s WHERE s.job_name = regexp_extract(c.condition, '^[a-z]+\\((job_[0-9]+)', 1)) AS s1,
  (SELECT status FROM s WHERE s.job_name = regexp_extract(c.condition, 'f\\((job_[0-9]+)', 1)) AS s2,
  (SELECT exit_code FROM s WHERE s.job_name = regexp_extract(c.condition, 'e\\((job_[0-9]+)', 1)) AS x FROM jc c)
SELECT job_name AS job, condition IS NULL OR (((s1 IN ('SUCCESS', 'ON_ICE')) AND (NOT contains(condition, '& f(') OR s2 = 'FAILURE') AND (NOT contains(condition, '& e(') OR x = 0)) OR contains(condition, '| v(REGION)')) AS satisfied FROM t""")
def condition_eval(spark: SparkSession, d: str) -> DataFrame:
    """All conditions against one snapshot of statuses, exit codes, ends and globals."""
    rows = conditions(spark, d)
    status = F.when(F.col("k") % 4 < 2, "SUCCESS").when(F.col("k") % 4 == 2, "FAILURE").otherwise("ON_ICE")
    end = F.lit("2025-10-15 11:00:00").cast("timestamp")
    states = rows.select(F.col("job_name").alias("name"), status.alias("status"), (F.col("k") % 3).alias("exit_code"), end.alias("last_end"))
    globals_ = spark.range(1).select(F.lit("REGION").alias("name"), F.lit("EU").alias("value"))
    return columns.evaluate(rows, "job_name", "condition", states, globals_, F.lit("2025-10-15 12:00:00"))


@query("dependency_wave", f"""WITH RECURSIVE {CONDITIONS}, {_EDGES}, sc AS (SELECT job_name, coalesce(box_name, '<root>') AS scope FROM jc UNION ALL SELECT job_name, job_name FROM jc WHERE job_type = 'BOX'),
se AS (SELECT a.scope, e.job, e.dep FROM e JOIN sc a ON a.job_name = e.job JOIN sc b ON b.job_name = e.dep AND b.scope = a.scope WHERE e.job <> e.dep),
w AS (SELECT scope, job_name, 1 AS n FROM sc UNION SELECT se.scope, se.job, w.n + 1 FROM w JOIN se ON se.scope = w.scope AND se.dep = w.job_name)
SELECT scope, job_name AS job, max(n) AS wave FROM w GROUP BY ALL""")
def dependency_wave(spark: SparkSession, d: str) -> DataFrame:
    """Longest chain of dependencies that each job ends, within its box (or among jobs without box)."""
    rows = conditions(spark, d)
    scopes = rows.select(F.coalesce("box_name", F.lit("<root>")).alias("scope"), F.col("job_name").alias("job"))
    scopes = scopes.unionByName(rows.where("job_type = 'BOX'").select(F.col("job_name").alias("scope"), F.col("job_name").alias("job")))
    return graphs.waves(scopes, _edges(spark, d))


@query("upstream_closure", f"""WITH RECURSIVE {CONDITIONS}, {_EDGES}, u AS (SELECT job, dep FROM e WHERE job <> dep AND job NOT IN (SELECT dep FROM e WHERE job <> dep) UNION SELECT e.job, e.dep FROM u JOIN e ON e.job = u.dep WHERE e.job <> e.dep)
SELECT DISTINCT dep AS job FROM u""")
def upstream_closure(spark: SparkSession, d: str) -> DataFrame:
    """All that the ends of chains (jobs that no other one depends on) depend on, directly or through others."""
    e = hierarchy.cut(_edges(spark, d).where("job != dep"))
    ends = e.select("job").join(e.select(F.col("dep").alias("job")), "job", "left_anti")
    return graphs.closure(ends, e)


@query("job_depends", f"WITH {CONDITIONS}, {_EDGES} SELECT job, 'needs' AS direction, dep AS other FROM e UNION ALL SELECT dep, 'needed_by', job FROM e")
def job_depends(spark: SparkSession, d: str) -> DataFrame:
    e = _edges(spark, d)
    needs = e.select("job", F.lit("needs").alias("direction"), F.col("dep").alias("other"))
    return needs.unionByName(e.select(F.col("dep").alias("job"), F.lit("needed_by").alias("direction"), F.col("job").alias("other")))


@query("box_graph_edges", f"WITH {CONDITIONS}, {_EDGES} SELECT e.job, e.dep, a.box_name AS box FROM e JOIN jc a ON a.job_name = e.job JOIN jc b ON b.job_name = e.dep AND b.box_name = a.box_name")
def box_graph_edges(spark: SparkSession, d: str) -> DataFrame:
    rows = conditions(spark, d)
    mine = rows.select(F.col("job_name").alias("job"), F.col("box_name").alias("box"))
    theirs = rows.select(F.col("job_name").alias("dep"), F.col("box_name").alias("box"))
    return _edges(spark, d).join(mine, "job").join(theirs, ["dep", "box"]).select("job", "dep", "box")


@query("box_nesting_depth", P3_BASE + """, y AS (SELECT DISTINCT m.node FROM m JOIN (SELECT node FROM m WHERE ancestor = node) c ON c.node = m.ancestor), n AS (SELECT node, max(distance) FILTER (ancestor <> node) AS d, count(*) FILTER (ancestor <> node) AS k FROM m GROUP BY 1),
t AS (SELECT j.k, j.name, coalesce(CASE WHEN y.node IS NULL THEN n.d ELSE n.k END, 0) + CASE WHEN y.node IS NULL AND coalesce((SELECT p.b FROM m JOIN j p ON p.k = m.ancestor WHERE m.node = j.k ORDER BY m.distance DESC LIMIT 1), CASE WHEN n.node IS NULL THEN j.b END, '') <> '' THEN 1 ELSE 0 END AS depth
  FROM j LEFT JOIN n ON n.node = j.k LEFT JOIN y ON y.node = j.k) SELECT name AS job_name, depth, CASE WHEN depth >= 5 THEN 'XL' WHEN depth >= 3 THEN 'L' WHEN depth >= 2 THEN 'M' WHEN depth >= 1 THEN 'S' ELSE 'XS' END AS score FROM t""")
def box_nesting_depth(spark: SparkSession, d: str) -> DataFrame:
    """Boxes above each job, with a score; a box that is named but doesn't exist counts as one. On and below cycles the distinct boxes above count."""
    rows = table(spark, d, "jobs").select("job_name", "box_name")
    p = hierarchy.paths(rows, F.col("job_name"), F.col("box_name"))
    # a root that names a box names one that doesn't exist
    named = rows.groupBy(name_key(F.col("job_name")).alias("_r")).agg(F.min(name_key(F.col("box_name"))).alias("_b")).where("_r is not null and _b is not null").select("_r", F.lit(1).alias("more"))
    out = p.join(named, name_key(F.col("root")) == F.col("_r"), "left")
    n = F.col("depth") + F.coalesce("more", F.lit(0))
    return out.select(F.col("name").alias("job_name"), n.alias("depth"), F.when(n >= 5, "XL").when(n >= 3, "L").when(n >= 2, "M").when(n >= 1, "S").otherwise("XS").alias("score"))


@query("box_descendants", f"""WITH RECURSIVE {CONDITIONS}, t AS (SELECT job_name AS box, job_name, 0 AS level FROM jc WHERE job_type = 'BOX' UNION ALL SELECT t.box, c.job_name, t.level + 1 FROM t JOIN jc c ON c.box_name = t.job_name WHERE t.level < 2)
SELECT box, job_name, level FROM t WHERE level > 0""")
def box_descendants(spark: SparkSession, d: str) -> DataFrame:
    """Jobs up to two levels below each box."""
    pairs = hierarchy.named_ancestors(conditions(spark, d).select("job_name", "box_name"), F.col("job_name"), F.col("box_name"))
    return pairs.where("distance <= 2").select(F.col("ancestor_name").alias("box"), F.col("name").alias("job_name"), F.col("distance").alias("level"))


@query("command_dialect", f"""WITH {JOBS} SELECT job_name, CASE WHEN contains(command, '.ksh') THEN 'ksh' WHEN contains(command, '.pl') THEN 'perl' WHEN contains(command, '.py') THEN 'python' WHEN contains(command, '.sh') THEN 'bash' ELSE 'none' END AS dialect,
len(regexp_extract_all(command, '(?:^|\\s)(/\\S+\\.\\w+)', 1)) AS n_absolute FROM j WHERE command IS NOT NULL""")
def command_dialect(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("command")
    return jobs(spark, d).where("command is not null").select("job_name", X.dialect(c).alias("dialect"), F.size(F.regexp_extract_all(c, F.lit(r"(?:^|\s)(/\S+\.\w+)"), 1)).cast("long").alias("n_absolute"))


@query("global_variables", f"WITH {JOBS} SELECT job_name, unnest(regexp_extract_all(command, '%%([A-Za-z0-9_]+)%%', 1)) AS variable FROM j")
def global_variables(spark: SparkSession, d: str) -> DataFrame:
    return jobs(spark, d).select("job_name", F.explode(X.variables(F.col("command"))).alias("variable"))


@query("substituted_command", f"WITH {JOBS} SELECT job_name, replace(command, '%%DAY%%', '2025-10-15') AS command FROM j WHERE command IS NOT NULL")
def substituted_command(spark: SparkSession, d: str) -> DataFrame:
    return jobs(spark, d).where("command is not null").select("job_name", X.substitute(F.col("command"), {"DAY": "2025-10-15"}).alias("command"))


@query("duration_anomalies", f"""WITH {RUNS} SELECT run_id, CASE WHEN epoch_us(end_time) - epoch_us(start_time) > -3600000000 THEN 'dst_suspected' ELSE 'clock_skew' END AS anomaly FROM r WHERE end_time < start_time""")
def duration_anomalies(spark: SparkSession, d: str) -> DataFrame:
    late = _US("end_time") - _US("start_time")
    return runs(spark, d).where("end_time < start_time").select("run_id", F.when(late > -3_600_000_000, "dst_suspected").otherwise("clock_skew").alias("anomaly"))


@query("run_fingerprint", f"""WITH {RUNS} SELECT run_id, 'imp:' || left(sha256('t' || chr(31) || job_name || chr(31) || CAST(epoch_us(start_time) AS VARCHAR) || chr(31) || CAST(retry_count AS VARCHAR)), 40) AS fingerprint FROM r WHERE start_time IS NOT NULL""")
def run_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    """Deterministic identity of a run by job, start and attempt."""
    return runs(spark, d).where("start_time is not null").select("run_id", X.run_key(F.lit("t"), F.col("job_name"), _US("start_time"), F.col("retry_count")).alias("fingerprint"))


@query("timezone_to_utc", "SELECT import_id, epoch_us(timezone('America/New_York', imported_at)) AS utc_us FROM history_imports")
def timezone_to_utc(spark: SparkSession, d: str) -> DataFrame:
    local = F.to_utc_timestamp(F.col("imported_at").cast("timestamp"), "America/New_York")
    return table(spark, d, "history_imports").select("import_id", F.unix_micros(local).alias("utc_us"))


@query("run_date_check", f"WITH {RUNS} SELECT run_id FROM r WHERE run_date IS DISTINCT FROM CAST(timezone('America/New_York', timezone('UTC', start_time)) AS DATE) AND start_time IS NOT NULL")
def run_date_check(spark: SparkSession, d: str) -> DataFrame:
    """Runs whose stored day is not the day of their start in New York."""
    return runs(spark, d).where(F.col("start_time").isNotNull() & ~F.col("run_date").eqNullSafe(F.to_date(F.from_utc_timestamp(F.col("start_time").cast("timestamp"), "America/New_York")))).select("run_id")


@query("retention_filter", f"WITH {RUNS} SELECT run_date, count(*) AS n_kept FROM r WHERE created_at >= TIMESTAMP '2025-10-01' GROUP BY 1")
def retention_filter(spark: SparkSession, d: str) -> DataFrame:
    """Runs that a retention rule keeps, by partition."""
    kept = table(spark, d, "job_runs").where(F.col("created_at") >= F.lit("2025-10-01").cast("timestamp_ntz")).dropDuplicates(["run_id"])
    return kept.groupBy("run_date").agg(F.count("*").alias("n_kept"))


@query("latest_status_merge", f"WITH {RUNS} SELECT job_name, status FROM r WHERE coalesce(end_time, start_time) IS NOT NULL QUALIFY row_number() OVER (PARTITION BY job_name ORDER BY coalesce(end_time, start_time) DESC, run_id DESC) = 1")
def latest_status_merge(spark: SparkSession, d: str) -> DataFrame:
    """Latest-wins state per job."""
    at = F.coalesce("end_time", "start_time")
    return table(spark, d, "job_runs").where(at.isNotNull()).groupBy("job_name").agg(F.max_by("status", F.struct(at.alias("t"), "run_id")).alias("status"))


@query("box_completion", f"""WITH {JOBS}, c AS (SELECT lower(trim(box_name, ' ' || chr(9) || chr(10) || chr(13))) AS box, bool_or(status IN (1, 3, 9)) AS active, bool_or(status = 5) AS failed, bool_or(status = 6) AS terminated, bool_and(status IN (4, 7)) AS good FROM j GROUP BY 1)
SELECT b.job_name AS box, CASE WHEN c.box IS NULL THEN 'SUCCESS' WHEN active THEN 'RUNNING' WHEN failed THEN 'FAILURE' WHEN terminated THEN 'TERMINATED' WHEN good THEN 'SUCCESS' ELSE 'INACTIVE' END AS box_status FROM j b LEFT JOIN c ON c.box = lower(b.job_name) WHERE b.job_type = 'BOX'""")
def box_completion(spark: SparkSession, d: str) -> DataFrame:
    """Status of each box from its children, by one map-side combined aggregation."""
    rows = jobs(spark, d).select("job_name", "job_type", "status", name_key(F.col("box_name")).alias("box"))
    s = F.col("status")
    kids = rows.where("box is not null").groupBy("box").agg(F.bool_or(s.isin(1, 3, 9)).alias("active"), F.bool_or(s == 5).alias("failed"), F.bool_or(s == 6).alias("terminated"), F.bool_and(s.isin(4, 7)).alias("good"), F.lit(True).alias("any"))
    boxes = rows.where("job_type = 'BOX'").select("job_name", F.lower("job_name").alias("box"))
    status = F.when(F.col("any").isNull(), "SUCCESS").when(F.col("active"), "RUNNING").when(F.col("failed"), "FAILURE").when(F.col("terminated"), "TERMINATED").when(F.col("good"), "SUCCESS").otherwise("INACTIVE")
    return boxes.join(kids, "box", "left").select(F.col("job_name").alias("box"), status.alias("box_status"))


@query("revenue_by_region_share", """WITH t AS (SELECT r_name AS region, CAST(sum(o_totalprice * 100) AS DECIMAL(30, 0)) AS cents FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1)
SELECT region, CAST(round(cents / 10000) AS BIGINT) AS revenue_e2, CAST(round(cents * 10000 / (SELECT sum(cents) FROM t)) AS BIGINT) AS share_e4 FROM t""")
def revenue_by_region_share(spark: SparkSession, d: str) -> DataFrame:
    o, c = table(spark, d, "orders").select("o_custkey", "o_totalprice"), table(spark, d, "customer").select("c_custkey", "c_nationkey")
    n, r = table(spark, d, "nation").select("n_nationkey", "n_regionkey"), table(spark, d, "region").select("r_regionkey", "r_name")
    j = o.join(c, o["o_custkey"] == c["c_custkey"]).join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    t = j.groupBy(F.col("r_name").alias("region")).agg(F.sum(F.col("o_totalprice") * 100).alias("cents"))
    total = t.agg(F.sum("cents").alias("total"))
    return t.crossJoin(F.broadcast(total)).select("region", F.round(F.col("cents") / 10000).cast("long").alias("revenue_e2"), F.round(F.col("cents") * 10000 / F.col("total")).cast("long").alias("share_e4"))  # total is one row


@query("top_customers", "SELECT o_custkey AS customer, CAST(round(sum(o_totalprice)) AS BIGINT) AS spent FROM orders GROUP BY 1 ORDER BY sum(o_totalprice) DESC, 1 LIMIT 5")
def top_customers(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("customer")).agg(F.sum("o_totalprice").alias("s"))
    return t.orderBy(F.desc("s"), "customer").limit(5).select("customer", F.round("s").cast("long").alias("spent"))


@query("sales_summary", "SELECT count(*) AS n_orders, count(DISTINCT o_custkey) AS n_customers, CAST(round(avg(o_totalprice)) AS BIGINT) AS average FROM orders")
def sales_summary(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").agg(F.count("*").alias("n_orders"), F.countDistinct("o_custkey").alias("n_customers"), F.round(F.avg("o_totalprice")).cast("long").alias("average"))


@query("extract_dedupe", "SELECT l_orderkey, min(l_linenumber) AS first_line FROM lineitem GROUP BY 1")
def extract_dedupe(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.min("l_linenumber").alias("first_line"))


@query("bulk_peak_concurrency", """WITH r AS (SELECT o_orderdate AS a, o_orderdate + to_hours(CAST(l_quantity AS INT)) AS b FROM orders JOIN lineitem ON l_orderkey = o_orderkey),
ev AS (SELECT a AS t, 1 AS d FROM r UNION ALL SELECT b, -1 FROM r), c AS (SELECT t, sum(d) OVER (ORDER BY t, d ROWS UNBOUNDED PRECEDING) AS n FROM ev)
SELECT CAST(n AS BIGINT) AS in_flight, epoch_us(t) AS at_us FROM c ORDER BY n DESC, t LIMIT 1""")
def bulk_peak_concurrency(spark: SparkSession, d: str) -> DataFrame:
    """Peak concurrency at volume: one run per line item, as long as its quantity in hours."""
    from runweave.operators import concurrency

    o, i = table(spark, d, "orders").select("o_orderkey", "o_orderdate"), table(spark, d, "lineitem").select("l_orderkey", "l_quantity")
    rows = o.join(i, F.col("l_orderkey") == F.col("o_orderkey"))
    start = F.col("o_orderdate").cast("timestamp")
    end = F.timestamp_micros(F.unix_micros(start) + F.col("l_quantity").cast("int").cast("long") * 3_600_000_000)
    return concurrency.peak(rows, start, end)


@query("simulation_outcomes")
def simulation_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """Twenty cycles of all jobs, wave by wave, with failures drawn from hashes; tested for reproducibility and propagation."""
    from runweave.operators import simulation

    rows = conditions(spark, d).select("job_name", (F.col("k") % 5).cast("int").alias("n_retrys"))
    runs_ = simulation.simulate(rows, _edges(spark, d), cycles=20, seed=42)
    return runs_.groupBy("cycle", "outcome").agg(F.count("*").alias("n_runs"))
