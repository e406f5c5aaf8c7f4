"""Operating views: traces of boxes, capacity, samples for review, identities of alarms, monitors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runweave.functions import strings as X
from runweave.operators import graphs
from runweave.operators.numbering import numbered
from runweave.plans.assessment import _ESTATE, _SIZED, JX, _edges, estate, sized
from runweave.plans.estate import ALARMS, RUNS, alarms
from runweave.plans.registry import query
from runweave.session import cut, table

_SECS = "(k % 9 + 1) * 60"


@query("box_trace", f"""{_ESTATE.replace("inner_ AS (", "unused_ AS (")}, bs AS (SELECT box_name AS scope, job_name, {_SECS} AS secs FROM jx WHERE box_name IS NOT NULL),
be AS (SELECT se.scope, se.job, se.dep FROM se JOIN bs a ON a.scope = se.scope AND a.job_name = se.job JOIN bs b ON b.scope = se.scope AND b.job_name = se.dep),
tr AS (SELECT scope, job_name, 0 AS start, secs AS finish FROM bs UNION SELECT be.scope, be.job, tr.finish, tr.finish + bs.secs FROM tr JOIN be ON be.scope = tr.scope AND be.dep = tr.job_name JOIN bs ON bs.scope = be.scope AND bs.job_name = be.job)
SELECT scope AS box, job_name AS job, CAST(max(start) AS BIGINT) AS start_s, CAST(max(finish) AS BIGINT) AS finish_s FROM tr GROUP BY ALL""".replace("{_SECS}", _SECS))
def box_trace(spark: SparkSession, d: str) -> DataFrame:
    """A dry run of every box: when each child starts and ends if nothing fails; the latest end is the length of the box's critical path."""
    rows = estate(spark, d)
    scopes = rows.where("box_name is not null").select(F.col("box_name").alias("scope"), F.col("job_name").alias("job"), F.expr(_SECS).alias("secs"))
    out = graphs.finish_times(scopes, _edges(rows))
    return out.select(F.col("scope").alias("box"), "job", F.col("start").alias("start_s"), F.col("finish").alias("finish_s"))


@query("machine_capacity", f"""WITH {JX}, u AS (SELECT machine, CAST(substr(machine, 5) AS INT) + 3 AS most, count(*) FILTER (status IN (1, 3)) AS used FROM jx WHERE machine IS NOT NULL GROUP BY machine)
SELECT machine, most, used, greatest(most - used, 0) AS available, used >= most AS saturated, used + 2 <= most AS accepts_two FROM u""")
def machine_capacity(spark: SparkSession, d: str) -> DataFrame:
    """Load of each machine against its own limit: what is left, whether it is full, whether a load of two still fits."""
    per = estate(spark, d).where("machine is not null").groupBy("machine").agg(F.count_if(F.col("status").isin(1, 3)).alias("used"))
    per = per.withColumn("most", F.substring("machine", 5, 9).cast("int") + 3)
    left = F.col("most") - F.col("used")
    return per.select("machine", "most", "used", F.greatest(left, F.lit(0).cast("long")).alias("available"), (left <= 0).alias("saturated"), (left >= 2).alias("accepts_two"))


@query("review_sample", f"{_SIZED}, n AS (SELECT job_name, row_number() OVER (ORDER BY job_name) AS i, count(*) OVER () AS n FROM z WHERE size = 'M') SELECT job_name FROM n WHERE i <= round_even(n * 0.3::DOUBLE, 0)")
def review_sample(spark: SparkSession, d: str) -> DataFrame:
    """The first three tenths of the jobs of middle size by name (a sample for review is the feature)."""
    rows = cut(numbered(sized(spark, d).where("size = 'M'").select("job_name"), [F.col("job_name")]))
    n = rows.agg(F.count("*").alias("n"))  # one row
    return rows.crossJoin(F.broadcast(n)).where(F.col("position") <= F.bround(F.col("n") * F.lit(0.3))).select("job_name")


@query("alarm_ids", f"WITH {RUNS}, {ALARMS} SELECT run_id, sha256(job_name || '|' || alarm_type || '|' || epoch_us(raised_at)) AS id FROM al")
def alarm_ids(spark: SparkSession, d: str) -> DataFrame:
    """Identities of alarms that follow from what they say, so raising one again makes no second."""
    at = F.unix_micros(F.col("raised_at").cast("timestamp")).cast("string")
    return alarms(spark, d).select("run_id", F.sha2(F.concat_ws("|", "job_name", "alarm_type", at), 256).alias("id"))


@query("monitor_results", """WITH h AS (SELECT import_id, count(*) AS n FROM history_rows WHERE contains(upper(raw_line), 'FA') GROUP BY 1) SELECT 'alarm' AS kind, import_id, n FROM h WHERE n >= 5 UNION ALL SELECT 'event', import_id, n FROM h WHERE n >= 5 AND import_id % 2 = 0""")
def monitor_results(spark: SparkSession, d: str) -> DataFrame:
    """A text monitor's hits as alarm rows and, where a job is linked, as events: two projections of one result."""
    hits = table(spark, d, "history_rows").where(F.upper("raw_line").contains("FA")).groupBy("import_id").agg(F.count("*").alias("n")).where("n >= 5")
    kinds = F.array_compact(F.array(F.lit("alarm"), F.when(F.col("import_id") % 2 == 0, "event")))
    return hits.select(F.explode(kinds).alias("kind"), "import_id", "n")


@query("local_jobs", f"WITH {JX} SELECT job_name FROM jx WHERE lower(machine) IN ('localhost', 'host3')")
def local_jobs(spark: SparkSession, d: str) -> DataFrame:
    """Jobs of this machine, by any of its names."""
    return estate(spark, d).where(F.lower("machine").isin("localhost", "host3")).select("job_name")


@query("space_needed", f"WITH {JX} SELECT job_name, '/tmp' AS location, CAST(k % 9 + 1 AS BIGINT) * 1048576 AS bytes FROM jx UNION ALL SELECT job_name, '/var', CAST(k AS BIGINT) * 1024 FROM jx")
def space_needed(spark: SparkSession, d: str) -> DataFrame:
    """Space that jobs ask for, from lists of locations and sizes."""
    k = F.col("k")
    spec = F.concat(F.lit("/tmp "), (k % 9 + 1).cast("string"), F.lit("MB, /var  "), k.cast("string"))
    pair = F.explode(F.transform(X.listed(spec), lambda x: F.split(x, r"\s+"))).alias("p")
    return estate(spark, d).select("job_name", pair).select("job_name", F.get("p", F.lit(0)).alias("location"), X.size_in_bytes(F.get("p", F.lit(1))).alias("bytes"))


@query("duplicate_dispositions", """SELECT stanza_id, CASE WHEN row_number() OVER (PARTITION BY object_name ORDER BY file_id, seq) > 1 THEN 'DUPLICATE' ELSE 'LOADED' END AS outcome FROM ujo_jil_stanza WHERE directive = 'insert_job' AND object_name IS NOT NULL""")
def duplicate_dispositions(spark: SparkSession, d: str) -> DataFrame:
    """Which definitions repeat an earlier one: all but the first of each name, found by a minimum that is combined map-side."""
    rows = table(spark, d, "ujo_jil_stanza").where("directive = 'insert_job' and object_name is not null").select("stanza_id", "object_name", "file_id", "seq")
    first = rows.groupBy("object_name").agg(F.min(F.struct("file_id", "seq")).alias("f"))
    again = (F.col("file_id") != F.col("f.file_id")) | (F.col("seq") != F.col("f.seq"))
    return rows.join(first, "object_name").select("stanza_id", F.when(again, "DUPLICATE").otherwise("LOADED").alias("outcome"))
