"""State that changes write: upserts, cascades, guards, archives, event queues. Each is a new version of rows, never an update in place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from runweave.conditions import columns
from runweave.functions.texts import host_key, name_key
from runweave.operators import concurrency, hierarchy, merge
from runweave.operators.numbering import numbered
from runweave.plans.assessment import JX, estate
from runweave.plans.estate import ALARMS, DATES, JOBS, RUNS, alarms, calendars, jobs, runs
from runweave.plans.registry import query
from runweave.session import cut, table

_US = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
_KEY = "lower(trim({0}, ' ' || chr(9) || chr(10) || chr(13)))"

# Settings of globals: one per order, its priority the value, a deletion now and then.
_SETS = "gs AS (SELECT o_orderkey AS seq, upper('g_' || (o_custkey % 50)) AS name, CASE WHEN o_orderkey % 17 = 0 THEN 'DELETE' ELSE o_orderpriority END AS value FROM orders)"


def global_settings(spark: SparkSession, d: str) -> DataFrame:
    value = F.when(F.col("o_orderkey") % 17 == 0, "DELETE").otherwise(F.col("o_orderpriority"))
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("seq"), F.upper(F.concat(F.lit("g_"), (F.col("o_custkey") % 50).cast("string"))).alias("name"), value.alias("value"))


_GLOBALS = f"{_SETS}, gl AS (SELECT name, value FROM (SELECT name, arg_max(value, seq) AS value FROM gs GROUP BY 1) WHERE value <> 'DELETE')"


@query("globals_state", f"WITH {_GLOBALS} SELECT name, value FROM gl")
def globals_state(spark: SparkSession, d: str) -> DataFrame:
    """Globals after all settings: the last value of each name (in upper case); the value DELETE removes it."""
    return merge.latest(global_settings(spark, d), ["name"], ["seq"], F.col("value") == "DELETE").select("name", "value")


@query("globals_map", f"WITH {_GLOBALS} SELECT count(*) AS n, string_agg(name || '=' || value, ',' ORDER BY name) AS pairs FROM gl")
def globals_map(spark: SparkSession, d: str) -> DataFrame:
    """All globals as one map, written out by name."""
    pairs = F.sort_array(F.collect_list(F.struct("name", "value")))
    return globals_state(spark, d).agg(F.map_from_entries(pairs).alias("m")).select(F.cardinality("m").alias("n").cast("long"), F.array_join(F.transform(F.array_sort(F.map_entries("m")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",").alias("pairs"))


@query("catalogue_state", f"""WITH c AS (SELECT job_name, import_seq, source_line, regexp_replace(lower(trim(op)), '_job$', '') AS op FROM jil_operations)
SELECT job_name, arg_max(op, import_seq * 1000000 + source_line) AS last_op, max(import_seq) AS import_seq FROM c GROUP BY 1 HAVING last_op <> 'delete'""")
def catalogue_state(spark: SparkSession, d: str) -> DataFrame:
    """A catalogue after inserts, updates and deletes: the last change of each name, unless it is a deletion."""
    op = F.regexp_replace(F.lower(F.trim("op")), "_job$", "")
    rows = table(spark, d, "jil_operations").select("job_name", "import_seq", "source_line", op.alias("last_op"))
    return merge.latest(rows, ["job_name"], ["import_seq", "source_line"], F.col("last_op") == "delete").select("job_name", "last_op", "import_seq")


@query("machine_merge", """WITH m AS (SELECT batch_row_id AS seq, split_part(lower(trim(machine)), '.', 1) AS machine, batch_row_id % 5 = 0 AS is_insert, CASE WHEN batch_row_id % 3 = 0 THEN status END AS factor, CASE WHEN batch_row_id % 7 < 3 THEN retry_count END AS max_load
  FROM run_batches WHERE trim(coalesce(machine, '')) <> ''), b AS (SELECT machine, max(seq) AS since FROM m WHERE is_insert GROUP BY 1)
SELECT machine, arg_max(factor, seq) FILTER (factor IS NOT NULL) AS factor, arg_max(max_load, seq) FILTER (max_load IS NOT NULL) AS max_load FROM m JOIN b USING (machine) WHERE seq >= since GROUP BY 1""")
def machine_merge(spark: SparkSession, d: str) -> DataFrame:
    """Machines after inserts (that replace) and updates (of named attributes only)."""
    n = F.col("batch_row_id")
    rows = table(spark, d, "run_batches").select(n.alias("seq"), host_key(F.col("machine")).alias("machine"), (n % 5 == 0).alias("is_insert"), F.when(n % 3 == 0, F.col("status")).alias("factor"), F.when(n % 7 < 3, F.col("retry_count")).alias("max_load"))
    return merge.patched(rows.where("machine is not null"), ["machine"], "seq", F.col("is_insert"), ["factor", "max_load"])


@query("machine_members", """WITH m AS (SELECT batch_row_id AS pos, CASE WHEN batch_row_id % 4 = 1 THEN split_part(lower(trim(coalesce(machine, 'none'))), '.', 1) END AS member, import_id, retry_count AS max_load FROM run_batches),
g AS (SELECT *, count(member) OVER (PARTITION BY import_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS grp FROM m)
SELECT import_id, grp, max(member) AS member, CAST(sum(max_load) AS BIGINT) AS max_load, count(*) AS n_lines FROM g WHERE grp > 0 GROUP BY ALL""")
def machine_members(spark: SparkSession, d: str) -> DataFrame:
    """Attributes fold into the member that they follow: lines of one import, a member opening a group. Lines before the first member belong to none."""
    n = F.col("batch_row_id")
    member = F.when(n % 4 == 1, F.coalesce(host_key(F.coalesce("machine", F.lit("none"))), F.lit("")))
    rows = table(spark, d, "run_batches").select(n.alias("at"), "import_id", member.alias("member"), F.col("retry_count").alias("max_load"))
    # an import may hold a third of all lines: members are counted up to each block of lines, then within it
    rows = rows.withColumn("block", F.expr("at div 4096"))
    blocks = rows.groupBy("import_id", "block").agg(F.count("member").alias("n"))
    before = F.sum("n").over(Window.partitionBy("import_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.join(blocks.select("import_id", "block", F.coalesce(before, F.lit(0)).alias("before")), ["import_id", "block"])
    within = F.count("member").over(Window.partitionBy("import_id", "block").orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
    grouped = rows.withColumn("grp", F.col("before") + within).where("grp > 0").groupBy("import_id", "grp")
    return grouped.agg(F.max("member").alias("member"), F.sum("max_load").alias("max_load"), F.count("*").alias("n_lines"))


@query("calendar_edits", f"""WITH {DATES}, ad AS (SELECT 'close_days' AS calendar_name, unnest(generate_series(DATE '2025-12-01', DATE '2025-12-31', INTERVAL 1 DAY))::DATE AS day), al AS (SELECT * FROM cal UNION SELECT * FROM ad WHERE isodow(day) IN (2, 4))
SELECT calendar_name, count(*) AS n_days, string_agg(CAST(day AS VARCHAR), ',' ORDER BY day) AS days FROM al WHERE NOT (calendar_name = 'bank_days' AND isodow(day) = 1) GROUP BY 1""")
def calendar_edits(spark: SparkSession, d: str) -> DataFrame:
    """Calendars after dates were added (every Tuesday and Thursday of a month) and removed (Mondays of one): sorted, each once."""
    month = F.filter(F.sequence(F.lit("2025-12-01").cast("date"), F.lit("2025-12-31").cast("date")), lambda x: F.weekday(x).isin(1, 3))
    rows = calendars(spark, d).groupBy("calendar_name").agg(F.collect_set("day").alias("days"))  # days of years, a bounded set
    added = F.when(F.col("calendar_name") == "close_days", F.array_union("days", month)).otherwise(F.col("days"))
    kept = F.when(F.col("calendar_name") == "bank_days", F.filter(added, lambda x: F.weekday(x) != 0)).otherwise(added)
    return rows.select("calendar_name", F.array_sort(kept).alias("k")).select("calendar_name", F.size("k").cast("long").alias("n_days"), F.array_join(F.transform("k", lambda x: x.cast("string")), ",").alias("days"))


@query("alarm_state", f"""WITH {RUNS}, {ALARMS} SELECT al.alarm_id, min(epoch_us(r.end_time)) AS resolved_us FROM al LEFT JOIN r ON r.job_name = al.job_name AND r.status = 4 AND r.end_time >= al.raised_at GROUP BY 1""")
def alarm_state(spark: SparkSession, d: str) -> DataFrame:
    """When each alarm is resolved: the first success of its job from then on; never is NULL. A forward as-of join over reversed time."""
    points = alarms(spark, d).select(F.col("alarm_id").alias("id"), F.col("job_name").alias("key"), (-F.unix_micros(F.col("raised_at").cast("timestamp"))).alias("at"))
    ends = table(spark, d, "job_runs").where("status = 4 and end_time is not null").select(F.col("job_name").alias("key"), (-_US("end_time")).alias("at"))
    return concurrency.as_of(points, ends).select(F.col("id").alias("alarm_id"), (-F.col("previous")).alias("resolved_us"))


@query("run_rows_folded", f"""WITH {RUNS} SELECT run_id, epoch_us(start_time) AS start_us, epoch_us(end_time) AS end_us, CASE WHEN end_time IS NULL THEN 1 ELSE status END AS status FROM r WHERE start_time IS NOT NULL""")
def run_rows_folded(spark: SparkSession, d: str) -> DataFrame:
    """Runs from the two rows that opening and closing them append: the last state of each, one aggregation, no update in place."""
    rows = table(spark, d, "job_runs").where("start_time is not null")
    opened = rows.select("run_id", F.lit(0).alias("step"), _US("start_time").alias("start_us"), F.lit(None).cast("long").alias("end_us"), F.lit(1).alias("status"))
    closed = rows.where("end_time is not null").select("run_id", F.lit(1).alias("step"), F.lit(None).cast("long").alias("start_us"), _US("end_time").alias("end_us"), "status")
    return opened.unionByName(closed).groupBy("run_id").agg(F.max("start_us").alias("start_us"), F.max("end_us").alias("end_us"), F.max_by("status", "step").alias("status"))


@query("output_lines", "SELECT import_id, row_number() OVER (PARTITION BY import_id ORDER BY line_no) AS nth, length(raw_line) AS n_chars FROM history_rows WHERE trim(raw_line) <> ''")
def output_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines of each output numbered from 1; one output may hold a third of all lines, so numbers come from one order of all."""
    rows = table(spark, d, "history_rows").where(F.trim("raw_line") != "").select("import_id", "line_no", F.length("raw_line").cast("long").alias("n_chars"))
    rows = cut(numbered(rows, [F.col("import_id"), F.col("line_no")]))
    first = rows.groupBy("import_id").agg(F.min("position").alias("first"))
    return rows.join(first, "import_id").select("import_id", (F.col("position") - F.col("first") + 1).alias("nth"), "n_chars")


@query("latest_output", """WITH i AS (SELECT file_format, arg_max(import_id, ROW(imported_at, import_id)) AS import_id FROM history_imports WHERE import_id IN (SELECT import_id FROM history_rows) GROUP BY 1)
SELECT i.file_format, i.import_id, count(*) AS n_lines FROM i JOIN history_rows USING (import_id) GROUP BY ALL""")
def latest_output(spark: SparkSession, d: str) -> DataFrame:
    """Output of the latest import of each format."""
    lines = table(spark, d, "history_rows").select("import_id")
    last = table(spark, d, "history_imports").join(lines, "import_id", "left_semi").groupBy("file_format").agg(F.max_by("import_id", F.struct("imported_at", "import_id")).alias("import_id"))
    return lines.join(last, "import_id").groupBy("file_format", "import_id").agg(F.count("*").alias("n_lines"))


@query("event_ticks", "SELECT event_id, (row_number() OVER (ORDER BY ts, event_id) - 1) // 100 AS tick FROM events")
def event_ticks(spark: SparkSession, d: str) -> DataFrame:
    """Events in the order of their arrival, a hundred to a tick."""
    rows = numbered(table(spark, d, "events").select("event_id", "ts"), [F.col("ts"), F.col("event_id")])
    return rows.select("event_id", F.expr("(position - 1) div 100").alias("tick"))


@query("queue_depth", "SELECT CAST(received_at AS DATE) AS day, count(*) AS n, count(*) FILTER (run_ref IS NULL) AS waiting, count(run_ref) AS processed FROM run_batches GROUP BY 1")
def queue_depth(spark: SparkSession, d: str) -> DataFrame:
    """Rows received, still without a run, and processed, by day."""
    rows = table(spark, d, "run_batches").groupBy(F.to_date("received_at").alias("day"))
    return rows.agg(F.count("*").alias("n"), F.count_if(F.col("run_ref").isNull()).alias("waiting"), F.count("run_ref").alias("processed"))


@query("import_guard", f"WITH {RUNS}, {JOBS} SELECT count(DISTINCT r.job_name) AS n_jobs, count(DISTINCT r.job_name) > 0 AS refused FROM r JOIN j USING (job_name) WHERE r.source = 'simulated'")
def import_guard(spark: SparkSession, d: str) -> DataFrame:
    """Whether simulated evidence stands in the way of loading real history, and for how many jobs."""
    known = jobs(spark, d).select("job_name")
    out = table(spark, d, "job_runs").where("source = 'simulated'").select("job_name").distinct().join(known, "job_name", "left_semi")
    return out.agg(F.count("*").alias("n_jobs"), (F.count("*") > 0).alias("refused"))


@query("clear_guard", "WITH n AS (SELECT count(DISTINCT job_name) AS actual FROM jobs), c(confirmed) AS (SELECT count(DISTINCT job_name) FROM job_runs) SELECT confirmed, actual, confirmed = actual AS cleared, CASE WHEN confirmed = actual THEN 0 ELSE actual END AS n_left FROM n, c")
def clear_guard(spark: SparkSession, d: str) -> DataFrame:
    """An estate is cleared only if the number confirmed is the number there."""
    actual = table(spark, d, "jobs").agg(F.countDistinct("job_name").alias("actual"))
    confirmed = table(spark, d, "job_runs").agg(F.countDistinct("job_name").alias("confirmed"))
    rows = confirmed.crossJoin(F.broadcast(actual))  # one row each
    return rows.withColumns({"cleared": F.col("confirmed") == F.col("actual"), "n_left": F.when(F.col("confirmed") == F.col("actual"), F.lit(0).cast("long")).otherwise(F.col("actual"))})


@query("evolved_schema", """WITH u AS (SELECT job_name, status, retry_count::BIGINT AS retry_count, run_id, NULL::BIGINT AS batch_row_id FROM job_runs UNION ALL SELECT job_name, status, retry_count, NULL, batch_row_id FROM run_batches)
SELECT status, count(*) AS n, count(run_id) AS with_run, count(batch_row_id) AS with_row, CAST(sum(retry_count) AS BIGINT) AS retries FROM u GROUP BY 1""")
def evolved_schema(spark: SparkSession, d: str) -> DataFrame:
    """Rows of an older and a newer schema together: missing columns are NULL, numbers are widened."""
    old = table(spark, d, "job_runs").select("job_name", "status", F.col("retry_count").cast("long").alias("retry_count"), "run_id")
    new = table(spark, d, "run_batches").select("job_name", "status", F.col("retry_count").cast("long").alias("retry_count"), "batch_row_id")
    rows = old.unionByName(new, allowMissingColumns=True)
    return rows.groupBy("status").agg(F.count("*").alias("n"), F.count("run_id").alias("with_run"), F.count("batch_row_id").alias("with_row"), F.sum("retry_count").alias("retries"))


_EXPORT = "x AS (SELECT job_name, 'CMD' AS job_type, upper(owner) AS owner FROM j WHERE length(job_name) % 3 <> 0 UNION ALL SELECT 'new_' || job_name, 'BOX', owner FROM j WHERE length(job_name) % 5 = 0)"


@query("job_upsert", f"WITH {JOBS}, {_EXPORT} SELECT coalesce(j.job_name, x.job_name) AS job_name, CASE WHEN x.job_name IS NULL THEN j.job_type ELSE x.job_type END AS job_type, CASE WHEN x.job_name IS NULL THEN j.owner ELSE x.owner END AS owner, CASE WHEN j.job_name IS NULL THEN 8 ELSE j.status END AS status FROM j FULL JOIN x ON x.job_name = j.job_name")
def job_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Definitions of a new export put in place of the old ones; what running left behind stays, and new jobs are inactive."""
    old = jobs(spark, d).select("job_name", "job_type", "owner", "status")
    length = F.length("job_name")
    new = old.where(length % 3 != 0).select("job_name", F.lit("CMD").alias("job_type"), F.upper("owner").alias("owner"))
    new = new.unionByName(old.where(length % 5 == 0).select(F.concat(F.lit("new_"), "job_name").alias("job_name"), F.lit("BOX").alias("job_type"), "owner"))
    return merge.upsert(old, new, "job_name", {"status": F.lit(8)})


@query("history_import_merge", f"""WITH k AS (SELECT {_KEY.format('job_name')} AS job, epoch_us(start_time) AS t, coalesce(retry_count, 0) AS a FROM job_runs WHERE start_time IS NOT NULL),
b AS (SELECT batch_row_id, {_KEY.format('job_name')} AS job, epoch_us(start_time) AS t, coalesce(retry_count, 0) AS a FROM run_batches WHERE start_time IS NOT NULL AND {_KEY.format("coalesce(job_name, '')")} <> '' QUALIFY row_number() OVER (PARTITION BY job, t, a ORDER BY batch_row_id) = 1)
SELECT batch_row_id FROM b WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.job = b.job AND k.t = b.t AND k.a = b.a)""")
def history_import_merge(spark: SparkSession, d: str) -> DataFrame:
    """Batch rows that an import would add: the first of each job, start and attempt, unless the history has it. Loading them again adds nothing."""
    key = lambda df: df.select("*", name_key(F.col("job_name")).alias("job"), _US("start_time").alias("t"), F.coalesce("retry_count", F.lit(0)).alias("a")).where("job is not null and t is not null")
    have = key(table(spark, d, "job_runs").select("job_name", "start_time", "retry_count")).select("job", "t", "a")
    new = key(table(spark, d, "run_batches").select("batch_row_id", "job_name", "start_time", "retry_count")).groupBy("job", "t", "a").agg(F.min("batch_row_id").alias("batch_row_id"))
    return new.join(have, ["job", "t", "a"], "left_anti").select("batch_row_id")


@query("batch_counters", f"""WITH {JOBS}, b AS (SELECT *, {_KEY.format('job_name')} AS job FROM run_batches), f AS (SELECT b.*, j.job_name IS NULL AS unknown, row_number() OVER (PARTITION BY import_id, job, start_time, coalesce(retry_count, 0) ORDER BY batch_row_id) > 1 AS again FROM b LEFT JOIN j ON lower(j.job_name) = b.job AND j.job_type = 'CMD')
SELECT import_id, count(*) AS n_read, count(*) FILTER (coalesce(job, '') = '' OR start_time IS NULL) AS n_skipped, count(*) FILTER (coalesce(job, '') <> '' AND start_time IS NOT NULL AND again) AS n_duplicate, count(*) FILTER (coalesce(job, '') <> '' AND unknown) AS n_unknown_job, count(DISTINCT nullif(job, '')) AS n_jobs,
epoch_us(min(start_time)) AS first_us, epoch_us(max(start_time)) AS last_us FROM f GROUP BY 1""")
def batch_counters(spark: SparkSession, d: str) -> DataFrame:
    """What an import of each batch would report, computed from its rows: read, skipped, repeated, of unknown jobs, jobs, window."""
    known = jobs(spark, d).where("job_type = 'CMD'").select(F.lower("job_name").alias("job"), F.lit(True).alias("known"))
    rows = table(spark, d, "run_batches").withColumn("job", name_key(F.col("job_name")))
    usable = F.col("job").isNotNull() & F.col("start_time").isNotNull()
    # rows of one job, start and attempt are one group, counted map-side: all but one of them are repeats
    one = rows.groupBy("import_id", "job", "start_time", F.coalesce("retry_count", F.lit(0)).alias("a")).agg(F.count("*").alias("n")).join(known, "job", "left")
    return one.groupBy("import_id").agg(
        F.sum("n").alias("n_read"), F.sum(F.when(~usable, F.col("n")).otherwise(0)).alias("n_skipped"), F.sum(F.when(usable, F.col("n") - 1).otherwise(0)).alias("n_duplicate"),
        F.sum(F.when(F.col("job").isNotNull() & F.col("known").isNull(), F.col("n")).otherwise(0)).alias("n_unknown_job"), F.countDistinct("job").alias("n_jobs"), F.min(_US("start_time")).alias("first_us"), F.max(_US("start_time")).alias("last_us"),
    )


@query("unknown_job_samples", f"""WITH {JOBS}, u AS (SELECT DISTINCT import_id, {_KEY.format('job_name')} AS job FROM run_batches WHERE {_KEY.format("coalesce(job_name, '')")} <> ''), s AS (SELECT * FROM u WHERE job NOT IN (SELECT lower(job_name) FROM j WHERE job_type = 'CMD') QUALIFY row_number() OVER (PARTITION BY import_id ORDER BY job) <= 50)
SELECT import_id, string_agg(job, ',' ORDER BY job) AS names FROM s GROUP BY 1""")
def unknown_job_samples(spark: SparkSession, d: str) -> DataFrame:
    """The first fifty names (that is the feature) of unknown jobs of each batch."""
    known = jobs(spark, d).where("job_type = 'CMD'").select(F.lower("job_name").alias("job"))
    names = table(spark, d, "run_batches").select("import_id", name_key(F.col("job_name")).alias("job")).where("job is not null").distinct().join(known, "job", "left_anti")
    first = names.withColumn("n", F.row_number().over(Window.partitionBy("import_id").orderBy("job"))).where("n <= 50")
    return first.groupBy("import_id").agg(F.array_join(F.sort_array(F.collect_list("job")), ",").alias("names"))


@query("stanza_archive", "SELECT file_path, file_id, count(*) AS n_stanzas FROM ujo_jil_stanza WHERE file_id = (SELECT max(s.file_id) FROM ujo_jil_stanza s WHERE s.file_path = ujo_jil_stanza.file_path) GROUP BY ALL")
def stanza_archive(spark: SparkSession, d: str) -> DataFrame:
    """The archive in which a file archived again takes the place of the earlier one."""
    rows = table(spark, d, "ujo_jil_stanza").select("file_path", "file_id", "seq")
    last = rows.groupBy("file_path").agg(F.max("file_id").alias("file_id"))
    return rows.join(last, ["file_path", "file_id"], "left_semi").groupBy("file_path", "file_id").agg(F.count("*").alias("n_stanzas"))


@query("prior_definition", "WITH f AS (SELECT object_name, min(stanza_id) AS first FROM ujo_jil_stanza WHERE directive = 'insert_job' AND object_name IS NOT NULL GROUP BY 1) SELECT s.stanza_id, p.file_path AS first_path, p.seq AS first_seq FROM ujo_jil_stanza s JOIN f USING (object_name) JOIN ujo_jil_stanza p ON p.stanza_id = f.first WHERE s.directive = 'insert_job' AND s.stanza_id > f.first")
def prior_definition(spark: SparkSession, d: str) -> DataFrame:
    """Where each repeated definition was defined first."""
    rows = table(spark, d, "ujo_jil_stanza").where("directive = 'insert_job' and object_name is not null").select("stanza_id", "object_name", "file_path", "seq")
    first = rows.groupBy("object_name").agg(F.min(F.struct("stanza_id", "file_path", "seq")).alias("f"))
    return rows.join(first, "object_name").where(F.col("stanza_id") > F.col("f.stanza_id")).select("stanza_id", F.col("f.file_path").alias("first_path"), F.col("f.seq").alias("first_seq"))


_OPS = "ops AS (SELECT op_id, job_name, import_seq * 1000000 + source_line AS seq, regexp_replace(lower(trim(op)), '_job$', '') AS op, raw_attrs FROM jil_operations)"
_ATTR = "(SELECT max(e.value) FROM (SELECT unnest(map_entries(raw_attrs)) AS e) WHERE lower(e.key) = '{0}')"


def _attr(name: str) -> Column:
    """An attribute of a change, by its name in any case; of several the greatest value."""
    return F.array_max(F.transform(F.filter(F.map_entries("raw_attrs"), lambda e: F.lower(e["key"]) == name), lambda e: e["value"]))


def operations(spark: SparkSession, d: str) -> DataFrame:
    seq = F.col("import_seq") * 1_000_000 + F.col("source_line")
    return table(spark, d, "jil_operations").select("op_id", "job_name", seq.alias("seq"), F.regexp_replace(F.lower(F.trim("op")), "_job$", "").alias("op"), "raw_attrs")


@query("late_links", f"""WITH {_OPS}, c AS (SELECT op_id, job_name, seq, {_ATTR.format('box_name')} AS box FROM ops WHERE op = 'insert'), f AS (SELECT job_name AS box, min(seq) AS defined FROM ops WHERE op = 'insert' GROUP BY 1)
SELECT c.op_id, c.job_name, c.box, f.defined FROM c LEFT JOIN f USING (box) WHERE c.box IS NOT NULL AND upper(trim(c.box)) <> 'NULL' AND (f.defined IS NULL OR f.defined > c.seq)""")
def late_links(spark: SparkSession, d: str) -> DataFrame:
    """Children inserted before their box: linked once it is defined; NULL if it never is."""
    rows = operations(spark, d).where("op = 'insert'")
    first = rows.groupBy(F.col("job_name").alias("box")).agg(F.min("seq").alias("defined"))
    kids = rows.select("op_id", "job_name", "seq", _attr("box_name").alias("box")).where(F.col("box").isNotNull() & (F.upper(F.trim("box")) != "NULL"))
    return kids.join(first, "box", "left").where("defined is null or defined > seq").select("op_id", "job_name", "box", "defined")


@query("rename_cascade", f"""WITH {JX}, n AS (SELECT job_name AS old, 'new_' || job_name AS new FROM jx WHERE k % 6 IN (0, 1))
SELECT coalesce(n.new, jx.job_name) AS job_name, coalesce(b.new, jx.box_name) AS box_name, CASE WHEN jx.condition IS NOT NULL THEN len([r FOR r IN regexp_extract_all(jx.condition, 'job_[0-9]+') IF CAST(r[5:] AS INT) % 6 IN (0, 1)]) END AS renamed_refs
FROM jx LEFT JOIN n ON n.old = jx.job_name LEFT JOIN n b ON b.old = jx.box_name""")
def rename_cascade(spark: SparkSession, d: str) -> DataFrame:
    """Jobs renamed: their own rows, the rows of what they contain, and how many references in conditions follow (renamed_condition has the texts)."""
    rows = estate(spark, d)
    names = rows.where("k % 6 IN (0, 1)").select(F.col("job_name").alias("old"), F.concat(F.lit("new_"), "job_name").alias("new"))
    own = names.select(F.col("old").alias("job_name"), F.col("new").alias("_own"))
    box = names.select(F.col("old").alias("box_name"), F.col("new").alias("_box"))
    refs = F.transform(F.regexp_extract_all("condition", F.lit("(job_[0-9]+)"), 1), lambda r: F.substring(r, 5, 10).cast("int") % 6 <= 1)
    out = rows.join(own, "job_name", "left").join(box, "box_name", "left")
    return out.select(F.coalesce("_own", "job_name").alias("job_name"), F.coalesce("_box", "box_name").alias("box_name"), F.when(F.col("condition").isNotNull(), F.size(F.filter(refs, lambda x: x)).cast("long")).alias("renamed_refs"))


@query("renamed_condition", f"WITH {JX}, w AS (SELECT job_name, unnest(regexp_split_to_array(regexp_replace(condition, '(job_[0-9]+)', '<\\1<', 'g'), '<')) AS t, generate_subscripts(regexp_split_to_array(regexp_replace(condition, '(job_[0-9]+)', '<\\1<', 'g'), '<'), 1) AS i FROM jx WHERE condition IS NOT NULL) "
       "SELECT job_name, string_agg(CASE WHEN regexp_full_match(t, 'job_[0-9]+') AND CAST(t[5:] AS INT) % 6 IN (0, 1) THEN 'new_' || t ELSE t END, '' ORDER BY i) AS condition FROM w GROUP BY job_name")  # fmt: skip
def renamed_condition(spark: SparkSession, d: str) -> DataFrame:
    """Conditions with renamed jobs: references are cut out of the text, renamed by a join, and put back in their places."""
    rows = estate(spark, d).where("condition is not null").select("job_name", "k", "condition")
    names = estate(spark, d).where("k % 6 IN (0, 1)").select(F.col("job_name").alias("old"), F.concat(F.lit("new_"), "job_name").alias("new"))
    marked = F.split(F.regexp_replace("condition", "(?<![A-Za-z0-9_.:%#-])(job_[0-9]+)(?![A-Za-z0-9_.:%#-])", "\u0001$1\u0001"), "\u0001")
    parts = rows.select("job_name", F.posexplode(marked).alias("i", "part")).join(names, F.col("part") == F.col("old"), "left")
    joined = parts.groupBy("job_name").agg(F.sort_array(F.collect_list(F.struct("i", F.coalesce("new", "part").alias("t")))).alias("ts"))
    return joined.select("job_name", F.array_join(F.transform("ts", lambda x: x["t"]), "").alias("condition"))


@query("delete_box_cascade", f"WITH RECURSIVE {JX}, gone AS (SELECT job_name FROM jx WHERE k % 300 = 0 UNION SELECT jx.job_name FROM jx JOIN gone ON jx.box_name = gone.job_name) SELECT job_name FROM jx WHERE job_name NOT IN (SELECT job_name FROM gone)")
def delete_box_cascade(spark: SparkSession, d: str) -> DataFrame:
    """What is left when boxes are deleted with everything below them."""
    rows = estate(spark, d)
    boxes = rows.where("k % 300 = 0").select("job_name")
    below = hierarchy.named_ancestors(rows, F.col("job_name"), F.col("box_name")).join(boxes.withColumnRenamed("job_name", "ancestor_name"), "ancestor_name", "left_semi")
    gone = boxes.unionByName(below.select(F.col("name").alias("job_name")))
    return rows.select("job_name").join(gone, "job_name", "left_anti")


@query("delete_job_cascade", f"""WITH {JX}, {RUNS}, gone AS (SELECT job_name FROM jobs WHERE length(job_name) % 4 = 0) SELECT 'jobs' AS table_name, count(*) AS n_left FROM jobs WHERE job_name NOT IN (SELECT job_name FROM gone)
UNION ALL SELECT 'job_runs', count(*) FROM r WHERE job_name NOT IN (SELECT job_name FROM gone)""")
def delete_job_cascade(spark: SparkSession, d: str) -> DataFrame:
    """Deleting jobs takes their runs along: one anti join for each table."""
    gone = table(spark, d, "jobs").where(F.length("job_name") % 4 == 0).select("job_name").distinct()
    left = lambda name, df: df.join(gone, "job_name", "left_anti").agg(F.count("*").alias("n_left")).select(F.lit(name).alias("table_name"), "n_left")
    return left("jobs", table(spark, d, "jobs")).unionByName(left("job_runs", runs(spark, d)))


@query("retention_dry_run", f"WITH {RUNS} SELECT source, count(*) FILTER (created_at < TIMESTAMP '2025-10-01') AS n_deleted, count(*) FILTER (created_at >= TIMESTAMP '2025-10-01') AS n_kept FROM r GROUP BY 1")
def retention_dry_run(spark: SparkSession, d: str) -> DataFrame:
    """How many runs a retention rule would delete, without doing so."""
    old = F.col("created_at") < F.lit("2025-10-01").cast("timestamp_ntz")
    return runs(spark, d).groupBy("source").agg(F.count_if(old).alias("n_deleted"), F.count_if(~old).alias("n_kept"))


@query("remote_status", f"""WITH {JX}, rs AS (SELECT 'job_' || lpad(CAST(p_partkey AS VARCHAR), 7, '0') AS name, CASE p_partkey % 3 WHEN 0 THEN 'SUCCESS' WHEN 1 THEN 'FAILURE' ELSE 'RUNNING' END AS status FROM part WHERE p_partkey % 4 <> 0)
SELECT jx.job_name, r.ref, coalesce(rs.status, 'INACTIVE') AS status FROM jx, (SELECT job_name AS j2, regexp_extract(condition, '(job_[0-9]+)\\^', 1) AS ref FROM jx) r LEFT JOIN rs ON rs.name = r.ref WHERE r.j2 = jx.job_name AND r.ref <> ''""")
def remote_status(spark: SparkSession, d: str) -> DataFrame:
    """References to another instance with the status that it last sent; unknown ones are inactive. One join, no call for each row."""
    rows = estate(spark, d)
    k = F.col("k")
    sent = rows.where(k % 4 != 0).select(F.col("job_name").alias("ref"), F.when(k % 3 == 0, "SUCCESS").when(k % 3 == 1, "FAILURE").otherwise("RUNNING").alias("status"))
    refs = columns.parsed(rows, "condition").select(F.col("condition"), F.explode(F.filter("steps", lambda s: s["instance"].isNotNull())).alias("s")).select("condition", F.col("s.name").alias("ref")).distinct()
    return rows.select("job_name", "condition").join(refs, "condition").join(sent, "ref", "left").select("job_name", "ref", F.coalesce("status", F.lit("INACTIVE")).alias("status"))


@query("alarm_notifications", f"WITH {RUNS}, {JOBS}, {ALARMS} SELECT al.alarm_id, coalesce(j.extra_attrs['group_label'], CASE WHEN j.alarm_if_fail THEN 'default' ELSE 'none' END) AS notification FROM al LEFT JOIN j USING (job_name)")
def alarm_notifications(spark: SparkSession, d: str) -> DataFrame:
    """Whom each alarm tells: its job's group, the default one, or none."""
    known = jobs(spark, d).select("job_name", F.coalesce(F.try_element_at("extra_attrs", F.lit("group_label")), F.when(F.col("alarm_if_fail"), "default").otherwise("none")).alias("notification"))
    out = alarms(spark, d).join(known, "job_name", "left")
    return out.select("alarm_id", F.coalesce("notification", F.lit("none")).alias("notification"))


@query("document_links", f"WITH {JOBS} SELECT d.doc_id, j.job_type, d.job_name IS NOT NULL AND j.job_name IS NULL AS dangling FROM documents d LEFT JOIN j ON j.job_name = d.job_name")
def document_links(spark: SparkSession, d: str) -> DataFrame:
    """Optional links to jobs, and whether they lead nowhere."""
    known = jobs(spark, d).select("job_name", "job_type", F.lit(True).alias("there"))
    out = table(spark, d, "documents").select("doc_id", "job_name").join(known, "job_name", "left")
    return out.select("doc_id", "job_type", (F.col("job_name").isNotNull() & F.col("there").isNull()).alias("dangling"))


@query("orphaned_duplicates", f"WITH d AS (SELECT object_name FROM ujo_jil_stanza WHERE disposition = 'DUPLICATE' AND object_name IS NOT NULL), l AS (SELECT object_name FROM ujo_jil_stanza WHERE disposition LIKE 'LOADED%' AND directive = 'insert_job') SELECT DISTINCT object_name FROM d WHERE object_name NOT IN (SELECT object_name FROM l WHERE object_name IS NOT NULL)")
def orphaned_duplicates(spark: SparkSession, d: str) -> DataFrame:
    """Names that are only there as duplicates of what wasn't loaded."""
    rows = table(spark, d, "ujo_jil_stanza").where("object_name is not null")
    live = rows.where("disposition like 'LOADED%' and directive = 'insert_job'").select("object_name")
    return rows.where("disposition = 'DUPLICATE'").select("object_name").distinct().join(live, "object_name", "left_anti")


_TABLES = ("jobs", "jil_operations", "ujo_jil_stanza", "history_imports", "history_rows", "history_staged", "job_runs", "run_batches", "documents", "eval_items", "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "embeddings")


@query("database_statistics", " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n_rows FROM {t}" for t in _TABLES))
def database_statistics(spark: SparkSession, d: str) -> DataFrame:
    """Rows of every table, from the files' footers."""
    out = None
    for t in _TABLES:
        one = table(spark, d, t).agg(F.count("*").alias("n_rows")).select(F.lit(t).alias("table_name"), "n_rows")
        out = one if out is None else out.unionByName(one)
    return out


@query("job_columns", f"""WITH {JOBS} SELECT job_name, coalesce(array_to_string(start_times, ','), '') AS start_times, coalesce(array_to_string(days_of_week, ','), '') AS days_of_week, CASE WHEN date_conditions THEN 1 ELSE 0 END AS date_conditions, coalesce(extra_attrs['group_label'], '') AS group_label FROM j""")
def job_columns(spark: SparkSession, d: str) -> DataFrame:
    """Jobs as flat rows: lists as comma text, flags as numbers, a bag's member as a column, nothing that running left behind."""
    text = lambda c: F.coalesce(F.array_join(c, ","), F.lit("")).alias(c)
    label = F.coalesce(F.try_element_at("extra_attrs", F.lit("group_label")), F.lit(""))
    return jobs(spark, d).select("job_name", text("start_times"), text("days_of_week"), F.col("date_conditions").cast("int").alias("date_conditions"), label.alias("group_label"))


@query("definition_key", f"WITH {JOBS} SELECT bit_xor(CAST('0x' || left(sha256(job_name || '|' || coalesce(job_type, '') || '|' || coalesce(command, '') || '|' || n_retrys), 15) AS BIGINT)) AS key, count(*) AS n_jobs FROM j")
def definition_key(spark: SparkSession, d: str) -> DataFrame:
    """Key of an estate's definitions for caching what was computed from them; changes of status leave it as it is. Hashes of jobs are combined in any order, map-side."""
    none = lambda c: F.coalesce(c, F.lit(""))
    line = F.concat_ws("|", "job_name", none("job_type"), none("command"), F.col("n_retrys").cast("string"))
    digits = F.conv(F.substring(F.sha2(line, 256), 1, 15), 16, 10).cast("long")
    return jobs(spark, d).agg(F.bit_xor(digits).alias("key"), F.count("*").alias("n_jobs"))


@query("sales_regions", "SELECT count(DISTINCT n_regionkey) AS n_regions, string_agg(DISTINCT r_name, ',' ORDER BY r_name) AS regions, count(DISTINCT c_custkey) AS n_customers FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def sales_regions(spark: SparkSession, d: str) -> DataFrame:
    """Regions and customers that orders come from."""
    o, c = table(spark, d, "orders").select("o_custkey").distinct(), table(spark, d, "customer").select("c_custkey", "c_nationkey")
    n, r = table(spark, d, "nation").select("n_nationkey", "n_regionkey"), table(spark, d, "region").select("r_regionkey", "r_name")
    rows = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.agg(F.countDistinct("n_regionkey").alias("n_regions"), F.array_join(F.array_sort(F.collect_set("r_name")), ",").alias("regions"), F.countDistinct("c_custkey").alias("n_customers"))


@query("extract_first_rows", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) = 1")
def extract_first_rows(spark: SparkSession, d: str) -> DataFrame:
    """The whole first row of each key, after the columns that are needed were checked."""
    rows = table(spark, d, "lineitem")
    if missing := {"l_orderkey", "l_linenumber", "l_partkey"} - set(rows.columns):
        raise ValueError(f"columns missing: {', '.join(sorted(missing))}")
    first = rows.groupBy("l_orderkey").agg(F.min(F.struct("l_linenumber", "l_partkey")).alias("x"))
    return first.select("l_orderkey", "x.l_linenumber", "x.l_partkey")
