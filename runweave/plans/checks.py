"""Checks and conversions of definitions at import: types, values, families, required fields, variables, schedules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runweave.conditions import columns
from runweave.functions import schedules
from runweave.functions import strings as X
from runweave.plans.aggregates import _STATS, run_stats
from runweave.plans.assessment import JX, estate
from runweave.plans.estate import ALARMS, DATES, JOBS, RUNS, alarms, calendars, jobs, runs
from runweave.plans.mutations import _ATTR, _OPS, _attr, operations
from runweave.plans.registry import query
from runweave.session import table
from runweave.sources import files

# Values that an import meets: those of the change feed, some of them damaged.
_RAW = f"""{_OPS}, rw AS (SELECT op_id, op, job_name, {_ATTR.format('job_type')} AS given_type, CASE WHEN op_id % 11 = 0 THEN {_ATTR.format('n_retrys')} || 'x' ELSE {_ATTR.format('n_retrys')} END AS n_retrys,
  CASE WHEN op_id % 9 = 0 THEN replace({_ATTR.format('start_times')}, ':', '.') ELSE {_ATTR.format('start_times')} END AS start_times, {_ATTR.format('term_run_time')} AS term_run_time, {_ATTR.format('alarm_if_fail')} AS alarm_if_fail,
  {_ATTR.format('command')} AS command, {_ATTR.format('machine')} AS machine, CASE op_id % 6 WHEN 0 THEN ' b ' WHEN 1 THEN 'c' WHEN 2 THEN 'Fw' WHEN 3 THEN '' WHEN 4 THEN 'CMDD' ELSE 'file_watch' END AS type_token,
  CASE op_id % 5 WHEN 0 THEN '-1' WHEN 1 THEN '5' WHEN 2 THEN '0' WHEN 3 THEN 'x' END AS auto_delete, CASE op_id % 7 WHEN 0 THEN 'ON_HOLD' WHEN 1 THEN 'running' WHEN 2 THEN 'on_ice' END AS status FROM ops)"""
_NULL = "coalesce(upper(trim({0})), 'NULL') IN ('NULL', '')"


def raw(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("op_id")
    damaged = lambda every, bad, good: F.when(n % every == 0, bad).otherwise(good)
    return operations(spark, d).select(
        n, "op", "job_name", _attr("job_type").alias("given_type"), damaged(11, F.concat(_attr("n_retrys"), F.lit("x")), _attr("n_retrys")).alias("n_retrys"),
        damaged(9, F.replace(_attr("start_times"), F.lit(":"), F.lit(".")), _attr("start_times")).alias("start_times"), _attr("term_run_time").alias("term_run_time"), _attr("alarm_if_fail").alias("alarm_if_fail"),
        _attr("command").alias("command"), _attr("machine").alias("machine"),
        F.when(n % 6 == 0, " b ").when(n % 6 == 1, "c").when(n % 6 == 2, "Fw").when(n % 6 == 3, "").when(n % 6 == 4, "CMDD").otherwise("file_watch").alias("type_token"),
        F.when(n % 5 == 0, "-1").when(n % 5 == 1, "5").when(n % 5 == 2, "0").when(n % 5 == 3, "x").alias("auto_delete"), F.when(n % 7 == 0, "ON_HOLD").when(n % 7 == 1, "running").when(n % 7 == 2, "on_ice").alias("status"),
    )


def _unset(c: str) -> Column:
    return F.coalesce(F.upper(F.trim(c)), F.lit("NULL")).isin("NULL", "")


@query("value_checks", rf"""WITH {_RAW} SELECT op_id, 'n_retrys' AS attr, n_retrys AS value FROM rw WHERE NOT {_NULL.format('n_retrys')} AND NOT regexp_full_match(trim(n_retrys), '[0-9]+')
UNION ALL SELECT op_id, 'start_times', t FROM (SELECT op_id, start_times, trim(unnest(string_split(start_times, ','))) AS t FROM rw WHERE NOT {_NULL.format('start_times')}) WHERE NOT regexp_full_match(t, '([01]?[0-9]|2[0-3]):[0-5][0-9]')""")
def value_checks(spark: SparkSession, d: str) -> DataFrame:
    """Values that don't have the form of their attribute; a warning each."""
    rows = raw(spark, d)
    numbers = rows.where(~_unset("n_retrys") & ~F.trim("n_retrys").rlike("^[0-9]+$")).select("op_id", F.lit("n_retrys").alias("attr"), F.col("n_retrys").alias("value"))
    times = rows.where(~_unset("start_times")).select("op_id", F.lit("start_times").alias("attr"), F.explode(F.transform(F.split("start_times", ","), lambda x: F.trim(x))).alias("value"))
    return numbers.unionByName(times.where(~F.col("value").rlike("^([01]?[0-9]|2[0-3]):[0-5][0-9]$")))


# Prefixes of attributes, and the types of jobs they belong to.
FAMILIES = {
    "ftp_": ("FTP", "FT"), "sap_": ("SAP", "SAPBDC", "SAPBWIP", "SAPBWPC", "SAPDA", "SAPEVT", "SAPJC", "SAPPM"), "oozie_": ("OOZIE",),
    "j2ee_": ("ENTYBEAN", "SESSBEAN", "JAVARMI", "POJO", "JMSPUB", "JMSSUB", "JMXMAG", "JMXMAS", "JMXMC", "JMXMOP", "JMXMREM", "JMXSUB"), "zos_": ("ZOS", "ZOSM", "ZOSDST"),
}


@query("family_checks", f"""WITH {JX}, a AS (SELECT job_name, job_type, CASE k % 8 WHEN 1 THEN 'FTP_local_name' WHEN 2 THEN 'sap_client' WHEN 3 THEN 'ftp_server' WHEN 4 THEN 'zos_dataset' ELSE 'owner' END AS attr FROM jx)
SELECT job_name, attr FROM a WHERE (starts_with(lower(attr), 'ftp_') AND job_type NOT IN ('FTP', 'FT')) OR starts_with(lower(attr), 'sap_') OR starts_with(lower(attr), 'zos_')""")
def family_checks(spark: SparkSession, d: str) -> DataFrame:
    """Attributes that belong to other types of jobs."""
    k = F.col("k") % 8
    rows = estate(spark, d).select("job_name", "job_type", F.when(k == 1, "FTP_local_name").when(k == 2, "sap_client").when(k == 3, "ftp_server").when(k == 4, "zos_dataset").otherwise("owner").alias("attr"))
    bad = F.lit(False)
    for prefix, types in FAMILIES.items():
        bad = bad | (F.lower("attr").startswith(prefix) & ~F.col("job_type").isin(*types))
    return rows.where(bad).select("job_name", "attr")


@query("required_fields", f"""WITH {_RAW}, t AS (SELECT op_id, coalesce(nullif(upper(trim(given_type)), ''), 'CMD') AS kind, {_NULL.format('command')} AS no_command, {_NULL.format('machine')} AS no_machine FROM rw WHERE op = 'insert')
SELECT op_id, unnest(list_filter([CASE WHEN kind = 'CMD' AND no_command THEN 'CMD needs command' END, CASE WHEN kind = 'CMD' AND no_machine THEN 'CMD needs machine' END, CASE WHEN kind = 'BOX' AND NOT no_command THEN 'BOX has command' END, CASE WHEN kind = 'FILEWATCH' THEN 'FILEWATCH needs watch_file' END], lambda x: x IS NOT NULL)) AS issue FROM t""")
def required_fields(spark: SparkSession, d: str) -> DataFrame:
    """Inserts that lack what their type needs, or have what it forbids."""
    kind = X.job_type(F.col("given_type"))
    rows = raw(spark, d).where("op = 'insert'").withColumn("watch_file", F.lit(None).cast("string"))
    tests = [(kind == "CMD") & _unset("command"), (kind == "CMD") & _unset("machine"), (kind == "BOX") & ~_unset("command"), (kind == "FILEWATCH") & _unset("watch_file")]
    says = ("CMD needs command", "CMD needs machine", "BOX has command", "FILEWATCH needs watch_file")
    return rows.select("op_id", F.explode(F.array_compact(F.array(*[F.when(t, s) for t, s in zip(tests, says, strict=True)]))).alias("issue"))


@query("job_types", f"""WITH {_RAW} SELECT op_id, CASE upper(trim(type_token)) WHEN '' THEN 'CMD' WHEN 'B' THEN 'BOX' WHEN 'C' THEN 'CMD' WHEN 'FW' THEN 'FILEWATCH' ELSE upper(trim(type_token)) END AS job_type,
CASE upper(trim(type_token)) WHEN 'CMDD' THEN 'CMD' WHEN 'FILE_WATCH' THEN 'FILEWATCH' END AS meant FROM rw""")
def job_types(spark: SparkSession, d: str) -> DataFrame:
    """Types by short names, and what misspelt ones were meant to be."""
    t = F.col("type_token")
    return raw(spark, d).select("op_id", X.job_type(t).alias("job_type"), X.like_built_in(t).alias("meant"))


@query("typed_build", f"""WITH {_RAW}, c AS (SELECT op_id, n_retrys AS r, term_run_time AS t, alarm_if_fail AS a, TRY_CAST(trim(n_retrys) AS INT) AS n_retrys, TRY_CAST(trim(term_run_time) AS INT) AS term_run_time,
  CASE WHEN lower(trim(alarm_if_fail)) IN ('1', 'y', 'yes', 't', 'true') THEN TRUE WHEN lower(trim(alarm_if_fail)) IN ('0', 'n', 'no', 'f', 'false') THEN FALSE END AS alarm_if_fail FROM rw WHERE op = 'insert')
SELECT op_id, n_retrys, term_run_time, alarm_if_fail, array_to_string(list_filter([CASE WHEN NOT {_NULL.format('r')} AND n_retrys IS NULL THEN 'n_retrys=' || r END, CASE WHEN NOT {_NULL.format('t')} AND term_run_time IS NULL THEN 'term_run_time=' || t END,
CASE WHEN NOT {_NULL.format('a')} AND alarm_if_fail IS NULL THEN 'alarm_if_fail=' || a END], lambda x: x IS NOT NULL), ';') AS extras FROM c""")
def typed_build(spark: SparkSession, d: str) -> DataFrame:
    """Typed attributes of inserts; values that don't fit their type are kept as extras (a strict caller rejects rows that have any)."""
    whole = lambda c: F.when(F.trim(c).rlike(r"^[+-]?\d+$"), F.trim(c)).try_cast("int")
    flag = F.when(F.lower(F.trim("alarm_if_fail")).isin("1", "y", "yes", "t", "true"), True).when(F.lower(F.trim("alarm_if_fail")).isin("0", "n", "no", "f", "false"), False)
    typed = {"n_retrys": whole("n_retrys"), "term_run_time": whole("term_run_time"), "alarm_if_fail": flag}
    left = [F.when(~_unset(c) & t.isNull(), F.concat(F.lit(f"{c}="), F.col(c))) for c, t in typed.items()]
    return raw(spark, d).where("op = 'insert'").select("op_id", *[t.alias(c) for c, t in typed.items()], F.array_join(F.array_compact(F.array(*left)), ";").alias("extras"))


@query("auto_delete", f"WITH {_RAW} SELECT op_id, coalesce(TRY_CAST(auto_delete AS INT) > 0, FALSE) AS deletes FROM rw WHERE auto_delete IS NOT NULL")
def auto_delete(spark: SparkSession, d: str) -> DataFrame:
    """Hours after which a job is deleted, as a flag: -1, 0 and what is no number mean never."""
    return raw(spark, d).where("auto_delete is not null").select("op_id", F.coalesce(F.col("auto_delete").try_cast("int") > 0, F.lit(False)).alias("deletes"))


# Statuses that an insert may begin with.
INITIAL = ("INACTIVE", "ON_HOLD", "ON_ICE", "ON_NOEXEC", "SUCCESS", "FAILURE", "TERMINATED")


@query("initial_status", f"WITH {_RAW} SELECT op_id, CASE WHEN op <> 'insert' THEN 'only on insert' WHEN upper(status) NOT IN {INITIAL} THEN 'not allowed' ELSE upper(status) END AS outcome FROM rw WHERE status IS NOT NULL")
def initial_status(spark: SparkSession, d: str) -> DataFrame:
    """Statuses that definitions ask for: taken on inserts only, and only some."""
    s = F.upper("status")
    return raw(spark, d).where("status is not null").select("op_id", F.when(F.col("op") != "insert", "only on insert").when(~s.isin(*INITIAL), "not allowed").otherwise(s).alias("outcome"))


@query("unparsed_conditions", f"WITH {JX} SELECT job_name FROM jx WHERE contains(condition, '& &')")
def unparsed_conditions(spark: SparkSession, d: str) -> DataFrame:
    rows = estate(spark, d)
    bad = columns.parsed(rows, "condition").where("error is not null").select("condition")
    return rows.join(bad, "condition", "left_semi").select("job_name")


@query("expanded_commands", f"""WITH {JX} SELECT job_name, replace(replace(replace(command, '%%REGION%%', 'EU'), '%%DATE%%', '10152025'), '%%TIMESTAMP%%', '%%DATE%%') AS command,
array_to_string(list_sort(list_distinct([v FOR v IN regexp_extract_all(command, '%%([A-Za-z0-9_]+)%%', 1) IF v NOT IN ('REGION', 'DATE', 'TIMESTAMP')])), ',') AS unresolved FROM jx""")
def expanded_commands(spark: SparkSession, d: str) -> DataFrame:
    """Commands with variables of the run and globals put in, once each, and the names that have no value."""
    now = F.lit("2025-10-15 12:00:00").cast("timestamp")
    text, left = X.expanded(F.col("command"), X.builtins(now, now) | {"REGION": F.lit("EU"), "timestamp": F.lit("%%DATE%%")})
    return estate(spark, d).select("job_name", text.alias("command"), F.array_join(F.array_sort(left), ",").alias("unresolved"))


@query("expanded_globs", f"""WITH {JX}, t AS (SELECT job_name, k % 5 AS n FROM jx) SELECT job_name, 'run ' || CASE WHEN n < 3 THEN 'text' || n ELSE '%%GLOB:g_' || n || '%%' END || ' for ' || job_name AS command FROM t""")
def expanded_globs(spark: SparkSession, d: str) -> DataFrame:
    """Texts of globs and parts of templates put into commands; unknown ones stay."""
    text = F.concat(F.lit("run %%GLOB:g_"), (F.col("k") % 5).cast("string"), F.lit("%% for {JOB}"))
    first, _ = X.expanded(text, {f"g_{i}": F.lit(f"text{i}") for i in range(3)}, X.GLOB, fold=False)
    both, _ = X.expanded(first, {"JOB": F.col("job_name")}, X.TEMPLATE, fold=False)
    return estate(spark, d).select("job_name", both.alias("command"))


@query("resource_limits", f"""WITH {JX}, t AS (SELECT job_name, 'N="' || (k % 100) || ', 256", t = "60"' || CASE WHEN k % 3 = 0 THEN ', c=""' ELSE '' END AS spec FROM jx)
SELECT job_name, 'n' AS code, (CAST(right(job_name, 7) AS INT) % 100) || ',256' AS value FROM t UNION ALL SELECT job_name, 't', '60,60' FROM t""")
def resource_limits(spark: SparkSession, d: str) -> DataFrame:
    """Soft and hard limits by code."""
    k = F.col("k")
    spec = F.concat(F.lit('N="'), (k % 100).cast("string"), F.lit(', 256", t = "60"'), F.when(k % 3 == 0, ', c=""').otherwise(""))
    return estate(spark, d).select("job_name", F.explode(X.limits(spec)).alias("code", "value"))


_MINUTE = "CAST(left(start_times, 2) AS INT) * 60"


@query("deadlines", f"""WITH {JX} SELECT job_name, must_start_times = '12:30' AS start_passed, must_complete_times IS NOT NULL AND start_times IS NOT NULL AND {_MINUTE} <= 765 AND 765 >= {_MINUTE} + 30 AS complete_passed FROM jx WHERE must_start_times IS NOT NULL OR must_complete_times IS NOT NULL""".replace("must_start_times = '12:30'", "coalesce(must_start_times = '12:30', FALSE)"))
def deadlines(spark: SparkSession, d: str) -> DataFrame:
    """Which deadlines have passed at a quarter to one: times of the day, or minutes after the preceding start."""
    at, starts = F.lit("2025-10-15 12:45:00").cast("timestamp"), F.split("start_times", ",")
    rows = estate(spark, d).where("must_start_times is not null or must_complete_times is not null")
    return rows.select("job_name", schedules.deadline_passed(F.col("must_start_times"), starts, at).alias("start_passed"), schedules.deadline_passed(F.col("must_complete_times"), starts, at).alias("complete_passed"))


_AT = ("2025-10-31 05:00:00", "2025-10-31 05:10:00")


@query("triggered", f"""WITH {JX}, {DATES}, t(moment) AS (VALUES {", ".join(f"(TIMESTAMP '{x}')" for x in _AT)}) SELECT jx.job_name, epoch_us(t.moment) AS at_us FROM jx, t WHERE jx.status IN (4, 5, 6, 8) AND (jx.date_conditions OR jx.start_mins IS NOT NULL)
AND (run_calendar IS NULL OR EXISTS (SELECT 1 FROM cal WHERE calendar_name = run_calendar AND day = CAST(t.moment AS DATE))) AND (exclude_calendar IS NULL OR NOT EXISTS (SELECT 1 FROM cal WHERE calendar_name = exclude_calendar AND day = CAST(t.moment AS DATE)))
AND (days_of_week IS NULL OR contains(days_of_week, 'fr')) AND (start_times = strftime(t.moment, '%H:%M') OR list_contains(string_split(start_mins, ','), CAST(minute(t.moment) AS VARCHAR)))""")
def triggered(spark: SparkSession, d: str) -> DataFrame:
    """Jobs that their schedule starts at two instants: startable, calendars, days, times of the day or minutes of the hour."""
    when = spark.createDataFrame([(x,) for x in _AT], "at string").select(F.col("at").cast("timestamp").alias("at"))  # two rows
    rows = estate(spark, d).where("status in (4, 5, 6, 8) and (date_conditions or start_mins is not null)").crossJoin(F.broadcast(when)).withColumn("day", F.to_date("at"))
    has = calendars(spark, d)
    inside = has.select(F.col("calendar_name").alias("run_calendar"), "day", F.lit(True).alias("_in"))
    outside = has.select(F.col("calendar_name").alias("exclude_calendar"), "day", F.lit(True).alias("_out"))
    rows = rows.join(inside, ["run_calendar", "day"], "left").join(outside, ["exclude_calendar", "day"], "left")
    time = schedules.starts_at(F.split("start_times", ","), F.col("at")) | schedules.starts_at_minute(F.split("start_mins", ","), F.col("at"))
    out = rows.where((F.col("run_calendar").isNull() | F.col("_in")) & F.col("_out").isNull() & schedules.on_day(F.split("days_of_week", ","), F.col("at")) & time)
    return out.select("job_name", F.unix_micros("at").alias("at_us"))


@query("stuck_jobs", f"WITH {JX} SELECT job_name FROM jx WHERE job_type <> 'BOX' AND status = 3")
def stuck_jobs(spark: SparkSession, d: str) -> DataFrame:
    return estate(spark, d).where("job_type != 'BOX' and status = 3").select("job_name")


@query("simulation_parameters", f"WITH {JX} SELECT job_name, CAST(round((CASE WHEN k % 5 >= 3 THEN 0.25 WHEN k % 5 >= 1 THEN 0.10 ELSE 0.03 END + CASE WHEN max_exit_success IS NOT NULL THEN 0.05 ELSE 0 END + CASE WHEN k % 6 = 0 THEN 0.05 ELSE 0 END) * 100) AS BIGINT) AS chance_e2, CASE WHEN k % 4 = 0 THEN (k % 9 + 1) * 60 WHEN max_run_alarm > 0 THEN max_run_alarm * 30 ELSE 60 END AS secs FROM jx")
def simulation_parameters(spark: SparkSession, d: str) -> DataFrame:
    """Chance of failure and length of each job's simulated runs."""
    k = F.col("k")
    chance = X.failure_chance(k % 5, F.col("max_exit_success"), F.when(k % 6 == 0, "3"))
    return estate(spark, d).select("job_name", F.round(chance * 100).cast("long").alias("chance_e2"), X.estimated_seconds(F.when(k % 4 == 0, k % 9 + 1), F.col("max_run_alarm")).alias("secs"))


@query("file_hashes", "SELECT stanza_id, sha256(raw_text) AS hash FROM ujo_jil_stanza")
def file_hashes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "ujo_jil_stanza").select("stanza_id", F.sha2("raw_text", 256).alias("hash"))


@query("decoded_props", """WITH p AS (SELECT event_id, CASE WHEN event_id % 50 = 0 THEN left(props, length(props) - 1) ELSE props END AS props FROM events) SELECT event_id, CASE WHEN json_valid(props) THEN CAST(json_extract(props, '$.k') AS INT) END AS k, NOT json_valid(props) AS corrupt FROM p""")
def decoded_props(spark: SparkSession, d: str) -> DataFrame:
    """Members of JSON texts; what can't be read is NULL and marked."""
    n = F.col("event_id")
    text = F.when(n % 50 == 0, F.expr("left(props, length(props) - 1)")).otherwise(F.col("props"))
    read = F.from_json(text, "k int, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    return table(spark, d, "events").select("event_id", read.alias("r")).select("event_id", F.when(F.col("r._bad").isNull(), F.col("r.k")).alias("k"), F.col("r._bad").isNotNull().alias("corrupt"))


@query("routed_operations", "SELECT split_part(directive, '_', 1) AS verb, 'ujo_' || substr(directive, position('_' IN directive) + 1) AS target, count(*) AS n FROM ujo_jil_stanza WHERE directive IS NOT NULL GROUP BY ALL")
def routed_operations(spark: SparkSession, d: str) -> DataFrame:
    """Which table each sub-command changes, and how; any of them is told by its name alone."""
    c = F.col("directive")
    target = F.concat(F.lit("ujo_"), F.regexp_replace(c, "^[a-z]+_", ""))
    return table(spark, d, "ujo_jil_stanza").where(c.isNotNull()).groupBy(F.split_part(c, F.lit("_"), F.lit(1)).alias("verb"), target.alias("target")).agg(F.count("*").alias("n"))


@query("evidence_labels", f"""WITH {JOBS}, {RUNS}, {_STATS}, sm AS (SELECT DISTINCT job_name FROM r WHERE source = 'simulated') SELECT CASE WHEN st.job_name IS NOT NULL THEN CASE WHEN (total_runs >= 2 AND failures = total_runs) OR (total_runs >= 10 AND (first_run IS NULL OR epoch_us(last_run) - epoch_us(first_run) >= 604800000000)) THEN 'observed' ELSE 'observed_insufficient' END
WHEN sm.job_name IS NOT NULL THEN 'simulated' ELSE 'none' END AS evidence, count(*) AS n_jobs FROM j LEFT JOIN st ON st.job_name = j.job_name LEFT JOIN sm ON sm.job_name = j.job_name WHERE coalesce(j.job_type, 'CMD') <> 'BOX' GROUP BY 1""")
def evidence_labels(spark: SparkSession, d: str) -> DataFrame:
    """Jobs by the evidence there is of them: observed runs, too few of them, simulated ones, none."""
    simulated = table(spark, d, "job_runs").where("source = 'simulated'").select("job_name").distinct().withColumn("simulated", F.lit(True))
    rows = jobs(spark, d).where(F.coalesce("job_type", F.lit("CMD")) != "BOX").select("job_name").join(run_stats(spark, d), "job_name", "left").join(simulated, "job_name", "left")
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    n = F.col("total_runs")
    enough = ((n >= 2) & (F.col("failures") == n)) | ((n >= 10) & (F.col("first_run").isNull() | (us("last_run") - us("first_run") >= 604_800_000_000)))
    label = F.when(n.isNotNull(), F.when(enough, "observed").otherwise("observed_insufficient")).when(F.col("simulated"), "simulated").otherwise("none")
    return rows.groupBy(label.alias("evidence")).agg(F.count("*").alias("n_jobs"))


@query("metrics_page", f"""WITH {JOBS}, {RUNS}, {ALARMS} SELECT 'estate_jobs{{status="' || status || '"}} ' || count(*) AS value FROM j GROUP BY status UNION ALL SELECT 'estate_runs{{source="' || source || '"}} ' || count(*) FROM r GROUP BY source
UNION ALL SELECT 'estate_alarms{{alarm_type="' || alarm_type || '",open="' || CAST(cleared_at IS NULL AS VARCHAR) || '"}} ' || count(*) FROM al GROUP BY alarm_type, cleared_at IS NULL""")
def metrics_page(spark: SparkSession, d: str) -> DataFrame:
    """All gauges of the metrics page."""
    of = lambda df, name, *labels: files.prometheus(df.groupBy(*labels).agg(F.count("*").alias("n")), name, "n", list(labels))
    out = of(jobs(spark, d), "estate_jobs", "status").unionByName(of(runs(spark, d), "estate_runs", "source"))
    return out.unionByName(of(alarms(spark, d).withColumn("open", F.col("cleared_at").isNull()), "estate_alarms", "alarm_type", "open"))


@query("definition_export", f"""WITH {JX} SELECT job_name, concat_ws(chr(10), 'insert_job: ' || job_name || '   job_type: ' || job_type, 'box_name: ' || box_name, 'command: ' || command, 'machine: ' || machine, 'condition: ' || condition,
CASE WHEN date_conditions THEN 'date_conditions: 1' END, 'days_of_week: ' || days_of_week, 'start_times: "' || start_times || '"', 'run_window: "' || run_window || '"', 'max_run_alarm: ' || max_run_alarm, CASE WHEN alarm_if_fail THEN 'alarm_if_fail: 1' END, 'timezone: ' || nullif(timezone, '')) AS jil FROM jx""")
def definition_export(spark: SparkSession, d: str) -> DataFrame:
    """Definition text of jobs: attributes in fixed order, defaults left out, values with colons of times quoted."""
    plain = lambda c: F.when(F.col(c).cast("string") != "", F.concat(F.lit(f"{c}: "), F.col(c).cast("string")))
    quoted = lambda c: F.when(F.col(c) != "", F.concat(F.lit(f'{c}: "'), F.col(c), F.lit('"')))
    flag = lambda c: F.when(F.col(c), f"{c}: 1")
    head = F.concat(F.lit("insert_job: "), "job_name", F.lit("   job_type: "), "job_type")
    lines = [head, plain("box_name"), plain("command"), plain("machine"), plain("condition"), flag("date_conditions"), plain("days_of_week"), quoted("start_times"), quoted("run_window"), plain("max_run_alarm"), flag("alarm_if_fail"), plain("timezone")]
    return estate(spark, d).select("job_name", F.concat_ws("\n", *lines).alias("jil"))


_DRAW = "((k * 1103515245 + n * 12345 + {seed}) % 2147483648)"


@query("synthetic_runs", f"WITH {JX}, g AS (SELECT job_name, k::BIGINT AS k, unnest(range(5)) AS n FROM jx) SELECT job_name, n, {_DRAW.format(seed=42)} % 1440 + n * 1440 AS start_minute, CASE WHEN {_DRAW.format(seed=7)} % 100 < 10 THEN 5 ELSE 4 END AS status FROM g")
def synthetic_runs(spark: SparkSession, d: str) -> DataFrame:
    """Made-up history from a seed: draws depend on job and number only, so neither order nor partitioning matters."""
    rows = estate(spark, d).select("job_name", F.col("k").cast("long").alias("k"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(4).cast("long"))).alias("n"))
    return rows.select("job_name", "n", F.expr(f"{_DRAW.format(seed=42)} % 1440 + n * 1440").alias("start_minute"), F.expr(f"case when {_DRAW.format(seed=7)} % 100 < 10 then 5 else 4 end").alias("status"))


@query("refused_columns", """WITH h AS (SELECT import_id, regexp_replace(lower(trim(unnest(string_split(replace(header_line, chr(9), ','), ',')))), '[\\s-]+', '_', 'g') AS c FROM history_imports WHERE header_line IS NOT NULL AND file_format IN ('csv', 'tsv'))
SELECT DISTINCT import_id, CASE WHEN c IN ('note', 'remark') THEN 'output' ELSE c END AS column_name FROM h WHERE c IN ('note', 'remark', 'command', 'cmd', 'std_out_file', 'std_err_file', 'stdout_path', 'stderr_path', 'output', 'stdout', 'stderr', 'message', 'envvars', 'env', 'auth_string', 'password', 'secret', 'token', 'credential')""")
def refused_columns(spark: SparkSession, d: str) -> DataFrame:
    """Columns of exports that are dropped with an issue each, as they may hold secrets or output (remarks stand for output here)."""
    from runweave.operators import rejects

    rows = table(spark, d, "history_imports").where("file_format in ('csv', 'tsv')").withColumn("header_line", F.regexp_replace("header_line", "(?i)\\b(note|remark)\\b", "output"))
    return rejects.refused(rows)
