"""The assessment of an estate: sizes with their drivers, gaps, signals, risk through boxes, and the report in the order of the box tree.

Run on a derived estate in which every signal occurs; its columns are given as
SQL that both engines read, the rules are written apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runweave.conditions import columns
from runweave.functions import strings as X
from runweave.operators import graphs, hierarchy
from runweave.operators.numbering import numbered
from runweave.plans.estate import CONDITIONS, conditions
from runweave.plans.registry import query
from runweave.session import cut

_NAME = "'job_' || lpad(CAST({0} AS STRING), 7, '0')"
_PREVIOUS, _EARLIER, _FIFTH = _NAME.format("k - 1"), _NAME.format("k - 100"), _NAME.format("k - 5")
#: Columns of the derived estate over those of CONDITIONS.
_COLUMNS = {
    "k": "k", "job_name": "job_name", "job_type": "job_type", "box_name": "box_name",
    "condition": f"""CASE WHEN k % 100 = 0 THEN CASE WHEN k >= 200 AND k % 1000 <> 100 THEN 's(' || {_EARLIER} || ')' END
      WHEN k % 97 = 5 THEN 's(' || {_PREVIOUS} || ') & & e(' || {_PREVIOUS} || ') = 0'
      WHEN k % 45 = 14 THEN condition || ' & n(' || {_PREVIOUS} || ')' WHEN k % 30 = 12 THEN condition || ' & d(' || {_FIFTH} || ')' ELSE condition END""",
    "command": """CASE WHEN k % 22 = 5 THEN 'run.sh %%REGION%% %%DESK%% %%REGION%% %%ODATE%%' WHEN k % 27 = 6 THEN '/opt/a.sh /opt/b.sh /opt/c.sh /opt/d.sh'
      WHEN k % 28 = 8 THEN 'perl load.pl %%DESK%% %%TIMESTAMP%%' ELSE command END""",
    "resources": "CASE WHEN k % 23 = 11 THEN '(lic, QUANTITY=1)' WHEN k % 23 = 12 THEN '' END",
    "box_success": f"CASE WHEN k % 70 = 0 THEN 's(' || {_NAME.format('k + 1')} || ')' END",
    "box_failure": f"CASE WHEN k % 90 = 0 THEN 'f(' || {_NAME.format('k + 2')} || ')' END",
    "max_exit_success": "CASE WHEN k % 31 = 4 THEN k % 3 END",
    "run_calendar": "CASE WHEN k % 19 = 2 THEN 'bank_days' END", "exclude_calendar": "CASE WHEN k % 29 = 3 THEN 'close_days' END",
    "date_conditions": "k % 9 = 5", "start_times": "CASE WHEN k % 9 = 5 THEN lpad(CAST(k % 24 AS STRING), 2, '0') || ':00' END",
    "start_mins": "CASE WHEN k % 37 = 8 THEN '10,40' END", "run_window": "CASE WHEN k % 41 = 6 THEN '22:00-04:00' END",
    "must_start_times": "CASE WHEN k % 43 = 9 THEN '12:30' END", "must_complete_times": "CASE WHEN k % 47 = 9 THEN '+30' END",
    "timezone": "CASE WHEN k % 53 = 7 THEN 'Europe/Berlin' WHEN k % 53 = 8 THEN '' END",
    "days_of_week": "CASE WHEN k % 15 = 7 THEN 'mo,tu' END", "alarm_if_fail": "k % 4 = 1",
    "max_run_alarm": "CASE WHEN k % 16 = 3 THEN 60 END", "min_run_alarm": "CASE WHEN k % 18 = 4 THEN 5 END",
    "box_terminator": "k % 33 = 9", "job_terminator": "k % 21 = 9",
    "watch_file": "CASE WHEN k % 20 = 7 THEN '/in/' || CAST(k AS STRING) END", "ftp_type": "CASE WHEN k % 100 = 3 THEN 'PUT' END",
    "machine": "CASE WHEN k % 8 <> 0 THEN 'host' || CAST(k % 61 % 13 AS STRING) END",
    "permission": "CASE k % 10 WHEN 1 THEN 'gx, wx' WHEN 2 THEN 'gx,wx,mx,ge,we,me' WHEN 3 THEN '' END",
    "std_out_file": "CASE k % 6 WHEN 2 THEN '/var/log/x.out' WHEN 3 THEN 'logs/x.out' END", "std_err_file": "CASE k % 7 WHEN 2 THEN '/var/log/x.err' WHEN 3 THEN 'x.err' END",
    "send_notification": "k % 12 = 5", "notification_address": "CASE WHEN k % 8 = 3 THEN 'ops@x.org' END",
    "risk": "CASE WHEN job_type = 'BOX' THEN 'NO_DATA' ELSE CASE k % 13 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'MEDIUM' WHEN 2 THEN 'LOW' WHEN 3 THEN 'NO_DATA' ELSE 'NONE' END END",
    "status": "CASE k % 11 WHEN 0 THEN 8 WHEN 1 THEN 9 WHEN 2 THEN 3 WHEN 3 THEN 1 WHEN 4 THEN 4 WHEN 5 THEN 4 WHEN 6 THEN 5 WHEN 7 THEN 6 WHEN 8 THEN 7 WHEN 9 THEN CASE WHEN k % 2 = 0 THEN 5 ELSE 11 END ELSE 8 END",
}
JX = CONDITIONS + ", jx AS (SELECT " + ", ".join(f"{e} AS {n}" for n, e in _COLUMNS.items()) + " FROM jc)"
_REFS = """e AS (SELECT DISTINCT job_name AS job, dep FROM (SELECT job_name, unnest(regexp_extract_all(condition, '[a-z]\\((job_[0-9]+)[,) ]', 1)) AS dep FROM jx))"""
# every job in the scope of its box (or among the jobs without one), and every box in its own
_SCOPES = """sc AS (SELECT job_name, coalesce(box_name, '<root>') AS scope FROM jx UNION ALL SELECT job_name, job_name FROM jx WHERE job_type = 'BOX'),
se AS (SELECT a.scope, e.job, e.dep FROM e JOIN sc a ON a.job_name = e.job JOIN sc b ON b.job_name = e.dep AND b.scope = a.scope WHERE e.job <> e.dep),
w AS (SELECT scope, job_name, 1 AS n FROM sc UNION SELECT se.scope, se.job, w.n + 1 FROM w JOIN se ON se.scope = w.scope AND se.dep = w.job_name),
wv AS (SELECT jx.job_name, max(w.n) AS wave FROM jx JOIN w ON w.job_name = jx.job_name AND w.scope = coalesce(jx.box_name, '<root>') GROUP BY 1),
inner_ AS (SELECT se.dep AS job_name FROM se JOIN wv ON wv.job_name = se.job WHERE se.scope = '<root>' AND wv.wave >= 7 UNION SELECT se.dep FROM inner_ JOIN se ON se.scope = '<root>' AND se.job = inner_.job_name)"""
_ESTATE = f"WITH RECURSIVE {JX}, {_REFS}, {_SCOPES}"
DEEP, LONG = 7, 4
_HOURS = {"XL": 60, "L": 24, "M": 8, "S": 4, "XS": 2}
_HOURS_SQL = "CASE size WHEN 'XL' THEN 60 WHEN 'L' THEN 24 WHEN 'M' THEN 8 WHEN 'S' THEN 4 ELSE 2 END"
_RISKS = ("HIGH", "MEDIUM", "LOW", "NONE", "NO_DATA")


def estate(spark: SparkSession, d: str) -> DataFrame:
    return conditions(spark, d).selectExpr(*[f"{e} AS {n}" for n, e in _COLUMNS.items()])


def _edges(rows: DataFrame) -> DataFrame:
    return columns.edges(rows, "job_name", "condition")


def _waves(rows: DataFrame) -> DataFrame:
    """(scope, job, wave) of every job in its box's scope, or among the jobs without box, and of boxes in their own."""
    scopes = rows.select(F.coalesce("box_name", F.lit("<root>")).alias("scope"), F.col("job_name").alias("job"))
    own = rows.where("job_type = 'BOX'").select(F.col("job_name").alias("scope"), F.col("job_name").alias("job"))
    return graphs.waves(scopes.unionByName(own), _edges(rows))


def _interior(rows: DataFrame, waves: DataFrame) -> DataFrame:
    """(job_name): jobs without box that a deep chain of such jobs leads through."""
    roots = rows.where("box_name is null").select(F.col("job_name").alias("job"))
    inner = _edges(rows).join(roots, "job", "left_semi").join(roots.withColumnRenamed("job", "dep"), "dep", "left_semi")
    deep = waves.where((F.col("scope") == "<root>") & (F.col("wave") >= DEEP)).select("job")
    return graphs.closure(deep, inner).withColumnRenamed("job", "job_name")


def _drivers(tests: list[tuple[Column, Column | str]]) -> Column:
    return F.array_compact(F.array(*[F.when(t, F.lit(v) if isinstance(v, str) else v) for t, v in tests]))


def _says(c: str) -> Column:
    return F.coalesce(F.col(c) != "", F.lit(False))


def _and(name: str) -> Column:
    return F.concat(F.lit(f"{name}="), F.col(name).cast("string"))


def sized(spark: SparkSession, d: str) -> DataFrame:
    """The estate with wave, interior, children, size and drivers: those of the first tier that has any."""
    rows = estate(spark, d)
    waves = cut(_waves(rows))
    inner = _interior(rows, waves).withColumn("interior", F.lit(True))
    own = waves.select(F.col("scope").alias("_s"), F.col("job").alias("job_name"), "wave")
    children = rows.where("box_name is not null").groupBy(F.col("box_name").alias("job_name")).agg(F.count("*").alias("children"))
    rows = rows.withColumn("_s", F.coalesce("box_name", F.lit("<root>"))).join(own, ["_s", "job_name"], "left").drop("_s").join(inner, "job_name", "left").join(children, "job_name", "left")
    rows = rows.withColumns({"interior": F.coalesce("interior", F.lit(False)), "children": F.coalesce("children", F.lit(0)), "wave": F.coalesce("wave", F.lit(1))})
    c, box = F.col("condition"), F.col("job_type") == "BOX"
    ops, names = F.coalesce(X.operator_count(c), F.lit(0)), X.business_globals(F.col("command"))
    wave, deep = F.col("wave").cast("string"), (F.col("wave") >= DEEP) & ~F.col("interior")
    chain = F.concat(F.lit("dependency chain depth="), wave)
    tiers = {
        "XL": [
            (deep, F.concat(chain, F.lit(" (chain terminal)"))), (F.col("job_type") == "FTP", F.concat(F.lit("FTP job ("), F.coalesce("ftp_type", F.lit("unknown")), F.lit(")"))),
            (c.contains("^"), "cross-instance dependency (^)"), (box & (F.col("children") > 15), F.concat(F.lit("BOX with "), F.col("children").cast("string"), F.lit(" children (>15)"))),
        ],
        "L": [
            (~deep & (F.col("wave") >= LONG), F.concat(chain, F.when(F.col("interior"), " (inside a longer chain)").otherwise(""))), (X.has_look_back(c), "look_back condition"),
            (ops >= 3, F.concat(F.lit("complex condition ("), ops.cast("string"), F.lit(" operators)"))),
            (F.size(names) >= 3, F.concat(F.size(names).cast("string"), F.lit(" business globals: "), F.array_join(F.slice(names, 1, 3), ", "), F.lit("..."))),
            (_says("resources"), F.concat(F.lit("virtual resource: "), F.col("resources"))), (_says("box_success") | _says("box_failure"), "custom box_success/box_failure"),
            (F.col("max_exit_success").isNotNull(), _and("max_exit_success")),
        ],
        "M": [
            (_says("run_calendar"), _and("run_calendar")), (_says("exclude_calendar"), _and("exclude_calendar")), (F.col("date_conditions"), "date_conditions=1"),
            (F.col("job_type") == "FILEWATCH", F.concat(F.lit("FILEWATCH ("), F.coalesce(F.nullif("watch_file", F.lit("")), F.lit("?")), F.lit(")"))), (_says("start_times"), _and("start_times")),
            (_says("start_mins"), "start_mins set"), (_says("run_window"), _and("run_window")), (_says("must_start_times"), "must_start_times"), (_says("must_complete_times"), "must_complete_times"),
            (_says("timezone"), _and("timezone")), (ops.between(1, 2), F.concat(F.lit("compound condition ("), ops.cast("string"), F.lit(" operators)"))),
            (F.size(names).between(1, 2), F.concat(F.lit("business globals: "), F.array_join(names, ", "))),
        ],
    }
    rows = rows.withColumns({f"_{t}": _drivers(tests) for t, tests in tiers.items()})
    brief = F.concat(F.lit("condition: "), F.substring(c, 1, 70))
    small = _drivers([(box, F.concat(F.lit("BOX ("), F.col("children").cast("string"), F.lit(" children)"))), (_says("condition") & (F.size("_L") == 0) & (F.size("_M") == 0), brief),
                      (_says("days_of_week"), _and("days_of_week")), (F.col("alarm_if_fail"), "alarm_if_fail")])
    rows = rows.withColumn("_S", small)
    size, why = F.lit("XS"), F.array(F.lit("no dependencies or schedule complexity"))
    for t in ("S", "M", "L", "XL"):
        size, why = F.when(F.size(f"_{t}") > 0, t).otherwise(size), F.when(F.size(f"_{t}") > 0, F.col(f"_{t}")).otherwise(why)
    return rows.select("*", size.alias("size"), F.array_join(why, "; ").alias("drivers")).drop("_XL", "_L", "_M", "_S")


_SOME = lambda *pairs: "list_filter([" + ", ".join(f"CASE WHEN {t} THEN {v} END" for t, v in pairs) + "], lambda x: x IS NOT NULL)"
_SIZED = f"""{_ESTATE}, g AS (SELECT *, coalesce(len(regexp_replace(condition, '[^&|]', '', 'g')), 0) AS ops,
    coalesce([v FOR v IN regexp_extract_all(command, '%%([A-Z_][A-Z_0-9]*)%%', 1) IF v NOT IN ('DATE','YEAR','MM','DD','TIME','HH','MIN','ODATE','OYEAR','OMM','ODD','OTIME','TIMESTAMP','UNIX_TIMESTAMP')], []) AS vars
  FROM jx JOIN wv USING (job_name) LEFT JOIN (SELECT box_name AS b, count(*) AS n FROM jx WHERE box_name IS NOT NULL GROUP BY 1) ch ON ch.b = jx.job_name),
t AS (SELECT g.*, job_name IN (SELECT job_name FROM inner_) AS interior, coalesce(n, 0) AS children FROM g),
d AS (SELECT *, {_SOME(("wave >= 7 AND NOT interior", "'dependency chain depth=' || wave || ' (chain terminal)'"), ("job_type = 'FTP'", "'FTP job (' || coalesce(ftp_type, 'unknown') || ')'"),
    ("contains(condition, '^')", "'cross-instance dependency (^)'"), ("job_type = 'BOX' AND children > 15", "'BOX with ' || children || ' children (>15)'"))} AS xl,
  {_SOME(("wave >= 4 AND (wave < 7 OR interior)", "'dependency chain depth=' || wave || CASE WHEN interior THEN ' (inside a longer chain)' ELSE '' END"),
    ("regexp_matches(condition, '\\(\\s*\\w[\\w_]+\\s*,\\s*[0-9]+')", "'look_back condition'"), ("ops >= 3", "'complex condition (' || ops || ' operators)'"),
    ("len(vars) >= 3", "len(vars) || ' business globals: ' || array_to_string(vars[1:3], ', ') || '...'"), ("resources <> ''", "'virtual resource: ' || resources"),
    ("box_success <> '' OR box_failure <> ''", "'custom box_success/box_failure'"), ("max_exit_success IS NOT NULL", "'max_exit_success=' || max_exit_success"))} AS l,
  {_SOME(("run_calendar <> ''", "'run_calendar=' || run_calendar"), ("exclude_calendar <> ''", "'exclude_calendar=' || exclude_calendar"), ("date_conditions", "'date_conditions=1'"),
    ("job_type = 'FILEWATCH'", "'FILEWATCH (' || coalesce(nullif(watch_file, ''), '?') || ')'"), ("start_times <> ''", "'start_times=' || start_times"), ("start_mins <> ''", "'start_mins set'"),
    ("run_window <> ''", "'run_window=' || run_window"), ("must_start_times <> ''", "'must_start_times'"), ("must_complete_times <> ''", "'must_complete_times'"), ("timezone <> ''", "'timezone=' || timezone"),
    ("ops BETWEEN 1 AND 2", "'compound condition (' || ops || ' operators)'"), ("len(vars) BETWEEN 1 AND 2", "'business globals: ' || array_to_string(vars, ', ')"))} AS m FROM t),
y AS (SELECT *, {_SOME(("job_type = 'BOX'", "'BOX (' || children || ' children)'"), ("condition <> '' AND len(l) = 0 AND len(m) = 0", "'condition: ' || left(condition, 70)"),
    ("days_of_week <> ''", "'days_of_week=' || days_of_week"), ("alarm_if_fail", "'alarm_if_fail'"))} AS s FROM d),
z AS (SELECT *, CASE WHEN len(xl) > 0 THEN 'XL' WHEN len(l) > 0 THEN 'L' WHEN len(m) > 0 THEN 'M' WHEN len(s) > 0 THEN 'S' ELSE 'XS' END AS size,
  array_to_string(CASE WHEN len(xl) > 0 THEN xl WHEN len(l) > 0 THEN l WHEN len(m) > 0 THEN m WHEN len(s) > 0 THEN s ELSE ['no dependencies or schedule complexity'] END, '; ') AS drivers FROM y)"""


def _hours() -> Column:
    out = F.lit(None)
    for s, h in _HOURS.items():
        out = F.when(F.col("size") == s, h).otherwise(out)
    return out


@query("job_size", f"{_SIZED} SELECT job_name, size FROM z")
def job_size(spark: SparkSession, d: str) -> DataFrame:
    """Size of each job by the first tier of signals that has any."""
    return sized(spark, d).select("job_name", "size")


@query("job_drivers", f"{_SIZED} SELECT job_name, size, drivers, wave, interior FROM z")
def job_drivers(spark: SparkSession, d: str) -> DataFrame:
    """Why each job has its size, with the depth of its chain and whether a longer one leads through it."""
    return sized(spark, d).select("job_name", "size", "drivers", "wave", "interior")


@query("wave_levels", f"{_ESTATE} SELECT job_name, wave - 1 AS level FROM wv")
def wave_levels(spark: SparkSession, d: str) -> DataFrame:
    """Topological level of each job within its box: 0 without dependencies."""
    rows = estate(spark, d)
    own = rows.select(F.coalesce("box_name", F.lit("<root>")).alias("scope"), F.col("job_name").alias("job"))
    return _waves(rows).join(own, ["scope", "job"]).select(F.col("job").alias("job_name"), (F.col("wave") - 1).alias("level"))


@query("wave_count", f"{_ESTATE} SELECT coalesce(jx.box_name, '<root>') AS scope, max(wave) AS waves, count(*) AS n_jobs FROM wv JOIN jx USING (job_name) WHERE jx.status = 9 GROUP BY 1")
def wave_count(spark: SparkSession, d: str) -> DataFrame:
    """Waves that the activated jobs of each box take."""
    rows = estate(spark, d)
    active = rows.where("status = 9").select(F.coalesce("box_name", F.lit("<root>")).alias("scope"), F.col("job_name").alias("job"))
    return _waves(rows).join(active, ["scope", "job"]).groupBy("scope").agg(F.max("wave").alias("waves"), F.count("*").alias("n_jobs"))


@query("size_counts", f"{_SIZED} SELECT s.size, count(z.job_name) AS n_jobs FROM (VALUES ('XL'), ('L'), ('M'), ('S'), ('XS')) s(size) LEFT JOIN z ON z.size = s.size GROUP BY 1")
def size_counts(spark: SparkSession, d: str) -> DataFrame:
    all_ = spark.range(1).select(F.explode(F.array(*[F.lit(s) for s in _HOURS])).alias("size"))
    return all_.join(sized(spark, d).groupBy("size").agg(F.count("*").alias("n")), "size", "left").select("size", F.coalesce("n", F.lit(0)).alias("n_jobs"))


@query("effort_overhead", f"""{_SIZED}, r AS (SELECT CAST(sum({_HOURS_SQL}) AS BIGINT) AS raw FROM z), o AS (SELECT raw, CAST(floor(raw * 0.2::DOUBLE) AS BIGINT) AS platform, CAST(floor(raw * 0.3::DOUBLE) AS BIGINT) AS testing,
CAST(floor(raw * 0.15::DOUBLE) AS BIGINT) AS pm, CAST(floor(raw * 0.1::DOUBLE) AS BIGINT) AS training FROM r) SELECT *, raw + platform + testing + pm + training AS total FROM o""")
def effort_overhead(spark: SparkSession, d: str) -> DataFrame:
    t = sized(spark, d).agg(F.sum(_hours()).alias("raw"))
    t = t.select("raw", *[F.expr(f"cast(raw * {x}D as bigint)").alias(n) for n, x in (("platform", 0.2), ("testing", 0.3), ("pm", 0.15), ("training", 0.1))])
    return t.withColumn("total", F.expr("raw + platform + testing + pm + training"))


@query("box_effort_breakdown", f"""{_SIZED} SELECT coalesce(box_name, '(top-level)') AS box, count(*) AS job_count, CAST(sum({_HOURS_SQL}) AS BIGINT) AS effort_h, {", ".join(f"count(*) FILTER (size = '{s}') AS size_{s.lower()}" for s in _HOURS)},
{", ".join(f"count(*) FILTER (risk = '{r}') AS risk_{r.lower()}" for r in _RISKS)} FROM z GROUP BY 1""")
def box_effort_breakdown(spark: SparkSession, d: str) -> DataFrame:
    """Effort of each box by size and risk."""
    rows = sized(spark, d).groupBy(F.coalesce("box_name", F.lit("(top-level)")).alias("box"))
    out = [F.count("*").alias("job_count"), F.sum(_hours()).cast("long").alias("effort_h"), *[F.count_if(F.col("size") == s).alias(f"size_{s.lower()}") for s in _HOURS]]
    out += [F.count_if(F.col("risk") == r).alias(f"risk_{r.lower()}") for r in _RISKS]
    return rows.agg(*out)


@query("high_risk_jobs", f"WITH {JX} SELECT coalesce(box_name, '(top-level)') AS box, job_name FROM jx WHERE risk = 'HIGH'")
def high_risk_jobs(spark: SparkSession, d: str) -> DataFrame:
    """Jobs at high risk with their box; a row each, as a box may hold very many."""
    return estate(spark, d).where("risk = 'HIGH'").select(F.coalesce("box_name", F.lit("(top-level)")).alias("box"), "job_name")


# Gaps in the order in which they are named, with their severity.
GAPS = {
    "cross-instance-event": "RED", "ftp-db-jobtype": "RED", "complex-calendar": "YELLOW", "sla-management": "YELLOW", "file-watcher": "GREEN", "global-variables": "GREEN", "look-back-condition": "YELLOW",
    "exit-code-condition": "YELLOW", "global-value-condition": "YELLOW", "notrunning-condition": "YELLOW", "box-success-failure": "YELLOW", "terminator": "YELLOW",
}


def tagged(rows: DataFrame) -> DataFrame:
    """rows with tags: the gaps of each job in order, from the parsed condition, or from its text where it doesn't parse."""
    known = columns.parsed(rows, "condition").withColumnRenamed("condition", "_c")
    rows = rows.join(known, rows["condition"] == known["_c"], "left")
    c, broken = F.lower("condition"), F.col("steps").isNull() & F.col("condition").isNotNull()

    def seen(step, text: Column) -> Column:
        return F.coalesce(F.when(broken, text).otherwise(F.exists("steps", step)), F.lit(False))

    calls = lambda short, long_: c.rlike(rf"(?<![\w#.-])({short}|{long_})\s*\(")
    tests = {
        "cross-instance-event": seen(lambda s: s["instance"].isNotNull(), c.contains("^")), "ftp-db-jobtype": F.col("job_type").isin("FTP", "DB", "I5"),
        "complex-calendar": _says("run_calendar") | _says("exclude_calendar"), "sla-management": F.col("max_run_alarm").isNotNull() | F.col("min_run_alarm").isNotNull(),
        "file-watcher": F.col("job_type") == "FILEWATCH", "global-variables": F.size(X.business_globals(F.col("command"))) > 0, "look-back-condition": seen(lambda s: s["hours"] > 0, F.lit(False)),
        "exit-code-condition": seen(lambda s: s["kind"] == "exit", calls("e", "exitcode")), "global-value-condition": seen(lambda s: s["kind"] == "value", calls("v", "value")),
        "notrunning-condition": seen(lambda s: s["test"] == "notrunning", calls("n", "notrunning")),
        "box-success-failure": (F.col("job_type") == "BOX") & (_says("box_success") | _says("box_failure")), "terminator": F.col("box_terminator") | F.col("job_terminator"),
    }
    return rows.withColumn("tags", _drivers([(tests[t], t) for t in GAPS])).drop("_c", "steps", "error")


_TAGS = "tg AS (SELECT *, " + _SOME(
    ("contains(condition, '^')", "'cross-instance-event'"), ("job_type = 'FTP'", "'ftp-db-jobtype'"), ("run_calendar <> '' OR exclude_calendar <> ''", "'complex-calendar'"), ("max_run_alarm IS NOT NULL OR min_run_alarm IS NOT NULL", "'sla-management'"),
    ("job_type = 'FILEWATCH'", "'file-watcher'"), ("regexp_matches(command, '%%(REGION|DESK)%%')", "'global-variables'"), ("contains(condition, ', 24)') AND NOT contains(condition, '& &')", "'look-back-condition'"), ("contains(condition, 'e(job')", "'exit-code-condition'"),
    ("contains(condition, 'v(')", "'global-value-condition'"), ("contains(condition, 'n(job')", "'notrunning-condition'"), ("job_type = 'BOX' AND (box_success <> '' OR box_failure <> '')", "'box-success-failure'"), ("box_terminator OR job_terminator", "'terminator'"),
) + " AS tags FROM {0})"


@query("gap_tags", f"WITH {JX}, {_TAGS.format('jx')} SELECT job_name, array_to_string(tags, ', ') AS gap_tags FROM tg")
def gap_tags(spark: SparkSession, d: str) -> DataFrame:
    """Features of each job that need work in a migration, in fixed order."""
    return tagged(estate(spark, d)).select("job_name", F.array_join("tags", ", ").alias("gap_tags"))


_SEVERITY = "CASE tag " + " ".join(f"WHEN '{t}' THEN '{s}'" for t, s in GAPS.items()) + " END"


@query("gap_severities", f"WITH {JX}, {_TAGS.format('jx')}, x AS (SELECT job_name, unnest(tags) AS tag FROM tg), c AS (SELECT {_SEVERITY} AS severity, count(*) AS n, count(DISTINCT job_name) AS jobs FROM x GROUP BY 1) "
       "SELECT s.severity, coalesce(n, 0) AS n_gaps, coalesce(jobs, 0) AS n_jobs FROM (VALUES ('RED'), ('YELLOW'), ('GREEN')) s(severity) LEFT JOIN c USING (severity)")  # fmt: skip
def gap_severities(spark: SparkSession, d: str) -> DataFrame:
    """Gaps by severity, those without any included."""
    level = F.try_element_at(F.create_map(*[F.lit(x) for kv in GAPS.items() for x in kv]), F.col("tag"))
    counts = tagged(estate(spark, d)).select("job_name", F.explode("tags").alias("tag")).groupBy(level.alias("severity")).agg(F.count("*").alias("n"), F.countDistinct("job_name").alias("jobs"))
    all_ = spark.range(1).select(F.explode(F.array(*[F.lit(s) for s in ("RED", "YELLOW", "GREEN")])).alias("severity"))
    return all_.join(counts, "severity", "left").select("severity", F.coalesce("n", F.lit(0)).alias("n_gaps"), F.coalesce("jobs", F.lit(0)).alias("n_jobs"))


@query("first_of_pattern", f"""{_SIZED}, {_TAGS.format('z')}, p AS (SELECT job_name, concat_ws(' ', job_type, size, array_to_string(list_sort(tags), ','), CASE WHEN wave >= 4 THEN 'deep' ELSE 'flat' END) AS pattern FROM tg)
SELECT job_name, pattern, CASE WHEN row_number() OVER (PARTITION BY pattern ORDER BY job_name) = 1 THEN 'DESIGN' ELSE 'ADAPTATION' END AS role FROM p""")
def first_of_pattern(spark: SparkSession, d: str) -> DataFrame:
    """The first job of each pattern (type, size, gaps, deep chain) in order of names; its minimum is combined map-side instead of ranking the group."""
    rows = cut(tagged(sized(spark, d)))
    pattern = F.concat_ws(" ", "job_type", "size", F.array_join(F.array_sort("tags"), ","), F.when(F.col("wave") >= LONG, "deep").otherwise("flat"))
    rows = rows.select("job_name", pattern.alias("pattern"))
    first = rows.groupBy("pattern").agg(F.min("job_name").alias("first"))
    return rows.join(first, "pattern").select("job_name", "pattern", F.when(F.col("job_name") == F.col("first"), "DESIGN").otherwise("ADAPTATION").alias("role"))


_TREE = """a AS (SELECT job_name AS node, box_name AS up, 1 AS n FROM jx WHERE box_name IS NOT NULL UNION ALL SELECT a.node, jx.box_name, a.n + 1 FROM a JOIN jx ON jx.job_name = a.up WHERE jx.box_name IS NOT NULL)"""
_LEVEL = "CASE risk WHEN 'HIGH' THEN 4 WHEN 'MEDIUM' THEN 3 WHEN 'LOW' THEN 2 WHEN 'NONE' THEN 1 ELSE 0 END"
_ROLLED = f"""{_TREE}, lv AS (SELECT jx.job_name, jx.box_name, jx.job_type, greatest({_LEVEL}, coalesce((SELECT max(CASE b.risk WHEN 'HIGH' THEN 4 WHEN 'MEDIUM' THEN 3 WHEN 'LOW' THEN 2 WHEN 'NONE' THEN 1 ELSE 0 END) FROM a JOIN jx b ON b.job_name = a.node WHERE a.up = jx.job_name), 0)) AS level, {_LEVEL} AS own FROM jx),
rk AS (SELECT lv.job_name, ['NO_DATA', 'NONE', 'LOW', 'MEDIUM', 'HIGH'][lv.level + 1] AS risk, CASE WHEN lv.level > lv.own THEN (SELECT min(c.job_name) FROM lv c WHERE c.box_name = lv.job_name AND c.level = lv.level) END AS inherited_from FROM lv)"""


def rolled_risk(rows: DataFrame) -> DataFrame:
    """(job_name, risk, inherited_from): boxes take the worst risk below them if it is worse than their own, from their first child that has it.

    The worst of all descendants is the worst that children have once they took theirs, so one
    aggregation over ancestors serves all levels.
    """
    level = F.when(F.col("risk") == "HIGH", 4).when(F.col("risk") == "MEDIUM", 3).when(F.col("risk") == "LOW", 2).when(F.col("risk") == "NONE", 1).otherwise(0)
    own = rows.select("job_name", "box_name", level.alias("own"))
    pairs = hierarchy.named_ancestors(rows, F.col("job_name"), F.col("box_name"))
    below = pairs.join(own.select(F.col("job_name").alias("name"), "own"), "name").groupBy(F.col("ancestor_name").alias("job_name")).agg(F.max("own").alias("below"))
    levels = cut(own.join(below, "job_name", "left").select("job_name", "box_name", "own", F.greatest("own", F.coalesce("below", F.lit(0))).alias("level")))
    first = levels.where("box_name is not null").groupBy(F.col("box_name").alias("job_name"), "level").agg(F.min("job_name").alias("inherited_from"))
    label = F.element_at(F.array(*[F.lit(x) for x in reversed(_RISKS)]), F.col("level") + 1)
    return levels.join(first, ["job_name", "level"], "left").select("job_name", label.alias("risk"), F.when(F.col("level") > F.col("own"), F.col("inherited_from")).alias("inherited_from"))


@query("box_worst_risk", f"WITH RECURSIVE {JX}, {_ROLLED} SELECT job_name, risk, inherited_from FROM rk")
def box_worst_risk(spark: SparkSession, d: str) -> DataFrame:
    return rolled_risk(estate(spark, d))


def _by_position(rows: DataFrame) -> DataFrame:
    """rows with position: depth-first order of the box tree, siblings by name, jobs whose box isn't known last by name."""
    known = rows.select(F.col("job_name").alias("box_name"), F.lit(False).alias("_orphan"))
    up = hierarchy.named_ancestors(rows, F.col("job_name"), F.col("box_name")).where("ancestor_name != name")
    chain = up.groupBy(F.col("name").alias("job_name")).agg(F.sort_array(F.collect_list(F.struct((-F.col("distance")).alias("d"), "ancestor_name"))).alias("_above"))
    orphan = F.col("box_name").isNotNull() & F.coalesce("_orphan", F.lit(True))
    path = F.concat(F.transform(F.coalesce("_above", F.array().cast("array<struct<d:int,ancestor_name:string>>")), lambda x: x["ancestor_name"]), F.array("job_name"))
    out = rows.join(known, "box_name", "left").join(chain, "job_name", "left").withColumns({"_last": orphan, "_path": path})
    return numbered(out, [F.col("_last"), F.col("_path")]).drop("_orphan", "_above", "_last", "_path")


# '!' comes before all characters of names, so joined paths sort as lists of names do
_ORDER = f"""{_TREE}, o AS (SELECT jx.job_name, row_number() OVER (ORDER BY jx.box_name IS NOT NULL AND jx.box_name NOT IN (SELECT job_name FROM jx),
  concat_ws('!', (SELECT string_agg(a.up, '!' ORDER BY a.n DESC) FROM a WHERE a.node = jx.job_name AND a.up IN (SELECT job_name FROM jx)), jx.job_name)) AS position FROM jx)"""


@query("report_order", f"WITH RECURSIVE {JX}, {_ORDER} SELECT job_name, position FROM o")
def report_order(spark: SparkSession, d: str) -> DataFrame:
    """Place of each job in the report."""
    return _by_position(estate(spark, d).select("job_name", "box_name")).select("job_name", "position")


_SIGNALS = {
    "notification": ("CASE WHEN send_notification AND notification_address <> '' THEN 'M' WHEN send_notification OR notification_address <> '' THEN 'S' END",
                     lambda: F.when(F.col("send_notification") & _says("notification_address"), "M").when(F.col("send_notification") | _says("notification_address"), "S")),
    "logs": ("CASE WHEN std_out_file LIKE '/%' OR std_err_file LIKE '/%' THEN 'M' WHEN std_out_file <> '' OR std_err_file <> '' THEN 'S' END",
             lambda: F.when(F.coalesce(F.col("std_out_file").startswith("/"), F.lit(False)) | F.coalesce(F.col("std_err_file").startswith("/"), F.lit(False)), "M").when(_says("std_out_file") | _says("std_err_file"), "S")),
    "zone": ("CASE WHEN timezone <> '' THEN 'S' END", lambda: F.when(_says("timezone"), "S")),
    "permission": ("CASE WHEN len([x FOR x IN string_split(coalesce(permission, ''), ',') IF trim(x) <> '']) >= 6 THEN 'M' WHEN len([x FOR x IN string_split(coalesce(permission, ''), ',') IF trim(x) <> '']) >= 1 THEN 'S' ELSE 'XS' END",
                   lambda: F.when(F.size(X.listed(F.col("permission"))) >= 6, "M").when(F.size(X.listed(F.col("permission"))) >= 1, "S").otherwise("XS")),
    "dialect": ("CASE WHEN contains(command, '.ksh') THEN 'ksh' WHEN contains(command, '.pl') THEN 'perl' WHEN contains(command, '.py') THEN 'python' WHEN contains(command, '.sh') THEN 'bash' ELSE 'none' END", lambda: X.dialect(F.col("command"))),
    "n_scripts": ("len(regexp_extract_all(command, '(\\S+\\.\\w+)', 1))", lambda: F.size(F.regexp_extract_all("command", F.lit(r"(\S+\.\w+)"), 1)).cast("long")),
    "n_absolute": ("len([x FOR x IN regexp_extract_all(command, '(\\S+\\.\\w+)', 1) IF x LIKE '/%'])", lambda: F.size(F.filter(F.regexp_extract_all("command", F.lit(r"(\S+\.\w+)"), 1), lambda x: x.startswith("/"))).cast("long")),
}
_SCORE = "CASE WHEN dialect IN ('ksh', 'perl') THEN 'L' WHEN dialect = 'bash' THEN CASE WHEN n_absolute > 3 THEN 'L' ELSE 'M' END WHEN dialect = 'python' THEN CASE WHEN n_absolute > 3 THEN 'L' ELSE 'S' END ELSE CASE WHEN n_absolute > 3 THEN 'L' ELSE 'XS' END END"
_BUCKET = "CASE WHEN {0} > 40 THEN 'XL' WHEN {0} > 20 THEN 'L' WHEN {0} > 10 THEN 'M' WHEN {0} > 5 THEN 'S' ELSE 'XS' END"
_SIGNALLED = f"""{_TREE}, sg AS (SELECT job_name, box_name, job_type, start_times, machine, {", ".join(f"{s} AS {n}" for n, (s, _) in _SIGNALS.items())} FROM jx),
mc AS (SELECT machine, count(*) AS on_machine FROM jx WHERE job_type = 'CMD' AND machine IS NOT NULL GROUP BY 1), bu AS (SELECT start_times, count(*) AS burst FROM jx WHERE start_times IS NOT NULL GROUP BY 1),
dp AS (SELECT node, max(n) AS depth FROM a GROUP BY 1),
xb AS (SELECT DISTINCT p.job_name FROM e JOIN jx p ON p.job_name = e.job JOIN jx q ON q.job_name = e.dep WHERE CASE WHEN q.job_type = 'BOX' THEN q.job_name ELSE q.box_name END IS DISTINCT FROM p.box_name AND CASE WHEN q.job_type = 'BOX' THEN q.job_name ELSE q.box_name END IS NOT NULL),
si AS (SELECT sg.* EXCLUDE (start_times, machine, box_name), {_SCORE} AS command_score, CASE WHEN sg.job_type = 'CMD' THEN coalesce(on_machine, 0) ELSE 0 END AS on_machine, coalesce(burst, 0) AS burst, coalesce(depth, 0) AS depth,
  CASE WHEN coalesce(depth, 0) >= 5 THEN 'XL' WHEN coalesce(depth, 0) >= 3 THEN 'L' WHEN coalesce(depth, 0) >= 2 THEN 'M' WHEN coalesce(depth, 0) >= 1 THEN 'S' ELSE 'XS' END AS depth_score, sg.job_name IN (SELECT job_name FROM xb) AS cross_box
  FROM sg LEFT JOIN mc ON mc.machine = sg.machine LEFT JOIN bu ON bu.start_times = sg.start_times LEFT JOIN dp ON dp.node = sg.job_name)"""


def cross_box(rows: DataFrame) -> DataFrame:
    """(job, dep, dep_box): references that leave the job's box; a box stands for itself."""
    mine = rows.select(F.col("job_name").alias("job"), F.col("box_name").alias("box"))
    theirs = rows.select(F.col("job_name").alias("dep"), F.when(F.col("job_type") == "BOX", F.col("job_name")).otherwise(F.col("box_name")).alias("dep_box"))
    out = _edges(rows).join(mine, "job").join(theirs, "dep")
    return out.where(F.col("dep_box").isNotNull() & ~F.col("dep_box").eqNullSafe(F.col("box"))).select("job", "dep", "dep_box")


def signalled(rows: DataFrame) -> DataFrame:
    """(job_name, ...): everything that the structure of the estate says about each job, in one select; group counts come back by joins."""
    out = rows.select("job_name", "job_type", "machine", "start_times", *[c().alias(n) for n, (_, c) in _SIGNALS.items()])
    far = F.col("n_absolute") > 3
    score = F.when(F.col("dialect").isin("ksh", "perl") | far, "L").when(F.col("dialect") == "bash", "M").when(F.col("dialect") == "python", "S").otherwise("XS")
    machines = rows.where("job_type = 'CMD' and machine is not null").groupBy("machine").agg(F.count("*").alias("on_machine"))
    bursts = rows.where("start_times is not null").groupBy("start_times").agg(F.count("*").alias("burst"))
    depths = hierarchy.named_ancestors(rows, F.col("job_name"), F.col("box_name")).groupBy(F.col("name").alias("job_name")).agg(F.max("distance").alias("depth"))
    leaves = cross_box(rows).select(F.col("job").alias("job_name"), F.lit(True).alias("cross_box")).distinct()
    out = out.join(machines, "machine", "left").join(bursts, "start_times", "left").join(depths, "job_name", "left").join(leaves, "job_name", "left")
    n = F.coalesce("depth", F.lit(0))
    nested = F.when(n >= 5, "XL").when(n >= 3, "L").when(n >= 2, "M").when(n >= 1, "S").otherwise("XS")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    on = F.when(F.col("job_type") == "CMD", F.coalesce("on_machine", F.lit(0))).otherwise(0).alias("on_machine")
    return out.select("job_name", "job_type", *_SIGNALS, score.alias("command_score"), on, zero("burst"), zero("depth"), nested.alias("depth_score"), F.coalesce("cross_box", F.lit(False)).alias("cross_box"))


@query("migration_signals", f"WITH RECURSIVE {JX}, {_REFS}, {_SIGNALLED} SELECT * FROM si")
def migration_signals(spark: SparkSession, d: str) -> DataFrame:
    return signalled(estate(spark, d))


@query("cross_box_dependencies", f"""WITH {JX}, {_REFS}, x AS (SELECT e.job, e.dep, a.box_name AS box, CASE WHEN b.job_type = 'BOX' THEN b.job_name ELSE b.box_name END AS dep_box FROM e JOIN jx a ON a.job_name = e.job JOIN jx b ON b.job_name = e.dep)
SELECT job, dep, dep_box FROM x WHERE dep_box IS NOT NULL AND dep_box IS DISTINCT FROM box""")
def cross_box_dependencies(spark: SparkSession, d: str) -> DataFrame:
    return cross_box(estate(spark, d))


@query("machine_jobs", f"WITH {JX}, n AS (SELECT machine, count(*) AS n_jobs FROM jx WHERE job_type = 'CMD' AND machine IS NOT NULL GROUP BY 1) SELECT jx.machine, jx.job_name, n.n_jobs, {_BUCKET.format('n.n_jobs')} AS score FROM jx JOIN n USING (machine) WHERE job_type = 'CMD'")
def machine_jobs(spark: SparkSession, d: str) -> DataFrame:
    """Jobs of each machine with their number and a score of their concentration; a row each, as a machine may hold very many."""
    n = F.col("n_jobs")
    rows = estate(spark, d).where("job_type = 'CMD' and machine is not null").select("machine", "job_name")
    score = F.when(n > 40, "XL").when(n > 20, "L").when(n > 10, "M").when(n > 5, "S").otherwise("XS")
    return rows.join(rows.groupBy("machine").agg(F.count("*").alias("n_jobs")), "machine").withColumn("score", score)


_REPORT = f"""{_SIZED}, {_TAGS.format('z')}, {_ROLLED.replace(_TREE, _TREE, 1)}, {_ORDER.replace(_TREE + ', ', '', 1)}, {_SIGNALLED.replace(_TREE + ', ', '', 1)},
fi AS (SELECT dep, count(*) AS n FROM e WHERE job <> dep GROUP BY 1)"""
_LINE = """position, tg.job_name, tg.job_type, coalesce(tg.box_name, '') AS box_name, tg.size, {h} AS effort_h, rk.risk, coalesce(rk.inherited_from, '') AS inherited_from, coalesce(fi.n, 0) AS blast_radius, array_to_string(tg.tags, ', ') AS gap_tags,
  si.dialect, si.on_machine, si.depth, si.cross_box, si.burst, si.notification IS NOT NULL AS notifies, coalesce(si.logs = 'M', FALSE) AS fixed_logs, coalesce(tg.timezone, '') AS timezone, tg.wave, tg.drivers""".format(h=_HOURS_SQL.replace("CASE size", "CASE tg.size"))


@query("report", f"{_REPORT} SELECT {_LINE} FROM tg JOIN o USING (job_name) JOIN rk USING (job_name) JOIN si USING (job_name) LEFT JOIN fi ON fi.dep = tg.job_name")
def report(spark: SparkSession, d: str) -> DataFrame:
    """One line of twenty columns for each job, with its place in the report."""
    rows = cut(tagged(sized(spark, d)))
    risk = rolled_risk(rows).select("job_name", F.col("risk").alias("_risk"), "inherited_from")
    place = _by_position(rows.select("job_name", "box_name")).select("job_name", "position")
    said = signalled(rows).drop("job_type", "zone", "permission")
    uses = _edges(rows).where("job != dep").groupBy(F.col("dep").alias("job_name")).agg(F.count("*").alias("blast_radius"))
    out = rows.join(risk, "job_name").join(place, "job_name").join(said, "job_name").join(uses, "job_name", "left")
    none = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return out.select(
        "position", "job_name", "job_type", none("box_name"), "size", _hours().alias("effort_h"), F.col("_risk").alias("risk"), none("inherited_from"), F.coalesce("blast_radius", F.lit(0)).alias("blast_radius"),
        F.array_join("tags", ", ").alias("gap_tags"), "dialect", "on_machine", "depth", "cross_box", "burst", F.col("notification").isNotNull().alias("notifies"),
        F.coalesce(F.col("logs") == "M", F.lit(False)).alias("fixed_logs"), none("timezone"), "wave", "drivers",
    )


@query("top_effort", f"{_SIZED}, {_ORDER} SELECT job_name, {_HOURS_SQL} AS effort_h FROM z JOIN o USING (job_name) ORDER BY effort_h DESC, position LIMIT 5")
def top_effort(spark: SparkSession, d: str) -> DataFrame:
    """The five jobs with most effort; ties keep the order of the report."""
    rows = sized(spark, d).select("job_name", _hours().alias("effort_h"))
    place = _by_position(estate(spark, d).select("job_name", "box_name")).select("job_name", "position")
    return rows.join(place, "job_name").orderBy(F.desc("effort_h"), "position").limit(5).select("job_name", "effort_h")


@query("tree_listing", f"WITH {JX} SELECT box_name, job_name, row_number() OVER (PARTITION BY box_name ORDER BY condition IS NOT NULL, job_name) AS place FROM jx WHERE box_name IS NOT NULL")
def tree_listing(spark: SparkSession, d: str) -> DataFrame:
    """Children of each box, those without condition first, then by name. One box may hold a third of all jobs, so places come from one order of all rows."""
    rows = estate(spark, d).where("box_name is not null").select("box_name", "job_name", F.col("condition").isNotNull().alias("waits"))
    rows = cut(numbered(rows, [F.col("box_name"), F.col("waits"), F.col("job_name")]))
    first = rows.groupBy("box_name").agg(F.min("position").alias("first"))
    return rows.join(first, "box_name").select("box_name", "job_name", (F.col("position") - F.col("first") + 1).alias("place"))
