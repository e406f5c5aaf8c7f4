"""Loading raw export lines: typed rows, and the lines that can't be loaded with one reason each.

Method: read permissively under an explicit schema, keep the raw text of every
line, then classify what doesn't fit by quoting, count and casts. Files differ
in delimiter, column order and optional columns, so a line is split by its own
file's delimiter and its fields are picked by the position that the file's
header gives them; JSON lines are read under a map schema. Everything is built-in
expressions. Reasons for whole files come from one map-side aggregation by file;
file sizes are skewed, and no step gathers a file in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runweave.functions.statuses import is_counted, literal_map, status_code
from runweave.functions.texts import staged, strip

# Names under which exports know each column (lower case, blanks and dashes as underscores).
ALIASES = {
    "job_name": ("job_name", "jobname", "job", "name"),
    "status": ("status", "job_status", "jobstatus", "terminal_status", "result"),
    "start_time": ("start_time", "starttime", "start", "started_at", "run_start"),
    "end_time": ("end_time", "endtime", "end", "ended_at", "run_end", "finish_time"),
    "exit_code": ("exit_code", "exitcode", "rc", "return_code"),
    "machine": ("machine", "host", "hostname", "agent"),
    "attempt": ("attempt", "ntry", "retry", "retry_count", "attempt_number"),
    "run_id": ("run_id", "runid", "id", "event_id"),
}
# Columns that are never stored.
REFUSED = (
    "command", "cmd", "std_out_file", "std_err_file", "stdout_path", "stderr_path", "output", "stdout", "stderr",
    "message", "envvars", "env", "auth_string", "password", "secret", "token", "credential",
)
REQUIRED = ("job_name", "status", "start_time")
DELIMITERS = {"csv": ",", "tsv": "\t", "pipe": "|"}
#: Stand for a delimiter inside and outside quotes; both are no characters of any text.
_INNER, _OUTER = "\ufdd0", "\ufdd1"
# Times with the groups year month day | month day year, hour minute second, offset.
_TIME = (
    r"^(?:(\d{4})-(\d{2})-(\d{2})[Tt ]|(\d{1,2})/(\d{1,2})/(\d{4}) )(\d{1,2}):(\d{2}):(\d{2})"
    r"(?:\.(\d+))?(Z|z|[+-]\d{2}:\d{2})?$"
)


def canonical(name: Column) -> Column:
    """Canonical column name of a header name; NULL for columns that are no part of a run."""
    n = F.regexp_replace(F.lower(strip(F.regexp_replace(name, "^\ufeff", ""))), r"[\s-]+", "_")
    return F.try_element_at(literal_map({a: c for c, names in ALIASES.items() for a in names}), n)


def split_quoted(line: Column, delimiter: Column) -> tuple[Column, Column]:
    """(fields, well quoted?): a double quote may only enclose a whole field and is doubled inside it.

    The line is cut at its quotes. The pieces with odd index lie inside quotes;
    a piece between two quoted parts is empty (a doubled quote) or begins and
    ends with a delimiter; the first ends and the last begins with one.
    """
    pieces = F.split(line, '"', -1)
    n = F.size(pieces)

    def sound(x: Column, i: Column) -> Column:
        opens = (x == "") | (i == 0) | x.startswith(delimiter)
        closes = (x == "") | (i == n - 1) | x.endswith(delimiter)
        return (i % 2 == 1) | (opens & closes)

    well = (n == 1) | ((n % 2 == 1) & F.forall(F.transform(pieces, sound), lambda b: b))
    joined = F.array_join(
        F.transform(
            pieces,
            lambda x, i: F.when(i % 2 == 1, F.replace(x, delimiter, F.lit(_INNER)))
            .when((x == "") & (i > 0) & (i < n - 1), F.lit('"'))
            .otherwise(F.replace(x, delimiter, F.lit(_OUTER))),
        ),
        "",
    )
    plain = F.when(n == 1, F.replace(line, delimiter, F.lit(_OUTER))).otherwise(joined)
    return F.transform(F.split(plain, _OUTER, -1), lambda x: F.replace(x, F.lit(_INNER), delimiter)), well


def _json_fields(line: Column) -> tuple[Column, Column]:
    """(map of the object, is it exactly one strict JSON object?).

    The line is put into an array and into an object: only a text that is one
    whole value fits both.
    """
    strict = {
        "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad", "allowSingleQuotes": "false", "allowNonNumericNumbers": "false",
        "allowUnquotedFieldNames": "false", "allowComments": "false", "allowUnquotedControlChars": "false",
    }
    whole = F.from_json(F.concat(F.lit('{"w":'), line, F.lit(',"z":1}')), "w map<string,string>, z int, _bad string", strict)
    one = F.json_array_length(F.concat(F.lit("["), line, F.lit("]"))) == 1
    ok = one & whole["_bad"].isNull() & (whole["z"] == 1) & whole["w"].isNotNull()
    return whole["w"], F.coalesce(ok, F.lit(False))


def _int(c: Column) -> Column:
    return F.when(c != "", c).try_cast("int")


def _time_parts(name: str, c: Column) -> dict[str, Column]:
    """Local microseconds (as if in UTC) and offset text of a valid time."""
    parts = F.split(F.regexp_replace(c, _TIME, "$1\u0001$2\u0001$3\u0001$4\u0001$5\u0001$6\u0001$7\u0001$8\u0001$9\u0001$10\u0001$11"), "\u0001", -1)
    return {f"_{name}": F.when(c.rlike(_TIME), parts)}


def _local_us(parts: Column) -> Column:
    g = lambda i: _int(F.get(parts, F.lit(i)))
    y, m, d = F.coalesce(g(0), g(5)), F.coalesce(g(1), g(3)), F.coalesce(g(2), g(4))
    first = F.make_date(F.greatest(F.least(y, F.lit(9999)), F.lit(1)), F.greatest(F.least(m, F.lit(12)), F.lit(1)), F.lit(1))
    ok = (y >= 1) & m.between(1, 12) & (d >= 1) & (d <= F.dayofmonth(F.last_day(first)))
    ok = ok & (g(6) <= 23) & (g(7) <= 59) & (g(8) <= 59) & (g(3).isNotNull() | (F.length(F.get(parts, F.lit(6))) == 2))
    micros = F.coalesce(_int(F.rpad(F.substring(F.get(parts, F.lit(9)), 1, 6), 6, "0")), F.lit(0))
    seconds = (F.unix_date(first).cast("long") + d - 1) * 86400 + g(6) * 3600 + g(7) * 60 + g(8)
    return F.when(ok, seconds * 1_000_000 + micros)


def _offset_minutes(text: Column) -> Column:
    sign = F.when(text.startswith("-"), -1).otherwise(1)
    return F.when(F.lower(text) == "z", 0).when(text != "", sign * (_int(F.substring(text, 2, 2)) * 60 + _int(F.substring(text, 5, 2))))


def parse_lines(lines: DataFrame, imports: DataFrame) -> DataFrame:
    """Each line with its canonical fields as text, and reason where it can't be loaded.

    lines: row_id, import_id, line_no, raw_line. imports: import_id,
    file_format, header_line, declared_timezone. Other columns are not read.
    Lines that are NULL or blank come out with blank = true, no fields and no
    reason. Lines of an import that isn't known, or of an unknown format, are
    read as comma-separated without header: missing_column. Of repeated header
    names the first counts. Raw text is kept in raw_line.
    """
    header = F.transform(split_quoted(F.col("header_line"), F.col("delimiter"))[0], canonical)
    files = imports.select(
        "import_id", "file_format", "header_line", "declared_timezone",
        F.coalesce(F.try_element_at(literal_map(DELIMITERS), F.col("file_format")), F.lit(",")).alias("delimiter"),
    )
    files = files.withColumn("header", header).withColumn("is_json", F.col("file_format") == "jsonl")
    files = files.withColumn("lacks", ~F.col("is_json") & (F.col("header").isNull() | F.array_contains(F.transform(F.array(*[F.lit(c) for c in REQUIRED]), lambda c: F.coalesce(F.array_position("header", c), F.lit(0))), F.lit(0).cast("long"))))
    files = files.select("import_id", "delimiter", "header", "is_json", "lacks", "declared_timezone")
    rows = lines.select("row_id", "import_id", "line_no", "raw_line").join(files, "import_id", "left")
    json = F.coalesce(F.col("is_json"), F.lit(False))
    fields, well = split_quoted(F.col("raw_line"), F.coalesce("delimiter", F.lit(",")))
    obj, is_obj = _json_fields(F.col("raw_line"))
    rows = rows.withColumn("blank", F.coalesce(F.regexp_replace("raw_line", r"[\s\ufeff]+", "") == "", F.lit(True)))
    rows = staged(
        rows,
        {
            "_fields": F.when(~F.col("blank") & ~json, fields),
            "_well": F.when(~F.col("blank") & ~json, well),
            "_object": F.when(~F.col("blank") & json, F.transform(F.map_entries(obj), lambda e: F.struct(canonical(e["key"]).alias("k"), e["value"].alias("v")))),
            "_one": F.when(~F.col("blank") & json, is_obj),
        },
    )

    def pick(c: str) -> Column:
        at = F.array_position("header", F.lit(c)).cast("int")
        plain = F.when(at > 0, F.get("_fields", at - 1))
        keyed = F.get(F.filter("_object", lambda e: e["k"] == c), F.lit(0))["v"]
        return strip(F.when(json, keyed).otherwise(plain))

    rows = staged(rows, {c: pick(c) for c in ALIASES} | {"_width": F.size("_fields")})
    rows = staged(rows, _time_parts("start", F.col("start_time")) | _time_parts("end", F.col("end_time")) | {"_code": status_code(F.col("status"))})
    rows = staged(
        rows,
        {
            "start_local_us": _local_us(F.col("_start")), "start_offset": _offset_minutes(F.get("_start", F.lit(10))),
            "end_local_us": _local_us(F.col("_end")), "end_offset": _offset_minutes(F.get("_end", F.lit(10))),
        },
    )
    blank = lambda c: F.coalesce(F.col(c) == "", F.lit(True))
    number = lambda c: blank(c) | F.col(c).rlike(r"^[+-]?\d+$")
    own = (
        F.when(F.col("blank") | F.coalesce("lacks", F.lit(True)), F.lit(None))
        .when(json & ~F.col("_one"), "bad_json")
        .when(~F.col("_well"), "bad_quoting")
        .when(~json & (F.col("_width") != F.size("header")), "column_count")
        .when(blank("job_name"), "missing_job_name")
        .when(F.col("_code").isNull(), "unknown_status")
        .when(~is_counted(F.col("_code")), "non_terminal_status")
        .when(blank("start_time"), "missing_start_time")
        .when(F.col("start_local_us").isNull() | (~blank("end_time") & F.col("end_local_us").isNull()), "bad_timestamp")
        .when(~number("exit_code") | ~number("attempt"), "bad_number")
    )
    split_fails = F.coalesce(F.col("line_reason").isin("bad_json", "bad_quoting", "column_count"), F.lit(False))
    naive = (F.col("start_local_us").isNotNull() & F.col("start_offset").isNull()) | (F.col("end_local_us").isNotNull() & F.col("end_offset").isNull())
    rows = staged(rows, {"line_reason": own, "status_code": F.col("_code")})
    return rows.withColumn("naive", ~split_fails & naive & ~F.col("blank")).select(
        "row_id", "import_id", "line_no", "raw_line", "blank", "lacks", "declared_timezone", *ALIASES,
        "status_code", "start_local_us", "start_offset", "end_local_us", "end_offset", "naive", "line_reason",
    )


def classify(lines: DataFrame, imports: DataFrame) -> DataFrame:
    """parse_lines with reason: the whole file's reason, else the line's; NULL for lines that load (and blank ones)."""
    rows = parse_lines(lines, imports)
    no_zone = imports.where("declared_timezone is null").select("import_id")
    files = parse_lines(lines.join(no_zone, "import_id", "left_semi"), imports).where("naive").groupBy("import_id").agg(F.lit(True).alias("naive_file"))
    reason = F.when(F.col("blank"), None).when(F.coalesce("lacks", F.lit(True)), "missing_column").when(F.col("naive_file"), "naive_no_tz").otherwise(F.col("line_reason"))
    return rows.join(files, "import_id", "left").withColumn("reason", reason)


def rejected(lines: DataFrame, imports: DataFrame) -> DataFrame:
    """(import_id, line_no, reason, raw_line) of each line that can't be loaded."""
    return classify(lines, imports).where("reason is not null").select("import_id", "line_no", "reason", "raw_line")


def loaded(lines: DataFrame, imports: DataFrame) -> DataFrame:
    """Typed run rows of all other lines; times in UTC by offset or declared zone, numbers as integers."""
    rows = classify(lines, imports).where("reason is null and not blank")

    def utc(name: str) -> Column:
        us = F.col(f"{name}_local_us")
        zoned = F.to_utc_timestamp(F.timestamp_micros(us), F.coalesce("declared_timezone", F.lit("UTC")))
        return F.when(F.col(f"{name}_offset").isNotNull(), F.timestamp_micros(us - F.col(f"{name}_offset").cast("long") * 60_000_000)).otherwise(zoned)

    text = lambda c: F.when(F.col(c) != "", F.col(c))
    return rows.select(
        "row_id", "import_id", "line_no", "job_name", F.col("status_code").alias("status"), utc("start").alias("start_time"), utc("end").alias("end_time"),
        F.col("exit_code").try_cast("int").alias("exit_code"), text("machine").alias("machine"),
        F.coalesce(F.col("attempt").try_cast("int"), F.lit(0)).alias("retry_count"), text("run_id").alias("run_ref"),
    )


def refused(imports: DataFrame) -> DataFrame:
    """(import_id, column_name): columns of each file's header that are never stored; loaded() leaves them out by taking only canonical ones."""
    delimiter = F.coalesce(F.try_element_at(literal_map(DELIMITERS), F.col("file_format")), F.lit(","))
    names = F.transform(split_quoted(F.col("header_line"), F.col("_d"))[0], lambda x: F.regexp_replace(F.lower(strip(x)), r"[\s-]+", "_"))
    rows = imports.where("header_line is not null").select("import_id", "header_line", delimiter.alias("_d"))
    return rows.select("import_id", F.explode(F.array_distinct(names)).alias("column_name")).where(F.col("column_name").isin(*REFUSED))
