"""Readers and writers of an estate's files as DataFrames."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from runweave.functions.texts import strip
from runweave.operators import rejects
from runweave.operators.numbering import numbered
from runweave.session import cut
from runweave.sources import jil_text

_STANZA = (
    "path string, encoding string, seq int, start_line int, end_line int, directive string, object_name string, disposition string, raw_text string, "
    "attrs map<string,string>, issues array<struct<severity:string,code:string,message:string,line:int>>"
)


def read_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, data) of all files below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern)
    return files.load(path).select("path", F.col("content").alias("data"))


def _stanza_batch(rows: list[tuple]) -> pa.RecordBatch:
    issue = pa.struct([("severity", pa.string()), ("code", pa.string()), ("message", pa.string()), ("line", pa.int32())])
    kinds = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.string(), pa.map_(pa.string(), pa.string()), pa.list_(issue)]
    names = ["path", "encoding", "seq", "start_line", "end_line", "directive", "object_name", "disposition", "raw_text", "attrs", "issues"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def stanzas(files: DataFrame) -> DataFrame:
    """One row per stanza of each file (path, data); bytes of any encoding are read, line ends come out as line feeds.

    The raw texts of a file's stanzas, in the order of seq, are the file.
    An empty file has none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("severity", "code", "message", "line")
        for b in batches:
            for path, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                text, encoding = jil_text.decode(data or b"")
                text = text.replace("\r\n", "\n").replace("\r", "\n")
                rows = [
                    (path, encoding, i, s.start, s.end, s.directive, s.name, s.disposition(), s.raw, list(s.merged().items()), [dict(zip(names, x, strict=True)) for x in s.issues])
                    for i, s in enumerate(jil_text.parse(text), 1)
                ]
                if rows:
                    yield _stanza_batch(rows)

    return files.select("path", "data").mapInArrow(run, _STANZA)


def parsed_texts(df: DataFrame, key: str, text: str) -> DataFrame:
    """stanzas() of texts that are in a column already; path is the key as text."""
    return stanzas(df.select(F.col(key).cast("string").alias("path"), F.encode(F.col(text), "utf-8").alias("data")))


def feed(stanza_rows: DataFrame, import_seq: Column) -> DataFrame:
    """The change feed that a set of stanzas makes: what operators.changefeed applies."""
    op = F.regexp_replace("directive", "_job$", "")
    job = stanza_rows.where("directive in ('insert_job', 'update_job', 'override_job', 'delete_job') and disposition like 'LOADED%'")
    return job.select(
        import_seq.alias("import_seq"), F.col("start_line").alias("source_line"), op.alias("op"), F.col("object_name").alias("job_name"),
        F.col("attrs").alias("raw_attrs"), F.concat_ws(":", "path", "seq").alias("op_id"),
    )


def calendar_files(files: DataFrame) -> DataFrame:
    """(calendar_name, day) from .cal files: a date a line, # begins a note; the name is the file's."""
    line = F.explode(F.split(F.decode("data", "utf-8"), r"\r?\n"))
    name = F.regexp_extract("path", r"([^/\\]+?)(\.[^./\\]*)?$", 1)
    rows = files.select(name.alias("calendar_name"), line.alias("line"))
    return rows.select("calendar_name", F.try_to_timestamp(strip(F.split_part("line", F.lit("#"), F.lit(1))), F.lit("yyyy-MM-dd")).cast("date").alias("day")).where("day is not null").distinct()


def calendar_exports(files: DataFrame) -> DataFrame:
    """(calendar_name, kind, day, rules) from calendar exports; extended calendars have rules and no days."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [
                (name, kind, day, list(rules.items()))
                for data in b.column(0).to_pylist()
                for kind, name, dates, rules, _ in jil_text.parse_calendars(jil_text.decode(data or b"")[0])
                for day in (dates or [None])
            ]
            if rows:
                kinds = [pa.string(), pa.string(), pa.string(), pa.map_(pa.string(), pa.string())]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["calendar_name", "kind", "day", "rules"])

    out = files.select("data").mapInArrow(run, "calendar_name string, kind string, day string, rules map<string,string>")
    return out.withColumn("day", F.col("day").cast("date"))


def global_exports(files: DataFrame) -> DataFrame:
    """(global_name, value) from exports of globals, names in upper case."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [x for data in b.column(0).to_pylist() for x in jil_text.parse_globals(jil_text.decode(data or b"")[0])]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], ["global_name", "value"])

    return files.select("data").mapInArrow(run, "global_name string, value string").withColumn("global_name", F.upper("global_name"))


def history_lines(spark: SparkSession, path: str, import_id: int, declared_timezone: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(lines, imports) of one run-history export or a folder of them, as operators.rejects reads them.

    Files are imports of their own, numbered from import_id on in the order of
    their paths; lines are numbered within their file from 1. A file's delimiter is the
    one of comma, tab and pipe that occurs most in its first line that isn't blank; a
    first line that opens an object is JSON Lines. Files are read in parallel and in
    parts: a line's number is its place in its part and what the parts before it hold.
    """
    at = ["_file", "_block"]
    text = spark.read.text(path).select(
        F.col("value").alias("raw_line"), F.monotonically_increasing_id().alias("row_id"), F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block")
    )
    parts = text.groupBy(*at).agg(F.min("row_id").alias("_first"), F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    text = text.join(parts.select(*at, "_first", before.alias("_before")), at)
    text = text.select("row_id", "_file", "raw_line", (F.col("row_id") - F.col("_first") + F.col("_before") + 1).alias("line_no"))
    first = F.min(F.when(F.trim("raw_line") != "", F.struct("line_no", "raw_line"))).alias("head")
    files = numbered(text.groupBy("_file").agg(first), [F.col("_file")], "_nth")
    header = F.coalesce(F.regexp_replace("head.raw_line", "^\ufeff", ""), F.lit(""))
    count = lambda c: F.length(header) - F.length(F.replace(header, F.lit(c), F.lit("")))
    comma, tab, pipe = (count(c) for c in rejects.DELIMITERS.values())
    kind = F.when(F.ltrim(header).startswith("{"), "jsonl").when((comma >= tab) & (comma >= pipe), "csv").when(tab >= pipe, "tsv").otherwise("pipe")
    files = cut(files.select("_file", (F.col("_nth") - 1 + import_id).alias("import_id"), kind.alias("file_format"), header.alias("header_line"), F.col("head.line_no").alias("_head")))
    imports = files.select("import_id", "file_format", F.when(F.col("file_format") != "jsonl", F.col("header_line")).alias("header_line"), F.lit(declared_timezone).cast("string").alias("declared_timezone"))
    lines = text.join(files, "_file").where((F.col("file_format") == "jsonl") | (F.col("line_no") > F.col("_head")))
    return lines.select("row_id", "import_id", "line_no", "raw_line"), imports


def idempotent_append(target: DataFrame, new: DataFrame, key: str, replace: bool = False) -> DataFrame:
    """target with the rows of new whose key it lacks; or, to replace, with all rows of new in place of those it has."""
    if replace:
        return target.join(new.select(key), key, "left_anti").select(*target.columns).unionByName(new)
    return target.unionByName(new.join(target.select(key), key, "left_anti").select(*new.columns))


def jil_of(df: DataFrame, name: Column, kind: Column, attrs: Column) -> DataFrame:
    """(job_name, jil): definition text of jobs; attributes in order of their names, values with blanks, commas or colons quoted."""
    quoted = lambda v: F.when(v.rlike(r"[\s:,]"), F.concat(F.lit('"'), F.replace(v, F.lit('"'), F.lit('\\"')), F.lit('"'))).otherwise(v)
    lines = F.transform(F.array_sort(F.map_entries(attrs)), lambda e: F.concat(e["key"], F.lit(": "), quoted(e["value"])))
    kept = F.filter(lines, lambda x: x.isNotNull())
    head = F.concat(F.lit("insert_job: "), name, F.lit("   job_type: "), F.coalesce(kind, F.lit("CMD")))
    return df.select(name.alias("job_name"), F.array_join(F.concat(F.array(head), kept), "\n").alias("jil"))


def prometheus(df: DataFrame, metric: str, value: str, labels: list[str]) -> DataFrame:
    """(value) lines of a gauge for a metrics page."""
    pairs = [F.concat(F.lit(f'{x}="'), F.coalesce(F.col(x).cast("string"), F.lit("")), F.lit('"')) for x in labels]
    return df.select(F.concat(F.lit(metric + "{"), F.concat_ws(",", *pairs), F.lit("} "), F.col(value).cast("string")).alias("value"))


def write_csv(df: DataFrame, path: str, sep: str = ",") -> None:
    df.write.mode("overwrite").option("header", "true").option("sep", sep).csv(path)
