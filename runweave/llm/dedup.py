"""New batches of run rows against everything already accepted.

Method: a pivot-distance table. The distance of two runs of one job and attempt
is the time between their starts; runs of other jobs are infinitely far apart.
The table stores each accepted run's distance to a fixed pivot, cut into ranges
as wide as the tolerance. By the triangle inequality a run within the tolerance
of a new row lies in the row's own range or a neighbouring one, so ranges are
joined by equality; the true distance is verified on the starts themselves.
The pivot is the earliest time there is, so distances order the starts. One pivot
is enough: on a line, from its end, |d(x, p) - d(y, p)| = d(x, y) for all x and y, so
the triangle inequality prunes exactly what is too far and a further pivot would
prune nothing more.

The table is stored in folders by the day of the distance. Queries make it from the
history once for each state of the history's files and then read it, and of it only
the folders that the batches reach.

Of each (job, attempt, machine, range) only the least and the greatest start
are needed to tell whether some run lies within the tolerance of a row: the
table is pre-aggregated, copies never multiply, and each probe meets at most one
row. Rows of the batches themselves are compared the same way with running
minima of their order, so nothing ever lists the pairs of a group. New rows are
appended to the table without reading the history again.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from runweave.functions.texts import host_key, name_key
from runweave.session import ensure_checkpoint_dir

#: The pivot: 0001-01-01 in microseconds since 1970.
PIVOT_US = -62_135_596_800_000_000
#: Starts at most so far apart are one run.
TOLERANCE_US = 5_000_000
#: Stand for "no machine" and "any machine" in the key; neither is a host name.
_NONE, _ANY = "", "*"
_KEY = ["job", "attempt", "host", "range"]
#: Ranges of a folder of the stored table: a day.
RANGES_A_FOLDER = 17_280
_STORED = "job string, attempt int, host string, range long, least long, greatest long, day long"


def _keyed(df: DataFrame, **extra: Column) -> DataFrame:
    """Rows with a job and a start: job, attempt, host, pd (distance to the pivot), range."""
    return (
        df.select(
            name_key(F.col("job_name")).alias("job"),
            F.col("retry_count").cast("int").alias("attempt"),
            F.coalesce(host_key(F.col("machine")), F.lit(_NONE)).alias("host"),
            (F.unix_micros(F.col("start_time").cast("timestamp")) - PIVOT_US).alias("pd"),
            *[c.alias(n) for n, c in extra.items()],
        )
        .where("job is not null and pd is not null")
        .withColumn("attempt", F.coalesce("attempt", F.lit(0)))
        .withColumn("range", F.expr(f"pd div {TOLERANCE_US}"))
    )


def _reachable(df: DataFrame) -> DataFrame:
    """Each accepted row under its own host and under any host."""
    return df.withColumn("host", F.explode(F.array(F.col("host"), F.lit(_ANY))))


def _asked() -> Column:
    """Hosts under which a row looks: its own and none, or any when it has none itself."""
    return F.when(F.col("host") == _NONE, F.array(F.lit(_ANY))).otherwise(F.array(F.col("host"), F.lit(_NONE)))


def pivot_table(history: DataFrame) -> DataFrame:
    """(job, attempt, host, range, least, greatest) of accepted runs; map-side combined."""
    return _reachable(_keyed(history)).groupBy(*_KEY).agg(F.min("pd").alias("least"), F.max("pd").alias("greatest"))


def _in_history(probes: DataFrame, pivots: DataFrame) -> DataFrame:
    """Distinct (job, attempt, host, pd) of probes that lie within the tolerance of an accepted run."""
    asked = probes.withColumn("own", F.col("host")).withColumn("host", F.explode(_asked()))
    asked = asked.withColumn("step", F.explode(F.array(*[F.lit(i) for i in (-1, 0, 1)]))).withColumn("range", F.col("range") + F.col("step"))
    # the true distance to the nearest start of the range
    near = F.when(F.col("step") == 0, F.lit(True)).when(F.col("step") < 0, F.col("pd") - F.col("greatest") <= TOLERANCE_US).otherwise(F.col("least") - F.col("pd") <= TOLERANCE_US)
    return asked.join(pivots, _KEY).where(near).select("job", "attempt", F.col("own").alias("host"), "pd").distinct()


def _earliest_near(points: DataFrame) -> DataFrame:
    """(job, attempt, host, pd, first): the least order of the points within the tolerance of each point.

    points: job, attempt, host, range, pd, ord, distinct by all but ord. A
    question about the range below asks at pd - tolerance, which lies in that
    range, for the least order of the starts from there on; one about the range
    above asks at pd + tolerance for the starts up to there.
    """
    stored = _reachable(points.select("job", "attempt", "host", "range", "pd", "ord"))
    stored = stored.groupBy(*_KEY, "pd").agg(F.min("ord").alias("ord")).withColumns({"own": F.lit(None).cast("string"), "side": F.lit(0), "asker": F.lit(None).cast("long")})
    asked = points.withColumn("own", F.col("host")).withColumn("host", F.explode(_asked()))
    asked = asked.withColumn("side", F.explode(F.array(*[F.lit(i) for i in (-1, 0, 1)])))
    asked = asked.select(
        "job", "attempt", "host", (F.col("range") + F.col("side")).alias("range"), (F.col("pd") + F.col("side") * TOLERANCE_US).alias("pd"),
        F.lit(None).cast("struct<import_id:bigint,batch_row_id:bigint>").alias("ord"), "own", "side", F.col("pd").alias("asker"),
    )
    both = stored.select(*_KEY, "pd", "ord", "own", "side", "asker").unionByName(asked)
    in_range = Window.partitionBy(*_KEY)
    up = in_range.orderBy("pd").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    down = in_range.orderBy(F.desc("pd")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    first = F.when(F.col("side") < 0, F.min("ord").over(down)).when(F.col("side") > 0, F.min("ord").over(up)).otherwise(F.min("ord").over(in_range))
    answered = both.withColumn("first", first).where("own is not null and first is not null")
    return answered.groupBy("job", "attempt", F.col("own").alias("host"), F.col("asker").alias("pd")).agg(F.min("first").alias("first"))


def duplicates(batches: DataFrame, pivots: DataFrame) -> DataFrame:
    """(batch_row_id, import_id) of each batch row that reports a run already accepted or in an earlier row.

    Same job (trimmed, without case), same retry_count (NULL counts as 0),
    starts within the tolerance, and machines that do not differ (trimmed,
    without case and domain; none differs from none). Rows come in the order of
    import_id, then batch_row_id. Rows without job or start are no case and
    nobody's earlier row. All batches are answered in one pass.
    """
    rows = _keyed(batches, batch_row_id=F.col("batch_row_id"), import_id=F.col("import_id"))
    # copies: only the first of each (job, attempt, host, start) has to be compared
    spot = ["job", "attempt", "host", "range", "pd"]
    order = F.struct("import_id", "batch_row_id")
    firsts = rows.groupBy(*spot).agg(F.min(order).alias("ord"))
    known = _in_history(firsts.select(*spot), pivots).withColumn("known", F.lit(True))
    near = _earliest_near(firsts)
    marks = firsts.join(known, ["job", "attempt", "host", "pd"], "left").join(near, ["job", "attempt", "host", "pd"], "left")
    marks = marks.select("job", "attempt", "host", "pd", "ord", "known", "first")
    out = rows.join(marks, ["job", "attempt", "host", "pd"])
    own = F.struct(F.col("import_id"), F.col("batch_row_id"))
    return out.where(F.coalesce("known", F.lit(False)) | (F.col("ord") < own) | (F.col("first") < own)).select("batch_row_id", "import_id")


def append(path: str, batches: DataFrame, ranges_a_folder: int = RANGES_A_FOLDER, mode: str = "append") -> None:
    """The rows' part of the table added to the stored one at path, a folder for each day of pivot distance."""
    part = pivot_table(batches).withColumn("day", F.expr(f"range div {int(ranges_a_folder)}"))
    part.hint("rebalance", "day").write.mode(mode).partitionBy("day").parquet(path)


def stored(spark: SparkSession, path: str, batches: DataFrame, ranges_a_folder: int = RANGES_A_FOLDER) -> DataFrame:
    """The stored table as far as the batches' distances reach; other folders aren't read.

    The days that batches reach come to the driver; they are as many as folders at most.
    A key may have a row from each time something was appended: a probe is near if it is near
    any of them, so they needn't be put together.
    """
    near = F.explode(F.array(*[F.expr(f"(range + {i}) div {int(ranges_a_folder)}") for i in (-1, 1)]))
    days = [r["day"] for r in _keyed(batches).select(near.alias("day")).distinct().collect()]
    return spark.read.schema(_STORED).parquet(path).where(F.col("day").isin(days) if days else F.lit(False)).drop("day")


def accepted(spark: SparkSession, source: str) -> str:
    """Path of the stored table of the history at source (a Parquet file or folder), made if there is none of its present state.

    It lies in the shared checkpoint folder under a name that follows from the
    names, sizes and times of the history's files; a table left half written has no
    success mark and is made again.
    """
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(source)
    files, state = at.getFileSystem(conf).listFiles(at, True), []
    while files.hasNext():
        f = files.next()
        state.append(f"{f.getPath()} {f.getLen()} {f.getModificationTime()}")
    name = hashlib.sha256("\n".join(sorted(state)).encode()).hexdigest()[:24]
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/accepted-runs-{name}"
    mark = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not mark.getFileSystem(conf).exists(mark):
        append(path, spark.read.parquet(source).select("job_name", "retry_count", "machine", "start_time"), mode="overwrite")
    return path
