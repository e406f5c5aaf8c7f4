"""Peaks of overlapping intervals, points in intervals, and as-of joins, without gathering a group in one task.

Running sums and maxima over time are taken in two levels: within slices of
time, and over the slices' totals (one row per entity and slice).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Length of a slice in microseconds.
SLICE_US = 6 * 3_600_000_000


def _sliced(df: DataFrame, keys: list[str], at: str) -> DataFrame:
    return df.withColumn("slice", F.expr(f"{at} div {SLICE_US}"))


def _carried(rows: DataFrame, keys: list[str], total: Column, over) -> DataFrame:
    """(keys, slice, carry): what earlier slices of the same keys leave behind."""
    per = rows.groupBy(*keys, "slice").agg(total.alias("_t"))
    earlier = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    return per.select(*keys, "slice", over(F.col("_t")).over(earlier).alias("carry"))


def peak(df: DataFrame, start: Column, end: Column, entity: str | None = None) -> DataFrame:
    """(entity,) in_flight, at_us: the greatest number of intervals at once, and the first instant of it.

    Rows without start or end are left out. At one instant ends come before
    starts. An empty table gives no rows.
    """
    keys = [entity] if entity else []
    us = lambda c: F.unix_micros(c.cast("timestamp"))
    spans = df.select(*keys, us(start).alias("a"), us(end).alias("b")).where("a is not null and b is not null")
    moves = spans.select(*keys, F.explode(F.array(F.struct(F.col("a").alias("at"), F.lit(1).alias("d")), F.struct(F.col("b").alias("at"), F.lit(-1).alias("d")))).alias("m"))
    moves = _sliced(moves.select(*keys, "m.at", "m.d"), keys, "at")
    # moves at one instant in one direction are one move
    moves = moves.groupBy(*keys, "slice", "at", "d").agg(F.sum("d").alias("n"))
    carried = _carried(moves, keys, F.sum("n"), F.sum)
    running = Window.partitionBy(*keys, "slice").orderBy("at", "d").rowsBetween(Window.unboundedPreceding, 0)
    level = moves.join(carried, [*keys, "slice"]).withColumn("in_flight", F.sum("n").over(running) + F.coalesce("carry", F.lit(0)))
    best = F.max(F.struct("in_flight", (-F.col("at")).alias("back"))).alias("x")
    grouped = level.groupBy(*keys).agg(best) if keys else level.agg(best).where("x is not null")
    return grouped.select(*keys, "x.in_flight", (-F.col("x.back")).alias("at_us"))


def count_covering(points: DataFrame, spans: DataFrame) -> DataFrame:
    """(id, n): for each point (id, key, at) the number of spans (key, a, b) of its key with a <= at <= b.

    n is the number of starts up to the point less the number of ends before
    it, both running counts; no pair of a point and a span is ever made.
    """
    none = F.lit(None).cast(dict(points.dtypes)["id"])
    moves = spans.select("key", F.explode(F.array(F.struct(F.col("a").alias("at"), F.lit(0).alias("o"), F.lit(1).alias("n")), F.struct(F.col("b").alias("at"), F.lit(2).alias("o"), F.lit(-1).alias("n")))).alias("m"))
    moves = moves.select("key", "m.at", "m.o", "m.n").groupBy("key", "at", "o").agg(F.sum("n").alias("n")).withColumn("id", none)
    rows = moves.unionByName(points.select("key", "at", F.lit(1).alias("o"), F.lit(0).cast("long").alias("n"), "id"))
    rows = _sliced(rows, ["key"], "at")
    carried = _carried(rows, ["key"], F.sum("n"), F.sum)
    running = Window.partitionBy("key", "slice").orderBy("at", "o").rowsBetween(Window.unboundedPreceding, 0)
    out = rows.join(carried, ["key", "slice"]).withColumn("c", F.sum("n").over(running) + F.coalesce("carry", F.lit(0)))
    return out.where("id is not null").select("id", F.col("c").alias("n"))


def as_of(left: DataFrame, right: DataFrame) -> DataFrame:
    """(id, previous): for each row (id, key, at) of left the greatest at of right's rows (key, at) that isn't after it.

    Rows without key or at match nothing. Ties and repeated rows don't matter.
    """
    none = F.lit(None).cast(dict(left.dtypes)["id"])
    known = right.where("key is not null and at is not null").select("key", "at").distinct()
    rows = known.select("key", "at", F.lit(0).alias("o"), F.col("at").alias("v"), none.alias("id")).unionByName(
        left.select("key", "at", F.lit(1).alias("o"), F.lit(None).cast("long").alias("v"), "id")
    )
    rows = _sliced(rows, ["key"], "at")
    carried = _carried(rows, ["key"], F.max("v"), F.max)
    running = Window.partitionBy("key", "slice").orderBy("at", "o").rowsBetween(Window.unboundedPreceding, 0)
    out = rows.where("key is not null and at is not null").join(carried, ["key", "slice"])
    out = out.withColumn("previous", F.greatest(F.max("v").over(running), F.col("carry")))
    return out.where("id is not null").select("id", "previous")


def previous_value(df: DataFrame, key: str, at: Column, tie: str, value: str) -> DataFrame:
    """df with previous: the value of the row before in the order of (at, tie) within the key, NULL for the first.

    A key may hold a third of all rows: slices of time are sorted one by one,
    and each takes over the last value of the slices before it.
    """
    rows = _sliced(df.withColumn("_at", F.unix_micros(at.cast("timestamp"))), [key], "_at")
    last = rows.groupBy(key, "slice").agg(F.max_by(F.struct(value), F.struct("_at", tie)).alias("_l"))
    before = Window.partitionBy(key).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.select(key, "slice", F.last("_l").over(before).alias("_l"))
    within = Window.partitionBy(key, "slice").orderBy("_at", tie)
    out = rows.join(carried, [key, "slice"]).withColumn("_p", F.lag(F.struct(value)).over(within))
    return out.select(*df.columns, F.coalesce("_p", "_l")[value].alias("previous"))
