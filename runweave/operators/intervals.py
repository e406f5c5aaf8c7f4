"""Overlapping and gapped intervals per entity: merged periods and the gaps between them.

Method: sort by start per entity, compare each start with the running maximum
of the previous ends, label islands cumulatively, aggregate periods, derive
gaps. An entity may hold a third of all rows, so the scan is cut into slices of
time: the window runs within (entity, slice) and each slice starts from the
maximum end of all earlier slices of its entity, which comes from a small
pre-aggregated table (one row per entity and slice). The number of slices is
bound by the calendar, not by the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOUR_US = 3_600_000_000


def label_islands(df: DataFrame, entity: Column, start: Column, end: Column, slice_us: int = HOUR_US) -> DataFrame:
    """Rows (entity, s, e, before, island): before is the latest end of all earlier intervals.

    s and e are microseconds since 1970. Rows without entity, start or end, or
    whose end isn't after the start, are left out. Touching intervals belong
    together. island is the start of the merged period that the row lies in.
    An empty table gives no rows; repeated rows fall into one island. Other
    columns of df are dropped, so their names can't clash.
    """
    us = lambda c: F.unix_micros(c.cast("timestamp"))
    rows = (
        df.select(entity.alias("entity"), us(start).alias("s"), us(end).alias("e"))
        .where("entity is not null and s is not null and e > s")
        .withColumn("slice", F.expr(f"s div {int(slice_us)}"))
    )
    # equal starts need one row only: the longest (also thins out repeated rows before the shuffle)
    rows = rows.groupBy("entity", "slice", "s").agg(F.max("e").alias("e"))
    # latest end and, later, latest island start that a slice takes over from earlier slices
    per_slice = rows.groupBy("entity", "slice").agg(F.max("e").alias("top"))
    earlier = Window.partitionBy("entity").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = per_slice.select("entity", "slice", F.max("top").over(earlier).alias("carry"))
    local = Window.partitionBy("entity", "slice").orderBy("s")
    prior = local.rowsBetween(Window.unboundedPreceding, -1)
    return (
        rows.join(carried, ["entity", "slice"])
        .withColumn("before", F.greatest(F.max("e").over(prior), F.col("carry")))
        .withColumn("opens", F.col("before").isNull() | (F.col("s") > F.col("before")))
        .withColumn("island", F.max(F.when(F.col("opens"), F.col("s"))).over(local.rowsBetween(Window.unboundedPreceding, 0)))
        .select("entity", "slice", "s", "e", "before", "opens", "island")
    )


def gaps(df: DataFrame, entity: Column, start: Column, end: Column, slice_us: int = HOUR_US) -> DataFrame:
    """(entity, gap_start_us, gap_end_us): each idle gap between two merged periods of an entity."""
    marked = label_islands(df, entity, start, end, slice_us)
    return marked.where("opens and before is not null").select("entity", F.col("before").alias("gap_start_us"), F.col("s").alias("gap_end_us"))


def periods(df: DataFrame, entity: Column, start: Column, end: Column, slice_us: int = HOUR_US) -> DataFrame:
    """(entity, period_start_us, period_end_us): the merged periods."""
    marked = label_islands(df, entity, start, end, slice_us)
    opened = marked.groupBy("entity", "slice").agg(F.max("island").alias("last_open"))
    earlier = Window.partitionBy("entity").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = opened.select("entity", "slice", F.max("last_open").over(earlier).alias("open_before"))
    return (
        marked.join(carried, ["entity", "slice"])
        .withColumn("period_start_us", F.coalesce("island", "open_before"))
        .groupBy("entity", "period_start_us")
        .agg(F.max("e").alias("period_end_us"))
    )
