"""Numbers of rows in a total order, without a single task that holds them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runweave.session import cut


def numbered(df: DataFrame, order: list[Column], name: str = "position") -> DataFrame:
    """df with the place of each row, from 1, in the order; rows that tie come in any order.

    Rows are range-partitioned and sorted; the driver gets one count for each
    partition. A column of that name is replaced. An empty table gives no rows.
    """
    df = df.drop(name, "_part", "_at")
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = cut(rows.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("_at")))
    before, starts = 0, []
    for r in rows.groupBy("_part").count().orderBy("_part").collect():
        starts.append((r["_part"], before))
        before += r["count"]
    offsets = df.sparkSession.createDataFrame(starts, "_part int, _start long")
    return rows.join(F.broadcast(offsets), "_part").select(*df.columns, (F.col("_start") + F.col("_at") + 1).alias(name))
