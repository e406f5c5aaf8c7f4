"""Joins whose keys may be hot."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key that holds more than this part of all rows is hot.
HOT = 0.001
#: Over so many groups the rows of hot keys are spread.
SPREAD = 1000


def lookup(rows: DataFrame, facts: DataFrame, on: dict[str, str], n: str, values: list[str], hot: float = HOT, nulls: bool = True) -> DataFrame:
    """rows with the values of the fact row of their key, NULL where there is none.

    on: columns of rows to the key columns of facts; they match where equal, NULL with
    NULL, or never (nulls = False; rows with a NULL in the key then are spread as well). facts has one row for each key, n of which are rows; it is read three times
    and should be cut. Keys that hold more than `hot` of all rows are 1 / hot at most:
    they are answered by a broadcast, and their rows go on spread evenly. No other key
    is large enough to matter. Columns of rows that begin with _fact_ or are named as a
    value are left out.
    """
    rows = rows.drop(*[c for c in rows.columns if c.startswith("_fact_") or c in values])
    whole = facts.agg(F.sum(n)).head()[0] or 0
    keyed = facts.select(F.col(n).alias("_fact_n"), *[F.col(k).alias(f"_fact_{k}") for k in on.values()], *values)
    if not nulls:
        keyed = keyed.dropna(subset=[f"_fact_{k}" for k in on.values()])
    same = lambda df, part: reduce(lambda a, b: a & b, [df[c].eqNullSafe(part[f"_fact_{k}"]) for c, k in on.items()])
    keys = [f"_fact_{k}" for k in on.values()]
    large = keyed.where(F.col("_fact_n") > whole * hot).withColumnsRenamed({v: f"_fact_{v}_hot" for v in values})
    first = rows.join(F.broadcast(large), same(rows, large), "left").drop(*keys)
    settled = F.col("_fact_n").isNotNull()
    if not nulls:
        settled = settled | reduce(lambda a, b: a | b, [F.col(c).isNull() for c in on])
    spread = F.when(~settled, 0).otherwise(1 + F.pmod(F.xxhash64(*[F.col(c) for c in rows.columns]), F.lit(SPREAD)))
    first = first.withColumn("_fact_spread", spread.cast("int")).drop("_fact_n")
    small = keyed.where(F.col("_fact_n") <= whole * hot).drop("_fact_n").withColumn("_fact_spread_0", F.lit(0))
    both = first.join(small, same(first, small) & (first["_fact_spread"] == small["_fact_spread_0"]), "left")
    return both.select(*rows.columns, *[F.coalesce(f"_fact_{v}_hot", v).alias(v) for v in values])
