"""State from logs of changes: latest-wins, upserts that keep columns, replacement by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: list[str], order: list[str], removed: Column | None = None) -> DataFrame:
    """The last row of each key in the order, without those that say the key is removed.

    max_by combines map-side, so a key with very many changes is no hot group. Rows
    with a NULL in the keys form keys of their own; ties in the order go to any row.
    """
    rest = [c for c in df.columns if c not in keys]
    gone = F.coalesce(removed, F.lit(False)) if removed is not None else F.lit(False)
    last = df.withColumn("_gone", gone).groupBy(*keys).agg(F.max_by(F.struct("_gone", *rest), F.struct(*order)).alias("_x"))
    return last.where("not _x._gone").select(*keys, *[F.col(f"_x.{c}").alias(c) for c in rest])


def patched(df: DataFrame, keys: list[str], seq: str, resets: Column, attributes: list[str]) -> DataFrame:
    """(keys, attributes): rows that reset a key set all its attributes, others only those that aren't NULL; keys never reset don't exist.

    Two map-side combined aggregations: where each key begins, and the last value of each attribute from there on.
    """
    start = df.where(resets).groupBy(*keys).agg(F.max(seq).alias("_from"))
    live = df.join(start, keys).where(F.col(seq) >= F.col("_from"))
    pick = lambda a: F.max_by(F.when(F.col(a).isNotNull(), F.col(a)), F.when(F.col(a).isNotNull(), F.col(seq))).alias(a)
    return live.groupBy(*keys).agg(*[pick(a) for a in attributes])


def upsert(target: DataFrame, new: DataFrame, key: str, kept: dict[str, Column]) -> DataFrame:
    """target with the rows of new put in place of those of the same key; the columns in kept stay as they were, with a default for new keys."""
    old = target.select(F.col(key).alias("_key"), *[F.col(c).alias(f"_old_{c}") for c in target.columns if c != key])
    fresh = new.withColumn("_new", F.lit(True))
    both = old.join(fresh, old["_key"] == fresh[key], "full")
    cols = [F.coalesce("_key", key).alias(key)]
    for c in target.columns:
        if c == key:
            continue
        if c in kept:
            cols.append(F.when(F.col("_key").isNotNull(), F.col(f"_old_{c}")).otherwise(kept[c]).alias(c))
        else:
            cols.append(F.when(F.col("_new"), F.col(c)).otherwise(F.col(f"_old_{c}")).alias(c))
    return both.select(*cols)


def replaced(target: DataFrame, new: DataFrame, by: str) -> DataFrame:
    """target without the rows of any value of `by` that new has, and new."""
    return target.join(new.select(by).distinct(), by, "left_anti").select(*target.columns).unionByName(new.select(*target.columns))
