"""Applying a change feed of inserts, updates and deletes in its true order.

Method: per-key ordered replay. The feed is range-partitioned by (key,
sequence) and sorted by it within partitions; a state machine runs over each
partition, skips sequences already applied and applies partial-column updates.
One key may hold a third of all rows, and the range partitioning may cut such a
key into several runs; each run is therefore reduced to a function of the state
before it (what it does to an absent and to an existing row), and the few runs
of a key are composed in order afterwards.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runweave.functions.texts import strip

_SUMMARY = "key string, s1 long, s2 long, resets boolean, state map<string,string>, absent map<string,string>"
_ARROW = pa.schema(
    [
        ("key", pa.string()),
        ("s1", pa.int64()),
        ("s2", pa.int64()),
        ("resets", pa.bool_()),
        ("state", pa.map_(pa.string(), pa.string())),
        ("absent", pa.map_(pa.string(), pa.string())),
    ]
)


def normalise_op(op):
    """insert, update, override or delete; other texts come out as they are, in lower case."""
    return F.regexp_replace(F.lower(strip(op)), "_job$", "")


class _Run:
    """What a run of consecutive changes of one key does to the state before it.

    state: after a reset the state itself (None: no row), before any reset the
    changes to an existing row, with None for cleared attributes.
    absent: before any reset, the state if there was no row.
    """

    __slots__ = ("absent", "resets", "state")

    def __init__(self) -> None:
        self.resets, self.state, self.absent = False, {}, None

    def apply(self, op: str, attrs: list, create_attr: str) -> None:
        if op == "insert":
            self.resets, self.absent = True, None
            self.state = {k: v for k, v in attrs if v is not None}
        elif op == "delete":
            self.resets, self.state, self.absent = True, None, None
        elif self.resets:
            self.state = self._merged(self.state, attrs, create_attr)
        else:
            self.absent = self._merged(self.absent, attrs, create_attr)
            self.state.update(attrs)

    @staticmethod
    def _merged(state: dict | None, attrs: list, create_attr: str) -> dict | None:
        if state is None:
            if not any(k == create_attr and v is not None for k, v in attrs):
                return None
            state = {}
        for k, v in attrs:
            if v is None:
                state.pop(k, None)
            else:
                state[k] = v
        return state


def _replayer(create_attr: str, rows_a_batch: int = 2000):
    def replay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        key, run, first, last = None, None, None, None

        def flush() -> pa.RecordBatch:
            cols = list(zip(*out, strict=True))
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _ARROW, strict=True)], schema=_ARROW)

        def close() -> None:
            items = lambda m: None if m is None else list(m.items())
            out.append((key, *first, run.resets, items(run.state), items(run.absent)))

        for b in batches:
            for k, s1, s2, op, names, values in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if run is None or k != key:
                    if run is not None:
                        close()
                    key, run, first, last = k, _Run(), (s1, s2), None
                if last == (s1, s2):
                    continue  # this change was applied already
                last = (s1, s2)
                run.apply(op, list(zip(names or [], values or [], strict=True)), create_attr)
                if len(out) >= rows_a_batch:
                    yield flush()
        if run is not None:
            close()
        if out:
            yield flush()

    return replay


def current_state(
    feed: DataFrame,
    key: str,
    op: str,
    attrs: str,
    sequence: tuple[str, str],
    arrival: str,
    create_attr: str = "job_type",
) -> DataFrame:
    """(key, state map): the rows that exist after all changes, with their attributes.

    A change is identified by its sequence pair; of repeated arrivals the first
    is applied. Attribute names come out in lower case (of names that differ
    only in case within a change the last one counts); a value NULL in any case
    clears the attribute. Inserts replace the row. Updates and overrides merge;
    without a row they create it when they carry create_attr, else they do
    nothing. Rows without key or sequence and unknown ops are left out. A NULL
    map counts as empty; an empty feed gives no rows. Only the named columns
    are read, so others can't clash.
    """
    value = lambda v: F.when(F.upper(strip(v)) != "NULL", v)
    ordered = (
        feed.select(
            F.col(key).alias("key"),
            F.col(sequence[0]).cast("long").alias("s1"),
            F.col(sequence[1]).cast("long").alias("s2"),
            normalise_op(F.col(op)).alias("op"),
            F.transform(F.map_keys(attrs), lambda k: F.lower(strip(k))).alias("names"),
            F.transform(F.map_values(attrs), value).alias("values"),
            F.col(arrival).alias("arrival"),
        )
        .where("key is not null and s1 is not null and s2 is not null and op in ('insert','update','override','delete')")
        .repartitionByRange("key", "s1", "s2")
        .sortWithinPartitions("key", "s1", "s2", "arrival")
        .drop("arrival")
    )
    return _compose(ordered.mapInArrow(_replayer(create_attr), _SUMMARY))


def _compose(runs: DataFrame) -> DataFrame:
    """The runs of each key, in order, applied to no row at all (a key has few: one for each partition it lies in)."""
    listed = F.sort_array(F.collect_list(F.struct("s1", "s2", F.struct("resets", F.map_entries("state").alias("state"), F.map_entries("absent").alias("absent")).alias("r"))))
    fold = """aggregate(runs, cast(null as map<string,string>), (acc, x) -> case
        when x.r.resets then map_from_entries(x.r.state)
        when acc is null then map_from_entries(x.r.absent)
        else map_filter(map_concat(
          map_filter(acc, (k, v) -> not exists(x.r.state, e -> e.key = k)), map_from_entries(x.r.state)), (k, v) -> v is not null)
      end)"""
    return runs.groupBy("key").agg(listed.alias("runs")).select("key", F.expr(fold).alias("state")).where("state is not null")


def attributes(state: DataFrame) -> DataFrame:
    """(key, attr_name, attr_value): one row for each attribute."""
    return state.select("key", F.explode("state").alias("attr_name", "attr_value"))
