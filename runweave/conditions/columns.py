"""Conditions on DataFrames: edges, evaluation of many conditions, and a single condition as a Column."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runweave.conditions.language import FALSE_OF_NOTRUNNING, TRUE_OF, ConditionError, parse

_TEXTS = ("kind", "test", "name", "instance")
_STEP = T.StructType(
    [T.StructField("at", T.IntegerType())]
    + [T.StructField(n, T.StringType()) for n in _TEXTS]
    + [T.StructField("hours", T.DoubleType()), T.StructField("comparison", T.StringType()), T.StructField("literal", T.StringType())]
)
_PARSED = T.StructType([T.StructField("steps", T.ArrayType(_STEP)), T.StructField("error", T.StringType())])


@F.pandas_udf(_PARSED)
def _parsed(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for s in texts:
        rows = []
        for t in s:
            try:
                steps = [] if not t or not t.strip() else parse(t)
                rows.append(([{"at": i, **x.__dict__} for i, x in enumerate(steps)], None))
            except ConditionError as e:
                rows.append((None, str(e)))
        yield pd.DataFrame(rows, columns=["steps", "error"])


def parsed(df: DataFrame, condition: str) -> DataFrame:
    """(condition, steps, error): each distinct condition parsed once."""
    return df.select(F.col(condition).alias("condition")).where("condition is not null").distinct().withColumn("p", _parsed("condition")).select("condition", "p.steps", "p.error")


def edges(df: DataFrame, job: str, condition: str, runtime: bool = False) -> DataFrame:
    """(job, dep): jobs that each job's condition refers to, once each.

    For analysis, references to other instances are left out, and names are
    picked by pattern from conditions that don't parse; at run time, instances
    are ignored and such conditions refer to nothing.
    """
    known = parsed(df, condition)
    refs = F.filter("steps", lambda s: s["kind"].isin("status", "exit") & (F.lit(runtime) | s["instance"].isNull()))
    names = F.transform(refs, lambda s: s["name"])
    if not runtime:
        names = F.coalesce(names, F.regexp_extract_all("condition", F.lit(r"(?i)(?<![\w#.-])(?:success|failure|done|notrunning|terminated|exitcode|activated|[sfdnte])\s*\(\s*([A-Za-z0-9_#][A-Za-z0-9_.:%#-]*)(?!\^)\s*[,)]"), 1))
    deps = known.select(F.col("condition").alias("_c"), F.explode(F.array_distinct(names)).alias("dep"))
    return df.select(F.col(job).alias("job"), F.col(condition).alias("_c")).join(deps, "_c").select("job", "dep").distinct()


def _compared(value: Column, comparison: Column, literal: Column) -> Column:
    """= and != compare texts, order compares numbers if both sides are numbers, else texts."""
    a, b = value.try_cast("double"), literal.try_cast("double")
    by = lambda x, y: F.when(comparison == "<", x < y).when(comparison == "<=", x <= y).when(comparison == ">", x > y).when(comparison == ">=", x >= y)
    ordered = F.when(a.isNotNull() & b.isNotNull(), by(a, b)).otherwise(by(value, literal))
    return F.when(comparison == "=", value == literal).when(comparison == "!=", value != literal).otherwise(ordered)


def _status_true(test: Column, status: Column) -> Column:
    out = F.when(test == "notrunning", ~status.isin(*FALSE_OF_NOTRUNNING))
    for name, good in TRUE_OF.items():
        out = out.when(test == name, status.isin(*good))
    return out


def evaluate(df: DataFrame, job: str, condition: str, states: DataFrame, globals_: DataFrame, now: Column) -> DataFrame:
    """(job, satisfied): whether each job's condition holds.

    states: name, status (a name), exit_code, last_end. globals_: name, value.
    Unknown jobs are INACTIVE, a missing exit code fails every comparison, a
    missing global is empty. A look-back holds if the test does and the job's
    last end lies at most so many hours back (0: any time). Blank and NULL
    conditions hold; conditions that don't parse don't. The leaves of all
    conditions meet the states in one join; the steps are then folded over a
    stack within each row.
    """
    rows = df.select(F.col(job).alias("job"), F.col(condition).alias("condition"))
    known = parsed(df, condition)
    leaves = known.select("condition", F.explode("steps").alias("s")).select("condition", "s.*")
    state = states.select(F.col("name").alias("_n"), "status", "exit_code", "last_end")
    value = globals_.select(F.upper("name").alias("_g"), "value")
    joined = leaves.join(state, leaves["name"] == state["_n"], "left").join(value, F.upper(leaves["name"]) == value["_g"], "left")
    back = F.unix_seconds(now.cast("timestamp")) - F.unix_seconds(F.col("last_end").cast("timestamp"))
    recent = F.col("hours").isNull() | (F.col("hours") == 0) | F.coalesce(back.between(0, F.col("hours") * 3600), F.lit(False))
    truth = (
        F.when(F.col("kind") == "status", _status_true(F.col("test"), F.coalesce("status", F.lit("INACTIVE"))) & recent)
        .when(F.col("kind") == "exit", _compared(F.col("exit_code").cast("string"), F.col("comparison"), F.col("literal")))
        .when(F.col("kind") == "value", _compared(F.coalesce("value", F.lit("")), F.col("comparison"), F.col("literal")))
    )
    steps = joined.groupBy("condition").agg(F.sort_array(F.collect_list(F.struct("at", "kind", F.coalesce(truth, F.lit(False)).alias("truth")))).alias("steps"))
    fold = """aggregate(steps, cast(array() as array<boolean>), (st, x) -> case
        when x.kind = 'not' then concat(slice(st, 1, size(st) - 1), array(not st[size(st) - 1]))
        when x.kind = 'and' then concat(slice(st, 1, size(st) - 2), array(st[size(st) - 2] and st[size(st) - 1]))
        when x.kind = 'or' then concat(slice(st, 1, size(st) - 2), array(st[size(st) - 2] or st[size(st) - 1]))
        else concat(st, array(x.truth)) end)[0]"""
    folded = steps.select(F.col("condition").alias("_c"), F.expr(fold).alias("_t"))
    out = rows.join(folded, rows["condition"] == folded["_c"], "left")
    blank = F.col("condition").isNull() | (F.trim("condition") == "")
    return out.select("job", F.when(blank, True).otherwise(F.coalesce("_t", F.lit(False))).alias("satisfied"))


def as_column(condition: str, status_of, exit_of, global_of) -> Column:
    """One condition as a Column, given functions that make a Column of a job's status name, exit code text and a global."""
    stack: list[Column] = []
    for s in parse(condition):
        if s.kind == "not":
            stack.append(~stack.pop())
        elif s.kind in ("and", "or"):
            b, a = stack.pop(), stack.pop()
            stack.append(a & b if s.kind == "and" else a | b)
        elif s.kind == "status":
            status = F.coalesce(status_of(s.name), F.lit("INACTIVE"))
            stack.append(~status.isin(*FALSE_OF_NOTRUNNING) if s.test == "notrunning" else status.isin(*TRUE_OF[s.test]))
        else:
            value = exit_of(s.name) if s.kind == "exit" else F.coalesce(global_of(s.name), F.lit(""))
            stack.append(F.coalesce(_compared(value, F.lit(s.comparison), F.lit(s.literal)), F.lit(False)))
    return stack[0] if stack else F.lit(True)
