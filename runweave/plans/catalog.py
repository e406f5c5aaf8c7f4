"""All core queries and their SQL by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from runweave.plans import aggregates, analytics, assessment, boxes, checks, ingest, mutations, operations, problems, rollups, selections, streams  # noqa: F401
from runweave.plans.registry import QUERIES, SQL


def flagship(spark: SparkSession, d: str) -> DataFrame:
    return aggregates.operational_risk(spark, d)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {**problems.QUERIES, **QUERIES}


def oracle_sql() -> dict[str, str]:
    return {**problems.SQL, **SQL}
