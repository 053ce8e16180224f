"""Registered queries over the given tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from workload import checking, diagnosing, evidence, filing, planning, profiling, runs, screening, transforming

FAMILIES = (profiling, diagnosing, transforming, planning, checking, screening, runs, filing, evidence)

Query = Callable[[SparkSession, str], DataFrame]


def all_queries() -> dict[str, Query]:
    return {name: q for family in FAMILIES for name, q in family.QUERIES.items()}


def all_sql() -> dict[str, str]:
    return {name: sql for family in FAMILIES for name, sql in family.SQL.items()}
