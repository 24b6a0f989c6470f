"""All queries of the ride, reading, quality and store operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from wattloom.plans import landed, readings, rides, runs

TABLES = (rides, readings, landed, runs)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for t in TABLES for name, (query, _) in t.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for t in TABLES for name, (_, sql) in t.QUERIES.items() if sql}
