"""Registered queries, each next to its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Run = Callable[[SparkSession, str], DataFrame]
RUNS: dict[str, Run] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Run], Run]:
    """Register a query; without SQL it is checked for rows only."""
    def keep(fn: Run) -> Run:
        if name in RUNS:
            raise ValueError(f"query {name} registered twice")
        RUNS[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return keep


def steady_col(c: Column, digits: int) -> Column:
    """Rounded with a small offset, so that exact halves and signed zeros are not on the edge."""
    return F.round(c + 2.71 * 10 ** -(digits + 2), digits)
