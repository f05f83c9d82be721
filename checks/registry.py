"""Queries by name, each with the SQL that must give the same rows (where SQL can)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
_written: dict[tuple, DataFrame] = {}


def check(name: str, query: Query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql is not None:
        ORACLES[name] = sql


def once(spark: SparkSession, folder: str, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """A result several queries start from, made once per session (it is a written table)."""
    key = (spark.sparkContext.applicationId, folder, name)
    if key not in _written:
        _written[key] = make()
    return _written[key]


def forget() -> None:
    """Make such tables anew from now on."""
    _written.clear()
