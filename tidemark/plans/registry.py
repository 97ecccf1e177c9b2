"""Where queries register themselves, each with its SQL for an independent engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers the decorated function (spark, sf_dir) as ``q_<its name>``."""
    def register(f):
        name = f"q_{f.__name__}"
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return register
