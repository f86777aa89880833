"""Registry of named queries: ``name -> (spark, sf_dir) -> DataFrame`` plus optional oracle SQL.

Names follow ``<inventory id>_<slug>`` (SURVEY §2). Oracle SQL is DuckDB text over the driver
tables; queries without one are checked by pytest against a brute-force fixture instead.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE_SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query name {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE_SQL[name] = sql
        return fn
    return deco


def load_all() -> None:
    """Import every query module so its ``@register`` calls run."""
    from cadence.plans import ingest_adapters  # noqa: F401  (registers SQL adapters)
    from cadence.plans import (q_recommend, q_ingest, q_quality, q_feedback,  # noqa: F401
                               q_monitoring, q_sequences, q_sessions)
