"""Registry of named queries: ``name -> (fn(spark, sf_dir) -> DataFrame, oracle SQL | None)``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Decorator: register ``fn`` under ``name`` with its (optional) exact SQL oracle."""
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return deco


def load_all() -> None:
    from . import (q_core, q_splits, q_text, q_pairwise, q_frames, q_reports, q_sources, q_merge, q_predict,  # noqa: F401
                   q_streams)
