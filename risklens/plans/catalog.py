"""The query catalogue: one Spark plan per operator key, each with its DuckDB
oracle SQL registered next to it (omitted for keys that are not expressible
in SQL: model training, scoring, attribution, writes, streaming).

Every query reads the driver tables under ``sf_dir`` (through the mapping in
``risklens.sources.testdata``) and runs over the whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir) -> DataFrame`` under ``name``."""
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query key {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def load_all() -> None:
    """Import every module that registers queries."""
    import importlib
    for mod in MODULES:
        importlib.import_module(f"risklens.plans.{mod}")


MODULES = ["q_drift", "q_features", "q_reports", "q_state", "q_model"]
