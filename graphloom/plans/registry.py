"""All named queries with their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from graphloom.session import Data, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    """Registers f(data) under ``name``; ``sql`` is what DuckDB runs for the same rows (None: not expressible)."""

    def register(f: Callable[[Data], DataFrame]) -> Callable[[Data], DataFrame]:
        if name in QUERIES:
            raise ValueError(f"two queries are named {name}")
        QUERIES[name] = lambda spark, sf_dir: f(Data(spark, sf_dir))
        if sql is not None:
            ORACLE[name] = with_views(sql)
        return f

    return register


def _load() -> None:
    import importlib

    for m in ("aggregates", "joins", "windows", "predicates", "graph", "retrieval", "text", "resolution", "temporal", "sales", "streams", "sources"):
        importlib.import_module(f"graphloom.plans.{m}")


_load()
