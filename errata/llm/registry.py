"""Registered queries of the subpackage: one ``opN_<name>`` per operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, QueryFn] = {}
_ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register a query, with DuckDB SQL for its rows where SQL can express it."""

    def deco(fn: QueryFn) -> QueryFn:
        if name in _QUERIES:
            raise ValueError(f"duplicate query {name}")
        _QUERIES[name] = fn
        if oracle is not None:
            _ORACLES[name] = oracle
        return fn

    return deco


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, read by Spark from wherever it lies."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def queries() -> dict[str, QueryFn]:
    from errata.llm import queries as _  # noqa: F401  fills the registry

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    from errata.llm import queries as _  # noqa: F401

    return dict(_ORACLES)
