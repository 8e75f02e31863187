"""Registry of named queries: each key maps to a Spark callable
``(spark, sf_dir) -> DataFrame`` and, where the result is SQL-expressible, to
an independent DuckDB oracle text over the same test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from errata.sources.workload import Dialect

QueryFn = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, QueryFn] = {}
_ORACLES: dict[str, Callable[[Dialect], str]] = {}
DUCK = Dialect("duckdb")


def query(name: str, oracle: Callable[[Dialect], str] | None = None):
    """Register ``fn`` as query ``name`` with an optional oracle builder."""

    def deco(fn: QueryFn) -> QueryFn:
        if name in _QUERIES:
            raise ValueError(f"duplicate query {name}")
        _QUERIES[name] = fn
        if oracle is not None:
            _ORACLES[name] = oracle
        return fn

    return deco


PLAN_MODULES = ["evaluation_plans", "names_plans", "tree_plans", "graph_plans", "detect_plans", "synth_plans", "corpus_plans", "prompt_plans", "training_plans", "linking_plans", "value_plans", "context_plans", "prompting_plans", "entity_plans", "render_plans", "source_plans"]


def _load_all() -> None:
    # importing the plan modules fills the registry
    import importlib

    for m in PLAN_MODULES:
        importlib.import_module(f"errata.plans.{m}")


def queries() -> dict[str, QueryFn]:
    _load_all()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load_all()
    return {k: f(DUCK) for k, f in _ORACLES.items()}
