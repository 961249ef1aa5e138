"""Query catalog: name → (Spark callable, DuckDB oracle SQL or None)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    fn: QueryFn
    oracle: str | None
    group: str


_QUERIES: dict[str, Query] = {}


def query(name: str, oracle: str | None = None, group: str = ""):
    """Register a query; ``oracle`` is DuckDB SQL over the driver tables."""

    def deco(fn: QueryFn) -> QueryFn:
        if name in _QUERIES:
            raise ValueError(f"duplicate query {name}")
        _QUERIES[name] = Query(name, fn, oracle, group)
        return fn

    return deco


def all_queries() -> dict[str, Query]:
    return dict(_QUERIES)
