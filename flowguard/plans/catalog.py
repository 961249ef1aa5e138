"""Query name → callable and oracle SQL (imported by ``__spark_entry__``)."""

from __future__ import annotations

from . import drift_queries, eval_queries, io_queries, model_queries, ops_queries, prep_queries  # noqa: F401  (registration)
from .registry import Query, all_queries

__all__ = ["Query", "all_queries", "queries", "oracle_sql"]


def queries():
    return {name: q.fn for name, q in all_queries().items()}


def oracle_sql():
    return {name: q.oracle for name, q in all_queries().items() if q.oracle}
