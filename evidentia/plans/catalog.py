"""Registered queries of the reference's operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from . import cascade_queries, chunk_queries, coverage_queries, dispatch_queries, hybrid_queries, reference_queries, rule_queries, source_queries

MODULES = (reference_queries, rule_queries, chunk_queries, coverage_queries, hybrid_queries, cascade_queries, source_queries, dispatch_queries)


def queries() -> dict[str, Callable]:
    return {name: q for m in MODULES for name, q in m.QUERIES.items()}


def without_sql() -> dict[str, Callable]:
    """Queries whose SQL would take too long or give no rows; tests hold them against small fixtures."""
    return {name: q for m in MODULES for name, q in m.WITHOUT_SQL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: s for m in MODULES for name, s in m.ORACLE_SQL.items()}
