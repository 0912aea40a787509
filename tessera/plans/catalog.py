"""Query catalogue: every registered key has a Spark callable
``(spark, sf_dir) -> DataFrame`` and, where SQL can express it, the DuckDB
oracle over the same driver tables."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
_ORACLE_PARTS: dict[str, tuple] = {}


def register(key: str, sql: str | None = None, views=()):
    def deco(fn):
        if key in QUERIES:
            raise KeyError(f"duplicate query key {key}")
        QUERIES[key] = fn
        if sql is not None:
            _ORACLE_PARTS[key] = (views, sql)
        return fn
    return deco


def load_queries() -> dict[str, Callable]:
    """Import the modules that register queries."""
    from tessera.plans import (q_text, q_rows, q_vocab, q_stats, q_labels,  # noqa: F401
                               q_splits, q_vectors, q_links, q_metrics, q_sources, q_models)
    return QUERIES


def load_oracles() -> dict[str, str]:
    """Oracle SQL with the CTEs of its views, built only when asked for."""
    from tessera.plans.views import with_views
    load_queries()
    return {k: with_views(views, sql) for k, (views, sql) in _ORACLE_PARTS.items()}
