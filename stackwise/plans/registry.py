"""Named queries of the engine and the SQL that gives the same rows."""

from __future__ import annotations

from . import catalog_queries, function_queries, library_queries, search_queries, state_queries

MODULES = [catalog_queries, function_queries, search_queries, state_queries, library_queries]


def queries() -> dict:
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def oracles() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in m.ORACLES.items()}


def flagship(spark, sf_dir: str):
    return queries()["t14_search"](spark, sf_dir)
