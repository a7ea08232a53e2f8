"""The registered queries of the library and the SQL that gives the same rows."""

from __future__ import annotations

from importlib import import_module

MODULES = ("hot_keys", "scans", "rollups", "texts", "pipelines", "workflows")


def _all(what: str) -> dict:
    found: dict = {}
    for name in MODULES:
        found.update(getattr(import_module(f"rulewake.plans.{name}"), what))
    return found


def queries() -> dict:
    """Name to function of (spark, folder)."""
    return _all("QUERIES")


def oracle_sql() -> dict:
    """Name to SQL, where SQL can express the query."""
    return _all("SQL")
