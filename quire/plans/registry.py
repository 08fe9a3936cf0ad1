"""Query registry: name -> (function of (spark, sf_dir), SQL for the same rows or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_FOUND: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def query(sql: str | None = None, name: str | None = None):
    """Registers a query function, with its SQL where SQL can express it."""

    def add(f):
        key = name or f.__name__
        if key in _FOUND:
            raise ValueError(f"two queries are named {key}")
        _FOUND[key] = (f, sql)
        return f

    return add


def _load() -> None:
    from quire.plans import catalogue  # noqa: F401  registers everything


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return {k: f for k, (f, _) in _FOUND.items()}


def oracle_sql() -> dict[str, str]:
    _load()
    return {k: sql for k, (_, sql) in _FOUND.items() if sql}
