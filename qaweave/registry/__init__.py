"""Registered queries over the test tables, with the SQL they must equal."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


def query(key: str, sql: str | None = None):
    """Register `fn(spark, sf_dir)` under a key, with its oracle text if any."""

    def add(fn):
        QUERIES[key] = fn
        if sql is not None:
            SQL[key] = sql.strip()
        return fn

    return add


def load_all() -> None:
    from qaweave.registry import corpus, pairs, retrieval, samples, text  # noqa: F401
