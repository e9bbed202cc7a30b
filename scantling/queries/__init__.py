"""Queries over the test tables, each with its SQL where SQL can express it."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from scantling.session import checkpoint_dir
from scantling.sources import store

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its name in the operator inventory."""

    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder in the shared checkpoint folder, for queries that write and read again."""
    base = checkpoint_dir(spark)
    path = f"{base}/scratch-{uuid.uuid4().hex}-{name}"
    atexit.register(store.remove, spark, path)
    return path


def load() -> tuple[dict[str, Query], dict[str, str]]:
    from scantling.queries import relational, sampling, scoring, sources, texts  # noqa: F401

    return dict(QUERIES), dict(SQL)
