"""Named queries over the driver's tables, each with SQL for a second engine where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

MODULES = ["metrics", "usage", "relations", "windows", "texts", "vectors", "dialogue", "documents", "decisions", "control", "more", "pieces", "records", "scripts", "surface", "books", "audits"]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def load() -> None:
    for name in MODULES:
        import_module(f"{__name__}.{name}")
