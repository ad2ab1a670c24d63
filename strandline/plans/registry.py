"""All queries of the sequence engine with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers the decorated function under `name`."""

    def put(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


def load() -> None:
    """Registers the queries of all plan modules."""
    from . import codecs, files, pixels, sequences, streaming, streams, tiles, twins, variants  # noqa: F401


load()
