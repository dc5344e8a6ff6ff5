"""The catalogue of registered queries: name, Spark callable, and SQL twin where one exists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under ``name``; ``sql`` is its twin over the same tables."""

    def register(run: Query) -> Query:
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return register


def load() -> tuple[dict[str, Query], dict[str, str]]:
    from . import features, geography, learning, quality, rollups, sources, streams, windows  # noqa: F401

    return QUERIES, ORACLES
