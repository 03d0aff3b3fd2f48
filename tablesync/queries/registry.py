"""Registry of runnable queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tablesync.tables import Tables, ansi_view

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

NOW = "2024-01-30 23:58:00"
"""Fixed reference time of every query that asks "as of when"."""


def query(name: str, sql: str | None = None, views: str = ""):
    """Register ``fn(tables) -> DataFrame`` under ``name``.

    ``sql`` is the equivalent ANSI text; ``views`` names the adapter views it reads.
    """

    def register(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if sql is not None:
            body = sql.strip()
            if views:
                ctes = ",\n".join(f"{v} AS ({ansi_view(v)})" for v in views.split())
                body = f"WITH {ctes}\nSELECT * FROM (\n{body}\n)"
            ORACLES[name] = body
        return fn

    return register
