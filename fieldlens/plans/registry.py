"""Registration of queries and their SQL; fieldlens.plans.catalog loads all of them."""

from __future__ import annotations

from collections.abc import Callable

from fieldlens.sources.fixtures import Tables, duckdb_sql

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None) -> Callable:
    """Registers f(tables) under a name; sql gives DuckDB the same rows."""

    def add(f: Callable) -> Callable:
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            ORACLES[name] = duckdb_sql(sql)
        return f

    return add
