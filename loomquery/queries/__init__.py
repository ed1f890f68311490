"""Registered queries and their DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def wide(sql: str, *columns: str) -> str:
    """An oracle whose columns have 64 bits, as the engine's integers have."""
    return f"SELECT * REPLACE ({', '.join(f'CAST({c} AS BIGINT) AS {c}' for c in columns)}) FROM ({sql}) AS q"


def register(name: str, oracle: str | None = None):
    """Register a (spark, sf_dir) -> DataFrame function under a name."""

    def put(function):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = function
        if oracle:
            ORACLES[name] = oracle
        return function

    return put


def register_sql(name: str, text: str, oracle: str | None = None, *args) -> None:
    """Register a query of the dialect; the oracle is the same text unless one is given."""
    from loomquery.session import Session

    register(name, oracle or text)(lambda spark, sf_dir: Session(spark, sf_dir).sql(text, *args))


from loomquery.queries import aggregation, changes, functions, joins, pricing, relational, windows  # noqa: E402,F401
