"""The catalogue: every query with the DuckDB SQL that checks it, where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(run: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return add


def rounded(df: DataFrame, places: int, *columns: str) -> DataFrame:
    """Round the named double columns (all of them by default), for comparison only."""
    names = set(columns or [f.name for f in df.schema if isinstance(f.dataType, T.DoubleType)])
    return df.selectExpr(*[f"round(`{c}`, {places}) AS `{c}`" if c in names else f"`{c}`" for c in df.columns])
