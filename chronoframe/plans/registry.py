"""The table of queries: each module of plans registers its own with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name; ``sql`` is its DuckDB text, where SQL can express it."""

    def register(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLES[function.__name__] = sql
        return function

    return register


def tidy(value: Column | str) -> Column:
    """To four places; a shade more than a half goes up, so that ties fall alike wherever sums are taken in another order."""
    return F.floor((F.col(value) if isinstance(value, str) else value) * 10000 + 0.500001) / 10000
