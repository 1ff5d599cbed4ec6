"""Named queries over the given tables, each next to the SQL that has to agree with it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


def r(expression: str, digits: int) -> str:
    """Half-up rounding of a DOUBLE in SQL, over ten decimals."""
    return f"cast(round(cast({expression} as decimal(30,10)), {digits}) as double)"


def signed(expression: str) -> str:
    short = r(expression, 2)
    return (
        f"case when ({expression}) < 0 and {short} = 0 then '-0.00' "
        f"else printf('%+.2f', {short}) end"
    )
