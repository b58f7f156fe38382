"""Registration of queries with their SQL statement, and the shared output form."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from .fixtures import SQL

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def R(expression: str, digits: int = 6) -> str:
    """SQL rounding that matches `present`."""
    scale = 10**digits
    return f"round_even(({expression})*{scale}.0,0)/{scale}.0 + 0.0"


def present(df: DataFrame) -> DataFrame:
    """Doubles to 6 places, whole numbers to bigint, dates to text."""
    columns = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        if kind in ("double", "float"):
            c = F.rint(c.cast("double") * 1e6) / 1e6 + 0.0
        elif kind in ("int", "smallint", "tinyint", "bigint"):
            c = c.cast("bigint")
        elif kind == "date":
            c = c.cast("string")
        columns.append(c.alias(name))
    return df.select(*columns)


def query(name: str, sql: str | None = None, needs: Sequence[str] = ()):
    """Register a query; `needs` names the fixtures its SQL reads."""
    def register(function):
        QUERIES[name] = lambda spark, folder: present(function(spark, folder))
        if sql is not None:
            ORACLES[name] = with_fixtures(sql, needs)
        return function
    return register


def with_fixtures(sql: str, needs: Sequence[str]) -> str:
    if not needs:
        return sql
    parts = ", ".join(f"{n} AS ({SQL[n]})" for n in needs)
    body = sql.strip()
    if body.upper().startswith("WITH "):
        return f"WITH {parts}, {body[5:]}"
    return f"WITH {parts} {body}"
