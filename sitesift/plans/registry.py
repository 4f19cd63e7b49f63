"""Registry of the named queries and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sitesift.plans.bindings import Source, cte

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register ``fn(source) -> DataFrame`` under ``name``."""

    def register(fn: Callable[[Source], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = lambda spark, folder: fn(Source(spark, folder))
        if oracle is not None:
            ORACLES[name] = cte(oracle)
        return fn

    return register


def scalar(name: str, source: str, keys: list[str], made, checked: dict[str, str]) -> None:
    """Register a query that adds Column functions to the rows of ``source``.

    ``source`` is SQL for both engines; ``made()`` gives the columns by name
    and ``checked`` the SQL of the same columns.
    """
    listed = ", ".join([*keys, *[f"{sql} AS {out}" for out, sql in checked.items()]])
    text = source.strip()
    if text.upper().startswith("WITH"):
        raise ValueError("source must be a plain SELECT")
    oracle = f"WITH i AS ({text})\nSELECT {listed} FROM i"

    @query(name, oracle)
    def run(s: Source) -> DataFrame:
        columns = made()
        assert list(columns) == list(checked), name
        return s.sql(text).select(*keys, *[c.alias(out) for out, c in columns.items()])


def rounded(sql: str, digits: int = 6) -> str:
    """SQL rounding that leaves no negative zero."""
    return f"(ROUND({sql}, {digits}) + 0e0)"
