"""Named queries, each with its Spark plan and, where SQL can say it, an equivalent ANSI-style text.

Every query declares its output as ``"name type, ..."`` with type letters
``s`` string, ``i`` bigint, ``d`` double (published at six decimals), ``t`` date, ``b`` boolean.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from reprise.functions.columns import r6
from reprise.plans.domain import Tables, with_ctes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

_SPARK = {"s": lambda c: c.cast("string"), "i": lambda c: c.cast("bigint"), "d": r6,
          "t": lambda c: c.cast("date"), "b": lambda c: c.cast("boolean")}
_SQL = {"s": "CAST({c} AS VARCHAR)", "i": "CAST({c} AS BIGINT)", "d": "round(CAST({c} AS DOUBLE), 6) + 0.0",
        "t": "CAST({c} AS DATE)", "b": "CAST({c} AS BOOLEAN)"}


def _parse(spec: str) -> list[tuple[str, str]]:
    return [tuple(part.split()) for part in spec.split(",")]


def query(name: str, spec: str, sql: str | None = None, need: str = ""):
    """Register ``fn(tables) -> DataFrame`` with its output spec and optional SQL over the named CTEs."""
    cols = _parse(spec)

    def wrap(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"duplicate query: {name}")
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir)).select(
            *[_SPARK[t](F.col(c)).alias(c) for c, t in cols])
        if sql is not None:
            outer = ", ".join(f'{_SQL[t].format(c=c)} AS {c}' for c, t in cols)
            ORACLES[name] = with_ctes(need.split(), f"SELECT {outer} FROM ({sql}) AS q")
        return fn

    return wrap
