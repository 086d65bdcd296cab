"""Query registry: every entry pairs a Spark query with the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import pin_runtime
from ..sources.tables import NAMES, Tables
from .standins import Domain, with_ctes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
_OFFSET = 0.1234


def query(name: str, sql: str | None = None, uses: str = ""):
    """Register ``fn(domain) -> DataFrame`` under ``name``; ``uses`` names stand-in tables in ``sql``."""

    def wrap(fn: Callable[[Domain], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            pin_runtime(spark)
            return fn(Domain(Tables(spark, sf_dir)))

        run.__name__ = name
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = with_ctes(sql, uses.split())
        return fn

    return wrap


def r6(col: Column | str, digits: int = 6) -> Column:
    """Round a double so that the order of float additions cannot change the answer.

    The small offset moves exact halves (means over 8, 16, ... rows) off the rounding boundary.
    """
    col = F.col(col) if isinstance(col, str) else col
    return F.round(col.cast("double") + F.lit(_OFFSET * 10.0**-digits), digits)


def q6(expr: str, digits: int = 6) -> str:
    """The SQL twin of :func:`r6`; adding 0.0 turns a negative zero into zero."""
    return f"(round(CAST({expr} AS DOUBLE) + {_OFFSET * 10.0**-digits!r}, {digits}) + 0.0)"


__all__ = ["QUERIES", "ORACLES", "query", "r6", "q6", "NAMES"]
