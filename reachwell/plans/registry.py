"""How a query and its SQL twin are registered together."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reachwell.plans.binding import TABLES, Binding

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None, ctes: str = "", digits: int = 6, recursive: bool = False) -> Callable:
    """Registers ``f(binding)`` under its name, with SQL over the bound tables.

    Doubles are rounded on both sides, since sums of doubles depend on order.
    """

    def register(f: Callable[[Binding], DataFrame]) -> Callable:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = f(Binding(spark, sf_dir))
            return df.select(*[(F.round(c, digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])

        QUERIES[f.__name__] = run
        if sql is not None:
            with_ = "WITH RECURSIVE" if recursive else "WITH"
            ORACLE[f.__name__] = f"{with_} {TABLES.strip()}{',' + ctes if ctes else ''} {sql}"
        return f

    return register


def r(*columns: str, digits: int = 6) -> str:
    """SQL that rounds columns or ``expression AS name`` items."""
    out = []
    for c in columns:
        expression, _, name = c.rpartition(" AS ")
        out.append(f"round(CAST({expression or c} AS DOUBLE), {digits}) + CAST(0 AS DOUBLE) AS {name or c}")
    return ", ".join(out)
