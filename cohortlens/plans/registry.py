"""Queries and oracles by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.plans.oracle import sql

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None, floats: str = "") -> Callable[[Query], Query]:
    """Register a query and its oracle.

    Floats are brought to six decimals, and -0.0 to 0.0, on both sides; ``floats`` names those of the oracle.
    """

    def add(f: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = f(spark, sf_dir)
            return df.select(*[(F.round(F.col(f"`{c}`"), 6) + F.lit(0.0)).alias(c) if t in ("double", "float") else F.col(f"`{c}`") for c, t in df.dtypes])

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        QUERIES[name] = run
        if oracle is not None:
            rounded = ", ".join(f"round({c}::DOUBLE, 6) + 0.0::DOUBLE AS {c}" for c in floats.split())
            ORACLES[name] = sql(f"SELECT * REPLACE ({rounded}) FROM ({oracle})" if floats else oracle)
        return f

    return add
