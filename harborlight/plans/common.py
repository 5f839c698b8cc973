"""Registry of queries: name, Spark callable and oracle SQL side by side."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, dates: str = "") -> Callable[[Query], Query]:
    """Register a query under its function's name; times are UTC, as naive times are in the tables.

    ``dates`` names the columns that are dates: both sides give them as text, which compares alike everywhere.
    """
    days = dates.split()

    def add(f: Query) -> Query:
        @wraps(f)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            df = f(spark, sf_dir)
            return df.withColumns({c: df[c].cast("string") for c in days}) if days else df

        QUERIES[f.__name__] = run
        if sql:
            ORACLE_SQL[f.__name__] = f"SELECT * REPLACE ({', '.join(f'CAST({c} AS VARCHAR) AS {c}' for c in days)}) FROM ({sql})" if days else sql
        return run

    return add


def r(expression: str, digits: int) -> str:
    """Half-up rounding, as harborlight.functions.numbers.half_up."""
    return f"floor(({expression}) * 1e{digits} + 0.500001) / 1e{digits}"


def seconds(expression: str) -> str:
    return f"CAST(floor(epoch({expression})) AS BIGINT)"
