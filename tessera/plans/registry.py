"""Register of named queries, each a function of the model, with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.fixtures import Memory, with_model
from tessera.sources.shared import ship_code

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, *model: str):
    """Register a function of Memory under its name; sql sees the named model tables as common table expressions."""

    def add(f: Callable[[Memory], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_code(spark)
            return f(Memory(spark, sf_dir))

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        QUERIES[f.__name__] = run
        if sql:
            ORACLE_SQL[f.__name__] = with_model(sql, *model) if model else sql.strip()
        return f

    return add


def r6(x: Column | str, name: str | None = None) -> Column:
    """Rounded to six digits, off the half-way points that sums in another order could cross."""
    out = F.round((F.col(x) if isinstance(x, str) else x) + 1e-9, 6)
    return out.alias(name or x) if name or isinstance(x, str) else out


def whole(x: Column | str, name: str | None = None) -> Column:
    out = (F.col(x) if isinstance(x, str) else x).cast("long")
    return out.alias(name or x) if name or isinstance(x, str) else out
