"""Registry of checkable queries: a Spark function and, where one exists, the same result as SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession, functions as F

from study_queries.rounding import DIGITS, DOUBLES

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _rounded(fn, columns: list[str]):
    @wraps(fn)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(spark, sf_dir).withColumns({c: F.round(c, DIGITS) for c in columns})

    return run


def _rounded_sql(sql: str, columns: list[str]) -> str:
    # adding zero turns a negative zero into zero
    parts = ", ".join(f'round("{c}", {DIGITS}) + 0.0::DOUBLE AS "{c}"' for c in columns)
    return f"SELECT * REPLACE ({parts}) FROM (\n{sql}\n) q"


def query(sql: str | None = None, name: str | None = None):
    """Register the decorated function under its own name; its double columns are rounded on both sides."""

    def add(fn):
        key = name or fn.__name__
        if key in QUERIES:
            raise ValueError(f"query {key} registered twice")
        columns = DOUBLES.get(key, "").split() if sql is not None else []
        QUERIES[key] = _rounded(fn, columns) if columns else fn
        if sql is not None:
            ORACLE[key] = _rounded_sql(sql, columns) if columns else sql
        return fn

    return add
