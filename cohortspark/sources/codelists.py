"""Codelists: tables of (system, list, code, category)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

SCHEMA = "system string, list string, code string, category string"


def read_codelist(spark: SparkSession, path: str, name: str, system: str, column: str = "code",
                  category: str | None = None) -> DataFrame:
    """A codelist file. Every column is read as text, so codes keep leading zeros."""
    raw = spark.read.csv(path, header=True, inferSchema=False)
    cat = F.col(category) if category else F.lit(None).cast("string")
    return raw.select(
        F.lit(system).alias("system"), F.lit(name).alias("list"), F.col(column).alias("code"), cat.alias("category"),
    ).where(F.col("code").isNotNull())


def codelist(spark: SparkSession, codes: Sequence[str], name: str, system: str) -> DataFrame:
    """A codelist written out in the program."""
    return spark.createDataFrame([(system, name, c, None) for c in codes], SCHEMA)


def combine_codelists(*lists: DataFrame, name: str) -> DataFrame:
    """Distinct codes of several lists under one name."""
    both = reduce(DataFrame.unionByName, lists)
    return both.withColumn("list", F.lit(name)).distinct()
