"""Reading, writing, checking and combining tables."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T


def read_table(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Columnar table; with a schema nothing is inferred."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.parquet(path)


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Columnar table, one folder per value of the partition columns."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=schema)


def write_csv(df: DataFrame, path: str, compress: bool = True) -> None:
    """Text table with ISO dates, gzip-compressed on request."""
    options = {"compression": "gzip"} if compress else {}
    df.write.mode("overwrite").csv(path, header=True, dateFormat="yyyy-MM-dd", **options)


def write_text_report(df: DataFrame, path: str, title: str) -> None:
    """A small summary table as plain text lines (title, column names, rows)."""
    line = F.concat_ws("\t", *[F.coalesce(F.col(c).cast("string"), F.lit("NA")) for c in df.columns])
    head = df.sparkSession.createDataFrame([(title,), ("\t".join(df.columns),)], "value string")
    head.unionByName(df.select(line.alias("value"))).coalesce(1).write.mode("overwrite").text(path)


def combine(parts: Iterable[tuple[Mapping[str, str], DataFrame]]) -> DataFrame:
    """Union of tables of the same kind, each tagged with where it comes from."""
    tagged = [df.select(*[F.lit(v).alias(k) for k, v in tags.items()], *df.columns) for tags, df in parts]
    return bind_rows(*tagged)


def bind_rows(*dfs: DataFrame) -> DataFrame:
    """Union by column name; a column missing on one side is NULL there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def restrict_to(df: DataFrame, ids: DataFrame, key: str = "patient_id") -> DataFrame:
    """Keep the people listed in another table."""
    return df.join(ids.select(key).distinct(), key, "left_semi")


def attach_values(df: DataFrame, values: DataFrame, columns: Sequence[str], key: str = "patient_id") -> DataFrame:
    """Add columns from another table keyed by person; people not in it get NULLs."""
    return df.join(values.select(key, *columns), key, "left")


def normalise_dates(df: DataFrame, suffix: str = "_date") -> DataFrame:
    """Cast every column with the date suffix to a date."""
    return df.withColumns({c: F.to_date(c) for c in df.columns if c.endswith(suffix)})


def schema_differences(actual: T.StructType, expected: T.StructType) -> list[str]:
    """Names missing on either side and names whose types differ."""
    a, e = {f.name: f.dataType for f in actual}, {f.name: f.dataType for f in expected}
    out = [f"missing column {n}" for n in e if n not in a]
    out += [f"unexpected column {n}" for n in a if n not in e]
    out += [f"column {n} is {a[n].simpleString()}, expected {e[n].simpleString()}" for n in e if n in a and a[n] != e[n]]
    return out


def assert_schema(df: DataFrame, expected: T.StructType) -> DataFrame:
    """Raise on any difference; otherwise return the columns in the expected order. Runs no job."""
    problems = schema_differences(df.schema, expected)
    if problems:
        raise ValueError("; ".join(problems))
    return df.select(*expected.fieldNames())
