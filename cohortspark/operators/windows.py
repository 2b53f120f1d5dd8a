"""Running totals, fills, dense grids and reshaping."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W, WindowSpec, functions as F


def running(by: Sequence[str], order: Sequence[str]) -> WindowSpec:
    """Everything up to and including the current row of the group."""
    return W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)


def remaining(by: Sequence[str], order: Sequence[str]) -> WindowSpec:
    """The current row of the group and everything after it."""
    return W.partitionBy(*by).orderBy(*order).rowsBetween(0, W.unboundedFollowing)


def cumulative_sum(x: Column, by: Sequence[str], order: Sequence[str]) -> Column:
    return F.sum(x).over(running(by, order))


def cumulative_product(x: Column, by: Sequence[str], order: Sequence[str]) -> Column:
    return F.product(x).over(running(by, order))


def first_difference(x: Column, by: Sequence[str], order: Sequence[str]) -> Column:
    """Step from the previous row; the first row steps from zero."""
    return x - F.coalesce(F.lag(x, 1).over(W.partitionBy(*by).orderBy(*order)), F.lit(0))


def fill_down(x: Column, by: Sequence[str], order: Sequence[str]) -> Column:
    """Last known value carried forward."""
    return F.last(x, ignorenulls=True).over(running(by, order))


def fill_up(x: Column, by: Sequence[str], order: Sequence[str]) -> Column:
    """Next known value carried backward."""
    return F.first(x, ignorenulls=True).over(remaining(by, order))


def share_of_total(x: Column, by: Sequence[str], scale: float = 1.0) -> Column:
    """Share of the group's total."""
    return F.try_divide(x.cast("double"), F.sum(x).over(W.partitionBy(*by)).cast("double")) * F.lit(scale)


def broadcast_within(value: Column, when: Column, by: Sequence[str]) -> Column:
    """Give every row of the group the value found on the row that meets ``when``."""
    return F.max(F.when(when, value)).over(W.partitionBy(*by))


def group_key(*cols: str) -> Column:
    """Surrogate key of a composite key."""
    return F.xxhash64(*cols)


def dense_grid(df: DataFrame, keys: Sequence[str], axis: str, points: Column,
               fill: Mapping[str, object] | None = None) -> DataFrame:
    """Every group crossed with every point of the axis (an array column), left-joined to the data."""
    grid = df.select(*keys).distinct().select(*keys, F.explode(points).alias(axis))
    out = grid.join(df, [*keys, axis], "left")
    return out.fillna(dict(fill)) if fill else out


def date_points(start, end) -> Column:
    """All days from start to end."""
    return F.sequence(F.lit(start), F.lit(end), F.expr("interval 1 day"))


def replicate(df: DataFrame, times: int | Column, index: str) -> DataFrame:
    """Repeat every row ``times`` times and number the copies from 1."""
    n = times if isinstance(times, Column) else F.lit(times)
    return df.select("*", F.explode(F.sequence(F.lit(1), n)).alias(index))


def pivot_long(df: DataFrame, ids: Sequence[str], pattern: str, columns: Sequence[str], names: Sequence[str],
               value: str = "value", drop_null: bool = True) -> DataFrame:
    """Unpivot columns and read the parts of their names with a regular expression's groups."""
    out = df.unpivot(list(ids), list(columns), "_name", value)
    out = out.select(*ids, *[F.regexp_extract("_name", pattern, i + 1).alias(n) for i, n in enumerate(names)], value)
    return out.where(F.col(value).isNotNull()) if drop_null else out


def pivot_long_values(df: DataFrame, ids: Sequence[str], index: str,
                      rows: Mapping[object, Mapping[str, str]]) -> DataFrame:
    """Unpivot several value columns at once. ``rows`` maps an index value to {new name: old column};
    an output row is dropped only when all its values are NULL."""
    structs = [
        F.struct(F.lit(i).alias(index), *[F.col(old).alias(new) for new, old in spec.items()])
        for i, spec in rows.items()
    ]
    news = list(next(iter(rows.values())))
    out = df.select(*ids, F.explode(F.array(*structs)).alias("_s")).select(*ids, "_s.*")
    return out.dropna(how="all", subset=news)


def pivot_wide(df: DataFrame, ids: Sequence[str], names_from: str, names: Sequence[object],
               values: Sequence[str], glue: str = "{value}_{name}") -> DataFrame:
    """Spread value columns over a known list of names."""
    return df.groupBy(*ids).agg(*[
        F.max(F.when(F.col(names_from) == n, F.col(v))).alias(glue.format(value=v, name=n))
        for v in values for n in names
    ])


def lag_or(x: Column, default: object, by: Sequence[str], order: Sequence[str], n: int = 1) -> Column:
    return F.lag(x, n, default).over(W.partitionBy(*by).orderBy(*order))


def lead_or(x: Column, default: object, by: Sequence[str], order: Sequence[str], n: int = 1) -> Column:
    return F.lead(x, n, default).over(W.partitionBy(*by).orderBy(*order))


def top_rows(df: DataFrame, by: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """First n rows per group; the rank filter is applied before the shuffle as well."""
    w = W.partitionBy(*by).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")
