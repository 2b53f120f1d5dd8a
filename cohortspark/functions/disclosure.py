"""Disclosure control: rounding rules and small-count suppression."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def roundmid_any(x: Column, to: int = 1) -> Column:
    """Round up to a multiple of ``to`` and step back half a multiple, so counts sit mid-interval."""
    if to == 1:
        return F.ceil(x)
    step = F.when(x != 0, F.lit(to // 2)).otherwise(F.lit(0))
    return F.ceil(x / F.lit(to)) * F.lit(to) - step


def ceiling_any(x: Column, to: int = 1) -> Column:
    """Round up to a multiple of ``to``; the inner rounding absorbs floating-point noise."""
    return F.ceil(F.round(x / F.lit(to), 8)) * F.lit(to)


def redaction_flag(df: DataFrame, n: str, threshold: int, by: Sequence[str] = (),
                   order: Sequence[str] = (), name: str = "redacted") -> DataFrame:
    """Mark counts to suppress within each group of a small summary table.

    Counts of 1..threshold are suppressed. If what they hide still adds up to no more than the
    threshold, the smallest remaining count is suppressed as well (the first in ``order`` on ties).
    """
    group = W.partitionBy(*by)
    small = F.col(n).between(1, threshold)
    pick = W.partitionBy(*by).orderBy(small.cast("int"), F.col(n), *[F.col(c) for c in order])
    out = df.withColumns({
        "_hidden": F.sum(F.when(small, F.col(n))).over(group),
        "_place": F.row_number().over(pick),
    })
    second = F.coalesce(F.col("_hidden") <= threshold, F.lit(False)) & (F.col("_place") == 1)
    return out.withColumn(name, small | second).drop("_hidden", "_place")


def redact(df: DataFrame, columns: Sequence[str], flag: str = "redacted") -> DataFrame:
    """Blank the given columns where the flag is set."""
    return df.withColumns({c: F.when(~F.col(flag), F.col(c)) for c in columns})
