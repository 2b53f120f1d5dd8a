"""Normal-distribution helpers for small result tables."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import DoubleType

# fixed value: the 97.5 % point of the standard normal distribution
Z975 = 1.959963984540054


@F.pandas_udf(DoubleType())
def _erfc(x: pd.Series) -> pd.Series:
    return x.map(lambda v: None if v is None or math.isnan(v) else math.erfc(v)).astype("float64")


def normal_cdf(z: Column) -> Column:
    """Standard normal distribution function."""
    return _erfc(-z / F.lit(math.sqrt(2.0))) / 2


def two_sided_p(z: Column) -> Column:
    """Two-sided p-value of a z statistic, which is also the upper chi-squared(1) tail of z squared."""
    return _erfc(F.abs(z) / F.lit(math.sqrt(2.0)))


def wald_limits(est: Column, se: Column) -> tuple[Column, Column]:
    """95 % limits on the scale of the estimate."""
    return est - F.lit(Z975) * se, est + F.lit(Z975) * se


def exp_limits(est: Column, log_se: Column) -> tuple[Column, Column]:
    """95 % limits of a ratio whose logarithm has standard error ``log_se``."""
    lo, hi = wald_limits(F.ln(est), log_se)
    return F.exp(lo), F.exp(hi)
