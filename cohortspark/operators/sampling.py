"""Deterministic sampling of persons by the order of their (randomly assigned) ids.

A sample of n is "the n smallest distinct ids". The cut-off id is found by a bounded histogram
search, after which the sample is a plain comparison: no global window, no ordered gather.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from cohortspark.operators.ranking import kth_smallest
from cohortspark.session import stable


def _flag(cut: int | None, id_col: str) -> Column:
    return F.lit(False) if cut is None else F.col(id_col) <= F.lit(cut)


def _cut_off(df: DataFrame, id_col: str, n: int) -> int | None:
    """The n-th smallest distinct id. The ids are written once; each pass of the search reads them."""
    return kth_smallest(stable(df.select(id_col).distinct()), id_col, n)


def sample_random_n(df: DataFrame, n: int, id_col: str = "patient_id", name: str = "sampled") -> DataFrame:
    """Flag the rows of the n smallest ids."""
    cut = _cut_off(df, id_col, n)
    return df.withColumn(name, _flag(cut, id_col))


def sample_random_prop(df: DataFrame, proportion: float, id_col: str = "patient_id", name: str = "sampled") -> DataFrame:
    """Flag the ids whose dense rank is at most the rounded-up share of the number of rows."""
    rows = df.agg(F.count(F.lit(1))).first()[0]
    return sample_random_n(df, _ceil(rows * proportion), id_col, name)


def sample_nonoutcomes_n(df: DataFrame, n: int, had: str, id_col: str = "patient_id", name: str = "sampled") -> DataFrame:
    """Flag every id with the outcome and the n smallest ids without it."""
    return _nonoutcomes(df, had, id_col, name, lambda _: n)


def sample_nonoutcomes_prop(df: DataFrame, proportion: float, had: str, id_col: str = "patient_id", name: str = "sampled") -> DataFrame:
    """Flag every id with the outcome and a share of those without it.

    When nobody has the outcome, ranks shift by one, so one more id is kept than the share asks for.
    """
    any_had = not df.where(F.col(had)).isEmpty()
    return _nonoutcomes(df, had, id_col, name, lambda rows: _ceil(rows * proportion) + (0 if any_had else 1))


def _nonoutcomes(df, had, id_col, name, amount) -> DataFrame:
    non = df.where(~F.col(had))
    k = amount(non.agg(F.count(F.lit(1))).first()[0])
    cut = _cut_off(non, id_col, k)
    return df.withColumn(name, F.col(had) | _flag(cut, id_col))


def _ceil(x: float) -> int:
    return math.ceil(x - 1e-9)


def sample_weights(df: DataFrame, had: str, sampled: str = "sampled", name: str = "sample_weight") -> DataFrame:
    """1 for outcomes, 0 for unsampled, and the inverse sampling share for sampled non-outcomes."""
    non = (~F.col(had)).cast("long")
    total, kept = df.agg(
        F.sum(non), F.sum(F.when(F.col(sampled), non).otherwise(F.lit(0))),
    ).first()
    share = F.lit(float(total) / kept) if kept else F.lit(None).cast("double")
    return df.withColumn(
        name, F.when(F.col(had), F.lit(1.0)).when(~F.col(sampled), F.lit(0.0)).when(F.col(sampled), share),
    )
