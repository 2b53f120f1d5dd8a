"""Weighted pooled logistic models with person-clustered robust standard errors."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from cohortspark.functions.stats import Z975, two_sided_p
from cohortspark.operators.design import Design, Factor, columns_of, fit_design, gram, independent
from cohortspark.session import stable

INTERCEPT = "(Intercept)"
#: Relative change of the deviance at which the steps end, and the last step of a coefficient that has no finite estimate.
TOLERANCE, SEPARATED = 1e-11, 0.05


@dataclass(frozen=True)
class LogisticFit:
    """Coefficients of a fitted model; the first one belongs to the constant."""

    design: Design
    coef: tuple[float, ...]
    dropped: tuple[str, ...]
    variance: np.ndarray | None = None
    converged: bool = True
    iterations: int = 0
    #: Coefficients that still moved when the likelihood stood still: their column separates the outcomes.
    diverging: tuple[str, ...] = ()

    @property
    def names(self) -> list[str]:
        return [INTERCEPT, *self.design.names]

    def prepare(self, df: DataFrame) -> DataFrame:
        return self.design.prepare(df)

    def probability(self, curve: Column | None = None, rest: Sequence[object] | None = None) -> Column:
        """Predicted probability of a prepared row, as a plain expression: predicting needs no join.

        ``curve``: what the curved terms add up to, if the row has that already; ``rest``: the terms that are not in it, if
        not just all straight ones.
        """
        if curve is None:
            total = self.design.linear(self.coef[1:])
        else:
            total = self.design.linear(self.coef[1:], self.design.straight() if rest is None else rest) + curve
        return 1 / (1 + F.exp(-(F.lit(self.coef[0]) + total)))


def patterns(df: DataFrame, columns: Sequence[str], weight: Column) -> DataFrame:
    """Equal rows as one, with their weights added up as ``_w``; rows without weight go.

    The likelihood of a pooled model depends on these sums only. How many patterns there are is bounded by the values of
    the covariates, not by the number of people; Spark adds up inside each task first, so a frequent pattern is no hot key.
    """
    return df.select(*columns, weight.alias("_w")).where("_w > 0").groupBy(*columns).agg(F.sum("_w").alias("_w"))


def counted(df: DataFrame, columns: Sequence[str], name: str, weight: str | None = None) -> DataFrame:
    """The distinct rows of some columns and how many rows have them; with ``weight`` also its sum, of the rows that have one."""
    sums = [F.sum(F.when(F.col(weight) > 0, F.col(weight).cast("double"))).alias(weight)] if weight else []
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias(name), *sums)


def _weight(weight: str | None, rows: str | None, summed: bool = False) -> Column:
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    return w if rows is None or summed else w * F.col(rows)


def fit_logistic(df: DataFrame, terms: Sequence[object], label: str, weight: str | None = None,
                 max_iter: int = 40, rows: str | None = None, summed: bool = False) -> LogisticFit:
    """Maximum-likelihood fit by Newton steps, each one pass over the data.

    Columns that depend linearly on earlier ones are dropped first (their coefficient is undefined). Knots and levels are
    read from all rows; every iteration then runs over the distinct rows with their weights added up.
    ``rows``: a column with how many rows each row stands for (:func:`counted`); ``summed``: their weights have been added up.
    """
    design = fit_design(df, terms, rows)
    w = _weight(weight, rows, summed)
    columns = sorted({c for t in terms for c in columns_of(t)} | {label})
    df = design.prepare(stable(patterns(df, columns, w)))
    with_one = df.select(F.concat(F.array(F.lit(1.0)), design.array()).alias("_x"))
    kept = [design.names[j - 1] for j in independent(gram(with_one, "_x")) if j > 0]
    dropped = tuple(n for n in design.names if n not in set(kept))
    design = design.keep(kept)
    cores = df.sparkSession.sparkContext.defaultParallelism
    data = df.select(F.col(label).cast("double").alias("_y"), "_w", F.concat(F.array(F.lit(1.0)), design.array()).alias("_x"))
    data = data.repartition(cores).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        coef, converged, iterations, last = newton(data, len(kept) + 1, max_iter)
    finally:
        data.unpersist()
    names = [INTERCEPT, *kept]
    moving = tuple(n for n, step in zip(names, last) if abs(step) > SEPARATED)
    return LogisticFit(design, tuple(coef), dropped, converged=converged, iterations=iterations, diverging=moving)


def newton(data: DataFrame, p: int, max_iter: int) -> tuple[list[float], bool, int, np.ndarray]:
    """Newton steps for the logistic likelihood of rows (_y, _w, _x): coefficients, convergence, steps, the last step.

    Each step is one pass that adds up the score and the information in every task. A step that lowers the likelihood
    is halved. The steps have converged when the deviance changes by less than TOLERANCE of itself.
    """
    beta, step, before = np.zeros(p), np.zeros(p), -np.inf
    for i in range(max_iter + 1):
        score, information, likelihood = newton_sums(data, beta, p)
        halvings = 0
        while likelihood < before - 1e-9 * abs(before) and halvings < 20:
            step = step / 2
            beta, halvings = beta - step, halvings + 1
            score, information, likelihood = newton_sums(data, beta, p)
        if i and abs(likelihood - before) <= TOLERANCE * (abs(likelihood) + 0.05):
            return beta.tolist(), True, i, step
        if i == max_iter:
            break
        before = likelihood
        step = np.linalg.lstsq(information, score, rcond=None)[0]
        beta = beta + step
    return beta.tolist(), False, max_iter, step


def newton_sums(data: DataFrame, beta: np.ndarray, p: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Score, information and log likelihood at some coefficients."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(p + p * p + 1)
        for batch in batches:
            y, w = (batch.column(i).to_numpy() for i in (0, 1))
            x = batch.column(2).flatten().to_numpy().reshape(-1, p)
            eta = x @ beta
            prob = 1 / (1 + np.exp(-eta))
            total += np.concatenate([
                x.T @ (w * (y - prob)), (x.T @ (x * (w * prob * (1 - prob))[:, None])).ravel(), [w @ (y * eta - np.logaddexp(0, eta))]])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["k", "v"])

    sums = data.mapInArrow(partial, "k long, v double").groupBy("k").agg(F.sum("v").alias("v")).collect()
    flat = np.zeros(p + p * p + 1)
    for r in sums:
        flat[r["k"]] = r["v"]
    return flat[:p], flat[p:-1].reshape(p, p), float(flat[-1])


def score_sums(rows: DataFrame, cluster: str, p: int, score) -> DataFrame:
    """Sum of p-vector scores per cluster.

    Scores are summed inside each Arrow batch before they are shuffled, so a cluster with very many
    rows sends few partial sums. ``score`` maps a pandas batch to an (n, p) array.
    """
    names = [f"u{j}" for j in range(p)]
    kind = dict(rows.dtypes)[cluster]

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                u = pd.DataFrame(score(b), columns=names)
                u[cluster] = b[cluster].to_numpy()
                yield u.groupby(cluster, sort=False).sum().reset_index()[[cluster, *names]]

    schema = ", ".join([f"`{cluster}` {kind}", *[f"{n} double" for n in names]])
    return rows.mapInPandas(partial, schema).groupBy(cluster).agg(*[F.sum(n).alias(n) for n in names])


def sandwich(bread: np.ndarray, sums: DataFrame, p: int, small_sample: bool = False) -> np.ndarray:
    """Cluster-robust variance from the information matrix and the per-cluster score sums."""
    flat = sums.select(F.array(*[F.col(f"u{j}") for j in range(p)]).alias("_u"))
    meat = gram(flat, "_u")
    inv = np.linalg.pinv(bread)
    out = inv @ meat @ inv
    if small_sample:
        g = sums.count()
        out = out * g / (g - 1)
    return out


def robust_logistic(df: DataFrame, fit: LogisticFit, label: str, cluster: str, weight: str | None = None,
                    small_sample: bool = False, kinds: DataFrame | None = None, rows: str | None = None,
                    summed: bool = False) -> LogisticFit:
    """Add the cluster-robust (HC0) variance to a fit.

    The information comes from the distinct rows; scores are added up per cluster as plain column sums.
    ``kinds``: the same rows without their cluster, each as often as ``rows`` says, if they have been counted already; ``summed``:
    with their weights added up.
    """
    p = len(fit.coef)
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    columns = sorted({c for t in fit.design.terms for c in columns_of(t)})
    alike = patterns(df, columns, w) if kinds is None else patterns(kinds, columns, _weight(weight, rows, summed))
    kinds = fit.prepare(alike).withColumn("_p", fit.probability())
    bread = gram(kinds.select(
        F.concat(F.array(F.lit(1.0)), fit.design.array()).alias("_x"), (F.col("_w") * F.col("_p") * (1 - F.col("_p"))).alias("_h")), "_x", "_h")
    rows = fit.prepare(df.select(cluster, *[c for c in {*columns, label} if c != cluster], w.alias("_w")).where("_w > 0"))
    rest = F.col("_w") * (F.col(label).cast("double") - fit.probability())
    rows = rows.withColumn("_r", rest)
    scores = [F.sum("_r"), *[F.sum(F.col("_r") * e.expr.cast("double")) for e in fit.design.entries]]
    sums = rows.groupBy(cluster).agg(*[x.alias(f"u{j}") for j, x in enumerate(scores)])
    return replace(fit, variance=sandwich(bread, sums, p, small_sample))


def coefficient_table(spark: SparkSession, fit: LogisticFit, exclude: Sequence[str] = (),
                      reference_rows: bool = False) -> DataFrame:
    """Estimates with robust standard errors, limits, p-values and odds ratios.

    Variables starting with an ``exclude`` prefix are left out. ``reference_rows`` adds each factor's
    first level with an odds ratio of 1.
    """
    se = np.sqrt(np.clip(np.diag(fit.variance), 0, None)) if fit.variance is not None else [None] * len(fit.coef)
    vars_ = [INTERCEPT, *[e.variable for e in fit.design.entries]]
    labels = [INTERCEPT, *[e.label for e in fit.design.entries]]
    rows = [
        (i, n, v, lb, False, float(b), None if s is None else float(s))
        for i, (n, v, lb, b, s) in enumerate(zip(fit.names, vars_, labels, fit.coef, se))
        if not any(v.startswith(x) or f":{x}" in v for x in exclude)
    ]
    if reference_rows:
        first = {r[2]: r[0] for r in reversed(rows)}
        for t in fit.design.terms:
            if isinstance(t, Factor) and t.col in first:
                rows.append((first[t.col], f"{t.col}{t.levels[0]}", t.col, str(t.levels[0]), True, None, None))
    df = spark.createDataFrame(
        rows, "ord int, term string, variable string, label string, reference_row boolean, estimate double, std_error double")
    z = F.try_divide(F.col("estimate"), F.col("std_error"))
    lo, hi = F.col("estimate") - Z975 * F.col("std_error"), F.col("estimate") + Z975 * F.col("std_error")
    return df.withColumns({
        "conf_low": lo, "conf_high": hi, "statistic": z,
        "or": F.when(F.col("reference_row"), F.lit(1.0)).otherwise(F.exp("estimate")),
        "or_ll": F.exp(lo), "or_ul": F.exp(hi),
    }).withColumn("p_value", two_sided_p(F.col("statistic")))


def effect_table(estimates: DataFrame, variable: str, by: Sequence[str] = ("model",), last_width: int = 7,
                 first_level: str | None = None, level: str = "subgroup_level") -> DataFrame:
    """Effect by time since treatment: band limits read from the labels, effectiveness 1 - OR, and the
    difference from the first subgroup level of the same band with a z-test.

    An open last band ends ``last_width`` days after the largest band start.
    """
    df = estimates.where((F.col("variable") == variable) & ~F.col("reference_row")).withColumn("term", F.col("label"))
    left = F.regexp_extract("term", r"(\d+)", 1).cast("double") - 1
    right = F.nullif(F.regexp_extract("term", r"(\d+)$", 1), F.lit("")).cast("double")
    whole = W.partitionBy(*by)
    df = df.withColumn("term_left", left)
    df = df.withColumn("term_right", F.coalesce(right, F.max("term_left").over(whole) + last_width))
    first = F.col(level) == first_level if first_level is not None else F.lit(True)
    base = W.partitionBy(*by, "term")
    ref = lambda c: F.max(F.when(first, F.col(c))).over(base)
    df = df.withColumns({
        "term_midpoint": F.col("term_left") + (F.col("term_right") - F.col("term_left")) / 2,
        "ve": 1 - F.col("or"), "ve_ll": 1 - F.col("or_ul"), "ve_ul": 1 - F.col("or_ll"),
        "diff": F.col("estimate") - ref("estimate"),
        "diff_se": F.when(~first, F.sqrt(F.pow("std_error", F.lit(2.0)) + F.pow(ref("std_error"), F.lit(2.0)))),
    })
    return df.withColumns({
        "z": F.try_divide(F.col("diff"), F.col("diff_se")),
        "diff_ll": F.col("diff") - Z975 * F.col("diff_se"), "diff_ul": F.col("diff") + Z975 * F.col("diff_se"),
    }).withColumn("diff_p_value", two_sided_p(F.col("z")))
