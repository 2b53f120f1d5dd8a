"""Cox regression with one treatment effect per follow-up period and clustered robust variance.

Rows are follow-up pieces that all start at their period's first day, so the people at risk at a day
of a period are those whose piece ends on that day or later. The sums a Newton step needs therefore
add up per (period, day): at most one entry per day of follow-up, whatever the number of people.
Equal rows are counted together once before the first step.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, functions as F

from cohortspark.functions.stats import Z975
from cohortspark.operators.design import fit_design
from cohortspark.operators.logistic import sandwich, score_sums


@dataclass(frozen=True)
class CoxFit:
    names: tuple[str, ...]
    coef: np.ndarray
    information: np.ndarray
    variance: np.ndarray
    robust: np.ndarray | None
    loglik: float
    iterations: int


@dataclass(frozen=True)
class _Day:
    """Risk-set sums of one day with events: s over everyone at risk, e over the events."""

    period: int
    time: int
    deaths: float
    xsum: np.ndarray
    s: tuple[float, np.ndarray, np.ndarray]
    e: tuple[float, np.ndarray, np.ndarray]


def _sums(patterns: DataFrame, beta: np.ndarray) -> pd.DataFrame:
    """Per (period, day, event): counts, sums of x, and sums of risk scores times 1, x, xx'."""
    p = len(beta)
    upper = np.triu_indices(p)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            x, n = np.stack(b["x"].to_numpy()), b["n"].to_numpy(dtype=float)
            r = n * np.exp(x @ beta)
            cols = np.column_stack([n, n[:, None] * x, r, r[:, None] * x, r[:, None] * (x[:, upper[0]] * x[:, upper[1]])])
            part = pd.DataFrame(cols).groupby([b["period_id"].to_numpy(), b["tstop"].to_numpy(), b["event"].to_numpy()]).sum()
            yield pd.DataFrame({
                "period_id": part.index.get_level_values(0), "tstop": part.index.get_level_values(1),
                "event": part.index.get_level_values(2), "v": list(part.to_numpy())})

    parts = patterns.mapInPandas(partial, "period_id int, tstop int, event int, v array<double>")
    flat = parts.select("period_id", "tstop", "event", F.posexplode("v").alias("k", "v"))
    flat = flat.groupBy("period_id", "tstop", "event", "k").agg(F.sum("v").alias("v"))
    rows = flat.groupBy("period_id", "tstop", "event").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("k", "v"))), lambda s: s["v"]).alias("v"))
    return rows.toPandas()


def _days(sums: pd.DataFrame, p: int) -> list[_Day]:
    """Turn sums per exact day into risk-set sums by adding up later days of the same period."""
    upper = np.triu_indices(p)

    def square(v: np.ndarray) -> np.ndarray:
        m = np.zeros((p, p))
        m[upper] = v
        return m + np.triu(m, 1).T

    out = []
    for period, part in sums.groupby("period_id"):
        total = np.zeros(2 + 2 * p + len(upper[0]))
        for time in sorted(part["tstop"].unique(), reverse=True):
            here = part[part["tstop"] == time]
            total = total + np.array(here["v"].to_list(), dtype=float).sum(axis=0)
            hit = here[here["event"] == 1]
            if len(hit):
                v = np.array(hit["v"].iloc[0], dtype=float)
                cut = lambda a: (a[1 + p], a[2 + p:2 + 2 * p], square(a[2 + 2 * p:]))
                out.append(_Day(int(period), int(time), v[0], v[1:1 + p], cut(total), cut(v)))
    return sorted(out, key=lambda d: (d.period, d.time))


def _tie_terms(d: _Day, ties: str) -> tuple[np.ndarray, np.ndarray]:
    """For each of the day's tied events: the share of event risk removed, and 1 / remaining risk."""
    n = int(round(d.deaths))
    share = np.arange(n) / n if ties == "efron" else np.zeros(n)
    return share, 1.0 / (d.s[0] - share * d.e[0])


def _newton_terms(days: Sequence[_Day], beta: np.ndarray, ties: str) -> tuple[float, np.ndarray, np.ndarray]:
    p = len(beta)
    loglik, grad, info = 0.0, np.zeros(p), np.zeros((p, p))
    for d in days:
        share, a = _tie_terms(d, ties)
        a0, a1 = a.sum(), (share * a).sum()
        b0, b1, b2 = (a * a).sum(), (share * a * a).sum(), (share * share * a * a).sum()
        s1, e1 = d.s[1], d.e[1]
        loglik += d.xsum @ beta + np.log(a).sum()
        grad += d.xsum - (s1 * a0 - e1 * a1)
        cross = np.outer(s1, e1)
        info += d.s[2] * a0 - d.e[2] * a1 - (np.outer(s1, s1) * b0 - (cross + cross.T) * b1 + np.outer(e1, e1) * b2)
    return loglik, grad, info


def _residual_tables(days: Sequence[_Day], ties: str) -> dict[int, dict[str, np.ndarray]]:
    """Per period: the days with events, running baseline sums up to each day, and that day's own terms
    for rows without and with the event, needed for score residuals."""
    out: dict[int, dict[str, list]] = {}
    for d in days:
        t = out.setdefault(d.period, {k: [] for k in ("time", "mean", "h", "hx", "dh", "dhx")})
        share, a = _tie_terms(d, ties)
        a0, a1 = a.sum(), (share * a).sum()
        b0, b1, b2 = (a * a).sum(), (share * a * a).sum(), (share * share * a * a).sum()
        s1, e1 = d.s[1], d.e[1]
        t["time"].append(d.time)
        t["mean"].append((s1 * a0 - e1 * a1) / len(a))
        t["h"].append(a0)
        t["hx"].append(s1 * b0 - e1 * b1)
        t["dh"].append(a0 - a1)
        t["dhx"].append(s1 * (b0 - b1) - e1 * (b1 - b2))
    return {k: {n: np.array(v) for n, v in t.items()} for k, t in out.items()}


def _score_residuals(beta: np.ndarray, tables: dict[int, dict[str, np.ndarray]]):
    p = len(beta)

    def score(b: pd.DataFrame) -> np.ndarray:
        x = np.stack(b["x"].to_numpy())
        risk = np.exp(x @ beta)
        u = np.zeros((len(b), p))
        periods, stops, events = (b[c].to_numpy() for c in ("period_id", "tstop", "event"))
        for period in np.unique(periods):
            t = tables.get(int(period))
            if t is None:
                continue
            rows = np.flatnonzero(periods == period)
            xs, rs, ev, st = x[rows], risk[rows], events[rows] == 1, stops[rows]
            cum = np.concatenate([[0.0], np.cumsum(t["h"])])
            cumx = np.vstack([np.zeros(p), np.cumsum(t["hx"], axis=0)])
            before = np.searchsorted(t["time"], st, side="left")
            upto = np.searchsorted(t["time"], st, side="right")
            h = np.where(ev, cum[before], cum[upto])
            hx = np.where(ev[:, None], cumx[before], cumx[upto])
            at = np.minimum(before, len(t["time"]) - 1)
            h = h + np.where(ev, t["dh"][at], 0.0)
            hx = hx + np.where(ev[:, None], t["dhx"][at], 0.0)
            own = np.where(ev[:, None], xs - t["mean"][at], 0.0)
            u[rows] = own - rs[:, None] * (xs * h[:, None] - hx)
        return u

    return score


def cox_fit(pieces: DataFrame, adjusters: Sequence[object], n_periods: int, cluster: str | None = "patient_id",
            event: str = "ind_outcome", arm: str = "treated", ties: str = "efron", max_iter: int = 20,
            tol: float = 1e-9) -> CoxFit:
    """Fit on follow-up pieces with columns period_id, tstop, event, arm and the adjusters."""
    design = fit_design(pieces, adjusters)
    pieces = design.prepare(pieces)
    a = F.col(arm).cast("double")
    by_period = [F.when(F.col("period_id") == k, a).otherwise(F.lit(0.0)) for k in range(1, n_periods + 1)]
    x = F.array(*by_period, *[e.expr.cast("double") for e in design.entries])
    names = (*[f"treated:period{k}" for k in range(1, n_periods + 1)], *design.names)
    rows = pieces.select(
        *([cluster] if cluster else []), F.col("period_id").cast("int").alias("period_id"),
        F.col("tstop").cast("int").alias("tstop"), F.col(event).cast("int").alias("event"), x.alias("x"))
    patterns = rows.groupBy("period_id", "tstop", "event", "x").agg(F.count(F.lit(1)).alias("n"))
    patterns = patterns.persist(StorageLevel.MEMORY_AND_DISK)
    p = len(names)
    beta, best, step = np.zeros(p), None, np.zeros(p)
    try:
        for it in range(1, max_iter + 1):
            days = _days(_sums(patterns, beta), p)
            loglik, grad, info = _newton_terms(days, beta, ties)
            if best is not None and loglik < best - 1e-12 * abs(best):
                step = step / 2
                beta = beta - step
                continue
            if best is not None and abs(loglik - best) <= tol * abs(loglik):
                break
            best = loglik
            step = np.linalg.pinv(info) @ grad
            beta = beta + step
    finally:
        patterns.unpersist()
    variance = np.linalg.pinv(info)
    robust = None
    if cluster:
        sums = score_sums(rows, cluster, p, _score_residuals(beta, _residual_tables(days, ties)))
        robust = sandwich(info, sums, p)
    return CoxFit(names, beta, info, variance, robust, float(loglik), it)


def coefficients(spark: SparkSession, fit: CoxFit) -> DataFrame:
    """All coefficients with model-based and robust standard errors."""
    root = lambda m: np.sqrt(np.clip(np.diag(m), 0, None)) if m is not None else [None] * len(fit.names)
    rows = [(n, float(b), float(s), None if r is None else float(r))
            for n, b, s, r in zip(fit.names, fit.coef, root(fit.variance), root(fit.robust))]
    return spark.createDataFrame(rows, "term string, estimate double, std_error double, robust_se double")


def cox_contrasts(spark: SparkSession, fit: CoxFit, cuts: Sequence[int], **tags: str) -> DataFrame:
    """Hazard ratio of treatment per follow-up period with robust limits. The standard error is that of
    the log hazard ratio. A period without any event has no estimate."""
    var = fit.robust if fit.robust is not None else fit.variance
    rows = []
    for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
        se = float(np.sqrt(max(var[k, k], 0.0)))
        known = fit.information[k, k] > 1e-12
        est = float(fit.coef[k])
        vals = (float(np.exp(est)), se, float(np.exp(est - Z975 * se)), float(np.exp(est + Z975 * se)))
        rows.append((*tags.values(), k + 1, a, b, f"{a}-{b}", *(vals if known else (None,) * 4)))
    schema = ", ".join([*[f"{t} string" for t in tags], "period_id int, period_start int, period_end int, fup_period string, "
                        "coxhazr double, coxhr_se double, coxhr_ll double, coxhr_ul double"])
    return spark.createDataFrame(rows, schema)
