"""Kaplan-Meier tables, rounded estimates, life tables and period contrasts.

One aggregate per (group, day) is the only shuffle over people; everything after it runs on at most
``max_followup`` rows per group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from cohortspark.functions.columns import ratio
from cohortspark.functions.disclosure import roundmid_any
from cohortspark.functions.stats import Z975, exp_limits, wald_limits
from cohortspark.operators.windows import dense_grid, remaining, running


def km_counts(df: DataFrame, by: Sequence[str], max_followup: int, time: str = "tte_outcome",
              event: str = "ind_outcome") -> DataFrame:
    """Events, censorings and people at risk on every day 1..max_followup of each group."""
    hit = F.col(event).cast("boolean")
    per_day = df.groupBy(*by, F.col(time).cast("int").alias("time")).agg(
        F.count(F.when(hit, F.lit(1))).alias("n_event"), F.count(F.when(~hit, F.lit(1))).alias("n_censor"))
    grid = dense_grid(per_day, by, "time", F.sequence(F.lit(1), F.lit(max_followup)), {"n_event": 0, "n_censor": 0})
    left = F.sum(F.col("n_event") + F.col("n_censor")).over(remaining(by, ["time"]))
    return grid.withColumn("n_risk", left)


def km_estimates(counts: DataFrame, by: Sequence[str], round_to: int = 1) -> DataFrame:
    """Kaplan-Meier estimates from cumulative counts that are rounded for disclosure control.

    Undefined values (nobody at risk, limits at a survival of exactly 0 or 1) are NULL.
    """
    upto, step = running(by, ["time"]), W.partitionBy(*by).orderBy("time")
    df = counts.withColumns({
        "lagtime": F.lag("time", 1, 0).over(step),
        "leadtime": F.coalesce(F.lead("time", 1).over(step), F.col("time") + 1),
        "_n": F.max("n_risk").over(W.partitionBy(*by)),
        "_all": roundmid_any(F.sum(F.col("n_event") + F.col("n_censor")).over(upto), round_to).cast("long"),
        "cml_event": roundmid_any(F.sum("n_event").over(upto), round_to).cast("long"),
    })
    df = df.withColumns({"interval": F.col("time") - F.col("lagtime"), "cml_censor": F.col("_all") - F.col("cml_event")})
    df = df.withColumns({
        "n_event": F.col("cml_event") - F.lag("cml_event", 1, 0).over(step),
        "n_censor": F.col("cml_censor") - F.lag("cml_censor", 1, 0).over(step),
        "n_risk": roundmid_any(F.col("_n"), round_to).cast("long") - F.lag("_all", 1, 0).over(step),
    })
    df = df.withColumns(km_curve(upto))
    return df.select(
        *by, "time", "lagtime", "leadtime", "interval", "cml_event", "cml_censor", "n_risk", "n_event", "n_censor",
        "surv", "surv_se", "surv_ll", "surv_ul",
        (1 - F.col("surv")).alias("risk"), F.col("surv_se").alias("risk_se"),
        (1 - F.col("surv_ul")).alias("risk_ll"), (1 - F.col("surv_ll")).alias("risk_ul"),
    )


def km_curve(upto) -> dict[str, Column]:
    """Product-limit survival, Greenwood standard error and complementary log-log limits."""
    risk, left = F.col("n_risk"), F.col("n_risk") - F.col("n_event")
    surv = F.when(risk > 0, F.product(1 - F.coalesce(ratio(F.col("n_event"), risk), F.lit(0.0))).over(upto))
    term = ratio(F.lit(1), left) - ratio(F.lit(1), risk)
    var = F.when(left > 0, F.sum(term).over(upto))
    log_surv = F.when((surv > 0) & (surv < 1), F.ln(surv))
    loglog, loglog_se = F.ln(-log_surv), F.sqrt(var / (log_surv * log_surv))
    return {
        "surv": surv, "surv_se": surv * F.sqrt(var),
        "surv_ll": F.exp(-F.exp(loglog + F.lit(Z975) * loglog_se)),
        "surv_ul": F.exp(-F.exp(loglog - F.lit(Z975) * loglog_se)),
    }


def life_table(counts: DataFrame, by: Sequence[str], add_time_zero: bool = False) -> DataFrame:
    """Kaplan-Meier and actuarial hazards with their standard errors and running totals."""
    upto, step = running(by, ["time"]), W.partitionBy(*by).orderBy("time")
    df = counts.withColumn("leadtime", F.lead("time", 1).over(step))
    df = df.withColumn("interval", F.col("leadtime") - F.col("time")).withColumns(km_curve(upto))
    e, r, c, i = (F.col(x).cast("double") for x in ("n_event", "n_risk", "n_censor", "interval"))
    term = ratio(e, (r - e) * r)
    haz_km = ratio(e, r * i)
    haz_ac = ratio(e, (r - c / 2 - e / 2) * i)
    log_surv = F.when((F.col("surv") > 0) & (F.col("surv") < 1), F.ln("surv"))
    df = df.withColumns({
        "summand": term, "haz_km": haz_km, "se_haz_km": haz_km * F.sqrt(ratio(r - e, r * e)),
        "haz_ac": haz_ac, "_inner": 1 - F.pow(haz_ac * i / 2, F.lit(2.0)),
        "cml_haz_ac": -F.when(F.col("surv") > 0, F.ln("surv")),
        "llsurv": F.ln(-log_surv), "se_llsurv": F.sqrt(F.sum(term).over(upto) / (log_surv * log_surv)),
    })
    df = df.withColumns({
        "cml_haz_km": F.when(F.col("haz_km").isNotNull(), F.sum("haz_km").over(upto)),
        "se_haz_ac": ratio(F.col("haz_ac") * F.sqrt(F.when(F.col("_inner") >= 0, F.col("_inner"))), F.sqrt(e)),
    })
    out = df.select(
        *by, "time", "leadtime", "interval", "n_risk", "n_event", "n_censor", "summand", "surv", "surv_ll", "surv_ul",
        "surv_se", "haz_km", "cml_haz_km", "se_haz_km", "haz_ac", "cml_haz_ac", "se_haz_ac", "llsurv", "se_llsurv")
    return with_time_zero(out, by) if add_time_zero else out


def with_time_zero(table: DataFrame, by: Sequence[str]) -> DataFrame:
    """Add the row before the first event time: survival one, hazards zero."""
    first = F.min("time")
    zero = table.groupBy(*by).agg(first.alias("leadtime")).select(
        *by, F.least(F.lit(0), F.col("leadtime") - 1).alias("time"), "leadtime",
    ).withColumns({
        "interval": F.col("leadtime") - F.col("time"),
        **{c: F.lit(1.0) for c in ("surv", "surv_ll", "surv_ul")},
        **{c: F.lit(0.0) for c in ("summand", "surv_se", "haz_km", "cml_haz_km", "se_haz_km",
                                   "haz_ac", "cml_haz_ac", "se_haz_ac")},
    })
    return table.unionByName(zero, allowMissingColumns=True)


def period_summary(km: DataFrame, by: Sequence[str], cuts: Sequence[int] | None = None) -> DataFrame:
    """Quantities per follow-up period and group. Without cuts every day is a period.

    Survival, risk and cumulative figures are those of the period's last day, or NULL when nobody was
    at risk at its start.
    """
    upto, step = running(by, ["time"]), W.partitionBy(*by).orderBy("time")
    weight = F.col("n_risk") * F.col("interval")
    df = km.where(F.col("time") != 0)
    if cuts is None:
        df = df.withColumns({"period_start": F.col("lagtime"), "period_end": F.col("time")})
    else:
        spans = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in zip(cuts, cuts[1:])])
        span = F.filter(spans, lambda s: (F.col("time") > s["a"]) & (F.col("time") <= s["b"]))
        df = df.withColumn("_span", F.try_element_at(span, F.lit(1))).withColumns(
            {"period_start": F.col("_span.a"), "period_end": F.col("_span.b")}).drop("_span")
    log_surv = F.when(F.col("surv") > 0, -F.ln("surv"))
    df = df.withColumns({
        "_pt": weight, "_cml_pt": F.sum(weight).over(upto),
        "_cml_event": F.sum(F.coalesce("n_event", F.lit(0))).over(upto),
        "_inc2": log_surv - F.coalesce(F.lag(log_surv, 1).over(step), F.when(F.col("lagtime") == 0, F.lit(0.0))),
    })
    df = df.withColumn("_cml_rate", ratio(F.col("_cml_event"), F.col("_cml_pt")))
    last = lambda c: F.max_by(c, "time")
    at_start = F.min_by("n_risk", "time")
    broken = F.count(F.when((F.col("_pt") > 0) & F.col("_inc2").isNull(), F.lit(1)))
    carried = ["surv", "surv_se", "surv_ll", "surv_ul", "risk", "risk_se", "risk_ll", "risk_ul"]
    out = df.groupBy(*by, "period_start", "period_end").agg(
        F.sum("_pt").alias("persontime"), at_start.alias("n_atrisk"),
        F.sum("n_event").alias("n_event"), F.sum("n_censor").alias("n_censor"),
        ratio(F.sum("n_event"), F.sum("_pt")).alias("inc"),
        F.when(broken == 0, ratio(F.sum(F.col("_inc2") * F.col("_pt")), F.sum("_pt"))).alias("inc2"),
        F.when(at_start > 0, F.sum("interval")).otherwise(F.lit(0)).alias("interval"),
        *[F.when(at_start > 0, last(c)).alias(c) for c in carried],
        F.when(at_start > 0, last("_cml_rate")).alias("cml_rate"),
        F.when(at_start > 0, last("_cml_event")).alias("cml_event"),
    )
    label = F.concat((F.col("period_start") + 1).cast("string"), F.lit(" - "), F.col("period_end").cast("string"))
    return out.withColumn("period", label)


def period_contrasts(km: DataFrame, by: Sequence[str], cuts: Sequence[int] | None = None,
                     arm: str = "treated") -> DataFrame:
    """Treated-versus-control contrasts per period: incidence rate ratios, cumulative rate ratio,
    survival ratio, risk ratio and risk difference, with 95 % limits."""
    s = period_summary(km, [*by, arm], cuts)
    values = ["interval", "persontime", "n_atrisk", "n_event", "n_censor", "inc", "inc2", "surv", "surv_se", "surv_ll",
              "surv_ul", "risk", "risk_se", "risk_ll", "risk_ul", "cml_event", "cml_rate"]
    wide = s.groupBy(*by, "period_start", "period_end", "period").agg(*[
        F.max(F.when(F.col(arm) == a, F.col(v))).alias(f"{v}_{a}") for v in values for a in (0, 1)
    ])
    c = F.col
    inv = lambda x: ratio(F.lit(1), c(x))
    wide = wide.withColumns({f"n_nonevent_{a}": c(f"n_atrisk_{a}") - c(f"n_event_{a}") for a in (0, 1)})
    log_se = F.sqrt(inv("n_event_0") + inv("n_event_1"))
    cml_se = F.sqrt(inv("cml_event_0") + inv("cml_event_1"))
    rel = lambda a, b: ratio(c(a), c(b))
    rr_se = F.sqrt(F.pow(rel("risk_se_1", "risk_1"), F.lit(2.0)) + F.pow(rel("risk_se_0", "risk_0"), F.lit(2.0)))
    wide = wide.withColumns({
        "irr": rel("inc_1", "inc_0"), "irr_ln_se": log_se,
        "irr2": rel("inc2_1", "inc2_0"), "irr2_ln_se": log_se,
        "cmlirr": rel("cml_rate_1", "cml_rate_0"), "cmlirr_ln_se": cml_se,
        "sr": rel("surv_1", "surv_0"), "sr_ln_se": rel("surv_se_0", "surv_0") + rel("surv_se_1", "surv_1"),
        "rr": rel("risk_1", "risk_0"), "rr_ln_se": rr_se,
        "rd": c("risk_1") - c("risk_0"), "rd_se": F.sqrt(c("risk_se_0") * c("risk_se_0") + c("risk_se_1") * c("risk_se_1")),
    })
    for name in ("irr", "irr2", "cmlirr", "sr", "rr"):
        lo, hi = exp_limits(c(name), c(f"{name}_ln_se"))
        wide = wide.withColumns({f"{name}_ll": lo, f"{name}_ul": hi})
    lo, hi = wald_limits(c("rd"), c("rd_se"))
    return wide.withColumns({"rd_ll": lo, "rd_ul": hi})
