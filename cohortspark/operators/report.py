"""Datasets behind the published tables and figures."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

from cohortspark.config import StudyConfig
from cohortspark.functions.columns import case_levels, estimate_text, fixed, level_order, recode, truncate_text
from cohortspark.functions.disclosure import roundmid_any
from cohortspark.functions.stats import Z975, two_sided_p
from cohortspark.operators.windows import pivot_wide, share_of_total


def add_descriptions(df: DataFrame, lookups: Mapping[str, Mapping[str, str]]) -> DataFrame:
    """For each coded column add ``<column>_descr`` and its sort key ``<column>_ord``."""
    return df.withColumns({
        **{f"{c}_descr": recode(F.col(c), m) for c, m in lookups.items()},
        **{f"{c}_ord": level_order(F.col(c), list(m)) for c, m in lookups.items()}})


def meta_analysis(estimates: DataFrame, by: Sequence[str], hr: str = "coxhazr", log_se: str = "coxhr_se",
                  with_p: bool = True) -> DataFrame:
    """Fixed-effect pooling of log hazard ratios with inverse-variance weights."""
    w = 1 / (F.col(log_se) * F.col(log_se))
    usable = estimates.where(F.col(hr).isNotNull() & (F.col(log_se) > 0))
    out = usable.groupBy(*by).agg(
        (F.sum(F.ln(hr) * w) / F.sum(w)).alias("loghr"), F.sqrt(1 / F.sum(w)).alias("loghr_se"))
    out = out.withColumns({
        "hr": F.exp("loghr"), "statistic": F.col("loghr") / F.col("loghr_se"),
        "conf_low": F.exp(F.col("loghr") - Z975 * F.col("loghr_se")),
        "conf_high": F.exp(F.col("loghr") + Z975 * F.col("loghr_se"))})
    return out.withColumn("p_value", two_sided_p(F.col("statistic"))) if with_p else out


def baseline_wide(tables: DataFrame, arms: Sequence[str], arm: str = "arm") -> DataFrame:
    """Baseline table with one text column per arm: ``n (p%)``, or median and quartiles."""
    share = F.col("p") * 100
    pct = F.when(share < 10, fixed(share, 1)).otherwise(fixed(share, 0))
    text = F.when(
        F.col("n").isNotNull(), F.concat(F.col("n").cast("string"), F.lit(" ("), pct, F.lit("%)")),
    ).otherwise(F.concat(fixed(F.col("median"), 0), F.lit(" ("), fixed(F.col("p25"), 0), F.lit(", "),
                         fixed(F.col("p75"), 0), F.lit(")")))
    return pivot_wide(tables.withColumn("stat", text), ["variable", "level"], arm, arms, ["stat"], "{name}")


def effect_comparison(sequential: DataFrame, single: DataFrame, cuts: Sequence[int]) -> DataFrame:
    """Estimates of both designs in long form under one period label."""
    seq = sequential.select(
        F.lit("Sequential trial").alias("approach"), "brand", "subgroup", "subgroup_level", "outcome",
        F.col("coxhazr").alias("estimate"), F.col("coxhr_ll").alias("lci"), F.col("coxhr_ul").alias("uci"),
        F.col("period_start").cast("int").alias("period_start"), F.col("period_end").cast("int").alias("period_end"))
    # an open last band ("71+") has no end and drops out of the shared periods
    one = single.select(
        F.lit("Single trial").alias("approach"), "brand", "subgroup", "subgroup_level", "outcome",
        F.col("or").alias("estimate"), F.col("or_ll").alias("lci"), F.col("or_ul").alias("uci"),
        (F.regexp_extract("term", r"^(\d+)", 1).cast("int") - 1).alias("period_start"),
        F.try_to_number(F.nullif(F.regexp_extract("term", r"-(\d+)$", 1), F.lit("")), F.lit("9999")).cast("int").alias("period_end"))
    out = seq.unionByName(one)
    labels = [f"{a}-{b}" for a, b in zip(cuts, cuts[1:])]
    label = F.concat_ws("-", F.col("period_start").cast("string"), F.col("period_end").cast("string"))
    return out.withColumn("fup_period", F.when(label.isin(labels), label)).withColumn(
        "period_ord", level_order(F.col("fup_period"), labels))


def effect_comparison_wide(long: DataFrame) -> DataFrame:
    """One row per outcome, brand and period; one text column per design."""
    text = estimate_text(F.col("estimate"), F.col("lci"), F.col("uci"))
    return pivot_wide(
        long.withColumn("value", text), ["outcome", "brand", "fup_period", "period_ord"], "approach",
        ["Sequential trial", "Single trial"], ["value"], "{name}")


def dose_status_by_date(days: DataFrame, cfg: StudyConfig, threshold: int = 1) -> DataFrame:
    """People per dose status on every day, per 10,000."""
    a, b = cfg.brands
    first, second = F.col(f"vax{a.name}_status"), F.col(f"vax{b.name}_status")
    status, _ = case_levels([
        ((first == 0) & (second == 0), "Not vaccinated"),
        (first == 1, f"{a.descr} dose 1"), (first == 2, f"{a.descr} dose 2"),
        (second == 1, f"{b.descr} dose 1"), (second == 2, f"{b.descr} dose 2"),
    ])
    day = F.date_add(F.lit(cfg.index_date), F.col("tstart"))
    counts = days.groupBy(day.alias("date"), status.alias("status")).agg(
        roundmid_any(F.count(F.lit(1)), threshold).cast("long").alias("n"))
    return counts.withColumn("n_per_10000", share_of_total(F.col("n"), ["date"], 10000.0))


def ratio_table_wide(coefs: DataFrame, brands: Sequence[str], ids: Sequence[str] = ("variable", "label")) -> DataFrame:
    """Treatment-model odds ratios as text, one column per brand; reference levels read ``1``."""
    text = F.when(F.col("reference_row"), F.lit("1 ")).otherwise(estimate_text(F.col("or"), F.col("or_ll"), F.col("or_ul")))
    return pivot_wide(coefs.withColumn("value", text), list(ids), "brand", brands, ["value"], "{name}")


def forest_data(coefs: DataFrame, skip: Sequence[str] = ("spline(", "region"), width: int = 20) -> DataFrame:
    """Rows of a coefficient plot: reference rows marked, variables alternating in shade (on their
    first row), levels numbered in order."""
    keep = F.lit(True)
    for s in skip:
        keep = keep & ~F.col("variable").contains(s)
    df = coefs.where(keep & (F.col("variable") != "(Intercept)"))
    text = F.when(F.col("reference_row"), F.concat(F.col("label"), F.lit(" (ref)"))).otherwise(F.col("label"))
    start = F.min("ord").over(W.partitionBy("variable"))
    inner = W.partitionBy("variable").orderBy(F.col("reference_row").desc(), "ord")
    df = df.withColumns({"_start": start, "row": F.row_number().over(inner), "text": truncate_text(text, width)})
    order = F.dense_rank().over(W.orderBy("_start"))  # one row per model coefficient, never per person
    df = df.withColumn("variable_ord", order)
    return df.withColumn(
        "shade", F.when(F.col("row") == 1, F.col("variable_ord") % 2).otherwise(F.lit(0)).cast("int")).drop("_start")


def pooled_table(pooled: DataFrame, last_end: int = 63, split_at: int = 35) -> DataFrame:
    """Pooled estimates of both designs side by side; periods ending after ``split_at`` share one end."""
    end = F.when(F.col("period_end") > split_at, F.lit(last_end)).otherwise(F.col("period_end"))
    days = F.when(end > split_at, F.concat((F.col("period_start") + 1).cast("string"), F.lit("+*"))).otherwise(
        F.concat((F.col("period_start") + 1).cast("string"), F.lit("-"), end.cast("string")))
    text = F.concat(fixed(F.col("hr"), 3), F.lit(" ("), fixed(F.col("conf_low"), 3), F.lit(", "), fixed(F.col("conf_high"), 3), F.lit(")"))
    df = pooled.withColumns({"days": days, "midpoint": (end + F.col("period_start")) / 2, "value": text})
    return pivot_wide(df, ["brand", "outcome", "days"], "approach", ["Single trial", "Sequential trial"], ["value"], "{name}")
