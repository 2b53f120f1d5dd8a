"""Derived person attributes: demographics, risk groups, history, doses, date normalisation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from cohortspark.config import StudyConfig
from cohortspark.functions.columns import (
    INF, any_true, case_levels, collapse, count_true, cut_band, cut_band_missing, day_index, latest, recode,
)

# fixed values: band edges (closed on the left) and their labels
AGEBAND = ([-INF, 18, 40, 50, 60, 70, 80, 90, INF],
           ["under 18", "18-39", "40-49", "50-59", "60-69", "70-79", "80-89", "90+"])
AGEBAND2 = ([-INF, 70, 80, INF], ["under 70", "70-79", "80+"])
PRIORITY_AGEBAND = ([-INF, 18, 40, 50, 55, 60, 65, 70, 75, 80, INF],
                    ["under 18", "18-39", "40-49", "50-54", "55-59", "60-64", "65-69", "70-74", "75-79", "80+"])
MORBIDITY = ([0, 1, 2, INF], ["0", "1", "2+"])
PRIOR_TESTS = ([0, 1, 2, 3, INF], ["0", "1", "2", "3+"])
SINCE_INFECTION = ([-INF, 30, 90, INF], ["<30 days", "30-90 days", "90+ days"])
IMD_QUINTILE = ["1 (most deprived)", "2", "3", "4", "5 (least deprived)"]
# fixed values: code -> label
SEX = {"F": "Female", "M": "Male"}
ETHNICITY = {"1": "White", "2": "Mixed", "3": "South Asian", "4": "Black", "5": "Other"}
PRIORITY_TEXT = {
    "1": "Care home residents and health and social care workers",
    "2": "80+ years",
    "3": "75-79 years",
    "4": "70-74 years or clinically extremely vulnerable",
    "5": "65-69 years",
    "6": "16-64 years or clinically at-risk",
    "7": "60-64 years",
    "8": "55-59 years",
    "9": "50-54 years",
    "10a": "40-49 years",
    "10b": "16-39 years",
}
# conditions that make a person clinically at risk, and those the morbidity count adds up
AT_RISK = ("immunosuppressed", "chronic_kidney_disease", "chronic_resp_disease", "diabetes", "chronic_liver_disease",
           "chronic_neuro_disease", "chronic_heart_disease", "learndis", "sev_mental")
MORBIDITIES = ("sev_obesity", "chronic_heart_disease", "chronic_kidney_disease", "diabetes", "chronic_liver_disease",
               "chronic_resp_disease", "chronic_neuro_disease")


def imd_quintile(rank: Column, n_areas: int = 32844) -> Column:
    """Deprivation fifth of an area rank; unknown without a valid rank."""
    edges = [-INF, *[n_areas * i / 5 for i in range(1, 5)], INF]
    band = cut_band(rank, edges, IMD_QUINTILE)
    return F.when(rank.isNull() | (rank < 0), F.lit("Unknown")).otherwise(band)


def add_demographics(df: DataFrame) -> DataFrame:
    """Age bands, sex, ethnicity with fallback source, deprivation fifth."""
    return df.withColumns({
        "ageband": cut_band(F.col("age"), *AGEBAND),
        "ageband2": cut_band(F.col("age"), *AGEBAND2),
        "sex": recode(F.col("sex"), SEX),
        "ethnicity_combined": recode(F.coalesce("ethnicity", "ethnicity_6_sus"), ETHNICITY),
        "imd_quintile": imd_quintile(F.col("imd")),
    }).drop("ethnicity", "ethnicity_6_sus")


def collapse_regions(df: DataFrame, groups: dict[str, Sequence[str]], col: str = "region") -> DataFrame:
    return df.withColumn(col, collapse(F.col(col), groups))


def add_risk_groups(df: DataFrame) -> DataFrame:
    """Clinical risk flag and class, morbidity count, treatment priority group."""
    age, cev = F.col("age"), F.col("cev")
    cv = any_true(*[F.col(c) for c in AT_RISK])
    risk, _ = case_levels(
        [(cev, "Clinically extremely vulnerable"), (F.col("cv"), "Clinically at-risk")], "Not clinically at-risk")
    group, _ = case_levels([
        (F.col("care_home") | F.col("hscworker"), "1"),
        (age >= 80, "2"), (age >= 75, "3"), ((age >= 70) | (cev & (age >= 16)), "4"), (age >= 65, "5"),
        (age.between(16, 64.999) & F.col("cv"), "6"), (age >= 60, "7"), (age >= 55, "8"), (age >= 50, "9"),
        (age >= 40, "10a"),
    ], "10b")
    df = df.withColumns({"cv": cv, "priority_ageband": cut_band(age, *PRIORITY_AGEBAND)})
    df = df.withColumns({
        "risk_class": risk, "priority_group": group,
        "multimorb": cut_band(count_true(*[F.col(c) for c in MORBIDITIES]), *MORBIDITY),
    })
    return df.withColumn("priority_group_descr", recode(F.col("priority_group"), PRIORITY_TEXT))


def add_history(df: DataFrame, anchor: Column, dated: Sequence[str], undated: Sequence[str] = (),
                tests: str | None = None) -> DataFrame:
    """Prior infection from any source, date of the last reliable one, time since it in bands, and the
    banded number of earlier tests. Sources in ``undated`` only count for the flag."""
    ever = any_true(*[F.col(c).isNotNull() for c in (*dated, *undated)])
    df = df.withColumns({"prior_infection": ever, "last_infection_date": latest(*[F.col(c) for c in dated])})
    since = F.datediff(anchor, F.col("last_infection_date"))
    df = df.withColumns({
        "timesince_infection": since,
        "timesince_infection_cat": cut_band_missing(since, *SINCE_INFECTION, "Never"),
    })
    return df.withColumn("prior_tests_cat", cut_band(F.col(tests), *PRIOR_TESTS)) if tests else df


def dose_history(events: DataFrame, brands: Sequence[str], kind: str = "kind") -> DataFrame:
    """Numbered treatment days with their brand. Two brands on one day make the brand ``duplicate``.

    Grouping by (person, day) replaces the full outer join of one table per brand, and leaves at most
    one row per day for the numbering window.
    """
    days = events.where(F.col(kind).isin(*brands)).groupBy("patient_id", "date").agg(
        F.min(kind).alias("_a"), F.max(kind).alias("_b"))
    w = W.partitionBy("patient_id").orderBy("date")
    return days.select(
        "patient_id", "date", F.when(F.col("_a") == F.col("_b"), F.col("_a")).otherwise("duplicate").alias("type"),
        F.row_number().over(w).alias("dose"))


def dose_wide(history: DataFrame, cfg: StudyConfig, n: int = 2) -> DataFrame:
    """First doses of each person as columns: date, brand, brand text, day of study."""
    descr = {b.name: b.descr for b in cfg.brands}
    at = lambda c, k: F.max(F.when(F.col("dose") == k, F.col(c)))
    wide = history.where(F.col("dose") <= n).groupBy("patient_id").agg(*[
        a for k in range(1, n + 1) for a in (at("date", k).alias(f"vax{k}_date"), at("type", k).alias(f"vax{k}_type"))])
    return wide.withColumns({
        **{f"vax{k}_type_descr": recode(F.col(f"vax{k}_type"), descr) for k in range(1, n + 1)},
        **{f"vax{k}_day": day_index(F.col(f"vax{k}_date"), cfg.index_date) for k in range(1, n + 1)},
    })
