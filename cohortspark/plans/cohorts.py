"""From person and event tables to eligible cohorts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cohortspark.config import StudyConfig
from cohortspark.operators import eligibility, recode
from cohortspark.operators.lookup import Find, lookup
from cohortspark.session import by_person

OUTCOMES = {"postest": "postest_date", "admitted": "admitted_date", "death": "death_date", "dereg": "dereg_date"}


def people_with_doses(persons: DataFrame, events: DataFrame, cfg: StudyConfig) -> DataFrame:
    """Persons with derived demographics, risk groups and their first two doses from the index date on."""
    brands = [b.name for b in cfg.brands]
    history = recode.dose_history(events.where(F.col("date") >= F.lit(cfg.index_date)), brands)
    wide = recode.dose_wide(history, cfg)
    people = recode.add_risk_groups(recode.add_demographics(by_person(persons)))
    return people.join(wide, "patient_id", "left")


def history_before(events: DataFrame, spells: DataFrame, anchors: DataFrame, anchor: str = "anchor_date") -> DataFrame:
    """What is known before the anchor date: last positive test, admission with its discharge, death,
    deregistration, number of tests."""
    before = F.date_sub(F.col(anchor), 1)
    kind = F.col("kind")
    out = lookup(events, anchors, [
        Find("postest_0_date", where=kind == "postest", on_or_before=before),
        Find("death_0_date", where=kind == "death", on_or_before=before),
        Find("dereg_0_date", where=kind == "dereg", on_or_before=before),
        Find("n_tests", "count", where=kind.isin("test", "postest"), on_or_before=before),
    ])
    stay = F.struct("discharged_date")
    out = lookup(spells, out, [
        Find("admitted_0_date", on_or_before=before),
        Find("_stay", "value", on_or_before=before, value=stay),
    ], date="admitted_date")
    return out.withColumn("discharged_0_date", F.col("_stay.discharged_date")).drop("_stay")


def with_history(people: DataFrame, events: DataFrame, spells: DataFrame, anchor: Column) -> DataFrame:
    """People alive and registered at their anchor date, with their history before it."""
    dated = people.withColumn("anchor_date", anchor)
    known = history_before(events, spells, dated.select("patient_id", "anchor_date").where("anchor_date is not null"))
    # one anchor per person here, so the person alone is the key and no new shuffle is needed
    df = dated.join(known.drop("anchor_date"), "patient_id")
    df = df.where(F.col("death_0_date").isNull() & F.col("dereg_0_date").isNull())
    return recode.add_history(df, F.col("anchor_date"), ["postest_0_date"], tests="n_tests")


def treated_cohort(people: DataFrame, events: DataFrame, spells: DataFrame, cfg: StudyConfig) -> DataFrame:
    """Everybody ever treated, anchored at the first dose, with cumulative inclusion flags."""
    df = with_history(people.where("vax1_date is not null"), events, spells, F.col("vax1_date"))
    return eligibility.apply_criteria(
        df, {**eligibility.treated_criteria(cfg), **eligibility.common_criteria(in_hospital=True)})


def control_cohort(people: DataFrame, events: DataFrame, spells: DataFrame, cfg: StudyConfig) -> DataFrame:
    """Potential controls: untreated at the start of the index date."""
    df = with_history(people, events, spells, F.lit(cfg.index_date))
    return eligibility.apply_criteria(df, {
        **eligibility.untreated_criteria(cfg, F.col("anchor_date"), strict=True),
        **eligibility.common_criteria(in_hospital=True)})


def controls_as_of(people: DataFrame, events: DataFrame, spells: DataFrame, anchors: DataFrame, cfg: StudyConfig) -> DataFrame:
    """Criteria of untreated people at any number of dates each.

    anchors: patient_id, anchor_date and further columns, which are kept. History, infection, hospital stay and
    treatment status are those of the anchor date; people dead or deregistered by then have no row.
    """
    known = history_before(events, spells, anchors.select("patient_id", "anchor_date").distinct())
    df = anchors.join(known, ["patient_id", "anchor_date"]).join(people, "patient_id")
    df = df.where(F.col("death_0_date").isNull() & F.col("dereg_0_date").isNull())
    df = recode.add_history(df, F.col("anchor_date"), ["postest_0_date"], tests="n_tests")
    return eligibility.apply_criteria(df, {
        **eligibility.untreated_criteria(cfg, F.col("anchor_date"), strict=True),
        **eligibility.common_criteria(in_hospital=True)})


def single_cohort(people: DataFrame, events: DataFrame, spells: DataFrame, cfg: StudyConfig) -> DataFrame:
    """The single-trial cohort: eligible at the index date, treated on or after it or never."""
    df = with_history(people, events, spells, F.lit(cfg.index_date))
    return eligibility.apply_criteria(df, {
        **eligibility.untreated_criteria(cfg, F.col("anchor_date"), strict=False),
        **eligibility.common_criteria(in_hospital=False)})


def outcomes_after(events: DataFrame, anchors: DataFrame, anchor: str) -> DataFrame:
    """First date of each outcome on or after the anchor date."""
    return lookup(events, anchors, [
        Find(f"{name}_date", "date", "first", F.col("kind") == kind, on_or_after=F.col(anchor))
        for name, kind in (("postest", "postest"), ("admitted", "admission"), ("death", "death"), ("dereg", "dereg"))
    ])
