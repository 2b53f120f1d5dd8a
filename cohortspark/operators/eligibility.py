"""Inclusion criteria, attrition flowcharts and match-flow categories."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from cohortspark.config import StudyConfig
from cohortspark.functions.columns import case_levels, fill_template, ratio, satisfied
from cohortspark.functions.disclosure import ceiling_any, roundmid_any
from cohortspark.operators.joins import predicate_join


def not_before_phase(cfg: StudyConfig, band: Column, day: Column) -> Column:
    """False when treatment came before the age band's own start; other bands pass."""
    out = None
    for label, start in cfg.age_phases:
        hit = (band == label) & (day < F.lit(start))
        out = F.when(hit, F.lit(False)) if out is None else out.when(hit, F.lit(False))
    return out.otherwise(F.lit(True))


def same_first_dose(recorded: str | None) -> Column:
    """The first dose agrees with the one recorded in another source (both may be missing)."""
    return F.lit(True) if recorded is None else F.col(recorded).eqNullSafe(F.col("vax1_date"))


def treated_criteria(cfg: StudyConfig, recorded: str | None = None) -> dict[str, Column]:
    """Base criteria of treated people: brand in use that day, expected brand, plausible dose gap, and
    a first dose that agrees with the other source named by ``recorded``."""
    kind, day, second = F.col("vax1_type"), F.col("vax1_date"), F.col("vax2_date")
    early = [(kind == b.name) & (day < F.lit(b.start)) for b in cfg.brands]
    intime = [(kind == b.name) & (day <= F.lit(b.end)) for b in cfg.brands]
    not_early, in_time = F.lit(True), F.lit(False)
    for e, i in zip(early, intime):
        not_early = not_early & ~satisfied(e)
        in_time = in_time | satisfied(i)
    return {
        "c0": not_early & in_time & not_before_phase(cfg, F.col("ageband2"), day),
        "c1": satisfied(kind.isin(*[b.name for b in cfg.brands]))
        & (second.isNull() | (second >= F.date_add(day, cfg.min_dose_gap)))
        & same_first_dose(recorded),
    }


def untreated_criteria(cfg: StudyConfig, index: Column, strict: bool, recorded: str | None = None) -> dict[str, Column]:
    """Base criteria of people untreated at the index date: treated after it (``strict``), or on or after."""
    day = F.col("vax1_date")
    free = day.isNull() | ((day > index) if strict else (day >= index))
    return {"c0": F.lit(True), "c1": free & not_before_phase(cfg, F.col("ageband2"), day) & same_first_dose(recorded)}


def common_criteria(in_hospital: bool) -> dict[str, Column]:
    """Criteria shared by every stage, in the order they are applied."""
    c = F.col
    known = [c(x).isNotNull() for x in ("age", "sex", "ethnicity_combined", "region")]
    demo = c("imd_quintile") != "Unknown"
    for k in known:
        demo = demo & k
    out = {
        "c2": c("has_follow_up_previous_year"),
        "c3": ~c("hscworker"),
        "c4": ~c("care_home") & ~c("housebound"),
        "c5": ~c("endoflife"),
        "c6": demo,
        "c7": ~c("prior_infection"),
    }
    if in_hospital:
        out["c8"] = c("admitted_0_date").isNull() | satisfied(c("discharged_0_date") < c("anchor_date"))
    return out


# fixed values: what each criterion of the flowchart says
CRITERIA_TEXT = {
    "c0": "All treated in the recruitment period",
    "c1": "  with an accepted treatment record",
    "c2": "  at least 1 year continuous registration",
    "c3": "  not a health or social care worker",
    "c4": "  not a care home resident or housebound",
    "c5": "  not receiving end-of-life care",
    "c6": "  no missing demographic information",
    "c7": "  no evidence of prior infection",
    "c8": "  not in hospital on trial date",
}


def apply_criteria(df: DataFrame, criteria: Mapping[str, Column]) -> DataFrame:
    """Add each criterion as the conjunction of itself and all before it, and ``include`` for the last."""
    flags: dict[str, Column] = {}
    so_far = F.lit(True)
    for name, test in criteria.items():
        so_far = so_far & satisfied(test)
        flags[name] = so_far
    return df.withColumns({**flags, "include": so_far})


def flowchart(df: DataFrame, criteria: Sequence[str], by: Sequence[str] = (), threshold: int | None = None,
              text: Mapping[str, str] = CRITERIA_TEXT) -> DataFrame:
    """Attrition: people left after each criterion, excluded by it, and shares. With a threshold the
    counts are rounded up first and everything else follows from the rounded counts."""
    sums = df.groupBy(*by).agg(*[F.coalesce(F.sum(F.col(c).cast("long")), F.lit(0)).alias(c) for c in criteria])
    rows = F.array(*[
        F.struct(F.lit(i).alias("ord"), F.lit(c).alias("crit"), F.lit(text.get(c, c)).alias("criteria"), F.col(c).alias("n"))
        for i, c in enumerate(criteria)
    ])
    long = sums.select(*by, F.explode(rows).alias("_r")).select(*by, "_r.*")
    if threshold is not None:
        long = long.withColumn("n", ceiling_any(F.col("n"), threshold).cast("long"))
    w = W.partitionBy(*by).orderBy("ord")
    before = F.lag("n").over(w)
    return long.withColumns({
        "n_exclude": before - F.col("n"), "pct_exclude": ratio(before - F.col("n"), before),
        "pct_all": ratio(F.col("n"), F.first("n").over(w)), "pct_step": ratio(F.col("n"), before),
    })


# fixed values: the categories of the match flow and the boxes that group them
FLOW_CATEGORIES = {
    "A": "treated on day 1, unmatched",
    "B": "treated on day 1, matched as treated",
    "C": "treated later, never matched",
    "D": "treated later, matched as treated only",
    "E": "treated later, matched as control only",
    "F": "treated later, matched as control and as treated",
    "G": "untreated throughout, unmatched",
    "H": "untreated throughout, matched as control",
    "I": "treated with another brand, matched as control",
}
FLOW_BOXES = {
    "ABCDEF": "Treated with {brand} during recruitment",
    "AC": "Treated with {brand} during recruitment, never matched",
    "BDF": "Treated with {brand} during recruitment, matched as treated",
    "E": "Treated with {brand} during recruitment, matched as control only",
    "F": "Treated with {brand} during recruitment, matched as treated and as control",
    "EFHI": "Matched as control in the {brand} trial",
    "GH": "Untreated up to the end of recruitment",
    "G": "Untreated up to the end of recruitment, unmatched",
    "H": "Untreated up to the end of recruitment, matched as control",
    "I": "Treated with another brand during recruitment, matched as control",
}


def match_flow(people: DataFrame, members: DataFrame, brand: str, start: date, end: date) -> DataFrame:
    """Flow category of every eligible person in one brand's trial."""
    roles = members.groupBy("patient_id").agg(
        F.max(F.col("treated") == 1).alias("as_treated"), F.max(F.col("treated") == 0).alias("as_control"))
    df = people.join(roles, "patient_id", "left").fillna(False, ["as_treated", "as_control"])
    day, mine = F.col("vax1_date"), F.col("vax1_type") == brand
    t, c = F.col("as_treated"), F.col("as_control")
    first, during = mine & (day == F.lit(start)), mine & (day <= F.lit(end))
    never = day.isNull() | (day > F.lit(end))
    crit, _ = case_levels([
        (first & ~c & ~t, "A"), (first & ~c & t, "B"),
        (during & ~c & ~t, "C"), (during & ~c & t, "D"), (during & c & ~t, "E"), (during & c & t, "F"),
        (never & ~c & ~t, "G"), (never & c & ~t, "H"), ((day <= F.lit(end)) & c & ~t, "I"),
    ])
    return df.select("patient_id", crit.alias("crit"))


def flow_counts(flow: DataFrame, brand: str) -> DataFrame:
    """People per category, categories without people included."""
    table = flow.sparkSession.createDataFrame(list(FLOW_CATEGORIES.items()), "crit string, criteria string")
    counts = flow.groupBy("crit").agg(F.count(F.lit(1)).alias("n"))
    return table.join(counts, "crit", "left").fillna(0, ["n"]).withColumn("brand", F.lit(brand))


def flow_boxes(counts: DataFrame, overlap: DataFrame, threshold: int = 1) -> DataFrame:
    """Totals of the boxes. A box lists its categories; boxes holding untreated people use the
    across-brand counts in ``overlap`` (crit, n)."""
    boxes = counts.sparkSession.createDataFrame(list(FLOW_BOXES.items()), "box_crit string, box_descr string")
    has = lambda box, crit: box.contains(crit)
    total = lambda df, *keys: df.groupBy(*keys, "box_crit", "box_descr").agg(F.sum("n").alias("n"))
    of_brand = predicate_join(boxes.where(~F.col("box_crit").contains("G")), counts, {"box_crit": "crit"}, has, "left")
    shared = predicate_join(boxes.where(F.col("box_crit").contains("G")), overlap, {"box_crit": "crit"}, has, "left")
    out = total(of_brand, "brand").unionByName(total(shared).withColumn("brand", F.lit("untreated")))
    out = out.withColumn("n", roundmid_any(F.col("n"), threshold).cast("long"))
    return out.select("brand", F.col("box_crit").alias("crit"), "n",
                      fill_template(F.col("box_descr"), {"brand": F.col("brand")}).alias("criteria"))


def brand_overlap(flows: DataFrame, n_brands: int) -> DataFrame:
    """People in H for any brand and people in G for every brand: (crit, n). ``flows`` has one row per
    person and brand; one aggregate replaces the self-joins."""
    per = flows.groupBy("patient_id").agg(
        F.max(F.col("crit") == "H").alias("h"), F.sum((F.col("crit") == "G").cast("int")).alias("g"))
    row = per.agg(F.sum(F.col("h").cast("long")).alias("H"), F.sum((F.col("g") == n_brands).cast("long")).alias("G"))
    pairs = F.array(*[F.struct(F.lit(x).alias("crit"), F.coalesce(F.col(x), F.lit(0)).alias("n")) for x in ("G", "H")])
    return row.select(F.explode(pairs).alias("_s")).select("_s.*")


def final_flowchart(single: DataFrame, boxes: DataFrame) -> DataFrame:
    """Single-trial attrition and sequential-trial boxes in one table."""
    return single.withColumn("brand", F.lit("single")).unionByName(boxes, allowMissingColumns=True)
