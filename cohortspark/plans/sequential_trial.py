"""Sequential trials: match per day, follow pairs up, estimate."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from cohortspark.config import StudyConfig
from cohortspark.operators import cox, intervals, matching, survival
from cohortspark.operators.design import Number
from cohortspark.plans import cohorts


def match_round(treated: DataFrame, controls: DataFrame, cfg: StudyConfig, **kw) -> DataFrame:
    """One matching round on eligible treated people and potential controls: numbered pairs."""
    pairs = matching.sequential_match(
        treated.withColumn("trial_date", F.col("vax1_date")), controls.withColumn("treated_date", F.col("vax1_date")),
        cfg.exact, dict(cfg.caliper), **kw)
    return matching.number_pairs(pairs)


@dataclass(frozen=True)
class Round:
    """What one matching round proposed, and what of it still held on the trial dates; two rows for each pair."""

    number: int
    proposed: DataFrame
    kept: DataFrame


def run_rounds(treated: DataFrame, people: DataFrame, events: DataFrame, spells: DataFrame, cfg: StudyConfig, brand: str,
               **kw) -> list[Round]:
    """The matching rounds of one brand, each with the state of those before it.

    treated: eligible treated people of the brand. A round's controls meet all criteria as of the round's own date
    (the brand's start, then every ``cfg.round_gap`` days) and met them in the rounds before. Nobody is proposed in a role in
    which an earlier pair was kept; who was proposed and not kept is free again. A pair is kept if the control still
    meets all criteria on the trial date and both still agree, with the control's values taken then.
    """
    values = [*cfg.exact, *dict(cfg.caliper)]
    # every round reads both again; written once, nothing upstream is computed again
    people, treated = matching.stable(people), matching.stable(treated.select("patient_id", "vax1_date", *values))
    rounds: list[Round] = []
    ever: DataFrame | None = None  # eligible in all rounds so far
    for number in range(1, cfg.n_rounds + 1):
        on_day = people.select("patient_id", F.lit(cfg.round_date(brand, number)).alias("anchor_date"))
        if ever is not None:
            on_day = on_day.join(ever, "patient_id", "left_semi")
        pool = cohorts.controls_as_of(people, events, spells, on_day, cfg).where("include")
        pool = matching.stable(pool.select("patient_id", "vax1_date", *values))
        ever = pool.select("patient_id")
        now = treated
        if rounds:
            done = reduce(DataFrame.unionByName, [r.kept.select("patient_id", "treated") for r in rounds])
            now = matching.drop_already_matched(treated.withColumn("treated", F.lit(1)), done).drop("treated")
            pool = matching.drop_already_matched(pool.withColumn("treated", F.lit(0)), done).drop("treated")
        proposed = matching.stable(matching.pair_members(match_round(now, pool, cfg, **kw)))
        trial = proposed.where("treated = 0").withColumn("anchor_date", F.col("trial_date"))
        still = cohorts.controls_as_of(people, events, spells, trial, cfg).where("include").select(*proposed.columns, *values)
        mine = proposed.where("treated = 1").join(treated.select("patient_id", *values), "patient_id")
        kept = matching.recheck_pairs(still.unionByName(mine), cfg.exact, dict(cfg.caliper))
        rounds.append(Round(number, proposed, matching.stable(kept.select(*proposed.columns))))
    return rounds


def match_rounds(treated: DataFrame, people: DataFrame, events: DataFrame, spells: DataFrame, cfg: StudyConfig, brand: str,
                 **kw) -> DataFrame:
    """Match status of all rounds of one brand: both members of every kept pair with their round."""
    done: DataFrame | None = None
    for r in run_rounds(treated, people, events, spells, cfg, brand, **kw):
        done = matching.add_round(r.kept, r.number, done)
    return done


def round_success(rounds: Sequence[Round]) -> DataFrame:
    """Pairs proposed, kept and the percentage kept, for each round."""
    return reduce(DataFrame.unionByName, [
        matching.success_share(r.proposed, r.kept).withColumn("matching_round", F.lit(r.number)) for r in rounds])


def matched_table(members: DataFrame, people: DataFrame, events: DataFrame) -> DataFrame:
    """Matched people with their covariates, second dose and outcomes as of the trial date. A person may
    appear once in each role, so nothing is keyed on the person alone."""
    base = members.join(people, "patient_id").withColumn(
        "dose2_date", F.when(F.col("treated") == 1, F.col("vax2_date")))
    anchors = base.select("patient_id", "trial_date").distinct()
    return base.join(cohorts.outcomes_after(events, anchors, "trial_date"), ["patient_id", "trial_date"])


def followed(matched: DataFrame, outcome: str, cfg: StudyConfig) -> DataFrame:
    return intervals.follow_up(matched, f"{outcome}_date", cfg.end_date, cfg.max_followup)


def km(matched: DataFrame, outcome: str, cfg: StudyConfig, by: Sequence[str] = (), round_to: int = 1) -> DataFrame:
    """Kaplan-Meier estimates by arm (and further columns)."""
    keys = [*by, "treated"]
    counts = survival.km_counts(followed(matched, outcome, cfg), keys, cfg.max_followup)
    return survival.km_estimates(counts, keys, round_to)


def km_all_outcomes(matched: DataFrame, cfg: StudyConfig, by: Sequence[str] = (), round_to: int = 1) -> DataFrame:
    """All outcomes at once: the outcome is one more grouping column, not one more job."""
    names = [o for o, _ in cfg.outcomes]
    parts = F.array(*[
        F.struct(F.lit(o).alias("outcome"), F.col(f"{o}_date").alias("outcome_date")) for o in names])
    keep = [c for c in (*by, "treated", "trial_date", "controlistreated_date", "dose2_date", "death_date", "dereg_date")]
    long = matched.select(*dict.fromkeys(keep), F.explode(parts).alias("_o")).select(*dict.fromkeys(keep), "_o.*")
    keys = ["outcome", *by, "treated"]
    done = intervals.follow_up(long, "outcome_date", cfg.end_date, cfg.max_followup)
    return survival.km_estimates(survival.km_counts(done, keys, cfg.max_followup), keys, round_to)


def cox_by_period(matched: DataFrame, outcome: str, cfg: StudyConfig, adjust: Sequence[str] | None = None,
                  level_col: str | None = None, levels: Sequence[str] = ("all",), **tags: str) -> DataFrame:
    """Hazard ratios per follow-up period, fitted separately for each subgroup level."""
    adjust = cfg.adjust_sequential if adjust is None else adjust
    group = [] if level_col is None else [level_col]
    # a narrow table, written once: every level and the final score pass read it
    done = matching.stable(followed(matched, outcome, cfg).select(
        "patient_id", "treated", "tte_outcome", "ind_outcome", *group,
        *[F.col(c).cast("double").alias(c) for c in adjust if c not in group]))
    parts = []
    for level in levels:
        mine = done if level_col is None else done.where(F.col(level_col) == level)
        pieces = intervals.split_follow_up(mine, "tte_outcome", "ind_outcome", cfg.cuts)
        fit = cox.cox_fit(pieces, [Number(c) for c in adjust], len(cfg.cuts) - 1)
        parts.append(cox.cox_contrasts(
            matched.sparkSession, fit, cfg.cuts, **tags, subgroup=level_col or "all", subgroup_level=level, outcome=outcome))
    return reduce(DataFrame.unionByName, parts)
