"""Single trial: person-days, inverse-probability weights, marginal structural model."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from cohortspark.config import StudyConfig
from cohortspark.functions.columns import timesince_cut, timesince_labels, tte
from cohortspark.operators import intervals, ipw, logistic, sampling
from cohortspark.operators.design import Factor, Number, Powers, Product, Spline, columns_of
from cohortspark.plans import cohorts
from cohortspark.session import tasks_for, written

HOSPITAL_LEVELS = ("Not in hospital", "In hospital", "1-21", "22-28")
TTE_EVENTS = ("vaxany1", "vaxany2", "postest", "admitted", "death", "dereg")


def time_to_event(cohort: DataFrame, events: DataFrame, cfg: StudyConfig) -> DataFrame:
    """One row per person: whole days from the day before the index date to every event."""
    anchors = cohort.select("patient_id").withColumn("index_date", F.lit(cfg.index_date))
    found = cohorts.outcomes_after(events, anchors, "index_date")
    df = cohort.select("patient_id", "ageband2", "vax1_date", "vax2_date", "vax1_type", "vax2_type").join(found, "patient_id")
    start, end = F.date_sub(F.lit(cfg.index_date), 1), F.lit(cfg.end_date)
    last = F.least(F.date_add("vax1_date", cfg.max_followup), F.col("death_date"), end, F.col("dereg_date"))
    df = df.withColumn("lastfup_date", last)
    to = lambda day: tte(start, F.col(day), F.col("lastfup_date"), na_censor=True).cast("int")
    days = {"vaxany1": "vax1_date", "vaxany2": "vax2_date", "postest": "postest_date",
            "admitted": "admitted_date", "death": "death_date"}
    df = df.withColumns({
        "tte_enddate": F.datediff(end, start), "tte_lastfup": F.datediff("lastfup_date", start),
        "tte_dereg": F.when(F.col("dereg_date").isNotNull(), F.datediff("dereg_date", start)),
        **{f"tte_{n}": to(d) for n, d in days.items()}})
    return df.withColumns({
        f"tte_vax{b.name}{k}": F.when(F.col(f"vax{k}_type") == b.name, F.col(f"tte_vaxany{k}"))
        for b in cfg.brands for k in (1, 2)})


def at_risk_starts(df: DataFrame, cfg: StudyConfig) -> DataFrame:
    """Day from which each age band may get any brand (``start_any``) and each brand (``start_<brand>``)."""
    origin = F.date_sub(F.lit(cfg.index_date), 1)
    phase = None
    for label, day in cfg.age_phases:
        hit = F.col("ageband2") == label
        phase = F.when(hit, F.lit(day)) if phase is None else phase.when(hit, F.lit(day))
    first = F.date_sub(phase, 1)
    return df.withColumns({
        "start_any": F.datediff(first, origin) - 1,
        **{f"start_{b.name}": F.datediff(F.greatest(F.lit(b.start), first), origin) - 1 for b in cfg.brands}})


def with_hospital_changes(base: DataFrame, spells: DataFrame, cfg: StudyConfig) -> DataFrame:
    """Attach each person's admissions and discharges as change arrays, infectious and other apart."""
    origin = F.date_sub(F.lit(cfg.index_date), 1)
    sides = F.array(
        F.struct(F.col("admitted_date").alias("d"), F.lit(1).alias("v"), F.lit(0).alias("o")),
        F.struct(F.col("discharged_date").alias("d"), F.lit(0).alias("v"), F.lit(1).alias("o")))
    long = spells.select("patient_id", "infectious", "admitted_date", "event_id", F.explode(sides).alias("_s")).select(
        "patient_id", "infectious", "admitted_date", "event_id", F.col("_s.v").alias("v"), F.col("_s.o").alias("o"),
        F.datediff("_s.d", origin).alias("t")).where("t is not null")
    per_day = long.groupBy("patient_id", "infectious", "t").agg(
        F.max_by("v", F.struct("admitted_date", "event_id", "o")).alias("v"),
        F.max(F.when(F.col("v") == 0, F.lit(1)).otherwise(F.lit(0))).alias("out"))
    pick = lambda flag: F.array_sort(F.collect_list(F.when(flag, F.struct("t", "v"))))
    outs = lambda flag: F.array_sort(F.collect_list(F.when(flag & (F.col("out") == 1), F.col("t"))))
    yes, no = F.col("infectious"), ~F.col("infectious")
    arrays = per_day.groupBy("patient_id").agg(
        pick(yes).alias("hospinf_status_changes"), pick(no).alias("hospnoninf_status_changes"),
        outs(yes).alias("hospinf_out"), outs(no).alias("hospnoninf_out"))
    df = base.join(arrays, "patient_id", "left")
    within = lambda c: F.filter(F.coalesce(c, F.array().cast("array<int>")), lambda t: (t > 0) & (t <= F.col("tte_lastfup")))
    kept = lambda c: F.filter(c, lambda x: x["t"] <= F.col("tte_lastfup"))
    return df.withColumns({
        **{f"{h}_out": within(F.col(f"{h}_out")) for h in ("hospinf", "hospnoninf")},
        **{f"{h}_status_changes": kept(F.col(f"{h}_status_changes")) for h in ("hospinf", "hospnoninf")}})


def counting_process(base: DataFrame, cfg: StudyConfig, carry: Sequence[str] = ()) -> DataFrame:
    """Intervals with all statuses and event flags, and the columns person-days are derived from; ``carry``: more to keep."""
    brands = [b.name for b in cfg.brands]
    doses = ["vaxany1", "vaxany2", *[f"vax{b}{k}" for b in brands for k in (1, 2)]]
    marks = [*doses, "postest", "admitted", "death", "dereg"]
    steps = {"vaxany_atrisk": "start_any", **{f"vax{b}_atrisk": f"start_{b}" for b in brands},
             **{f"{m}_status": f"tte_{m}" for m in marks}}
    keep = ["patient_id", "hospinf_out", "hospnoninf_out", *[f"tte_{d}" for d in doses], *carry]
    out = intervals.to_intervals(
        base, "tte_lastfup", steps, {**{m: f"tte_{m}" for m in marks}, "lastfup": "tte_lastfup"},
        ["hospinf_status_changes", "hospnoninf_status_changes"], keep)
    for b in brands:
        out = intervals.mask(out, f"vax{b}_atrisk", "vaxany_atrisk")
    ended = lambda h: F.array_contains(f"{h}_out", F.col("tstop")).cast("int")
    return out.withColumns({
        "hospinf_discharge": ended("hospinf"), "hospnoninf_discharge": ended("hospnoninf"),
        "twidth": F.col("tstop") - F.col("tstart"),
        **{f"vax{b}_status": F.col(f"vax{b}1_status") + F.col(f"vax{b}2_status") for b in ("any", *brands)}})


def person_days(intervals_df: DataFrame, cfg: StudyConfig) -> DataFrame:
    """One row per person and day with time since each dose and time since discharge.

    Days come from a narrow explode; counters follow from the onset times, so no window is needed.
    """
    brands = [b.name for b in cfg.brands]
    doses = ["vaxany1", "vaxany2", *[f"vax{b}{k}" for b in brands for k in (1, 2)]]
    flags = [*doses, "postest", "admitted", "death", "dereg", "hospinf_discharge", "hospnoninf_discharge", "lastfup"]
    day, hospitals = F.col("tstop"), ("hospinf", "hospnoninf")
    # the last discharge at both ends of an interval: where they are the same, so it is on every day between
    ends = {f"_{h}_{end}": intervals.last_time_before(F.col(f"{h}_out"), F.col(end)) for h in hospitals for end in ("tstart", "tstop")}
    days = intervals.person_days(intervals_df.withColumns(ends), flags)
    # columns of their own, read several times below
    days = days.withColumns({f"_{h}_last": F.when(F.col(f"_{h}_tstart").eqNullSafe(F.col(f"_{h}_tstop")), F.col(f"_{h}_tstop")).otherwise(
        intervals.last_time_before(F.col(f"{h}_out"), day)) for h in hospitals})
    days = days.withColumns({
        **{f"{d}_timesince": intervals.days_since(F.col(f"tte_{d}"), day) for d in doses},
        **{f"timesince_{h}discharge": intervals.time_since_discharge(F.col(f"{h}_status"), F.col(f"_{h}_last"), day) for h in hospitals}})
    return days.drop("hospinf_out", "hospnoninf_out", "twidth", *ends, *[f"_{h}_last" for h in hospitals], *[f"tte_{d}" for d in doses])


def person_day_table(cohort: DataFrame, events: DataFrame, spells: DataFrame, cfg: StudyConfig) -> DataFrame:
    base = with_hospital_changes(at_risk_starts(time_to_event(cohort, events, cfg), cfg), spells, cfg)
    return person_days(counting_process(base, cfg), cfg)


def risk_window(base: DataFrame, outcome: str, brand: str) -> DataFrame:
    """Decide on the person's row which days belong to the analysis of one outcome and brand.

    Adds ``risk_from`` and ``risk_to``: days that start from the one on and before the other count. They begin when the
    brand is in use and end the day after the outcome, a competing brand or a second dose. All these statuses begin
    once and never end, so a day's statuses follow from the times alone. ``infected_untreated``: some counted
    day is after the infection and before any dose. People without a counted day go.
    """
    from_brand, from_any = F.col(f"start_{brand}"), F.col("start_any")
    competing = F.when(F.col(f"tte_vax{brand}1").isNull(), F.col("tte_vaxany1")) if brand != "any" else F.lit(None).cast("int")
    out = base.where(from_brand.isNotNull() & from_any.isNotNull()).withColumns({
        "risk_from": F.greatest(from_brand, from_any, F.lit(0)),
        "risk_to": F.least("tte_lastfup", f"tte_{outcome}", competing, "tte_vaxany2")}).where("risk_from < risk_to")
    infected = F.greatest("risk_from", "tte_postest")
    untreated = F.col("tte_vaxany1").isNull() | (F.col("tte_vaxany1") > infected)
    return out.withColumn("infected_untreated", F.coalesce(
        F.col("tte_postest").isNotNull() & (infected < F.col("risk_to")) & untreated, F.lit(False)))


#: Columns that each use of the at-risk days takes besides ids, times, outcome, treatment and covariates.
STAGES = {"msm": ("death_atrisk",), "preflight": ("death", "dereg")}


def at_risk_days(base: DataFrame, fixed: DataFrame, outcome: str, brand: str, cfg: StudyConfig, stage: str = "msm",
                 subgroup: str | None = None, level: str | None = None, tasks: int | None = None) -> DataFrame:
    """Person-days of the single-trial analysis of one outcome and brand (or ``any``), with covariates.

    ``base``: one row per person from :func:`with_hospital_changes`. ``fixed``: one row per person with covariates. Window,
    subgroup and covariates are settled on the person's row; what is left is expanded to days once. People whose infection
    comes before treatment count as never treated. ``stage``: which columns are returned (:data:`STAGES`). ``tasks``: over how many
    tasks the people are dealt before they are expanded.
    """
    more = [c for c in fixed.columns if c not in base.columns]
    people = risk_window(base, outcome, brand).join(fixed.select("patient_id", *more), "patient_id")
    if subgroup is not None:
        people = people.where(F.col(subgroup) == level)
    if tasks is not None:
        people = people.repartition(tasks, "patient_id")
    group = [subgroup] if subgroup in base.columns else []
    spans = counting_process(people, cfg, [*more, *group, "risk_from", "risk_to", "infected_untreated"])
    spans = spans.where((F.col("tstart") >= F.col("risk_from")) & (F.col("tstart") < F.col("risk_to"))).drop("risk_from", "risk_to")
    days = person_days(spans, cfg)
    brands = ["any", *[b.name for b in cfg.brands]]
    clean = (F.col("vaxany1_status") == 0) & (F.col("postest_status") == 0)
    days = days.withColumns({
        **{f"vax{b}1_atrisk": clean & (F.col(f"vax{b}_atrisk") == 1) for b in brands}, "death_atrisk": F.col("death_status") == 0})
    never = lambda c: F.when(F.col("infected_untreated"), F.lit(0)).otherwise(F.col(c))
    days = days.withColumns({c: never(c) for b in brands for c in (f"vax{b}1", f"vax{b}1_status", f"vax{b}1_timesince")})
    days = days.withColumns({
        "timesincevax_pw": timesince_cut(F.col("vaxany1_timesince"), (0, *cfg.cuts[1:]), "pre-vax"),
        "outcome": F.col(outcome), "vax": F.col(f"vax{brand}1"), "vax_atrisk": F.col(f"vax{brand}1_atrisk")})
    own = [c for b in brands for c in (f"vax{b}1", f"vax{b}1_status", f"vax{b}1_atrisk")]
    return days.select(
        "patient_id", "tstart", "tstop", "outcome", "timesincevax_pw", "vax", "vax_atrisk", "infected_untreated", *own,
        "timesince_hospinfdischarge", "timesince_hospnoninfdischarge", *STAGES[stage], *more, *group)


def covariate_terms(cfg: StudyConfig, regions: Sequence[str], adjust: Sequence[str], spline_df: int = 5,
                    skip: Sequence[str] = ()) -> list[object]:
    """Baseline covariates and a regional secular trend; a subgroup variable can be left out."""
    region = Factor("region", tuple(regions))
    terms: list[object] = [Powers("age", 2), Factor("sex", ("Female", "Male")), *[Number(a) for a in adjust if a not in skip]]
    return [*terms, Spline("tstop", spline_df), region, Product(Spline("tstop", spline_df), region)]


def weighted_days(base: DataFrame, fixed: DataFrame, outcome: str, brand: str, cfg: StudyConfig, terms: Sequence[object],
                  subgroup: str | None = None, level: str | None = None, robust: bool = False, write: bool = True,
                  columns: Sequence[str] | None = None) -> tuple[DataFrame, list]:
    """At-risk days of one outcome and brand with stabilised weights, and the fitted treatment models.

    Treatment is any brand for ``any``, otherwise each brand has its own models. Everybody takes part unless the
    configuration asks for samples. With ``robust`` the treatment models carry their person-clustered variance.
    The days are expanded and written once, and counted once by what the models read: these are fitted on the counts.
    ``write``: write the weighted days, for callers that read them several times. ``columns``: what the caller reads of the days
    beside person, day and weights; other columns are then neither written nor sorted.
    """
    brands = ["any"] if brand == "any" else [b.name for b in cfg.brands]
    varying = [*terms, *[Factor(f"timesince_{h}discharge", HOSPITAL_LEVELS) for h in ("hospinf", "hospnoninf")]]
    tasks = tasks_for(base)
    read = {c for t in (*varying, *terms) for c in columns_of(t)} | {c for b in brands for c in (f"vax{b}1", f"vax{b}1_atrisk")}
    mine = at_risk_days(base, fixed, outcome, brand, cfg, "msm", subgroup, level, tasks)
    if columns is not None:
        mine = mine.select("patient_id", *sorted({*read, "tstop", *columns} - {"patient_id"}))
    mine = written(mine)
    kinds = None
    if cfg.ipw_sample is None:
        kinds = written(logistic.counted(mine, sorted(read), "_rows"))
    models = [(b, ipw.treatment_models(mine, f"vax{b}1", f"vax{b}1_atrisk", varying, terms, "random_n", cfg.ipw_sample, robust=robust,
                                       kinds=kinds, rows="_rows")) for b in brands]
    mine = ipw.with_stabilised_weights(mine, {f"_w_{b}": (pair, f"vax{b}1", f"vax{b}1_atrisk") for b, pair in models}, kinds)
    weights = {f"vax{b}1": F.col(f"_w_{b}") for b in brands}
    if columns is not None:
        mine = mine.select("patient_id", "tstop", *[c for c in columns if c not in ("patient_id", "tstop")], *[f"_w_{b}" for b in brands])
    if cfg.nonoutcome_sample is None:
        kept = mine.withColumn("sample_weight", F.lit(1.0))
    else:
        had = base.select("patient_id", F.col(f"tte_{outcome}").isNotNull().alias("had"))
        sampled = sampling.sample_weights(sampling.sample_nonoutcomes_n(had, cfg.nonoutcome_sample, "had"), "had")
        kept = mine.join(sampled.where("sampled").select("patient_id", "sample_weight"), "patient_id")
    out = ipw.add_weights(kept, weights, "sample_weight", tasks=tasks).drop(*[f"_w_{b}" for b, _ in models])
    return written(out) if write else out, models


def msm(weighted: DataFrame, cfg: StudyConfig, terms: Sequence[object]) -> logistic.LogisticFit:
    """Weighted pooled logistic model of the outcome on time since treatment, with robust variance."""
    labels = tuple(timesince_labels((0, *cfg.cuts[1:]), "pre-vax"))
    full, weight = [Factor("timesincevax_pw", labels), *terms], "cmlipweight_sample"
    # knots, fit and information come from the distinct rows; only the scores need the days once more
    kinds = written(logistic.counted(weighted, sorted({c for t in full for c in columns_of(t)} | {"outcome"}), "_rows", weight))
    fit = logistic.fit_logistic(kinds, full, "outcome", weight, rows="_rows", summed=True)
    return logistic.robust_logistic(weighted, fit, "outcome", "patient_id", weight, kinds=kinds, rows="_rows", summed=True)


def msm_columns(terms: Sequence[object]) -> list[str]:
    """What :func:`msm` reads of the at-risk days beside person, day and weights."""
    return sorted({c for t in terms for c in columns_of(t)} | {"timesincevax_pw", "outcome"})


def msm_by_subgroup(base: DataFrame, fixed: DataFrame, outcome: str, brand: str, cfg: StudyConfig, terms: Sequence[object],
                    subgroup: str, levels: Sequence[str]) -> DataFrame:
    """Coefficients of the marginal structural model fitted apart on each level of a subgroup; ``terms`` must not hold it."""
    tables = []
    for level in levels:
        days, _ = weighted_days(base, fixed, outcome, brand, cfg, terms, subgroup, level, columns=msm_columns(terms))
        table = logistic.coefficient_table(base.sparkSession, msm(days, cfg, terms))
        tables.append(table.withColumns({
            "brand": F.lit(brand), "subgroup": F.lit(subgroup), "subgroup_level": F.lit(level), "outcome": F.lit(outcome)}))
    return reduce(DataFrame.unionByName, tables)
