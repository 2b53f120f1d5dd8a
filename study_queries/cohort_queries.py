"""Recoding, doses, eligibility, flowcharts, matching, follow-up and survival queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortspark import fixture as fx
from cohortspark.operators import eligibility as el, intervals, matching, recode, survival
from cohortspark.plans import sequential_trial as seq
from study_queries import chain
from study_queries.chain import CFG, sql
from study_queries.registry import query


@query(sql("""SELECT patient_id, age, sex, region, ageband, ageband2, ethnicity_combined, imd_quintile FROM people""", "people"))
def recode_demographics(spark, sf):
    return recode.add_demographics(fx.persons(spark, sf)).select(
        "patient_id", "age", "sex", "region", "ageband", "ageband2", "ethnicity_combined", "imd_quintile")


@query(sql(f"""SELECT patient_id, cv, risk_class, multimorb, {chain.PRIORITY_AGEBAND} AS priority_ageband, g AS priority_group,
 CASE g WHEN '1' THEN 'Care home residents and health and social care workers' WHEN '2' THEN '80+ years' WHEN '3' THEN '75-79 years'
  WHEN '4' THEN '70-74 years or clinically extremely vulnerable' WHEN '5' THEN '65-69 years' WHEN '6' THEN '16-64 years or clinically at-risk' END AS priority_group_descr
 FROM (SELECT *, CASE WHEN care_home OR hscworker THEN '1' WHEN age>=80 THEN '2' WHEN age>=75 THEN '3' WHEN age>=70 OR cev THEN '4' WHEN age>=65 THEN '5'
  WHEN cv THEN '6' END AS g FROM people)""", "people"))
def risk_groups(spark, sf):
    return recode.add_risk_groups(fx.persons(spark, sf)).select(
        "patient_id", "cv", "risk_class", "multimorb", "priority_ageband", "priority_group", "priority_group_descr")


@query(sql("""SELECT patient_id, postest_0_date IS NOT NULL AS prior_infection,
 CAST(DATE '1997-01-01' - postest_0_date AS INT) AS timesince_infection,
 CASE WHEN postest_0_date IS NULL THEN 'Never' WHEN DATE '1997-01-01' - postest_0_date < 30 THEN '<30 days'
  WHEN DATE '1997-01-01' - postest_0_date < 90 THEN '30-90 days' ELSE '90+ days' END AS timesince_infection_cat,
 CASE WHEN n_tests >= 3 THEN '3+' ELSE CAST(n_tests AS VARCHAR) END AS prior_tests_cat FROM single""", "single"))
def infection_history(spark, sf):
    return chain.single(spark, sf).select(
        "patient_id", "prior_infection", "timesince_infection", "timesince_infection_cat", "prior_tests_cat")


@query(fx.with_sql("ev") + """SELECT patient_id, date, CASE WHEN bool_or(kind='pfizer') AND bool_or(kind='az') THEN 'duplicate' ELSE min(kind) END AS type,
 CAST(row_number() OVER (PARTITION BY patient_id ORDER BY date) AS INT) AS dose FROM ev WHERE kind IN ('pfizer','az') GROUP BY 1, 2""")
def dose_history(spark, sf):
    return recode.dose_history(fx.events(spark, sf), ["pfizer", "az"])


@query(sql("""SELECT patient_id, vax1_date, vax1_type, vax2_date, vax2_type,
 CASE vax1_type WHEN 'pfizer' THEN 'BNT162b2' WHEN 'az' THEN 'ChAdOx1' END AS vax1_type_descr,
 CASE vax2_type WHEN 'pfizer' THEN 'BNT162b2' WHEN 'az' THEN 'ChAdOx1' END AS vax2_type_descr,
 CAST(vax1_date - DATE '1997-01-01' + 1 AS INT) AS vax1_day, CAST(vax2_date - DATE '1997-01-01' + 1 AS INT) AS vax2_day FROM dosew""", "dosew"))
def dose_wide(spark, sf):
    ev = fx.events(spark, sf).where("date >= '1997-01-01'")
    return recode.dose_wide(recode.dose_history(ev, ["pfizer", "az"]), CFG)


CS = ", ".join(f"c{i}" for i in range(9))


@query(sql(f"SELECT patient_id, {CS}, include FROM treated", "treated"))
def eligibility_flags(spark, sf):
    return chain.treated(spark, sf).select("patient_id", *[f"c{i}" for i in range(9)], "include")


@query(sql(f"SELECT patient_id, {CS}, include FROM control", "control"))
def control_eligibility_flags(spark, sf):
    return chain.controls(spark, sf).select("patient_id", *[f"c{i}" for i in range(9)], "include")


@query(sql("SELECT patient_id, age, sex, region, ageband2, risk_class, vax1_date, vax1_type FROM single WHERE include", "single"))
def eligible_cohort(spark, sf):
    return chain.single(spark, sf).where("include").select(
        "patient_id", "age", "sex", "region", "ageband2", "risk_class", "vax1_date", "vax1_type")


def _flow_sql(rounded: bool) -> str:
    texts = " ".join(f"WHEN 'c{i}' THEN '{t}'" for i, t in enumerate(el.CRITERIA_TEXT.values()))
    n = "CAST(ceil(round(n0/6.0, 8))*6 AS BIGINT)" if rounded else "n0"
    w = "OVER (PARTITION BY vax1_type ORDER BY ord)"
    return sql(f"""SELECT vax1_type, ord, crit, CASE crit {texts} END AS criteria, n, lag(n) {w} - n AS n_exclude,
 (lag(n) {w} - n)/nullif(lag(n) {w},0)::DOUBLE AS pct_exclude, n/nullif(first_value(n) {w},0)::DOUBLE AS pct_all, n/nullif(lag(n) {w},0)::DOUBLE AS pct_step
 FROM (SELECT vax1_type, CAST(right(crit,1) AS INT) AS ord, crit, {n} AS n FROM (
  SELECT vax1_type, crit, CAST(n0 AS BIGINT) AS n0 FROM (SELECT vax1_type, {', '.join(f'count(*) FILTER (c{i}) AS c{i}' for i in range(9))} FROM treated
  WHERE vax1_type IN ('pfizer','az') GROUP BY 1) UNPIVOT (n0 FOR crit IN ({CS}))))""", "treated")


@query(_flow_sql(False))
def flowchart(spark, sf):
    df = chain.treated(spark, sf).where(F.col("vax1_type").isin("pfizer", "az"))
    return el.flowchart(df, [f"c{i}" for i in range(9)], ["vax1_type"])


@query(_flow_sql(True))
def flowchart_rounded(spark, sf):
    df = chain.treated(spark, sf).where(F.col("vax1_type").isin("pfizer", "az"))
    return el.flowchart(df, [f"c{i}" for i in range(9)], ["vax1_type"], CFG.threshold)


# -- matching -------------------------------------------------------------------------------------

@query(sql("SELECT region, sex, treated_id, control_id, trial_date, controlistreated_date, match_id FROM pairs_a", "pairs_a"))
def sequential_match(spark, sf):
    return chain.pairs(spark, sf)


@query(sql("""SELECT t.id AS patient_id, p.match_id, CASE WHEN p.match_id IS NULL THEN 0 ELSE 1 END AS matched, 1 AS treated,
 CASE WHEN p.match_id IS NOT NULL THEN 0 END AS control, t.day AS trial_date, p.controlistreated_date,
 CAST(t.day - DATE '1997-01-01' AS INT) AS trial_time FROM t_a t LEFT JOIN pairs_a p ON p.treated_id=t.id AND p.trial_date=t.day
 UNION ALL SELECT control_id, match_id, 1, 0, 1, trial_date, controlistreated_date, CAST(trial_date - DATE '1997-01-01' AS INT) FROM pairs_a""", "pairs_a"))
def match_status(spark, sf):
    mine = chain.treated(spark, sf).where(F.col("include") & (F.col("vax1_type") == chain.BRAND))
    mine = mine.withColumn("trial_date", F.col("vax1_date"))
    return matching.match_status(mine, chain.pairs(spark, sf), CFG.index_date)


RANK_T = """SELECT region, sex, patient_id AS treated_id, vax1_date AS trial_date, row_number() OVER (PARTITION BY region, sex ORDER BY vax1_date, patient_id) AS k
 FROM people WHERE vax1_type='pfizer' AND sex IS NOT NULL AND region IS NOT NULL"""
RANK_C = """SELECT region, sex, patient_id AS control_id, row_number() OVER (PARTITION BY region, sex ORDER BY patient_id) AS k
 FROM people WHERE vax1_date IS NULL AND sex IS NOT NULL AND region IS NOT NULL"""


def _rank_pairs(spark, sf):
    who = chain.people(spark, sf)
    t = who.where("vax1_type = 'pfizer'").withColumn("trial_date", F.col("vax1_date"))
    return matching.exact_rank_match(t, who.where("vax1_date is null"), ["region", "sex"])


@query(sql("SELECT region, sex, treated_id, control_id, trial_date FROM rt JOIN rc USING (region, sex, k)", "people", rt=RANK_T, rc=RANK_C))
def exact_rank_match(spark, sf):
    return _rank_pairs(spark, sf)


# an age that changes for a third of the people between matching and re-check
NOW_AGE_SQL = "(age + CASE WHEN patient_id%3=0 THEN 2 ELSE 0 END)"


@query(sql(f"""SELECT m.patient_id, m.treated, m.trial_date, m.match_id FROM mem m JOIN (
 SELECT trial_date, match_id FROM mem GROUP BY 1, 2 HAVING count(*)=2 AND min(region)=max(region) AND min(sex)=max(sex)
 AND max(age_now)-min(age_now)<=3 AND bool_and(ok)) USING (trial_date, match_id)""", "members_a", "people",
 mem=f"""SELECT m.*, region, sex, {NOW_AGE_SQL} AS age_now, patient_id%17<>0 AS ok FROM members_a m JOIN people USING (patient_id)"""))
def rematch_check(spark, sf):
    who = chain.people(spark, sf).select(
        "patient_id", "region", "sex", (F.col("age") + F.when(F.col("patient_id") % 3 == 0, 2).otherwise(0)).alias("age_now"),
        (F.col("patient_id") % 17 != 0).alias("ok"))
    members = matching.pair_members(chain.pairs(spark, sf)).join(who, "patient_id")
    return matching.recheck_pairs(members, ["region", "sex"], {"age_now": 3}, "ok").select(
        "patient_id", "treated", "trial_date", "match_id")


@query(sql("""SELECT patient_id, 0 AS treated, age FROM control WHERE include AND patient_id NOT IN (SELECT control_id FROM pairs_a)
 UNION ALL SELECT patient_id, 1, age FROM treated WHERE include AND vax1_type='pfizer' AND patient_id NOT IN (SELECT treated_id FROM pairs_a)""", "pairs_a"))
def match_carryover_anti(spark, sf):
    done = matching.pair_members(chain.pairs(spark, sf))
    pool = chain.controls(spark, sf).where("include").select("patient_id", F.lit(0).alias("treated"), "age")
    mine = chain.treated(spark, sf).where(F.col("include") & (F.col("vax1_type") == chain.BRAND))
    mine = mine.select("patient_id", F.lit(1).alias("treated"), "age")
    return matching.drop_already_matched(pool.unionByName(mine), done)


@query(sql(f"""SELECT status, date, cumuln, cumuln - lag(cumuln,1,0) OVER (PARTITION BY status ORDER BY date) AS n FROM (
 SELECT status, date, CAST({chain.mid('cn', 6)} AS BIGINT) AS cumuln FROM (
 SELECT g.status, g.date, sum(coalesce(n,0)) OVER (PARTITION BY g.status ORDER BY g.date) AS cn FROM
 (SELECT s.status, CAST(d AS DATE) AS date FROM (VALUES ('matched'),('unmatched')) s(status), range(DATE '1997-01-01', DATE '1998-01-01', INTERVAL 1 DAY) r(d)) g
 LEFT JOIN (SELECT t.day AS date, CASE WHEN p.match_id IS NULL THEN 'unmatched' ELSE 'matched' END AS status, count(*) AS n
  FROM t_a t LEFT JOIN pairs_a p ON p.treated_id=t.id GROUP BY ALL) x ON x.status=g.status AND x.date=g.date))""", "pairs_a"))
def coverage(spark, sf):
    st = match_status(spark, sf).where("treated = 1")
    return matching.coverage(st, CFG.index_date, CFG.end_date, CFG.threshold)


ROUNDS = range(1, CFG.n_rounds + 1)


@query(sql(" UNION ALL ".join(f"""SELECT {side}_id AS patient_id, match_id, trial_date, {r} AS matching_round, {role} AS treated, controlistreated_date
 FROM kept_r{r}""" for r in ROUNDS for side, role in (("treated", 1), ("control", 0))), *[f"kept_r{r}" for r in ROUNDS]))
def matching_rounds(spark, sf):
    mine = chain.treated(spark, sf).where(F.col("include") & (F.col("vax1_type") == chain.BRAND))
    return seq.match_rounds(mine, chain.people(spark, sf), fx.events(spark, sf), fx.spells(spark, sf), CFG, chain.BRAND)


@query(sql(" UNION ALL ".join(f"""SELECT {r} AS matching_round, p AS proposed, k AS kept, round(100.0*k/nullif(p, 0), 2)::DOUBLE AS pct
 FROM (SELECT count(*) AS p FROM pairs_r{r}), (SELECT count(*) AS k FROM kept_r{r})""" for r in ROUNDS), *[f"kept_r{r}" for r in ROUNDS]))
def matching_rounds_success(spark, sf):
    return seq.round_success(chain.rounds(spark, sf))


# -- match flow -----------------------------------------------------------------------------------

def _flow_case(tag: str, brand: str) -> str:
    return f"""SELECT s.patient_id, '{brand}' AS brand, CASE
 WHEN vax1_type='{brand}' AND vax1_date=DATE '1997-01-01' AND NOT ct AND NOT tr THEN 'A'
 WHEN vax1_type='{brand}' AND vax1_date=DATE '1997-01-01' AND NOT ct AND tr THEN 'B'
 WHEN vax1_type='{brand}' AND vax1_date<=DATE '1997-12-31' AND NOT ct AND NOT tr THEN 'C'
 WHEN vax1_type='{brand}' AND vax1_date<=DATE '1997-12-31' AND NOT ct AND tr THEN 'D'
 WHEN vax1_type='{brand}' AND vax1_date<=DATE '1997-12-31' AND ct AND NOT tr THEN 'E'
 WHEN vax1_type='{brand}' AND vax1_date<=DATE '1997-12-31' AND ct AND tr THEN 'F'
 WHEN (vax1_date IS NULL OR vax1_date>DATE '1997-12-31') AND NOT ct AND NOT tr THEN 'G'
 WHEN (vax1_date IS NULL OR vax1_date>DATE '1997-12-31') AND ct AND NOT tr THEN 'H'
 WHEN vax1_date<=DATE '1997-12-31' AND ct AND NOT tr THEN 'I' END AS crit
 FROM (SELECT *, patient_id IN (SELECT control_id FROM pairs_{tag}) AS ct, patient_id IN (SELECT treated_id FROM pairs_{tag}) AS tr FROM single WHERE include) s"""


FLOWS = dict(fl=f"{_flow_case('a', 'pfizer')} UNION ALL {_flow_case('b', 'az')}")
CATS = "(VALUES " + ", ".join(f"('{c}','{t}')" for c, t in el.FLOW_CATEGORIES.items()) + ") c(crit, criteria)"
BOXES = "(VALUES " + ", ".join(f"('{c}','{t}')" for c, t in el.FLOW_BOXES.items()) + ") b(box_crit, box_descr)"


def _flows(spark, sf):
    who = chain.single(spark, sf).where("include").select("patient_id", "vax1_date", "vax1_type")
    return {b.name: el.match_flow(who, matching.pair_members(chain.pairs(spark, sf, b.name)), b.name, b.start, b.end)
            for b in CFG.brands}


@query(sql(f"""SELECT b.brand, c.crit, c.criteria, count(fl.patient_id) AS n FROM {CATS} CROSS JOIN (VALUES ('pfizer'),('az')) b(brand)
 LEFT JOIN fl ON fl.crit=c.crit AND fl.brand=b.brand GROUP BY ALL""", "pairs_a", "pairs_b", "single", **FLOWS))
def match_flow_categories(spark, sf):
    a, b = [el.flow_counts(f, name) for name, f in _flows(spark, sf).items()]
    return a.unionByName(b)


OVER = """SELECT 'H' AS crit, count(DISTINCT patient_id) FILTER (crit='H') AS n FROM fl
 UNION ALL SELECT 'G', count(*) FROM (SELECT patient_id FROM fl WHERE crit='G' GROUP BY 1 HAVING count(*)=2)"""


@query(sql(OVER, "pairs_a", "pairs_b", "single", **FLOWS))
def brand_overlap(spark, sf):
    tagged = [f.withColumn("brand", F.lit(n)) for n, f in _flows(spark, sf).items()]
    return el.brand_overlap(tagged[0].unionByName(tagged[1]), 2)


BOX_COUNTS = f"""SELECT brand, box_crit AS crit, CAST({chain.mid('n', 6)} AS BIGINT) AS n, replace(box_descr, '{{brand}}', brand) AS criteria FROM (
 SELECT c.brand, box_crit, box_descr, sum(c.n) AS n FROM {BOXES} LEFT JOIN (
  SELECT b.brand, c.crit, count(fl.patient_id) AS n FROM {CATS} CROSS JOIN (VALUES ('pfizer'),('az')) b(brand)
  LEFT JOIN fl ON fl.crit=c.crit AND fl.brand=b.brand GROUP BY ALL) c ON contains(box_crit, c.crit) WHERE NOT contains(box_crit,'G') GROUP BY ALL
 UNION ALL SELECT 'untreated', box_crit, box_descr, sum(o.n) FROM {BOXES} LEFT JOIN ({OVER}) o ON contains(box_crit, o.crit) WHERE contains(box_crit,'G') GROUP BY ALL)"""


@query(sql(BOX_COUNTS, "pairs_a", "pairs_b", "single", **FLOWS))
def flow_boxes_theta_join(spark, sf):
    flows = _flows(spark, sf)
    a, b = [el.flow_counts(f, name) for name, f in flows.items()]
    over = el.brand_overlap(flows["pfizer"].unionByName(flows["az"]), 2)
    return el.flow_boxes(a.unionByName(b), over, CFG.threshold)


# -- follow-up and survival -----------------------------------------------------------------------

@query(sql("""SELECT patient_id, treated, trial_date, match_id, censor_date, matchcensor_date, tte_outcome, ind_outcome FROM fu""", "fu"))
def follow_up_tte(spark, sf):
    return chain.followed(spark, sf).select(
        "patient_id", "treated", "trial_date", "match_id", "censor_date", "matchcensor_date", "tte_outcome", "ind_outcome")


CUTS_SQL = "(VALUES " + ", ".join(f"({i + 1},{a},{b})" for i, (a, b) in enumerate(zip(CFG.cuts, CFG.cuts[1:]))) + ") p(period_id, period_start, period_end)"


@query(sql(f"""SELECT patient_id, treated, trial_date, match_id, period_id, period_start, period_end, period_start AS tstart, least(tte_outcome, period_end) AS tstop,
 CASE WHEN ind_outcome AND tte_outcome<=period_end THEN 1 ELSE 0 END AS ind_outcome FROM fu JOIN {CUTS_SQL} ON period_start < tte_outcome""", "fu"))
def split_follow_up(spark, sf):
    df = chain.followed(spark, sf).select("patient_id", "treated", "trial_date", "match_id", "tte_outcome", "ind_outcome")
    return intervals.split_follow_up(df, "tte_outcome", "ind_outcome", CFG.cuts).drop("tte_outcome")


@query(sql("SELECT treated, time, n_event, n_censor, n_risk FROM kmc", "kmc"))
def km_table(spark, sf):
    return survival.km_counts(chain.followed(spark, sf), ["treated"], CFG.max_followup)


@query(sql("SELECT * FROM km6", "km6"))
def km_rounded(spark, sf):
    return survival.km_estimates(km_table(spark, sf), ["treated"], CFG.threshold)


@query(sql("SELECT * FROM km1", "km1"))
def km_unrounded(spark, sf):
    return survival.km_estimates(km_table(spark, sf), ["treated"], 1)


LONG = {"fo": """SELECT * EXCLUDE (outcome_date), outcome_date, least(censor_date, controlistreated_date - 1) AS matchcensor_date,
 CAST(least(outcome_date, censor_date, controlistreated_date - 1) - (trial_date-1) AS INT) AS tte_outcome,
 coalesce(outcome_date <= least(censor_date, controlistreated_date - 1), false) AS ind_outcome FROM (
 SELECT o.outcome, CASE o.outcome WHEN 'postest' THEN postest_date WHEN 'admitted' THEN admitted_date ELSE death_date END AS outcome_date, m.*,
 least(death_date, dereg_date, dose2_date - 1, DATE '1997-12-31', trial_date + 69) AS censor_date
 FROM matched m CROSS JOIN (VALUES ('postest'),('admitted'),('death')) o(outcome))"""}


@query(sql("SELECT * FROM kall", "matched", **LONG, kallc=chain.km_counts_part("fo", "outcome, ageband2, treated"),
           kall=chain.km_part("kallc", "outcome, ageband2, treated", 6)))
def sequential_trial_km(spark, sf):
    """Flagship: cohort, matching, follow-up and rounded estimates for all outcomes and age bands."""
    return seq.km_all_outcomes(chain.matched(spark, sf), CFG, ["ageband2"], CFG.threshold)


def _contrast_sql(km: str) -> str:
    carried = ["surv", "surv_se", "surv_ll", "surv_ul", "risk", "risk_se", "risk_ll", "risk_ul"]
    vals = ["interval", "persontime", "n_atrisk", "n_event", "n_censor", "inc", "inc2", *carried, "cml_event", "cml_rate"]
    pre = f"""SELECT *, n_risk*"interval" AS pt, sum(n_risk*"interval") OVER w AS cpt, CAST(sum(n_event) OVER w AS BIGINT) AS cev,
 ls - coalesce(lag(ls) OVER w2, CASE WHEN lagtime=0 THEN 0 END) AS i2 FROM (SELECT *, CASE WHEN surv>0 THEN -ln(surv) END AS ls FROM {km}) k JOIN {CUTS_SQL} ON time>period_start AND time<=period_end
 WINDOW w AS (PARTITION BY treated ORDER BY time ROWS UNBOUNDED PRECEDING), w2 AS (PARTITION BY treated ORDER BY time)"""
    agg = f"""SELECT treated, period_start, period_end, sum(pt) AS persontime, arg_min(n_risk, time) AS n_atrisk, sum(n_event) AS n_event, sum(n_censor) AS n_censor,
 sum(n_event)/nullif(sum(pt),0)::DOUBLE AS inc, CASE WHEN count(*) FILTER (pt>0 AND i2 IS NULL)=0 THEN sum(i2*pt)/nullif(sum(pt),0)::DOUBLE END AS inc2,
 CASE WHEN arg_min(n_risk, time)>0 THEN sum("interval") ELSE 0 END AS "interval",
 {', '.join(f'CASE WHEN arg_min(n_risk, time)>0 THEN (max(struct_pack(t := time, v := {c}))).v END AS {c}' for c in carried)},
 CASE WHEN arg_min(n_risk, time)>0 THEN max(struct_pack(t := time, v := cev/nullif(cpt,0)::DOUBLE)).v END AS cml_rate,
 CASE WHEN arg_min(n_risk, time)>0 THEN max(struct_pack(t := time, v := cev)).v END AS cml_event FROM ({pre}) GROUP BY 1, 2, 3"""
    ints = {"interval", "persontime", "n_atrisk", "n_event", "n_censor", "cml_event"}
    cast = lambda v: "BIGINT" if v in ints else "DOUBLE"
    wide = f"""SELECT period_start, period_end, (period_start+1)::VARCHAR || ' - ' || period_end::VARCHAR AS period,
 {', '.join(f'CAST(max("{v}") FILTER (treated={a}) AS {cast(v)}) AS {v}_{a}' for v in vals for a in (0, 1))} FROM ({agg}) GROUP BY 1, 2"""
    d = lambda a, b: f"({a})/nullif({b},0)::DOUBLE"
    z = 1.959963984540054
    main = f"""SELECT *, n_atrisk_0-n_event_0 AS n_nonevent_0, n_atrisk_1-n_event_1 AS n_nonevent_1,
 {d('inc_1', 'inc_0')} AS irr, sqrt({d('1', 'n_event_0')}+{d('1', 'n_event_1')}) AS irr_ln_se,
 {d('inc2_1', 'inc2_0')} AS irr2, sqrt({d('1', 'n_event_0')}+{d('1', 'n_event_1')}) AS irr2_ln_se,
 {d('cml_rate_1', 'cml_rate_0')} AS cmlirr, sqrt({d('1', 'cml_event_0')}+{d('1', 'cml_event_1')}) AS cmlirr_ln_se,
 {d('surv_1', 'surv_0')} AS sr, {d('surv_se_0', 'surv_0')}+{d('surv_se_1', 'surv_1')} AS sr_ln_se,
 {d('risk_1', 'risk_0')} AS rr, sqrt(pow({d('risk_se_1', 'risk_1')},2)+pow({d('risk_se_0', 'risk_0')},2)) AS rr_ln_se,
 risk_1-risk_0 AS rd, sqrt(risk_se_0*risk_se_0+risk_se_1*risk_se_1) AS rd_se FROM ({wide})"""
    lims = ", ".join(f"CASE WHEN {n}>0 THEN exp(ln({n}) - {z}*{n}_ln_se) END AS {n}_ll, CASE WHEN {n}>0 THEN exp(ln({n}) + {z}*{n}_ln_se) END AS {n}_ul"
                     for n in ("irr", "irr2", "cmlirr", "sr", "rr"))
    return f"SELECT *, {lims}, rd - {z}*rd_se AS rd_ll, rd + {z}*rd_se AS rd_ul FROM ({main})"


@query(sql(_contrast_sql("km6"), "km6"))
def km_contrasts(spark, sf):
    return survival.period_contrasts(km_rounded(spark, sf), [], CFG.cuts)


def _life_sql() -> str:
    up = "OVER (PARTITION BY treated ORDER BY time ROWS UNBOUNDED PRECEDING)"
    return f"""SELECT treated, time, leadtime, "interval", n_risk, n_event, n_censor, summand, surv,
 CASE WHEN surv>0 AND surv<1 THEN exp(-exp(ln(-ln(surv)) + 1.959963984540054*sqrt(v/(ln(surv)*ln(surv))))) END AS surv_ll,
 CASE WHEN surv>0 AND surv<1 THEN exp(-exp(ln(-ln(surv)) - 1.959963984540054*sqrt(v/(ln(surv)*ln(surv))))) END AS surv_ul,
 surv*sqrt(v) AS surv_se, haz_km, CASE WHEN haz_km IS NOT NULL THEN sum(haz_km) {up} END AS cml_haz_km,
 haz_km*sqrt((r-e)/nullif(r*e,0)) AS se_haz_km, haz_ac, CASE WHEN surv>0 THEN -ln(surv) END AS cml_haz_ac,
 haz_ac*CASE WHEN 1-pow(haz_ac*i/2,2)>=0 THEN sqrt(1-pow(haz_ac*i/2,2)) END/nullif(sqrt(e),0) AS se_haz_ac,
 CASE WHEN surv>0 AND surv<1 THEN ln(-ln(surv)) END AS llsurv,
 CASE WHEN surv>0 AND surv<1 THEN sqrt(sum(summand) {up}/(ln(surv)*ln(surv))) END AS se_llsurv FROM (
 SELECT *, n_risk::DOUBLE AS r, n_event::DOUBLE AS e, "interval"::DOUBLE AS i, e/nullif((r-e)*r,0) AS summand, e/nullif(r*i,0) AS haz_km,
 e/nullif((r-n_censor::DOUBLE/2-e/2)*i,0) AS haz_ac,
 CASE WHEN n_risk>0 THEN product(1 - coalesce(n_event/nullif(n_risk,0)::DOUBLE, 0)) {up} END AS surv,
 CASE WHEN n_risk-n_event>0 THEN sum(1/nullif(n_risk-n_event,0)::DOUBLE - 1/nullif(n_risk,0)::DOUBLE) {up} END AS v FROM (
 SELECT *, lead(time) OVER (PARTITION BY treated ORDER BY time) AS leadtime, lead(time) OVER (PARTITION BY treated ORDER BY time) - time AS "interval" FROM kmc))
 UNION ALL SELECT treated, 0, 1, 1, NULL, NULL, NULL, 0, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0, NULL, NULL FROM (SELECT DISTINCT treated FROM kmc)"""


@query(sql(_life_sql(), "kmc"))
def life_table(spark, sf):
    return survival.life_table(km_table(spark, sf), ["treated"], add_time_zero=True)


@query(sql("""SELECT 'single' AS brand, crit, CASE crit WHEN 'c0' THEN 'Everybody' ELSE crit END AS criteria, n FROM (
 SELECT unnest(['c0','c1','c2','c3','c4','c5','c6','c7']) AS crit, unnest([c0,c1,c2,c3,c4,c5,c6,c7]) AS n FROM (
 SELECT %s FROM single))""" % ", ".join(f"CAST(ceil(count(*) FILTER (c{i})/6.0)*6 AS BIGINT) AS c{i}" for i in range(8)) + """
 UNION ALL SELECT brand, crit, criteria, n FROM (""" + BOX_COUNTS + ")",
 "pairs_a", "pairs_b", "single", **FLOWS))
def final_flowchart(spark, sf):
    crit = [f"c{i}" for i in range(8)]
    text = {c: ("Everybody" if c == "c0" else c) for c in crit}
    single = el.flowchart(chain.single(spark, sf), crit, threshold=CFG.threshold, text=text).select("crit", "criteria", "n")
    return el.final_flowchart(single, flow_boxes_theta_join(spark, sf))


@query(sql("""SELECT CAST(count(*) FILTER (ok) AS BIGINT) AS kept, count(*) AS proposed, round(100*(count(*) FILTER (ok))/count(*)::DOUBLE, 2) AS pct
 FROM (SELECT m.*, t.age % 2 = 0 AS ok FROM pairs_a m JOIN people t ON t.patient_id=m.treated_id)""", "pairs_a", "people"))
def match_success(spark, sf):
    members = matching.pair_members(chain.pairs(spark, sf))
    even = chain.people(spark, sf).where("age % 2 = 0").select("patient_id")
    kept = members.where("treated = 1").join(even, "patient_id", "left_semi").select("trial_date", "match_id")
    return matching.success_share(members, members.join(kept, ["trial_date", "match_id"]))


@query(sql("""SELECT treated, CAST(count(*) FILTER (n > 1) AS BIGINT) AS n_duplicated FROM (
 SELECT treated, patient_id, count(*) AS n FROM (
  SELECT 1 AS treated, treated_id AS patient_id FROM pairs_a UNION ALL SELECT 0, control_id FROM pairs_a
  UNION ALL SELECT 1, treated_id FROM pairs_b UNION ALL SELECT 0, control_id FROM pairs_b) GROUP BY ALL) GROUP BY 1""", "pairs_a", "pairs_b"))
def duplicated_members(spark, sf):
    """Over the trials of both brands, which may share controls but no treated people."""
    members = [matching.pair_members(chain.pairs(spark, sf, b.name)).select("treated", "patient_id") for b in CFG.brands]
    return matching.duplicated_members(members[0].unionByName(members[1]))


@query(sql("""SELECT treated, count(*) FILTER (NOT ind_outcome) AS "ind_outcome_False", count(*) FILTER (ind_outcome) AS "ind_outcome_True" FROM fu GROUP BY 1""", "fu"))
def outcome_frequency(spark, sf):
    from cohortspark.operators.summary import cross_counts
    return cross_counts(chain.followed(spark, sf), "treated", "ind_outcome", [False, True])


@query(sql("""SELECT patient_id, treated, trial_date, match_id, dose2_date, postest_date, admitted_date, death_date, dereg_date FROM matched""", "matched"))
def matched_outcomes(spark, sf):
    return chain.matched(spark, sf).select("patient_id", "treated", "trial_date", "match_id", "dose2_date", "postest_date",
                                           "admitted_date", "death_date", "dereg_date")
