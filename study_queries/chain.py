"""The study chain on both sides: people, cohorts, matched pairs, follow-up, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from cohortspark import fixture as fx
from cohortspark.config import StudyConfig
from cohortspark.plans import cohorts, sequential_trial as seq

CFG = StudyConfig()
BRAND = "pfizer"


def people(spark: SparkSession, sf: str) -> DataFrame:
    return cohorts.people_with_doses(fx.persons(spark, sf), fx.events(spark, sf), CFG)


def treated(spark: SparkSession, sf: str) -> DataFrame:
    return cohorts.treated_cohort(people(spark, sf), fx.events(spark, sf), fx.spells(spark, sf), CFG)


def controls(spark: SparkSession, sf: str) -> DataFrame:
    return cohorts.control_cohort(people(spark, sf), fx.events(spark, sf), fx.spells(spark, sf), CFG)


def single(spark: SparkSession, sf: str) -> DataFrame:
    return cohorts.single_cohort(people(spark, sf), fx.events(spark, sf), fx.spells(spark, sf), CFG)


def pairs(spark: SparkSession, sf: str, brand: str = BRAND) -> DataFrame:
    mine = treated(spark, sf).where(F.col("include") & (F.col("vax1_type") == brand))
    return seq.match_round(mine, controls(spark, sf).where("include"), CFG)


def rounds(spark: SparkSession, sf: str, brand: str = BRAND) -> list[seq.Round]:
    mine = treated(spark, sf).where(F.col("include") & (F.col("vax1_type") == brand))
    return seq.run_rounds(mine, people(spark, sf), fx.events(spark, sf), fx.spells(spark, sf), CFG, brand)


def matched(spark: SparkSession, sf: str, brand: str = BRAND) -> DataFrame:
    from cohortspark.operators.matching import pair_members

    return seq.matched_table(pair_members(pairs(spark, sf, brand)), people(spark, sf), fx.events(spark, sf))


def followed(spark: SparkSession, sf: str, outcome: str = "postest") -> DataFrame:
    return seq.followed(matched(spark, sf), outcome, CFG)


# -- the same as SQL ------------------------------------------------------------------------------

BAND = lambda x, edges: "CASE " + " ".join(f"WHEN {x} < {hi} THEN '{lb}'" for hi, lb in edges[:-1]) + f" ELSE '{edges[-1][1]}' END"
AGEBAND2 = BAND("age", [(70, "under 70"), (80, "70-79"), (None, "80+")])
AGEBAND = BAND("age", [(18, "under 18"), (40, "18-39"), (50, "40-49"), (60, "50-59"), (70, "60-69"), (80, "70-79"), (90, "80-89"), (None, "90+")])
PRIORITY_AGEBAND = BAND("age", [(18, "under 18"), (40, "18-39"), (50, "40-49"), (55, "50-54"), (60, "55-59"), (65, "60-64"),
                                (70, "65-69"), (75, "70-74"), (80, "75-79"), (None, "80+")])
IMD = """CASE WHEN imd IS NULL OR imd < 0 THEN 'Unknown' WHEN imd < 32844*0.2 THEN '1 (most deprived)' WHEN imd < 32844*0.4 THEN '2'
 WHEN imd < 32844*0.6 THEN '3' WHEN imd < 32844*0.8 THEN '4' ELSE '5 (least deprived)' END"""
ETH = """CASE coalesce(ethnicity, ethnicity_6_sus) WHEN '1' THEN 'White' WHEN '2' THEN 'Mixed' WHEN '3' THEN 'South Asian'
 WHEN '4' THEN 'Black' WHEN '5' THEN 'Other' END"""
CV = """(immunosuppressed OR chronic_kidney_disease OR chronic_resp_disease OR diabetes OR chronic_liver_disease OR chronic_neuro_disease
 OR chronic_heart_disease OR learndis OR sev_mental)"""
MORB = """(sev_obesity::INT + chronic_heart_disease::INT + chronic_kidney_disease::INT + diabetes::INT + chronic_liver_disease::INT
 + chronic_resp_disease::INT + chronic_neuro_disease::INT)"""

PARTS: dict[str, str] = {
    "dosew": """SELECT patient_id, max(date) FILTER (dose=1) AS vax1_date, max(type) FILTER (dose=1) AS vax1_type,
 max(date) FILTER (dose=2) AS vax2_date, max(type) FILTER (dose=2) AS vax2_type FROM dose GROUP BY 1""",
    "people": f"""SELECT p.* REPLACE (CASE sex WHEN 'F' THEN 'Female' WHEN 'M' THEN 'Male' END AS sex),
 {AGEBAND2} AS ageband2, {AGEBAND} AS ageband, {IMD} AS imd_quintile, {ETH} AS ethnicity_combined, {CV} AS cv,
 CASE WHEN {MORB}=0 THEN '0' WHEN {MORB}=1 THEN '1' ELSE '2+' END AS multimorb,
 CASE WHEN cev THEN 'Clinically extremely vulnerable' WHEN {CV} THEN 'Clinically at-risk' ELSE 'Not clinically at-risk' END AS risk_class,
 vax1_date, vax1_type, vax2_date, vax2_type FROM person p LEFT JOIN dosew USING (patient_id)""",
}


def _cohort(tag: str, where: str, anchor: str, c0: str, c1: str, c8: bool) -> None:
    """Add the parts of one cohort: anchors, history before them, cumulative criteria."""
    phase = """NOT coalesce((ageband2='80+' AND vax1_date < DATE '1997-01-01') OR (ageband2='70-79' AND vax1_date < DATE '1997-02-01'), false)"""
    demo = "age IS NOT NULL AND sex IS NOT NULL AND imd_quintile<>'Unknown' AND ethnicity_combined IS NOT NULL AND region IS NOT NULL"
    crit = [c0.format(phase=phase), c1.format(phase=phase), "has_follow_up_previous_year", "NOT hscworker",
            "NOT care_home AND NOT housebound", "NOT endoflife", demo, "postest_0_date IS NULL"]
    if c8:
        crit.append("(admitted_0_date IS NULL OR coalesce(discharged_0_date < anchor_date, false))")
    PARTS[f"b_{tag}"] = f"SELECT patient_id, {anchor} AS anchor_date FROM people WHERE {where}"
    PARTS[f"h_{tag}"] = f"""SELECT b.patient_id, b.anchor_date, max(date) FILTER (kind='postest') AS postest_0_date,
 max(date) FILTER (kind='death') AS death_0_date, max(date) FILTER (kind='dereg') AS dereg_0_date,
 count(date) FILTER (kind IN ('test','postest')) AS n_tests
 FROM b_{tag} b LEFT JOIN ev e ON e.patient_id=b.patient_id AND e.date < b.anchor_date GROUP BY 1, 2"""
    PARTS[f"s_{tag}"] = f"""SELECT b.patient_id, s.admitted_date AS admitted_0_date, s.discharged_date AS discharged_0_date
 FROM b_{tag} b JOIN spell s ON s.patient_id=b.patient_id AND s.admitted_date < b.anchor_date
 QUALIFY row_number() OVER (PARTITION BY b.patient_id ORDER BY s.admitted_date DESC, s.discharged_date DESC NULLS LAST)=1"""
    tests = ", ".join(f"coalesce({c}, false) AS q{i}" for i, c in enumerate(crit))
    cum = ", ".join(f"{' AND '.join(f'q{j}' for j in range(i + 1))} AS c{i}" for i in range(len(crit)))
    PARTS[tag] = f"""SELECT * EXCLUDE ({', '.join(f'q{i}' for i in range(len(crit)))}), {cum}, {' AND '.join(f'q{j}' for j in range(len(crit)))} AS include FROM (
 SELECT p.*, h.anchor_date, h.postest_0_date, h.n_tests, s.admitted_0_date, s.discharged_0_date, {tests}
 FROM people p JOIN h_{tag} h USING (patient_id) LEFT JOIN s_{tag} s USING (patient_id) WHERE death_0_date IS NULL AND dereg_0_date IS NULL)"""


_cohort("treated", "vax1_date IS NOT NULL", "vax1_date",
        "vax1_type IN ('pfizer','az') AND vax1_date BETWEEN DATE '1997-01-01' AND DATE '1997-12-31' AND {phase}",
        "vax1_type IN ('pfizer','az') AND (vax2_date IS NULL OR vax2_date >= vax1_date + 17)", True)
_cohort("control", "true", "DATE '1997-01-01'", "true", "(vax1_date IS NULL OR vax1_date > anchor_date) AND {phase}", True)
_cohort("single", "true", "DATE '1997-01-01'", "true", "(vax1_date IS NULL OR vax1_date >= anchor_date) AND {phase}", False)


def _pairs(tag: str, brand: str, pool: str = "control", free: str = "") -> None:
    """Greedy matching as a recursion over the treated people of each stratum. free: a condition with the column name {id}."""
    PARTS[f"t_{tag}"] = f"""SELECT region, sex, patient_id AS id, age, vax1_date AS day,
 row_number() OVER (PARTITION BY region, sex ORDER BY vax1_date, patient_id) AS k FROM treated WHERE include AND vax1_type='{brand}'{free.format(id='treated_id')}"""
    PARTS[f"u_{tag}"] = f"SELECT region, sex, patient_id AS id, age, vax1_date AS until FROM {pool} WHERE include{free.format(id='control_id')}"
    PARTS[f"m_{tag}"] = f"""SELECT DISTINCT region, sex, CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS treated_id, CAST(NULL AS BIGINT) AS control_id,
 CAST(NULL AS DATE) AS trial_date, CAST([] AS BIGINT[]) AS used FROM t_{tag}
 UNION ALL SELECT m.region, m.sex, t.k, t.id, x.cid, t.day, CASE WHEN x.cid IS NULL THEN m.used ELSE list_append(m.used, x.cid) END
 FROM m_{tag} m JOIN t_{tag} t ON t.region=m.region AND t.sex=m.sex AND t.k=m.k+1
 LEFT JOIN LATERAL (SELECT min(c.id) AS cid FROM u_{tag} c WHERE c.region=t.region AND c.sex=t.sex AND abs(c.age-t.age)<=3
  AND (c.until IS NULL OR c.until > t.day) AND NOT list_contains(m.used, c.id)) x ON true"""
    PARTS[f"pairs_{tag}"] = f"""SELECT m.region, m.sex, m.treated_id, m.control_id, m.trial_date, c.until AS controlistreated_date,
 row_number() OVER (PARTITION BY m.trial_date ORDER BY m.treated_id) AS match_id
 FROM m_{tag} m JOIN u_{tag} c ON c.id=m.control_id WHERE m.control_id IS NOT NULL"""
    PARTS[f"members_{tag}"] = f"""SELECT treated_id AS patient_id, 1 AS treated, trial_date, match_id, controlistreated_date FROM pairs_{tag}
 UNION ALL SELECT control_id, 0, trial_date, match_id, controlistreated_date FROM pairs_{tag}"""


_pairs("a", "pfizer")
_pairs("b", "az")


def _rounds(tag: str, brand: str, n: int) -> None:
    """Matching rounds: pools as of the round's date, pairs, the controls' criteria on the trial date, pairs kept."""
    c1 = "(vax1_date IS NULL OR vax1_date > anchor_date) AND {phase}"
    for r in range(1, n + 1):
        pool, pairs, check, free, before = f"pool_{tag}{r}", f"{tag}{r}", f"check_{tag}{r}", "", ""
        if r > 1:
            before = f" AND patient_id IN (SELECT patient_id FROM pool_{tag}{r - 1} WHERE include)"
            free = " AND patient_id NOT IN (" + " UNION ALL ".join(f"SELECT {{id}} FROM kept_{tag}{i}" for i in range(1, r)) + ")"
        _cohort(pool, "true" + before, f"DATE '{CFG.round_date(brand, r)}'", "true", c1, True)
        _pairs(pairs, brand, pool, free)
        _cohort(check, f"patient_id IN (SELECT control_id FROM pairs_{pairs})",
                f"(SELECT trial_date FROM pairs_{pairs} WHERE control_id=patient_id)", "true", c1, True)
        PARTS[f"kept_{pairs}"] = f"""SELECT x.* FROM pairs_{pairs} x JOIN {check} c ON c.patient_id=x.control_id JOIN treated t ON t.patient_id=x.treated_id
 WHERE c.include AND c.region=t.region AND c.sex=t.sex AND abs(c.age-t.age)<=3"""
        for cohort in (pool, check):
            ROUND_NEEDS[cohort] = [f"b_{cohort}", f"h_{cohort}", f"s_{cohort}", "people"]
            ROUND_NEEDS.update({f"{x}_{cohort}": [f"b_{cohort}"] for x in "hs"})
        ROUND_NEEDS[f"b_{pool}"] = ["people"] + ([f"pool_{tag}{r - 1}"] if r > 1 else [])
        ROUND_NEEDS[f"b_{check}"] = ["people", f"pairs_{pairs}"]
        ROUND_NEEDS[f"kept_{pairs}"] = [f"pairs_{pairs}", check, "treated"]
        ROUND_NEEDS[f"pairs_{pairs}"] = [f"m_{pairs}", f"u_{pairs}"]
        ROUND_NEEDS[f"m_{pairs}"] = [f"t_{pairs}", f"u_{pairs}"]
        ROUND_NEEDS[f"t_{pairs}"] = ["treated"] + [f"kept_{tag}{i}" for i in range(1, r)]
        ROUND_NEEDS[f"u_{pairs}"] = [pool] + [f"kept_{tag}{i}" for i in range(1, r)]


ROUND_NEEDS: dict[str, list[str]] = {}
_rounds("r", BRAND, CFG.n_rounds)
PARTS["matched"] = """SELECT m.*, p.* EXCLUDE (patient_id), CASE WHEN m.treated=1 THEN p.vax2_date END AS dose2_date,
 o.postest_date, o.admitted_date, o.death_date, o.dereg_date FROM members_a m JOIN people p USING (patient_id) JOIN (
 SELECT m.patient_id, m.trial_date, min(date) FILTER (kind='postest') AS postest_date, min(date) FILTER (kind='admission') AS admitted_date,
 min(date) FILTER (kind='death') AS death_date, min(date) FILTER (kind='dereg') AS dereg_date
 FROM (SELECT DISTINCT patient_id, trial_date FROM members_a) m LEFT JOIN ev e ON e.patient_id=m.patient_id AND e.date >= m.trial_date GROUP BY 1, 2) o
 ON o.patient_id=m.patient_id AND o.trial_date=m.trial_date"""


def followed_part(outcome: str) -> str:
    return f"""SELECT *, least(censor_date, controlistreated_date - 1) AS matchcensor_date,
 CAST(least(CAST({outcome} AS DATE) - (trial_date-1), least(censor_date, controlistreated_date - 1) - (trial_date-1)) AS INT) AS tte_outcome,
 coalesce({outcome} <= least(censor_date, controlistreated_date - 1), false) AS ind_outcome
 FROM (SELECT *, least(death_date, dereg_date, dose2_date - 1, DATE '1997-12-31', trial_date + 69) AS censor_date FROM matched)"""


PARTS["fu"] = followed_part("postest_date")


def km_counts_part(source: str, keys: str, extra: str = "") -> str:
    """Dense daily counts per arm: events, censorings and people at risk."""
    return f"""SELECT g.*, d.time, coalesce(x.n_event, 0) AS n_event, coalesce(x.n_censor, 0) AS n_censor,
 CAST(sum(coalesce(x.n_event, 0) + coalesce(x.n_censor, 0)) OVER (PARTITION BY {', '.join('g.' + k for k in keys.split(', '))} ORDER BY d.time ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS n_risk
 FROM (SELECT DISTINCT {keys} FROM {source}) g CROSS JOIN (SELECT CAST(range AS INT) AS time FROM range(1, 71)) d
 LEFT JOIN (SELECT {keys}, tte_outcome AS time, count(*) FILTER (ind_outcome) AS n_event, count(*) FILTER (NOT ind_outcome) AS n_censor
  FROM {source} GROUP BY ALL) x ON x.time=d.time AND {' AND '.join(f'x.{k}=g.{k}' for k in keys.split(', '))}"""


def mid(x: str, to: int) -> str:
    return x if to == 1 else f"(ceil({x}/{to}.0)*{to} - CASE WHEN {x}<>0 THEN {to // 2} ELSE 0 END)"


def km_part(counts: str, keys: str, to: int) -> str:
    """Rounded Kaplan-Meier estimates from daily counts."""
    w = f"OVER (PARTITION BY {keys} ORDER BY time)"
    up = f"OVER (PARTITION BY {keys} ORDER BY time ROWS UNBOUNDED PRECEDING)"
    return f"""SELECT {keys}, time, lagtime, leadtime, "interval", cml_event, cml_censor, n_risk, n_event, n_censor, surv, surv_se, surv_ll, surv_ul,
 1-surv AS risk, surv_se AS risk_se, 1-surv_ul AS risk_ll, 1-surv_ll AS risk_ul FROM (
 SELECT *, surv*sqrt(v) AS surv_se,
 CASE WHEN surv>0 AND surv<1 THEN exp(-exp(ln(-ln(surv)) + 1.959963984540054*sqrt(v/(ln(surv)*ln(surv))))) END AS surv_ll,
 CASE WHEN surv>0 AND surv<1 THEN exp(-exp(ln(-ln(surv)) - 1.959963984540054*sqrt(v/(ln(surv)*ln(surv))))) END AS surv_ul FROM (
 SELECT *, CASE WHEN n_risk>0 THEN product(1 - coalesce(n_event/nullif(n_risk,0)::DOUBLE, 0)) {up} END AS surv,
 CASE WHEN n_risk-n_event>0 THEN sum(1/nullif(n_risk-n_event,0)::DOUBLE - 1/nullif(n_risk,0)::DOUBLE) {up} END AS v FROM (
 SELECT {keys}, time, lagtime, leadtime, time-lagtime AS "interval", cml_event, al-cml_event AS cml_censor,
 CAST(cml_event - lag(cml_event,1,0) {w} AS BIGINT) AS n_event, CAST((al-cml_event) - lag(al-cml_event,1,0) {w} AS BIGINT) AS n_censor,
 CAST({mid('n', to)} AS BIGINT) - lag(al,1,0) {w} AS n_risk FROM (
 SELECT *, CAST({mid('ca', to)} AS BIGINT) AS al, CAST({mid('ce', to)} AS BIGINT) AS cml_event FROM (
 SELECT *, lag(time,1,0) {w} AS lagtime, coalesce(lead(time) {w}, time+1) AS leadtime, max(n_risk) OVER (PARTITION BY {keys}) AS n,
 sum(n_event+n_censor) {up} AS ca, sum(n_event) {up} AS ce FROM {counts})))))"""


PARTS["kmc"] = km_counts_part("fu", "treated")
PARTS["km1"] = km_part("kmc", "treated", 1)
PARTS["km6"] = km_part("kmc", "treated", 6)

NEEDS = {"kmc": ["fu"], "km1": ["kmc"], "km6": ["kmc"], "fu": ["matched"], "matched": ["members_a", "people"], "people": ["dosew"],
         **{f"members_{t}": [f"pairs_{t}"] for t in "ab"}, **{f"pairs_{t}": [f"m_{t}", f"u_{t}"] for t in "ab"},
         **{f"m_{t}": [f"t_{t}", f"u_{t}"] for t in "ab"}, **{f"t_{t}": ["treated"] for t in "ab"}, **{f"u_{t}": ["control"] for t in "ab"},
         **{c: [f"b_{c}", f"h_{c}", f"s_{c}", "people"] for c in ("treated", "control", "single")},
         **{f"{x}_{c}": [f"b_{c}"] for x in "hs" for c in ("treated", "control", "single")},
         **{f"b_{c}": ["people"] for c in ("treated", "control", "single")}, **ROUND_NEEDS}


def sql(body: str, *parts: str, **extra: str) -> str:
    """A query on the named parts of the chain; further parts may be added."""
    need: set[str] = set()
    stack = list(parts)
    while stack:
        p = stack.pop()
        if p not in need:
            need.add(p)
            stack += NEEDS.get(p, [])
    texts = [f"{n} AS ({q})" for n, q in fx.SQL.items() if n != "act"]
    texts += [f"{n} AS ({PARTS[n]})" for n in PARTS if n in need]
    texts += [f"{n} AS ({q})" for n, q in extra.items()]
    return "WITH RECURSIVE " + ",\n".join(texts) + "\n" + body
