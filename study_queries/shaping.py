"""Spells, counting-process intervals, person-days, weights and time functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from cohortspark import fixture as fx
from cohortspark.functions import columns as c
from cohortspark.operators import intervals, ipw, report, summary
from cohortspark.plans import single_trial as st
from cohortspark.session import by_person, stable
from study_queries import chain
from study_queries.chain import CFG, sql
from study_queries.registry import query

# -- the single-trial tables as SQL ---------------------------------------------------------------
DOSES = ["vaxany1", "vaxany2", "vaxpfizer1", "vaxpfizer2", "vaxaz1", "vaxaz2"]
MARKS = [*DOSES, "postest", "admitted", "death", "dereg"]
D0 = "DATE '1996-12-31'"
SETS: dict[str, str] = {
    "so": """SELECT s.patient_id, min(date) FILTER (kind='postest') AS postest_date, min(date) FILTER (kind='admission') AS admitted_date,
 min(date) FILTER (kind='death') AS death_date, min(date) FILTER (kind='dereg') AS dereg_date
 FROM (SELECT patient_id FROM single WHERE include) s LEFT JOIN ev e ON e.patient_id=s.patient_id AND e.date >= DATE '1997-01-01' GROUP BY 1""",
    "l0": """SELECT s.patient_id, ageband2, vax1_date, vax2_date, vax1_type, vax2_type, so.* EXCLUDE (patient_id),
 least(vax1_date + 70, death_date, DATE '1997-12-31', dereg_date) AS lf FROM single s JOIN so USING (patient_id) WHERE include""",
    "stt": f"""SELECT *, CAST(DATE '1997-12-31' - {D0} AS INT) AS tte_enddate, CAST(lf - {D0} AS INT) AS tte_lastfup,
 {', '.join(f"CAST(CASE WHEN lf >= {d} THEN {d} - {D0} END AS INT) AS tte_{n}" for n, d in [('vaxany1', 'vax1_date'), ('vaxany2', 'vax2_date'), ('postest', 'postest_date'), ('admitted', 'admitted_date'), ('death', 'death_date')])},
 CAST(dereg_date - {D0} AS INT) AS tte_dereg,
 {', '.join(f"CAST(CASE WHEN vax{k}_type='{b}' AND lf >= vax{k}_date THEN vax{k}_date - {D0} END AS INT) AS tte_vax{b}{k}" for b in ('pfizer', 'az') for k in (1, 2))},
 CASE ageband2 WHEN '80+' THEN -1 WHEN '70-79' THEN 30 END AS start_any FROM l0""",
    "hc0": f"""SELECT patient_id, infectious, admitted_date, event_id, 1 AS v, 0 AS o, CAST(admitted_date - {D0} AS INT) AS t FROM spell
 UNION ALL SELECT patient_id, infectious, admitted_date, event_id, 0, 1, CAST(discharged_date - {D0} AS INT) FROM spell WHERE discharged_date IS NOT NULL""",
    "hc": """SELECT h.patient_id, infectious, t, arg_max(v, row(h.admitted_date, h.event_id, o)) AS v, bool_or(v=0) AS out
 FROM hc0 h JOIN stt USING (patient_id) WHERE t <= tte_lastfup GROUP BY 1, 2, 3""",
    "pt": f"""SELECT DISTINCT patient_id, t FROM (SELECT patient_id, 0 AS t FROM stt UNION ALL SELECT patient_id, tte_lastfup FROM stt
 UNION ALL SELECT x.patient_id, x.t FROM (SELECT patient_id, unnest([start_any, {', '.join('tte_' + m for m in MARKS)}]) AS t FROM stt
  UNION ALL SELECT patient_id, t FROM hc) x JOIN stt USING (patient_id) WHERE x.t > 0 AND x.t < tte_lastfup)""",
    "iv0": """SELECT patient_id, t AS tstart, lead(t) OVER (PARTITION BY patient_id ORDER BY t) AS tstop FROM pt""",
    "iv": f"""SELECT i.patient_id, i.tstart, i.tstop,
 CAST(coalesce(start_any <= tstart, false) AS INT) AS vaxany_atrisk, CAST(coalesce(start_any <= tstart, false) AS INT) AS vaxpfizer_atrisk, CAST(coalesce(start_any <= tstart, false) AS INT) AS vaxaz_atrisk,
 {', '.join(f'CAST(coalesce(tte_{m} <= tstart, false) AS INT) AS {m}_status, CAST(coalesce(tte_{m} = tstop, false) AS INT) AS {m}' for m in MARKS)},
 CAST(tte_lastfup = tstop AS INT) AS lastfup,
 {', '.join(f"coalesce((SELECT arg_max(v, t) FROM hc WHERE hc.patient_id=i.patient_id AND {cond} AND hc.t <= i.tstart), 0) AS {h}_status, CAST(EXISTS (SELECT 1 FROM hc WHERE hc.patient_id=i.patient_id AND {cond} AND hc.out AND hc.t = i.tstop) AS INT) AS {h}_discharge" for h, cond in (('hospinf', 'infectious'), ('hospnoninf', 'NOT infectious')))}
 FROM iv0 i JOIN stt USING (patient_id) WHERE i.tstop IS NOT NULL""",
    "iw": "SELECT *, tstop - tstart AS twidth, " + ", ".join(f"vax{b}1_status + vax{b}2_status AS vax{b}_status" for b in ("any", "pfizer", "az")) + " FROM iv",
    "dd": f"""SELECT i.* REPLACE (d - 1 AS tstart, d AS tstop, {', '.join(f'CASE WHEN d=tstop THEN {e} ELSE 0 END AS {e}' for e in [*MARKS, 'lastfup', 'hospinf_discharge', 'hospnoninf_discharge'])})
 FROM (SELECT *, unnest(range(tstart + 1, tstop + 1)) AS d0 FROM iw) i, LATERAL (SELECT CAST(d0 AS INT) AS d)""",
    "days": f"""SELECT * EXCLUDE (d0, lo1, lo2), {', '.join(f'CASE WHEN {h}_status=0 AND NOT coalesce(tstop-{lo} BETWEEN 1 AND 28, false) THEN $$Not in hospital$$ WHEN {h}_status=1 THEN $$In hospital$$ WHEN tstop-{lo}<=21 THEN $$1-21$$ ELSE $$22-28$$ END AS timesince_{h}discharge' for h, lo in (('hospinf', 'lo1'), ('hospnoninf', 'lo2')))}
 FROM (SELECT *, {', '.join(f'CAST(sum({d}_status) OVER w AS INT) AS {d}_timesince' for d in DOSES)},
 max(CASE WHEN hospinf_discharge=1 THEN tstop END) OVER w AS lo1, max(CASE WHEN hospnoninf_discharge=1 THEN tstop END) OVER w AS lo2
 FROM dd WINDOW w AS (PARTITION BY patient_id ORDER BY tstop ROWS UNBOUNDED PRECEDING))""",
}


def _sets(upto: str) -> dict[str, str]:
    names = list(SETS)
    return {n: SETS[n].replace("$$", "'") for n in names[: names.index(upto) + 1]}


def single_cohort(spark, sf):
    """The people of the single trial, written once: a task then sorts for the joins of one step only."""
    return by_person(stable(chain.single(spark, sf).where("include")))


def single_base(spark, sf):
    base = st.at_risk_starts(st.time_to_event(single_cohort(spark, sf), fx.events(spark, sf), CFG), CFG)
    return by_person(stable(st.with_hospital_changes(base, fx.spells(spark, sf), CFG)))


TTE = ["tte_enddate", "tte_lastfup", *[f"tte_{m}" for m in MARKS]]


@query(sql(f"SELECT patient_id, {', '.join(TTE)} FROM stt", "single", **_sets("stt")))
def time_to_event_table(spark, sf):
    return st.time_to_event(single_cohort(spark, sf), fx.events(spark, sf), CFG).select("patient_id", *TTE)


@query(sql("SELECT * FROM iw", "single", **_sets("iw")))
def counting_process(spark, sf):
    return st.counting_process(single_base(spark, sf), CFG).drop(
        "hospinf_out", "hospnoninf_out", *[f"tte_{d}" for d in DOSES])


def single_days(spark, sf):
    return st.person_days(st.counting_process(single_base(spark, sf), CFG), CFG)


_DAY_SUMS = [*MARKS, *[f"{m}_status" for m in MARKS], *[f"{d}_timesince" for d in DOSES], "hospinf_status", "hospnoninf_status",
             "hospinf_discharge", "hospnoninf_discharge", "vaxany_atrisk"]


@query(sql(f"SELECT tstop, tstart, count(*) AS n, {', '.join(f'CAST(sum({x}) AS BIGINT) AS {x}' for x in _DAY_SUMS)} FROM days GROUP BY 1, 2", "single", **_sets("days")))
def person_days(spark, sf):
    return single_days(spark, sf).groupBy("tstop", "tstart").agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(x).alias(x) for x in _DAY_SUMS])


_BANDS = "CASE WHEN vaxany1_timesince<=0 THEN 'pre-vax' " + " ".join(
    f"WHEN vaxany1_timesince<={b} THEN '{a + 1}-{b}'" for a, b in zip(CFG.cuts, CFG.cuts[1:])) + " ELSE '71+' END"


@query(sql(f"""SELECT {_BANDS} AS band, timesince_hospinfdischarge, timesince_hospnoninfdischarge, count(*) AS n, count(DISTINCT patient_id) AS people
 FROM days GROUP BY ALL""", "single", **_sets("days")))
def time_since_bands(spark, sf):
    band = c.timesince_cut(F.col("vaxany1_timesince"), CFG.cuts, "pre-vax")
    return single_days(spark, sf).groupBy(band.alias("band"), "timesince_hospinfdischarge", "timesince_hospnoninfdischarge").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("patient_id").alias("people"))


_ATRISK = """SELECT d.*, f.region, bool_or(inf) OVER (PARTITION BY d.patient_id) AS z FROM (
 SELECT *, vaxany_status=0 AND postest_status=1 AS inf FROM days WHERE death_status=0 AND vaxany1_status=vaxpfizer1_status AND vaxany2_status=0 AND vaxpfizer_atrisk=1) d
 JOIN people f USING (patient_id)"""


@query(sql(f"""SELECT region, CASE WHEN z THEN 'pre-vax' ELSE {_BANDS} END AS timesincevax_pw, count(*) AS n, CAST(sum(death) AS BIGINT) AS outcome,
 CAST(sum(CASE WHEN z THEN 0 ELSE vaxpfizer1 END) AS BIGINT) AS vax, count(*) FILTER (vaxany1_status=0 AND postest_status=0 AND vaxpfizer_atrisk=1) AS vax_atrisk
 FROM ar GROUP BY ALL""", "single", **_sets("days"), ar=_ATRISK))
def at_risk_days(spark, sf):
    fixed = chain.people(spark, sf).select("patient_id", "region")
    days = st.at_risk_days(single_base(spark, sf), fixed, "death", "pfizer", CFG)
    return days.groupBy("region", "timesincevax_pw").agg(
        F.count(F.lit(1)).alias("n"), F.sum("outcome").alias("outcome"), F.sum("vax").alias("vax"),
        F.count(F.when(F.col("vax_atrisk"), F.lit(1))).alias("vax_atrisk"))


_SUB = """SELECT d.*, f.region, bool_or(vaxany_status=0 AND postest_status=1) OVER (PARTITION BY d.patient_id) AS z FROM days d JOIN people f USING (patient_id)
 WHERE {outcome}_status=0 AND vaxany1_status=vax{brand}1_status AND vaxany2_status=0 AND vax{brand}_atrisk=1 AND f.ageband2='{level}'"""
_GRID = [(o, b, lv) for o in ("postest", "admitted") for b in ("any", "az") for lv in ("80+", "70-79")]


@query(sql(" UNION ALL ".join(f"""SELECT '{o}' AS analysed, '{b}' AS brand, '{lv}' AS subgroup_level, tstop, count(*) AS n, count(DISTINCT patient_id) AS people,
 CAST(sum({o}) AS BIGINT) AS outcome, CAST(sum(CASE WHEN z THEN 0 ELSE vax{b}1 END) AS BIGINT) AS vax, CAST(sum(death) AS BIGINT) AS death, CAST(sum(dereg) AS BIGINT) AS dereg,
 count(*) FILTER (z) AS infected FROM ({_SUB.format(outcome=o, brand=b, level=lv)}) GROUP BY tstop""" for o, b, lv in _GRID), "single", **_sets("days")))
def at_risk_days_subgroups(spark, sf):
    """At-risk days before modelling, for outcomes, brands and age bands."""
    base = single_base(spark, sf)
    fixed = chain.people(spark, sf).select("patient_id", "region")
    parts = []
    for outcome, brand, level in _GRID:
        days = st.at_risk_days(base, fixed, outcome, brand, CFG, "preflight", "ageband2", level)
        parts.append(days.groupBy("tstop").agg(
            F.count(F.lit(1)).alias("n"), F.count_distinct("patient_id").alias("people"), F.sum("outcome").alias("outcome"), F.sum("vax").alias("vax"),
            F.sum("death").alias("death"), F.sum("dereg").alias("dereg"), F.count(F.when(F.col("infected_untreated"), F.lit(1))).alias("infected"),
        ).select(F.lit(outcome).alias("analysed"), F.lit(brand).alias("brand"), F.lit(level).alias("subgroup_level"), "*"))
    return reduce(DataFrame.unionByName, parts)


@query(sql("""SELECT date, status, n, n/sum(n) OVER (PARTITION BY date)::DOUBLE*10000 AS n_per_10000 FROM (
 SELECT DATE '1997-01-01' + tstart AS date, CASE WHEN vaxpfizer_status=0 AND vaxaz_status=0 THEN 'Not vaccinated' WHEN vaxpfizer_status=1 THEN 'BNT162b2 dose 1'
  WHEN vaxpfizer_status=2 THEN 'BNT162b2 dose 2' WHEN vaxaz_status=1 THEN 'ChAdOx1 dose 1' WHEN vaxaz_status=2 THEN 'ChAdOx1 dose 2' END AS status,
 CAST(ceil(count(*)/6.0)*6 - 3 AS BIGINT) AS n FROM days GROUP BY 1, 2)""", "single", **_sets("days")))
def dose_status_by_date(spark, sf):
    return report.dose_status_by_date(single_days(spark, sf), CFG, CFG.threshold)


@query(sql("""SELECT CAST(count(*) AS BIGINT) AS obs, count(DISTINCT patient_id) AS patients, CAST(sum(death) AS BIGINT) AS death, CAST(sum(postest) AS BIGINT) AS postest,
 sum(death)/count(DISTINCT patient_id)::DOUBLE AS rate_death, sum(postest)/count(DISTINCT patient_id)::DOUBLE AS rate_postest,
 sum(death)/count(*)::DOUBLE AS incidencerate_death, sum(postest)/count(*)::DOUBLE AS incidencerate_postest FROM days""", "single", **_sets("days")))
def incidence_summary(spark, sf):
    return summary.incidence_summary(single_days(spark, sf), ["death", "postest"])


_SEP = ["region", "sex", "flu_vaccine", "diabetes", "timesince_hospinfdischarge"]


@query(sql(f"""SELECT variable, level, max(n) FILTER (event=0) AS event0_n, max(pct) FILTER (event=0) AS event0_pct, max(n) FILTER (event=1) AS event1_n, max(pct) FILTER (event=1) AS event1_pct FROM (
 SELECT *, n/sum(n) OVER (PARTITION BY event, variable)::DOUBLE AS pct FROM (SELECT postest AS event, variable, level, count(*) AS n FROM (
 SELECT postest, unnest(['region','sex','flu_vaccine','diabetes','timesince_hospinfdischarge']) AS variable,
 unnest([region, coalesce(sex,'(missing)'), CASE WHEN flu_vaccine THEN 'yes' ELSE 'no' END, CASE WHEN diabetes THEN 'yes' ELSE 'no' END, timesince_hospinfdischarge]) AS level
 FROM days JOIN people USING (patient_id)) GROUP BY ALL)) GROUP BY 1, 2""", "single", **_sets("days")))
def separation_check(spark, sf):
    fixed = chain.people(spark, sf).select("patient_id", "region", "sex", "flu_vaccine", "diabetes")
    # covariates come to the person's row, before it is expanded to days
    spans = st.counting_process(single_base(spark, sf).join(fixed, "patient_id"), CFG, [c for c in fixed.columns if c != "patient_id"])
    return summary.separation_table(st.person_days(spans, CFG), "postest", _SEP)


@query(sql("""SELECT tstop, count(*) AS n, sum(ipweight_a) AS ipweight_a, sum(cm_a) AS cmlipweight_a, sum(ipweight_a*ipweight_b) AS ipweight, sum(cm_a*cm_b) AS cmlipweight,
 max(cm_a*cm_b*sw) AS top FROM (SELECT *, product(ipweight_a) OVER w AS cm_a, product(ipweight_b) OVER w AS cm_b FROM (
 SELECT patient_id, tstop, 1 + (tstop%7 - 3)/100.0::DOUBLE AS ipweight_a, CASE WHEN vaxany1_status=0 THEN 1 + (patient_id%5 - 2)/500.0::DOUBLE ELSE 1 END AS ipweight_b, (1 + patient_id%3)::DOUBLE AS sw FROM days)
 WINDOW w AS (PARTITION BY patient_id ORDER BY tstop ROWS UNBOUNDED PRECEDING)) GROUP BY 1""", "single", **_sets("days")))
def cumulative_weights(spark, sf):
    days = single_days(spark, sf).withColumn("sw", (1 + F.col("patient_id") % 3).cast("double"))
    out = ipw.add_weights(days, {
        "a": 1 + (F.col("tstop") % 7 - 3) / 100,
        "b": F.when(F.col("vaxany1_status") == 0, 1 + (F.col("patient_id") % 5 - 2) / 500)}, "sw")
    s = lambda n: F.sum(n).alias(n)
    return out.groupBy("tstop").agg(F.count(F.lit(1)).alias("n"), s("ipweight_a"), s("cmlipweight_a"), s("ipweight"),
                                    s("cmlipweight"), F.max("cmlipweight_sample").alias("top"))


# -- spells ---------------------------------------------------------------------------------------

@query(fx.with_sql("spell") + """SELECT patient_id, CAST(k AS INT) AS spell, admitted_date, nullif(d, DATE '0001-01-01') AS discharged_date FROM (
 SELECT *, row_number() OVER (PARTITION BY patient_id ORDER BY admitted_date) AS k FROM (
 SELECT patient_id, admitted_date, max(coalesce(discharged_date, DATE '0001-01-01')) AS d FROM spell GROUP BY 1, 2)) WHERE k <= 4""")
def hospital_spells_long(spark, sf):
    from cohortspark.operators import lookup as lk
    s = fx.spells(spark, sf).withColumnRenamed("admitted_date", "admitted").withColumnRenamed("discharged_date", "discharged")
    wide = lk.widen(lk.nth_events(s, 4, date="admitted", carry=["discharged"]), 4, ["admitted", "discharged"])
    return intervals.spells_long(wide, 4)


@query(fx.with_sql("spell") + """SELECT DISTINCT a.patient_id, a.admitted_date, a.discharged_date FROM spell a WHERE NOT EXISTS (
 SELECT 1 FROM spell b WHERE b.infectious AND b.patient_id=a.patient_id AND b.admitted_date IS NOT DISTINCT FROM a.admitted_date AND b.discharged_date IS NOT DISTINCT FROM a.discharged_date)""")
def noninfectious_spells(spark, sf):
    s = fx.spells(spark, sf)
    return intervals.without_spells(s.select("patient_id", "admitted_date", "discharged_date"), s.where("infectious")).distinct()


# -- time functions -------------------------------------------------------------------------------

@query("""WITH l AS (SELECT l_orderkey, l_linenumber, CAST(o_orderdate AS DATE) AS o, CASE WHEN l_linenumber=2 THEN NULL ELSE CAST(l_shipdate AS DATE) END AS e,
 CAST(o_orderdate AS DATE) + CAST(l_orderkey%900 AS INT) - 200 AS c FROM lineitem JOIN orders ON l_orderkey=o_orderkey)
SELECT l_orderkey, l_linenumber, CAST(least(e-o, c-o) AS INT) AS tte_cens, CAST(CASE WHEN c>=e THEN e-o END AS INT) AS tte_na, e IS NOT NULL AND NOT coalesce(e>c,false) AS ind,
 CASE WHEN e<=c THEN e END AS cens_na, CASE WHEN e>c THEN c WHEN e<=c THEN e END AS cens_date, CAST(ceil(least(e-o,c-o)/7.0) AS INT) AS week,
 least(e,c) AS first_any, greatest(e,c) AS last_any, CASE WHEN e IS NOT NULL AND c IS NOT NULL THEN greatest(e,c) END AS last_known,
 CASE WHEN e IS NOT NULL AND c IS NOT NULL THEN least(e,c) END AS first_known FROM l""")
def censoring(spark, sf):
    o = fx.load(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.to_date("o_orderdate").alias("o"))
    df = fx.load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.to_date("l_shipdate").alias("e")).join(o, "l_orderkey")
    df = df.withColumns({"e": F.when(F.col("l_linenumber") != 2, F.col("e")),
                         "c": F.date_add("o", (F.col("l_orderkey") % 900).cast("int") - 200)})
    o, e, k = F.col("o"), F.col("e"), F.col("c")
    return df.select(
        "l_orderkey", "l_linenumber", c.tte(o, e, k).alias("tte_cens"), c.tte(o, e, k, True).alias("tte_na"),
        c.censor_indicator(e, k).alias("ind"), c.censor_event(e, k).alias("cens_na"), c.censor_event(e, k, False).alias("cens_date"),
        c.round_tte(c.tte(o, e, k)).alias("week"), c.earliest(e, k).alias("first_any"), c.latest(e, k).alias("last_any"),
        c.latest_known(e, k).alias("last_known"), c.earliest_known(e, k).alias("first_known"))
