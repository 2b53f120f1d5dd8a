"""Cox models, inverse-probability weights, marginal structural models and their report tables.

Iterative fits have no SQL form; the tests compare them with an independent small-scale fit.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortspark import fixture as fx
from cohortspark.operators import ipw, logistic, report
from cohortspark.plans import sequential_trial as seq, single_trial as st
from cohortspark.session import stable, tasks_for, written
from study_queries import chain
from study_queries.chain import CFG, sql
from study_queries.registry import query
from study_queries.shaping import _sets, single_base

ADJUST = ("flu_vaccine", "diabetes", "chronic_heart_disease")
REGIONS = ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")


@query()
def cox_period_hr(spark, sf):
    """Hazard ratio per follow-up period with person-clustered robust limits."""
    return seq.cox_by_period(chain.matched(spark, sf), "postest", CFG, ADJUST, brand=chain.BRAND)


@query()
def cox_robust(spark, sf):
    """All coefficients of the period model with model-based and person-clustered standard errors."""
    from cohortspark.operators import cox
    from cohortspark.operators.design import Number
    from cohortspark.operators.intervals import split_follow_up

    done = stable(chain.followed(spark, sf).select(
        "patient_id", "treated", "tte_outcome", "ind_outcome", *[F.col(a).cast("double").alias(a) for a in ADJUST]))
    fit = cox.cox_fit(split_follow_up(done, "tte_outcome", "ind_outcome", CFG.cuts), [Number(a) for a in ADJUST], len(CFG.cuts) - 1)
    return cox.coefficients(spark, fit)


@query()
def cox_by_subgroup(spark, sf):
    m = stable(chain.matched(spark, sf))
    return seq.cox_by_period(m, "admitted", CFG, ADJUST, "ageband2", ("80+", "70-79"), brand=chain.BRAND)


@query()
def cox_meta_analysis(spark, sf):
    """Age-band estimates pooled per period."""
    return report.meta_analysis(cox_by_subgroup(spark, sf), ["brand", "outcome", "period_start", "period_end"])


def _inputs(spark, sf):
    """People's times and covariates, and the model terms."""
    fixed = chain.people(spark, sf).select("patient_id", "age", "sex", "region", *[F.col(a).cast("int").alias(a) for a in ADJUST])
    return single_base(spark, sf), fixed, st.covariate_terms(CFG, REGIONS, ADJUST, spline_df=3)


def _weighted(spark, sf, outcome: str, brand: str, robust: bool = False, write: bool = False, model: bool = False):
    """Weighted at-risk days, written where they are read several times; ``model``: with the columns of the outcome model."""
    base, fixed, terms = _inputs(spark, sf)
    columns = st.msm_columns(terms) if model else []
    out, models = st.weighted_days(base, fixed, outcome, brand, CFG, terms, robust=robust, write=write, columns=columns)
    return out, models, terms


@query()
def ipw_weights(spark, sf):
    """Stabilised weights per person-day, summed up per day of follow-up."""
    w, _, _ = _weighted(spark, sf, "postest", "pfizer")
    return w.groupBy("tstop").agg(
        F.count(F.lit(1)).alias("n"), F.avg("ipweight").alias("ipweight"), F.avg("cmlipweight").alias("cmlipweight"),
        F.max("cmlipweight_sample").alias("largest"))


@query()
def weight_report(spark, sf):
    return ipw.weight_report(_weighted(spark, sf, "postest", "pfizer")[0])


@query()
def weight_histogram(spark, sf):
    return ipw.weight_histogram(_weighted(spark, sf, "postest", "pfizer")[0], "cmlipweight")


@query()
def treatment_model_table(spark, sf):
    """Odds ratios of the treatment model with robust limits; splines left out, reference rows added."""
    _, models, _ = _weighted(spark, sf, "postest", "pfizer", robust=True)
    tables = []
    for brand, (fit, _fixed) in models:
        tables.append(logistic.coefficient_table(spark, fit, exclude=("spline(",), reference_rows=True).withColumn("brand", F.lit(brand)))
    return tables[0].unionByName(tables[1])


@query()
def treatment_model_wide(spark, sf):
    return report.ratio_table_wide(treatment_model_table(spark, sf), ["pfizer", "az"])


@query()
def forest_plot_data(spark, sf):
    return report.forest_data(treatment_model_table(spark, sf).where("brand = 'pfizer'"))


def _msm(spark, sf):
    days, _, terms = _weighted(spark, sf, "postest", "pfizer", write=True, model=True)
    table = logistic.coefficient_table(spark, st.msm(days, CFG, terms))
    return table.withColumns({"model": F.lit("4"), "subgroup_level": F.lit("all")})


@query()
def msm_effects(spark, sf):
    """Marginal structural model: all coefficients with robust limits."""
    return _msm(spark, sf)


@query()
def msm_any_by_ageband(spark, sf):
    """Treatment with any brand, fitted apart in each age band."""
    base, fixed, terms = _inputs(spark, sf)
    return st.msm_by_subgroup(base, fixed, "postest", "any", CFG, terms, "ageband2", CFG.subgroups["ageband2"])


# A saturated model has a closed form: log odds against the first band, and its clustered variance.
_SATURATED = sql("""SELECT band AS label, ln(p/(1-p)) - CASE WHEN ord=0 THEN 0 ELSE first_value(ln(p/(1-p))) OVER (ORDER BY ord) END AS estimate,
 sqrt(CASE WHEN ord=0 THEN var ELSE var + first_value(var) OVER (ORDER BY ord) - 2*cov END) AS std_error FROM (
 SELECT a.band, a.ord, p, sum(m.u*m.u)/pow(max(a.info),2) AS var, sum(m.u*coalesce(m0.u,0))/max(a.info)/max(z.info) AS cov
 FROM (SELECT band, CASE WHEN band='pre-vax' THEN 0 ELSE CAST(regexp_extract(band,'[0-9]+') AS INT) END AS ord, avg(outcome) AS p, count(*)*avg(outcome)*(1-avg(outcome)) AS info FROM sd GROUP BY 1) a
 JOIN (SELECT patient_id, s.band, sum(outcome - p) AS u FROM sd s JOIN (SELECT band, avg(outcome) AS p FROM sd GROUP BY 1) USING (band) GROUP BY 1, 2) m ON m.band=a.band
 LEFT JOIN (SELECT patient_id, sum(outcome - (SELECT avg(outcome) FROM sd WHERE band='pre-vax')) AS u FROM sd WHERE band='pre-vax' GROUP BY 1) m0 ON m0.patient_id=m.patient_id
 CROSS JOIN (SELECT count(*)*avg(outcome)*(1-avg(outcome)) AS info FROM sd WHERE band='pre-vax') z WHERE p > 0 GROUP BY ALL) q""", "single", **_sets("days"), sd="""
 SELECT d.patient_id, death AS outcome, CASE WHEN bool_or(vaxany_status=0 AND postest_status=1) OVER (PARTITION BY d.patient_id) OR vaxany1_timesince<=0 THEN 'pre-vax'
  WHEN vaxany1_timesince<=14 THEN '1-14' ELSE '15+' END AS band FROM days d WHERE death_status=0 AND vaxany2_status=0 AND vaxany_atrisk=1""")


@query(_SATURATED)
def msm_saturated(spark, sf):
    """The unweighted pooled model of death on coarse bands since any dose; a saturated model, so that SQL can check the fit
    and its person-clustered standard errors."""
    from cohortspark.operators.design import Factor

    base, fixed, _ = _inputs(spark, sf)
    days = st.at_risk_days(base, fixed, "death", "any", CFG, "preflight")
    since = F.col("timesincevax_pw")
    band = F.when(since == "pre-vax", "pre-vax").when(since.isin("1-3", "4-7", "8-14"), "1-14").otherwise("15+")
    days = stable(days.select("patient_id", "outcome", band.alias("band")))
    fit = logistic.fit_logistic(days, [Factor("band", ("pre-vax", "1-14", "15+"))], "outcome")
    fit = logistic.robust_logistic(days, fit, "outcome", "patient_id")
    return logistic.coefficient_table(spark, fit).select(
        F.when(F.col("label") == logistic.INTERCEPT, "pre-vax").otherwise(F.col("label")).alias("label"), "estimate", "std_error")


_WEIGHTS = sql("""SELECT tstop, count(*) AS n, avg(ip) AS ipweight, avg(cml) AS cmlipweight, max(cml) AS largest FROM (
 SELECT *, exp(sum(ln(ip)) OVER (PARTITION BY patient_id ORDER BY tstop)) AS cml FROM (
 SELECT patient_id, tstop, CASE WHEN NOT risk THEN 1 WHEN vax=1 THEN f.p/v.p ELSE (1-f.p)/(1-v.p) END AS ip FROM wd
 JOIN (SELECT sex, avg(vax) FILTER (risk) AS p FROM wd GROUP BY 1) f USING (sex) JOIN (SELECT region, avg(vax) FILTER (risk) AS p FROM wd GROUP BY 1) v USING (region))) GROUP BY 1""",
 "single", **_sets("days"), wd="""SELECT d.patient_id, tstop, f.sex, f.region, vaxany1_status=0 AND postest_status=0 AND vaxany_atrisk=1 AS risk,
 CASE WHEN bool_or(vaxany_status=0 AND postest_status=1) OVER (PARTITION BY d.patient_id) THEN 0 ELSE vaxany1 END AS vax
 FROM days d JOIN people f USING (patient_id) WHERE death_status=0 AND vaxany2_status=0 AND vaxany_atrisk=1""")


@query(_WEIGHTS)
def ipw_weights_saturated(spark, sf):
    """Stabilised weights from one-factor treatment models, whose probabilities are plain shares, so that SQL can check them."""
    from cohortspark.operators.design import Factor

    base, fixed, _ = _inputs(spark, sf)
    tasks = tasks_for(base)
    days = written(st.at_risk_days(base, fixed, "death", "any", CFG, tasks=tasks).withColumn("sample_weight", F.lit(1.0)))
    pair = ipw.treatment_models(days, "vaxany1", "vaxany1_atrisk", [Factor("region", REGIONS)], [Factor("sex", ("Female", "Male"))], "random_n", None)
    days = ipw.with_stabilised_weight(days, pair, "vaxany1", "vaxany1_atrisk", "_w")
    w = ipw.add_weights(days, {"vaxany1": F.col("_w")}, "sample_weight", tasks=tasks)
    return w.groupBy("tstop").agg(
        F.count(F.lit(1)).alias("n"), F.avg("ipweight").alias("ipweight"), F.avg("cmlipweight").alias("cmlipweight"),
        F.max("cmlipweight_sample").alias("largest"))


@query()
def ve_table(spark, sf):
    """Effectiveness by time since treatment."""
    return logistic.effect_table(_msm(spark, sf), "timesincevax_pw", first_level="all")


@query()
def effect_comparison(spark, sf):
    """Both designs side by side per outcome, brand and period."""
    tags = {"brand": F.lit(chain.BRAND), "subgroup": F.lit("all"), "outcome": F.lit("postest")}
    long = report.effect_comparison(cox_period_hr(spark, sf), ve_table(spark, sf).withColumns(tags), CFG.cuts)
    return report.effect_comparison_wide(long)


_BAND_SQL = """WITH e AS (SELECT l_returnflag AS subgroup_level, CASE WHEN l_linenumber=1 THEN 'pre-vax' WHEN l_linenumber=2 THEN '1-3' WHEN l_linenumber=3 THEN '4-7' ELSE '71+' END AS term,
 avg(l_discount) - 0.1 AS estimate, avg(l_tax) AS std_error FROM lineitem GROUP BY 1, 2),
x AS (SELECT *, CAST(nullif(regexp_extract(term, '(\\d+)', 1), '') AS DOUBLE) - 1 AS term_left, CAST(nullif(regexp_extract(term, '(\\d+)$', 1), '') AS DOUBLE) AS r FROM e WHERE term<>'pre-vax'),
y AS (SELECT * EXCLUDE (r), coalesce(r, max(term_left) OVER () + 7) AS term_right, max(CASE WHEN subgroup_level='A' THEN estimate END) OVER (PARTITION BY term) AS e0,
 max(CASE WHEN subgroup_level='A' THEN std_error END) OVER (PARTITION BY term) AS s0 FROM x)
SELECT subgroup_level, term, term_left, term_right, term_left + (term_right-term_left)/2 AS term_midpoint, 1-exp(estimate) AS ve,
 1-exp(estimate+1.959963984540054*std_error) AS ve_ll, 1-exp(estimate-1.959963984540054*std_error) AS ve_ul, estimate-e0 AS diff,
 CASE WHEN subgroup_level<>'A' THEN sqrt(std_error*std_error+s0*s0) END AS diff_se,
 CASE WHEN subgroup_level<>'A' THEN (estimate-e0)/sqrt(std_error*std_error+s0*s0) END AS z FROM y"""


@query(_BAND_SQL)
def effect_table_from_estimates(spark, sf):
    """The effect table on estimates taken from plain aggregates, so that SQL can check it."""
    n = F.col("l_linenumber")
    term = F.when(n == 1, "pre-vax").when(n == 2, "1-3").when(n == 3, "4-7").otherwise("71+")
    z = logistic.Z975
    est = fx.load(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("subgroup_level"), term.alias("label")).agg(
        (F.avg("l_discount") - 0.1).alias("estimate"), F.avg("l_tax").alias("std_error"))
    est = est.withColumns({
        "model": F.lit("4"), "variable": F.lit("band"), "reference_row": F.col("label") == "pre-vax", "or": F.exp("estimate"),
        "or_ll": F.exp(F.col("estimate") - z * F.col("std_error")), "or_ul": F.exp(F.col("estimate") + z * F.col("std_error"))})
    return logistic.effect_table(est, "band", first_level="A").select(
        "subgroup_level", "term", "term_left", "term_right", "term_midpoint", "ve", "ve_ll", "ve_ul", "diff", "diff_se", "z")


def _text_sql(e: str) -> str:
    f = lambda x: f"printf('%.2f', round({x}, 2))"
    return f"{f(e)} || ' (' || {f(e + '*0.9')} || '-' || {f(e + '*1.1')} || ')'"


@query(f"""WITH s AS (SELECT 'Sequential trial' AS approach, o_orderpriority AS brand, CASE o_orderkey%3 WHEN 0 THEN 0 WHEN 1 THEN 3 ELSE 35 END AS a,
 CASE o_orderkey%3 WHEN 0 THEN 3 WHEN 1 THEN 7 ELSE 70 END AS b, avg(o_totalprice)/250000 AS e FROM orders GROUP BY ALL
 UNION ALL SELECT 'Single trial', o_orderpriority, CASE o_orderkey%4 WHEN 0 THEN 0 WHEN 1 THEN 3 WHEN 2 THEN 35 ELSE 70 END,
 CASE o_orderkey%4 WHEN 0 THEN 3 WHEN 1 THEN 7 WHEN 2 THEN 70 END, avg(o_totalprice)/260000 FROM orders GROUP BY ALL)
SELECT 'death' AS outcome, brand, CASE WHEN b IS NOT NULL THEN a::VARCHAR || '-' || b::VARCHAR END AS fup_period, CAST(CASE b WHEN 3 THEN 1 WHEN 7 THEN 2 WHEN 70 THEN 7 END AS INT) AS period_ord,
 max(CASE WHEN approach='Sequential trial' THEN {_text_sql('e')} END) AS "Sequential trial", max(CASE WHEN approach='Single trial' THEN {_text_sql('e')} END) AS "Single trial" FROM s GROUP BY ALL""")
def effect_comparison_from_estimates(spark, sf):
    """The design comparison on estimates taken from plain aggregates, so that SQL can check it."""
    orders = fx.load(spark, sf, "orders")
    k3, k4 = F.col("o_orderkey") % 3, F.col("o_orderkey") % 4
    tags = [F.lit("all").alias("subgroup"), F.lit("all").alias("subgroup_level"), F.lit("death").alias("outcome")]
    span = lambda lo, mid, hi: F.when(k3 == 0, lo).when(k3 == 1, mid).otherwise(hi)
    seq_e = orders.groupBy(F.col("o_orderpriority").alias("brand"), span(0, 3, 35).alias("period_start"), span(3, 7, 70).alias("period_end")).agg(
        (F.avg("o_totalprice") / 250000).alias("coxhazr"))
    seq_e = seq_e.select("*", *tags, (F.col("coxhazr") * 0.9).alias("coxhr_ll"), (F.col("coxhazr") * 1.1).alias("coxhr_ul"))
    term = F.when(k4 == 0, "1-3").when(k4 == 1, "4-7").when(k4 == 2, "36-70").otherwise("71+")
    one_e = orders.groupBy(F.col("o_orderpriority").alias("brand"), term.alias("term")).agg((F.avg("o_totalprice") / 260000).alias("or"))
    one_e = one_e.select("*", *tags, (F.col("or") * 0.9).alias("or_ll"), (F.col("or") * 1.1).alias("or_ul"))
    return report.effect_comparison_wide(report.effect_comparison(seq_e, one_e, CFG.cuts))


@query(f"""WITH c AS (SELECT l_returnflag AS brand, l_linestatus AS label, l_linestatus='F' AS ref, avg(l_discount)*20 AS e FROM lineitem GROUP BY ALL)
SELECT 'status' AS variable, label, max(CASE WHEN brand='A' THEN v END) AS "A", max(CASE WHEN brand='N' THEN v END) AS "N", max(CASE WHEN brand='R' THEN v END) AS "R"
FROM (SELECT *, CASE WHEN ref THEN '1 ' ELSE {_text_sql('e')} END AS v FROM c) GROUP BY 1, 2""")
def ratio_table_from_estimates(spark, sf):
    """The wide odds-ratio table on estimates taken from plain aggregates."""
    est = fx.load(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("brand"), F.col("l_linestatus").alias("label")).agg(
        (F.avg("l_discount") * 20).alias("or"))
    est = est.select("*", F.lit("status").alias("variable"), (F.col("label") == "F").alias("reference_row"),
                     (F.col("or") * 0.9).alias("or_ll"), (F.col("or") * 1.1).alias("or_ul"))
    return report.ratio_table_wide(est, ["A", "N", "R"])


@query("""SELECT CAST(greatest(least(floor((log10(w) + 1)/(2/20.0)), 20), -1) AS INT) AS bin, count(*) AS n,
 -1.0::DOUBLE + greatest(least(floor((log10(w) + 1)/(2/20.0)), 20), -1)*(2/20.0) AS bin_start FROM (SELECT l_quantity/(l_linenumber*5.3) AS w FROM lineitem) GROUP BY ALL""")
def weight_histogram_from_values(spark, sf):
    """The weight histogram on a plain ratio, so that SQL can check it."""
    w = fx.load(spark, sf, "lineitem").select((F.col("l_quantity") / (F.col("l_linenumber") * 5.3)).alias("w"))
    return ipw.weight_histogram(w, "w", 20, -1.0, 1.0)
