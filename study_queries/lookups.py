"""Event lookups: first, last, n-th, flag, count, value, category, interval and codelist queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from cohortspark import fixture as fx
from cohortspark.functions.columns import case_levels, resolved_after_onset, satisfied
from cohortspark.operators import lookup as lk
from cohortspark.operators.lookup import Find
from cohortspark.operators.recode import imd_quintile
from cohortspark.sources.codelists import codelist, combine_codelists
from cohortspark.sources.tables import attach_values, restrict_to
from study_queries.registry import query

def _k():
    return F.col("kind")


# every person's own anchor day, spread over 300 days
ANCHORS_SQL = "SELECT patient_id, DATE '1997-01-01' + CAST(patient_id%300 AS INT) AS anchor_date FROM person"


def anchors(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey") + 1
    return fx.load(spark, sf, "customer").select(
        k.cast("long").alias("patient_id"),
        F.date_add(F.to_date(F.lit("1997-01-01")), (k % 300).cast("int")).alias("anchor_date"))


def _sql(body: str, *names: str, **extra: str) -> str:
    return fx.with_sql("person", "ev", *names, anchors=ANCHORS_SQL, **extra) + body


@query(_sql("""
SELECT a.patient_id, a.anchor_date,
 min(e.date) FILTER (e.kind='postest' AND e.date >= a.anchor_date) AS postest_date,
 min(e.date) FILTER (e.kind='admission' AND e.date >= a.anchor_date) AS admitted_date,
 min(e.date) FILTER (e.kind='death' AND e.date >= a.anchor_date) AS death_date
FROM anchors a LEFT JOIN ev e USING (patient_id) GROUP BY ALL"""))
def first_event_after(spark, sf):
    find = lambda n, k: Find(n, "date", "first", _k() == k, on_or_after=F.col("anchor_date"))
    return lk.lookup(fx.events(spark, sf), anchors(spark, sf), [
        find("postest_date", "postest"), find("admitted_date", "admission"), find("death_date", "death")])


@query(_sql("""
SELECT a.patient_id, a.anchor_date,
 max(e.date) FILTER (e.kind='postest' AND e.date < a.anchor_date) AS postest_0_date,
 max(e.date) FILTER (e.kind='test' AND e.date < a.anchor_date) AS test_0_date
FROM anchors a LEFT JOIN ev e USING (patient_id) GROUP BY ALL"""))
def last_event_before(spark, sf):
    find = lambda n, k: Find(n, "date", "last", _k() == k, on_or_before=F.date_sub(F.col("anchor_date"), 1))
    return lk.lookup(fx.events(spark, sf), anchors(spark, sf), [find("postest_0_date", "postest"), find("test_0_date", "test")])


@query(fx.with_sql("ev", d="""SELECT patient_id, date, row_number() OVER (PARTITION BY patient_id ORDER BY date) AS k FROM
 (SELECT DISTINCT patient_id, date FROM ev WHERE kind IN ('pfizer','az') AND date >= DATE '1996-06-01')""") + """
SELECT patient_id, max(date) FILTER (k=1) AS dose_1_date, max(date) FILTER (k=2) AS dose_2_date, max(date) FILTER (k=3) AS dose_3_date
FROM d GROUP BY patient_id""")
def nth_event_wide(spark, sf):
    ev = fx.events(spark, sf).where(_k().isin("pfizer", "az") & (F.col("date") >= "1996-06-01"))
    return lk.widen(lk.nth_events(ev, 3).withColumnRenamed("date", "dose"), 3, ["dose"])


@query(_sql("""
SELECT patient_id, anchor_date, CAST(k AS INT) AS k, date FROM
 (SELECT a.patient_id, a.anchor_date, e.date, row_number() OVER (PARTITION BY a.patient_id ORDER BY e.date) AS k
  FROM anchors a JOIN (SELECT DISTINCT patient_id, date FROM ev WHERE kind IN ('postest','test')) e
  ON a.patient_id=e.patient_id AND e.date >= a.anchor_date) WHERE k <= 2"""))
def nth_test_after_anchor(spark, sf):
    tests = fx.events(spark, sf).where(_k().isin("postest", "test")).select("patient_id", "date").distinct()
    mine = lk.on_or_after(tests, anchors(spark, sf), F.col("date") >= F.col("anchor_date"))
    return lk.nth_events(mine, 2, carry=["anchor_date"]).select("patient_id", "anchor_date", "k", "date")


@query(fx.with_sql("spell", one="""SELECT patient_id, admitted_date, max(coalesce(discharged_date, DATE '0001-01-01')) AS d
 FROM spell WHERE admitted_date >= DATE '1996-01-01' GROUP BY ALL""", r="""
 SELECT *, row_number() OVER (PARTITION BY patient_id ORDER BY admitted_date) AS k FROM one""") + """
SELECT patient_id, max(admitted_date) FILTER (k=1) AS admitted_1_date, max(admitted_date) FILTER (k=2) AS admitted_2_date,
 max(admitted_date) FILTER (k=3) AS admitted_3_date,
 nullif(max(d) FILTER (k=1), DATE '0001-01-01') AS discharged_1_date, nullif(max(d) FILTER (k=2), DATE '0001-01-01') AS discharged_2_date,
 nullif(max(d) FILTER (k=3), DATE '0001-01-01') AS discharged_3_date FROM r GROUP BY patient_id""")
def nth_spell_wide(spark, sf):
    s = fx.spells(spark, sf).where("admitted_date >= '1996-01-01'").withColumnRenamed("admitted_date", "admitted")
    s = s.withColumnRenamed("discharged_date", "discharged")
    return lk.widen(lk.nth_events(s, 3, date="admitted", carry=["discharged"]), 3, ["admitted", "discharged"])


@query(_sql("""
SELECT a.patient_id, a.anchor_date,
 count(e.date) FILTER (e.kind='other' AND e.date BETWEEN a.anchor_date - 182 AND a.anchor_date) > 0 AS seen_recently,
 count(e.date) FILTER (e.kind='dereg' AND e.date <= a.anchor_date) > 0 AS ever_left
FROM anchors a LEFT JOIN ev e USING (patient_id) GROUP BY ALL"""))
def event_flag_window(spark, sf):
    a = F.col("anchor_date")
    return lk.lookup(fx.events(spark, sf), anchors(spark, sf), [
        Find("seen_recently", "flag", where=_k() == "other", on_or_after=F.date_sub(a, 182), on_or_before=a),
        Find("ever_left", "flag", where=_k() == "dereg", on_or_before=a)])


@query(_sql("""
SELECT a.patient_id, a.anchor_date,
 count(e.date) FILTER (e.kind IN ('test','postest') AND e.date BETWEEN a.anchor_date - 400 AND a.anchor_date - 1) AS n_tests
FROM anchors a LEFT JOIN ev e USING (patient_id) GROUP BY ALL"""))
def event_count_window(spark, sf):
    a = F.col("anchor_date")
    return lk.lookup(fx.events(spark, sf), anchors(spark, sf), [
        Find("n_tests", "count", where=_k().isin("test", "postest"), on_or_after=F.date_sub(a, 400), on_or_before=F.date_sub(a, 1))])


@query(fx.with_sql("act", u="SELECT DISTINCT patient_id, DATE '2024-01-15' + CAST(patient_id%14 AS INT) AS anchor_date FROM act") + """
SELECT u.patient_id, u.anchor_date,
 coalesce(bool_or(a.date BETWEEN u.anchor_date - 3 AND u.anchor_date), false) AS lag_0_3,
 coalesce(bool_or(a.date BETWEEN u.anchor_date - 6 AND u.anchor_date - 4), false) AS lag_4_6,
 coalesce(bool_or(a.date BETWEEN u.anchor_date - 9 AND u.anchor_date - 7), false) AS lag_7_9
FROM u LEFT JOIN act a ON a.patient_id=u.patient_id AND a.event_type='error' GROUP BY ALL""")
def lag_window_flags(spark, sf):
    act = fx.activity(spark, sf)
    who = act.select("patient_id").distinct().withColumn(
        "anchor_date", F.date_add(F.to_date(F.lit("2024-01-15")), (F.col("patient_id") % 14).cast("int")))
    a = F.col("anchor_date")
    lag = lambda lo, hi: Find(f"lag_{lo}_{hi}", "flag", where=F.col("event_type") == "error",
                              on_or_after=F.date_sub(a, hi), on_or_before=F.date_sub(a, lo))
    return lk.lookup(act, who, [lag(0, 3), lag(4, 6), lag(7, 9)])


@query(_sql("""
SELECT a.patient_id, a.anchor_date, x.value AS last_value FROM anchors a LEFT JOIN (
 SELECT a.patient_id, max(struct_pack(d := e.date, v := e.value)).v AS value FROM anchors a JOIN ev e
 ON a.patient_id=e.patient_id AND e.kind='other' AND e.value < 300000 AND e.date <= a.anchor_date GROUP BY 1) x USING (patient_id)"""))
def latest_value(spark, sf):
    known = F.when(F.col("value") < 300000, F.col("value"))
    return lk.lookup(fx.events(spark, sf), anchors(spark, sf), [
        Find("last_value", "value", "last", _k() == "other", on_or_before=F.col("anchor_date"), value=known)])


CATEGORY_SQL = """SELECT * FROM (VALUES ('postest','infection'),('test','infection'),('admission','care'),('other','contact')) t(code, category)"""


def _categories(spark):
    rows = [("postest", "infection"), ("test", "infection"), ("admission", "care"), ("other", "contact")]
    return spark.createDataFrame([("local", "groups", c, g) for c, g in rows], "system string, list string, code string, category string")


@query(fx.with_sql("ev", codes=CATEGORY_SQL) + """
SELECT patient_id, max(struct_pack(d := date, c := category)).c AS category FROM ev JOIN codes ON kind=code
WHERE date <= DATE '1997-01-01' GROUP BY patient_id""")
def latest_category(spark, sf):
    ev = lk.with_category(fx.events(spark, sf).where("date <= '1997-01-01'"), _categories(spark), "kind")
    return lk.lookup_fixed(ev, [Find("_c", "value", "last", value=F.col("category"))]).withColumnRenamed("_c", "category")


@query(fx.with_sql("act", n="SELECT patient_id, event_type, count(*) AS n FROM act GROUP BY ALL") + """
SELECT patient_id, event_type AS most_frequent FROM n
QUALIFY row_number() OVER (PARTITION BY patient_id ORDER BY n DESC, event_type) = 1""")
def most_frequent_code(spark, sf):
    return lk.most_frequent(fx.activity(spark, sf), "event_type", name="most_frequent")


@query(_sql("""
SELECT p.patient_id, p.first_test, min(e.date) FILTER (e.kind='admission') AS admitted_after_test,
 count(e.date) FILTER (e.kind='postest') > 0 AS positive_within_200
FROM (SELECT a.patient_id, min(e.date) AS first_test FROM anchors a LEFT JOIN ev e
      ON a.patient_id=e.patient_id AND e.kind='test' AND e.date >= DATE '1996-01-01' GROUP BY 1) p
LEFT JOIN ev e ON e.patient_id=p.patient_id AND ((e.kind='admission' AND e.date >= p.first_test + 1)
 OR (e.kind='postest' AND e.date BETWEEN p.first_test AND p.first_test + 200)) GROUP BY 1, 2"""))
def dependent_window_lookup(spark, sf):
    ev = fx.events(spark, sf)
    first = lk.lookup(ev, anchors(spark, sf).select("patient_id"), [
        Find("first_test", "date", "first", _k() == "test", on_or_after=F.lit("1996-01-01").cast("date"))])
    t = F.col("first_test")
    return lk.lookup(ev, first, [
        Find("admitted_after_test", "date", "first", _k() == "admission", on_or_after=F.date_add(t, 1)),
        Find("positive_within_200", "flag", where=_k() == "postest", on_or_after=t, on_or_before=F.date_add(t, 200))])


@query(fx.with_sql("act") + """
SELECT DISTINCT patient_id, date FROM act a WHERE event_type='purchase' AND NOT EXISTS
 (SELECT 1 FROM act b WHERE b.patient_id=a.patient_id AND b.date=a.date AND b.event_type='error')""")
def exclude_days_anti(spark, sf):
    act = fx.activity(spark, sf)
    kept = lk.exclude_days(act.where("event_type = 'purchase'"), act.where("event_type = 'error'"))
    return kept.select("patient_id", "date").distinct()


@query(fx.with_sql("ev") + """
SELECT patient_id, count(*) AS n, min(date) AS first_date FROM ev WHERE kind IN ('postest','admission','death') GROUP BY patient_id""")
def codelist_semi_join(spark, sf):
    severe = combine_codelists(
        codelist(spark, ["postest", "admission"], "a", "local"), codelist(spark, ["admission", "death"], "b", "local"), name="severe")
    return lk.in_codelist(fx.events(spark, sf), severe, "kind").groupBy("patient_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("date").alias("first_date"))


@query(fx.with_sql("ev", a="SELECT DISTINCT kind FROM ev WHERE value > 499000", b="SELECT DISTINCT kind FROM ev WHERE value < 1500") + """
SELECT 'extreme' AS list, kind AS code FROM (SELECT kind FROM a UNION SELECT kind FROM b)""", name="combine_codelists")
def combine_lists(spark, sf):
    def of(rows, name):
        return rows.select(F.lit("local").alias("system"), F.lit(name).alias("list"), F.col("kind").alias("code"),
                           F.lit(None).cast("string").alias("category")).distinct()
    ev = fx.events(spark, sf)
    return combine_codelists(of(ev.where("value > 499000"), "high"), of(ev.where("value < 1500"), "low"), name="extreme").select("list", "code")


# registration-like intervals: every event opens one, its length depends on the event
REG_SQL = """SELECT patient_id, date AS start_date, CASE WHEN event_id%9=0 THEN NULL ELSE date + CAST(event_id%700 AS INT) END AS end_date,
 event_id%50 AS practice FROM ev WHERE kind IN ('other','dereg')"""


def registrations(spark, sf):
    eid = F.col("event_id")
    return fx.events(spark, sf).where(_k().isin("other", "dereg")).select(
        "patient_id", F.col("date").alias("start_date"),
        F.when(eid % 9 != 0, F.date_add("date", (eid % 700).cast("int"))).alias("end_date"), (eid % 50).alias("practice"))


@query(_sql("""
SELECT a.patient_id, a.anchor_date, x.w.p AS practice, x.w IS NOT NULL AS registered FROM anchors a LEFT JOIN (
 SELECT a.patient_id, max(struct_pack(s := start_date, e := coalesce(end_date, DATE '9999-12-31'), p := practice)) AS w
 FROM anchors a JOIN reg r ON a.patient_id=r.patient_id AND start_date <= anchor_date AND (end_date IS NULL OR end_date >= anchor_date)
 GROUP BY 1) x USING (patient_id)""", reg=REG_SQL))
def asof_interval_lookup(spark, sf):
    return lk.as_of(registrations(spark, sf), anchors(spark, sf), F.col("anchor_date"), ["practice"], "registered")


@query(_sql("""
SELECT a.patient_id, a.anchor_date, EXISTS (SELECT 1 FROM reg r WHERE r.patient_id=a.patient_id AND start_date <= anchor_date - 365
 AND coalesce(end_date, DATE '9999-12-31') >= anchor_date) AS registered_a_year FROM anchors a""", reg=REG_SQL))
def continuous_registration(spark, sf):
    a = F.col("anchor_date")
    return lk.registered_throughout(registrations(spark, sf), anchors(spark, sf), F.date_sub(a, 365), a, "registered_a_year")


@query(_sql("""
SELECT a.patient_id, a.anchor_date, CAST(date_diff('year', b.dob, a.anchor_date) - CASE WHEN strftime(a.anchor_date, '%m%d') < strftime(b.dob, '%m%d') THEN 1 ELSE 0 END AS INT) AS age_on
FROM anchors a JOIN (SELECT patient_id, DATE '1920-03-01' + CAST(patient_id*37%9000 AS INT) AS dob FROM person) b USING (patient_id)"""))
def age_as_of(spark, sf):
    born = F.date_add(F.to_date(F.lit("1920-03-01")), (F.col("patient_id") * 37 % 9000).cast("int"))
    df = anchors(spark, sf).withColumn("dob", born)
    return df.select("patient_id", "anchor_date", lk.age_on(F.col("dob"), F.col("anchor_date")).alias("age_on"))


@query(_sql("""
SELECT p.patient_id, min(e.date) FILTER (e.kind='death' AND e.date >= DATE '1997-01-01') AS death_date,
 min(e.date) FILTER (e.kind='death' AND e.date >= DATE '1997-01-01' AND e.value > 450000) AS cause_death_date,
 min(e.date) FILTER (e.kind='dereg' AND e.date >= DATE '1997-01-01') AS dereg_date
FROM person p LEFT JOIN ev e USING (patient_id) GROUP BY 1"""))
def death_and_deregistration(spark, sf):
    start = F.lit("1997-01-01").cast("date")
    find = lambda n, w: Find(n, "date", "first", w, on_or_after=start)
    found = lk.lookup_fixed(fx.events(spark, sf).where(_k().isin("death", "dereg")), [
        find("death_date", _k() == "death"), find("cause_death_date", (_k() == "death") & (F.col("value") > 450000)),
        find("dereg_date", _k() == "dereg")])
    return attach_values(anchors(spark, sf).select("patient_id"), found, ["death_date", "cause_death_date", "dereg_date"])


@query(_sql("""
SELECT p.patient_id, p.age,
 max(struct_pack(d := e.date, v := e.value/1000)) FILTER (e.kind='other' AND e.value/1000 < 100 AND e.date BETWEEN DATE '1997-01-01' - 1826 AND DATE '1997-01-01'
  AND e.date >= DATE '1997-01-01' - to_months(12 * (p.age - 70))).v AS bmi,
 CAST(round(p.imd/100.0)*100 AS INT) AS imd_rounded
FROM person p LEFT JOIN ev e USING (patient_id) GROUP BY p.patient_id, p.age, p.imd"""))
def cleaned_measurement(spark, sf):
    index, x = F.lit("1997-01-01").cast("date"), F.col("value") / 1000
    who = fx.persons(spark, sf).select("patient_id", "age", "imd")
    of_age = lk.day_of_age(F.col("age"), index, 70)
    since = F.when(of_age.isNotNull(), F.greatest(F.date_sub(index, 1826), of_age))  # unknown age: nothing counts
    out = lk.lookup(fx.events(spark, sf), who, [Find("bmi", "value", "last", (_k() == "other") & (x < 100), since, index, x)])
    return out.select("patient_id", "age", "bmi", F.round("imd", -2).alias("imd_rounded"))


@query(_sql("""
SELECT p.patient_id,
 CASE WHEN immunosuppressed OR (diabetes AND age >= 80) THEN true ELSE false END AS high_risk,
 coalesce(onset IS NOT NULL AND (resolved IS NULL OR resolved < onset), false) AS current_condition,
 CASE WHEN imd IS NULL OR imd < 0 THEN 'Unknown' WHEN imd < 32844*1/5.0 THEN '1 (most deprived)' WHEN imd < 32844*2/5.0 THEN '2'
  WHEN imd < 32844*3/5.0 THEN '3' WHEN imd < 32844*4/5.0 THEN '4' ELSE '5 (least deprived)' END AS imd_quintile,
 CASE WHEN hscworker THEN 'worker' WHEN care_home THEN 'resident' ELSE 'community' END AS setting
FROM person p LEFT JOIN (SELECT patient_id, max(date) FILTER (kind='postest') AS onset, max(date) FILTER (kind='test') AS resolved FROM ev GROUP BY 1) x USING (patient_id)"""))
def satisfying_and_categorised(spark, sf):
    dates = lk.lookup_fixed(fx.events(spark, sf), [Find("onset", where=_k() == "postest"), Find("resolved", where=_k() == "test")])
    c = F.col
    setting, _ = case_levels([(c("hscworker"), "worker"), (c("care_home"), "resident")], "community")
    return fx.persons(spark, sf).join(dates, "patient_id", "left").select(
        "patient_id", satisfied(c("immunosuppressed") | (c("diabetes") & (c("age") >= 80))).alias("high_risk"),
        resolved_after_onset(c("onset"), c("resolved")).alias("current_condition"),
        imd_quintile(c("imd")).alias("imd_quintile"), setting.alias("setting"))


@query(_sql("""
SELECT p.patient_id, count(e.date) AS n_events, max(coalesce(e.value > 490000, false)) AS any_large
FROM person p JOIN ev e USING (patient_id) WHERE p.age >= 70 AND p.region IN ('EUROPE','ASIA')
 AND NOT EXISTS (SELECT 1 FROM ev d WHERE d.patient_id=p.patient_id AND d.kind='death' AND d.date < DATE '1997-01-01') GROUP BY 1"""))
def population_restriction(spark, sf):
    ev = fx.events(spark, sf)
    dead = ev.where((_k() == "death") & (F.col("date") < "1997-01-01")).select("patient_id").distinct()
    who = fx.persons(spark, sf).where((F.col("age") >= 70) & F.col("region").isin("EUROPE", "ASIA")).select("patient_id")
    return restrict_to(ev, who.join(dead, "patient_id", "left_anti")).groupBy("patient_id").agg(
        F.count("date").alias("n_events"), F.max(F.col("value") > 490000).alias("any_large"))
