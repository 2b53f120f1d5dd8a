"""Joins, windows, sampling, summaries, disclosure control, formatting and report tables."""

from __future__ import annotations

import operator

from pyspark.sql import functions as F

from cohortspark import fixture as fx
from cohortspark.functions import columns as c, disclosure as dc
from cohortspark.operators import joins, matching, report, sampling, summary, windows as wn
from cohortspark.operators.ranking import quantiles
from cohortspark.sources.tables import bind_rows, combine
from study_queries import chain
from study_queries.chain import CFG, sql
from study_queries.registry import query

# -- predicate joins ------------------------------------------------------------------------------
_P, _N = "SELECT p_partkey, p_size FROM part", "SELECT n_nationkey, n_regionkey FROM nation"
_COND = "abs(p_size - 3*n_nationkey) < 1"


def _fuzzy(how: str):
    def run(spark, sf):
        x = fx.load(spark, sf, "part").select("p_partkey", "p_size")
        y = fx.load(spark, sf, "nation").select("n_nationkey", "n_regionkey")
        return joins.predicate_join(x, y, {"p_size": "n_nationkey"}, lambda a, b: F.abs(a - 3 * b) < 1, how)
    return run


for _how in ("inner", "left", "right", "full"):
    query(f"SELECT * FROM ({_P}) {_how} JOIN ({_N}) ON {_COND}", name=f"fuzzy_join_{_how}")(_fuzzy(_how))
for _how, _not in (("semi", ""), ("anti", "NOT")):
    query(f"SELECT * FROM ({_P}) WHERE {_not} EXISTS (SELECT 1 FROM nation WHERE {_COND})", name=f"fuzzy_join_{_how}")(_fuzzy(_how))


@query("""SELECT p_partkey, p_name, p_size, s_suppkey, s_nationkey FROM part JOIN supplier ON p_size > s_nationkey*2 AND p_size <= s_nationkey*2 + 2""")
def fuzzy_join_multi(spark, sf):
    x = fx.load(spark, sf, "part").select("p_partkey", "p_name", "p_size")
    y = fx.load(spark, sf, "supplier").select("s_suppkey", "s_nationkey")
    return joins.predicate_join(x, y, {"p_size": "s_nationkey"}, lambda a, b: (a > b * 2) & (a <= b * 2 + 2), multi=True)


_NEAR = "SELECT o_orderkey, o_totalprice, c_custkey, c_acctbal FROM orders {how} JOIN customer ON o_totalprice - c_acctbal BETWEEN -20 AND 5"


def _near(how: str):
    def run(spark, sf):
        x = fx.load(spark, sf, "orders").select("o_orderkey", "o_totalprice")
        y = fx.load(spark, sf, "customer").select("c_custkey", "c_acctbal")
        return joins.predicate_join(x, y, {"o_totalprice": "c_acctbal"}, joins.Band(-20, 5), how)
    return run


for _how in ("inner", "left", "full"):
    query(_NEAR.format(how=_how), name=f"band_join_{_how}")(_near(_how))


@query(fx.with_sql("ev", "spell") + """SELECT patient_id, date, event_id, event_id_1 AS event_id_y, admitted_date, discharged_date FROM (
 SELECT e.patient_id, e.date, e.event_id, s.event_id AS event_id_1, s.admitted_date, s.discharged_date FROM ev e JOIN spell s
 ON e.patient_id=s.patient_id AND e.date > s.admitted_date AND e.date <= s.discharged_date WHERE e.kind='postest')""")
def between_join_positive_in_hospital(spark, sf):
    x = fx.events(spark, sf).where("kind = 'postest'").select("patient_id", "date", "event_id")
    y = fx.spells(spark, sf).select("patient_id", "event_id", "admitted_date", "discharged_date")
    out = joins.predicate_join(
        x, y, {"patient_id": "patient_id", "date": ("admitted_date", "discharged_date")}, [operator.eq, joins.Between("right")])
    return out.select(F.col("patient_id_x").alias("patient_id"), "date", F.col("event_id_x").alias("event_id"),
                      F.col("event_id_y"), "admitted_date", "discharged_date")


_RANGES = "SELECT s_suppkey, s_acctbal AS low, s_acctbal + 1 + s_suppkey % 7 * 40 AS high FROM supplier"


@query(f"SELECT p_partkey, p_retailprice, s_suppkey, low, high FROM part JOIN ({_RANGES}) ON p_retailprice >= low AND p_retailprice < high")
def between_join_price_ranges(spark, sf):
    x = fx.load(spark, sf, "part").select("p_partkey", "p_retailprice")
    y = fx.load(spark, sf, "supplier").select(
        "s_suppkey", F.col("s_acctbal").alias("low"), (F.col("s_acctbal") + 1 + F.col("s_suppkey") % 7 * 40).alias("high"))
    return joins.predicate_join(x, y, {"p_retailprice": ("low", "high")}, joins.Between("left"))


@query("""SELECT p_partkey, p.n AS n_x, y.n AS n_y, n_name, abs(p.n - y.n) AS gap FROM (SELECT p_partkey, p_size AS n FROM part) p
 LEFT JOIN (SELECT n_nationkey AS n, n_name FROM nation) y ON abs(p.n - y.n) <= 1""")
def fuzzy_join_index(spark, sf):
    """Pairs of the common key `n` given by a function of both tables of distinct keys."""
    x = fx.load(spark, sf, "part").select("p_partkey", F.col("p_size").alias("n"))
    y = fx.load(spark, sf, "nation").select(F.col("n_nationkey").alias("n"), "n_name")

    def near(a, b):
        steps = b.withColumn("n", F.explode(F.array(*[F.col("n_y") + k for k in (-1, 0, 1)])))
        return a.join(steps, "n").withColumn("gap", F.abs(F.col("n") - F.col("n_y")))

    return joins.predicate_join(x, y, how="left", index=near)


@query(sql("""SELECT t.trial_date, t.match_id, t.patient_id, t.age, t.region, c.patient_id AS patient_id_y, c.age AS age_y FROM
 (SELECT m.*, age, region FROM members_a m JOIN people USING (patient_id) WHERE treated=1) t JOIN
 (SELECT m.*, age, region FROM members_a m JOIN people USING (patient_id) WHERE treated=0) c
 ON t.trial_date=c.trial_date AND t.match_id=c.match_id AND t.region=c.region AND abs(t.age-c.age)<=2""", "members_a", "people"))
def caliper_recheck_join(spark, sf):
    who = chain.people(spark, sf).select("patient_id", "age", "region")
    m = matching.pair_members(chain.pairs(spark, sf)).join(who, "patient_id")
    cols = ["trial_date", "match_id", "region", "patient_id", "age"]
    return joins.caliper_join(
        m.where("treated = 1").select(*cols), m.where("treated = 0").select(*cols), ["trial_date", "match_id", "region"], {"age": 2})


# -- windows and reshaping ------------------------------------------------------------------------
_DAILY = fx.with_sql("act", d="SELECT patient_id, date, max(value) AS value FROM act WHERE event_type='purchase' GROUP BY 1, 2",
                     g="""SELECT p.patient_id, CAST(t AS DATE) AS date, d.value FROM (SELECT DISTINCT patient_id FROM d) p
 CROSS JOIN range(DATE '2024-01-01', DATE '2024-01-31', INTERVAL 1 DAY) r(t) LEFT JOIN d ON d.patient_id=p.patient_id AND d.date=CAST(t AS DATE)""")


def _daily(spark, sf):
    d = fx.activity(spark, sf).where("event_type = 'purchase'").groupBy("patient_id", "date").agg(F.max("value").alias("value"))
    return wn.dense_grid(d, ["patient_id"], "date", wn.date_points(F.lit("2024-01-01").cast("date"), F.lit("2024-01-30").cast("date")))


@query(_DAILY + """SELECT patient_id, date, value, last_value(value IGNORE NULLS) OVER (PARTITION BY patient_id ORDER BY date ROWS UNBOUNDED PRECEDING) AS down,
 first_value(value IGNORE NULLS) OVER (PARTITION BY patient_id ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS up FROM g""")
def locf_nocb(spark, sf):
    k = (["patient_id"], ["date"])
    return _daily(spark, sf).withColumns({"down": wn.fill_down(F.col("value"), *k), "up": wn.fill_up(F.col("value"), *k)})


@query(_DAILY + """SELECT patient_id, date, coalesce(value, 0) AS value, CAST(sum(CASE WHEN value IS NOT NULL THEN 1 ELSE 0 END) OVER w AS BIGINT) AS seen, coalesce(value,0) - lag(coalesce(value,0),1,0) OVER w2 AS step,
 lead(date, 2) OVER w2 AS two_ahead, product(CASE WHEN value IS NOT NULL THEN 0.9 ELSE 1.0 END) OVER w AS decay FROM g
 WINDOW w AS (PARTITION BY patient_id ORDER BY date ROWS UNBOUNDED PRECEDING), w2 AS (PARTITION BY patient_id ORDER BY date)""")
def dense_grid_fill(spark, sf):
    k = (["patient_id"], ["date"])
    hit = F.col("value").isNotNull()
    df = _daily(spark, sf).withColumns({
        "seen": wn.cumulative_sum(F.when(hit, 1).otherwise(0), *k),
        "decay": wn.cumulative_product(F.when(hit, 0.9).otherwise(1.0), *k)})
    df = df.withColumn("value", F.coalesce("value", F.lit(0.0)))
    return df.withColumns({"step": wn.first_difference(F.col("value"), *k), "two_ahead": wn.lead_or(F.col("date"), None, *k, n=2)})


@query(fx.with_sql("act") + """SELECT date, event_type, n, n/sum(n) OVER (PARTITION BY date)::DOUBLE*10000 AS per_10000,
 max(CASE WHEN event_type='click' THEN n END) OVER (PARTITION BY date) AS clicks FROM (SELECT date, event_type, count(*) AS n FROM act GROUP BY 1, 2)""")
def share_of_total(spark, sf):
    n = fx.activity(spark, sf).groupBy("date", "event_type").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumns({"per_10000": wn.share_of_total(F.col("n"), ["date"], 10000.0),
                          "clicks": wn.broadcast_within(F.col("n"), F.col("event_type") == "click", ["date"])})


@query(fx.with_sql("ev", dose0="SELECT patient_id, date, row_number() OVER (PARTITION BY patient_id ORDER BY date) AS k FROM (SELECT DISTINCT patient_id, date FROM ev WHERE kind='pfizer')") + """
SELECT patient_id, 'dose' AS what, CAST(k AS VARCHAR) AS idx, date AS value FROM dose0 WHERE k <= 3""")
def pivot_long_names(spark, sf):
    from cohortspark.operators import lookup as lk
    ev = fx.events(spark, sf).where("kind = 'pfizer'").withColumnRenamed("date", "dose")
    wide = lk.widen(lk.nth_events(ev, 3, date="dose"), 3, ["dose"])
    return wn.pivot_long(wide, ["patient_id"], r"^(.*)_(\d+)_date$", [f"dose_{i}_date" for i in (1, 2, 3)], ["what", "idx"])


@query("""SELECT o_orderstatus, max(CASE WHEN o_orderpriority='1-URGENT' THEN n END) AS n_urgent, max(CASE WHEN o_orderpriority='5-LOW' THEN n END) AS n_low,
 max(CASE WHEN o_orderpriority='1-URGENT' THEN top END) AS top_urgent, max(CASE WHEN o_orderpriority='5-LOW' THEN top END) AS top_low
 FROM (SELECT o_orderstatus, o_orderpriority, count(*) AS n, max(o_totalprice) AS top FROM orders GROUP BY 1, 2) GROUP BY 1""")
def pivot_wide_values(spark, sf):
    df = fx.load(spark, sf, "orders").groupBy("o_orderstatus", "o_orderpriority").agg(
        F.count(F.lit(1)).alias("n"), F.max("o_totalprice").alias("top"))
    df = df.withColumn("p", c.recode(F.col("o_orderpriority"), {"1-URGENT": "urgent", "5-LOW": "low"}))
    return wn.pivot_wide(df, ["o_orderstatus"], "p", ["urgent", "low"], ["n", "top"])


@query("""SELECT patient_id, i AS copy, age FROM (SELECT CAST(c_custkey+1 AS BIGINT) AS patient_id, CAST(66+(c_custkey*7)%30 AS INT) AS age FROM customer), (SELECT CAST(range AS INT) AS i FROM range(1, 4))""")
def replicate_rows(spark, sf):
    return wn.replicate(fx.persons(spark, sf).select("patient_id", "age"), 3, "copy")


@query(fx.with_sql("ev") + """SELECT patient_id, date, value FROM (SELECT *, row_number() OVER (PARTITION BY patient_id ORDER BY value DESC, event_id) AS r FROM ev) WHERE r <= 2""")
def top_rows_per_group(spark, sf):
    ev = fx.events(spark, sf)
    return wn.top_rows(ev, ["patient_id"], [F.col("value").desc(), F.col("event_id")], 2).select("patient_id", "date", "value")


@query(fx.with_sql("person", "ev") + """SELECT 'person' AS source, patient_id, age, CAST(NULL AS DATE) AS date FROM person
 UNION ALL SELECT 'death', patient_id, NULL, date FROM ev WHERE kind='death'""")
def bind_rows_missing_cols(spark, sf):
    p = fx.persons(spark, sf).select("patient_id", "age")
    d = fx.events(spark, sf).where("kind = 'death'").select("patient_id", "date")
    return combine([({"source": "person"}, p), ({"source": "death"}, d)])


# -- sampling -------------------------------------------------------------------------------------
_HAD = fx.with_sql("person", "ev", h="SELECT patient_id, EXISTS (SELECT 1 FROM ev e WHERE e.patient_id=p.patient_id AND kind='death') AS had FROM person p")


def _had(spark, sf):
    dead = fx.events(spark, sf).where("kind = 'death'").select("patient_id").distinct().withColumn("had", F.lit(True))
    return fx.persons(spark, sf).select("patient_id").join(dead, "patient_id", "left").fillna(False, ["had"])


@query(_HAD + "SELECT patient_id, had, dense_rank() OVER (ORDER BY patient_id) <= 137 AS sampled FROM h")
def sample_random_n(spark, sf):
    return sampling.sample_random_n(_had(spark, sf), 137)


@query(_HAD + "SELECT patient_id, had, dense_rank() OVER (ORDER BY patient_id) <= ceil((SELECT count(*) FROM h)*0.15) AS sampled FROM h")
def sample_random_prop(spark, sf):
    return sampling.sample_random_prop(_had(spark, sf), 0.15)


@query(_HAD + "SELECT patient_id, had, dense_rank() OVER (ORDER BY CASE WHEN had THEN 0 ELSE patient_id END) - 1 <= 100 AS sampled FROM h")
def sample_nonoutcomes(spark, sf):
    return sampling.sample_nonoutcomes_n(_had(spark, sf), 100, "had")


@query(_HAD + "SELECT patient_id, had, dense_rank() OVER (ORDER BY CASE WHEN had THEN 0 ELSE patient_id END) - 1 <= ceil((SELECT count(*) FILTER (NOT had) FROM h)*0.2) AS sampled FROM h")
def sample_nonoutcomes_prop(spark, sf):
    return sampling.sample_nonoutcomes_prop(_had(spark, sf), 0.2, "had")


@query(_HAD + """SELECT *, CASE WHEN had THEN 1.0::DOUBLE WHEN NOT sampled THEN 0.0::DOUBLE ELSE sum((NOT had)::INT) OVER ()::DOUBLE / sum((sampled AND NOT had)::INT) OVER ()::DOUBLE END AS sample_weight
 FROM (SELECT patient_id, had, dense_rank() OVER (ORDER BY CASE WHEN had THEN 0 ELSE patient_id END) - 1 <= 100 AS sampled FROM h)""")
def sample_weights(spark, sf):
    return sampling.sample_weights(sample_nonoutcomes(spark, sf), "had")


# -- summaries ------------------------------------------------------------------------------------
_Q = ", ".join(f"quantile_disc(x, {p}) AS p{round(100 * p)}" for p in summary.PROBS)
_NUM = f"""count(*) AS n, count(x) AS n_nonmiss, count(DISTINCT x) AS "unique", avg(x) AS mean, stddev_samp(x) AS sd, min(x) AS min, max(x) AS max,
 count(x)/count(*)::DOUBLE AS pct_nonmiss, count(*)-count(x) AS n_miss, (count(*)-count(x))/count(*)::DOUBLE AS pct_miss, {_Q}"""
_STACK = """SELECT sex, 'imd' AS variable, imd::DOUBLE AS x FROM person UNION ALL SELECT sex, 'age', age::DOUBLE FROM person"""


@query(fx.with_sql("person") + f"SELECT coalesce(sex, '(missing)') AS sex, variable, {_NUM} FROM ({_STACK}) GROUP BY 1, 2")
def numeric_summary(spark, sf):
    return summary.numeric_summary(fx.persons(spark, sf), ["imd", "age"], ["sex"])


@query(fx.with_sql("ev") + f"""SELECT kind, variable, n, n_nonmiss, "unique", pct_nonmiss, n_miss, pct_miss, sd,
 {', '.join(f"DATE '1970-01-01' + CAST(floor({x}) AS INT) AS {x}" for x in ('mean', 'min', 'max', 'p10', 'p25', 'p50', 'p75', 'p90'))}
 FROM (SELECT kind, 'date' AS variable, {_NUM} FROM (SELECT kind, (date - DATE '1970-01-01')::DOUBLE AS x FROM ev) GROUP BY 1)""")
def date_summary(spark, sf):
    return summary.date_summary(fx.events(spark, sf), ["date"], ["kind"])


def _redact_sql(inner: str, part: str, level: str, t: int, keep: str, name: str = "redacted") -> str:
    return f"""SELECT *, (n BETWEEN 1 AND {t}) OR (coalesce(hid <= {t}, false) AND place=1) AS {name} FROM (SELECT *,
 sum(CASE WHEN n BETWEEN 1 AND {t} THEN n END) OVER (PARTITION BY {part}) AS hid,
 row_number() OVER (PARTITION BY {part} ORDER BY (n BETWEEN 1 AND {t})::INT, n, {level}) AS place FROM ({inner}))"""


_CAT = """SELECT variable, level, CAST(n AS BIGINT) AS n, n/sum(n) OVER (PARTITION BY variable)::DOUBLE AS pct,
 CASE WHEN level='(missing)' THEN 0 ELSE n END/sum(CASE WHEN level='(missing)' THEN 0 ELSE n END) OVER (PARTITION BY variable)::DOUBLE AS pct_nonmiss FROM
 (SELECT variable, coalesce(level,'(missing)') AS level, count(*) AS n FROM (SELECT 'sex' AS variable, sex AS level FROM person UNION ALL SELECT 'region', region FROM person
  UNION ALL SELECT 'ethnicity', ethnicity FROM person UNION ALL SELECT 'endoflife', CASE WHEN endoflife THEN 'yes' ELSE 'no' END FROM person) GROUP BY 1, 2)"""


@query(fx.with_sql("person") + f"""SELECT variable, level, redacted, CASE WHEN NOT redacted THEN n END AS n, CASE WHEN NOT redacted THEN pct END AS pct,
 CASE WHEN NOT redacted THEN pct_nonmiss END AS pct_nonmiss FROM ({_redact_sql(_CAT, 'variable', 'level', 24, '')})""")
def cat_summary(spark, sf):
    return summary.cat_summary(fx.persons(spark, sf), ["sex", "region", "ethnicity", "endoflife"], threshold=24)


_CC = """SELECT level1, level2, CAST(n AS BIGINT) AS n, n/sum(n) OVER (PARTITION BY level2)::DOUBLE AS pct,
 CASE WHEN level1='(missing)' THEN 0 ELSE n END/sum(CASE WHEN level1='(missing)' THEN 0 ELSE n END) OVER (PARTITION BY level2)::DOUBLE AS pct_nonmiss FROM (
 SELECT a.level1, b.level2, count(p.patient_id) AS n FROM (SELECT DISTINCT coalesce(ethnicity,'(missing)') AS level1 FROM person) a
 CROSS JOIN (SELECT DISTINCT coalesce(sex,'(missing)') AS level2 FROM person) b LEFT JOIN person p ON coalesce(p.ethnicity,'(missing)')=level1 AND coalesce(p.sex,'(missing)')=level2 GROUP BY 1, 2)"""


@query(fx.with_sql("person") + f"""SELECT level1, level2, redacted, CASE WHEN NOT redacted THEN n END AS n, CASE WHEN NOT redacted THEN pct END AS pct,
 CASE WHEN NOT redacted THEN pct_nonmiss END AS pct_nonmiss FROM (SELECT *, r1 OR r2 AS redacted FROM (
 {_redact_sql('SELECT * EXCLUDE (hid, place) FROM (' + _redact_sql(_CC, 'level1', 'level2', 5, '', 'r1') + ')', 'level2', 'level1', 5, '', 'r2')}))""")
def catcat_summary(spark, sf):
    return summary.catcat_summary(fx.persons(spark, sf), "ethnicity", "sex", threshold=5)


@query(fx.with_sql("ev") + f"""SELECT patient_id, kind, n, redacted FROM ({_redact_sql('SELECT patient_id, kind, count(*) AS n FROM ev GROUP BY 1, 2', 'patient_id', 'kind', 2, '')})""")
def redact_counts(spark, sf):
    n = fx.events(spark, sf).groupBy("patient_id", "kind").agg(F.count(F.lit(1)).alias("n"))
    return dc.redaction_flag(n, "n", 2, ["patient_id"], ["kind"])


@query(fx.with_sql("ev") + """SELECT date, count(*) AS n, CAST(CASE WHEN count(*)=0 THEN 0 ELSE ceil(count(*)/6.0)*6-3 END AS BIGINT) AS mid6, CAST(ceil(count(*)/6.0)*6 AS BIGINT) AS up6,
 CAST(ceil(round(sum(value)/1000.0, 8))*1000 AS BIGINT) AS value_up FROM ev GROUP BY 1""")
def disclosure_rounding(spark, sf):
    df = fx.events(spark, sf).groupBy("date").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("v"))
    return df.select("date", "n", dc.roundmid_any(F.col("n"), 6).alias("mid6"), dc.ceiling_any(F.col("n"), 6).alias("up6"),
                     dc.ceiling_any(F.col("v"), 1000).alias("value_up"))


@query(fx.with_sql("person") + """SELECT variable, n_miss, complete_rate, n_unique FROM (
 SELECT 'age' AS variable, count(*)-count(age) AS n_miss, count(age)/count(*)::DOUBLE AS complete_rate, count(DISTINCT age) AS n_unique FROM person
 UNION ALL SELECT 'imd', count(*)-count(imd), count(imd)/count(*)::DOUBLE, count(DISTINCT imd) FROM person
 UNION ALL SELECT 'sex', count(*)-count(sex), count(sex)/count(*)::DOUBLE, count(DISTINCT sex) FROM person
 UNION ALL SELECT 'region', count(*)-count(region), count(region)/count(*)::DOUBLE, count(DISTINCT region) FROM person
 UNION ALL SELECT 'cev', count(*)-count(cev), count(cev)/count(*)::DOUBLE, count(DISTINCT cev) FROM person)""")
def skim_completeness(spark, sf):
    df = fx.persons(spark, sf).select("patient_id", "age", "imd", "sex", "region", "cev")
    return summary.skim(df).select("variable", "n_miss", "complete_rate", "n_unique")


@query(sql(f"""SELECT 'age' AS variable, 'numeric' AS type, {_NUM}, CAST(NULL AS DATE) AS date_min, CAST(NULL AS DATE) AS date_p50, CAST(NULL AS DATE) AS date_max FROM (SELECT age::DOUBLE AS x FROM people)""".replace(
    _NUM, """count(*)-count(x) AS n_miss, count(x)/count(*)::DOUBLE AS complete_rate, count(DISTINCT x) AS n_unique, avg(x) AS mean, stddev_samp(x) AS sd, min(x) AS min, max(x) AS max, """ + _Q) + """
 UNION ALL SELECT 'vax1_date', 'date', count(*)-count(vax1_date), count(vax1_date)/count(*)::DOUBLE, count(DISTINCT vax1_date), NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL,
 min(vax1_date), quantile_disc(vax1_date, 0.5), max(vax1_date) FROM people
 UNION ALL SELECT 'region', 'text', count(*)-count(region), count(region)/count(*)::DOUBLE, count(DISTINCT region), NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM people
 UNION ALL SELECT 'diabetes', 'logical', 0, 1.0, count(DISTINCT diabetes), avg(diabetes::INT), NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM people""", "people"))
def skim(spark, sf):
    return summary.skim(chain.people(spark, sf).select("patient_id", "age", "vax1_date", "region", "diabetes"))


@query(fx.with_sql("person") + """SELECT * FROM (SELECT variable, level, n, round(100*n/sum(n) OVER (PARTITION BY variable)::DOUBLE, 2) AS percent,
 count(*) OVER (PARTITION BY variable) AS n_levels, CAST(row_number() OVER (PARTITION BY variable ORDER BY level NULLS LAST) AS INT) AS place FROM (
 SELECT variable, level, CAST(ceil(count(*)/6.0)*6-3 AS BIGINT) AS n FROM (SELECT 'age' AS variable, CAST(age AS VARCHAR) AS level FROM person UNION ALL SELECT 'ethnicity', ethnicity FROM person) GROUP BY 1, 2)) WHERE place <= 10""")
def level_counts(spark, sf):
    return summary.level_counts(fx.persons(spark, sf), ["age", "ethnicity"], 10, CFG.threshold)


def _table1_sql(source: str, by: str, cats: dict[str, str], num: str, t: int) -> str:
    r = lambda x: f"CAST({chain.mid(x, t)} AS BIGINT)"
    stack = " UNION ALL ".join(f"SELECT {by} AS arm, '{v}' AS variable, {e} AS level FROM {source}" for v, e in cats.items())
    q = lambda p: f"""(max(age) FILTER (rn = greatest(ceil(N*{p}), 1)) + max(age) FILTER (rn = CASE WHEN N*{p}=round(N*{p}) THEN least(N*{p}+1, N) ELSE ceil(N*{p}) END))/2.0"""
    return f"""SELECT arm, variable, level, {r('n0')} AS n, {r('N1')} AS n_base, {r('m')} AS n_miss, {r('o')} AS n_obs, {r('N1')} AS n_nonmiss, median, p25, p75,
 {r('n0')}/nullif({r('N1')},0)::DOUBLE AS p, {r('m')}/nullif({r('o')},0)::DOUBLE AS p_miss, {r('N1')}/nullif({r('o')},0)::DOUBLE AS p_nonmiss FROM (
 SELECT arm, variable, level, n0, o-m AS N1, m, o, NULL::DOUBLE AS median, NULL::DOUBLE AS p25, NULL::DOUBLE AS p75 FROM (
  SELECT arm, variable, level, n0, sum(n0) OVER (PARTITION BY arm, variable) AS o, coalesce(sum(CASE WHEN level IS NULL THEN n0 END) OVER (PARTITION BY arm, variable), 0) AS m FROM (
   SELECT arm, variable, level, count(*) AS n0 FROM ({stack}) GROUP BY 1, 2, 3)) WHERE level IS NOT NULL
 UNION ALL SELECT arm, '{num}', '', NULL, max(N), 0, max(N), {q(0.5)}::DOUBLE, {q(0.25)}::DOUBLE, {q(0.75)}::DOUBLE FROM (
  SELECT {by} AS arm, age, row_number() OVER (PARTITION BY {by} ORDER BY age) AS rn, count(*) OVER (PARTITION BY {by}) AS N FROM {source}) GROUP BY 1)"""


_T1 = {"sex": "sex", "region": "region", "imd_quintile": "imd_quintile", "multimorb": "multimorb", "diabetes": "CASE WHEN diabetes THEN 'yes' ELSE 'no' END",
       "ethnicity_combined": "ethnicity_combined"}


def _baseline(spark, sf):
    return chain.people(spark, sf).withColumn("arm", F.coalesce("vax1_type", F.lit("none")))


_T1_SQL = _table1_sql("(SELECT *, coalesce(vax1_type,'none') AS arm FROM people)", "arm", _T1, "age", 6)


@query(sql(_T1_SQL, "people"))
def table1(spark, sf):
    return summary.baseline_table(_baseline(spark, sf), "arm", list(_T1), ["age"], CFG.threshold)


_PCT = "CASE WHEN p*100 < 10 THEN printf('%.1f', round(p*100,1)) ELSE printf('%.0f', round(p*100,0)) END"
_STAT = f"CASE WHEN n IS NOT NULL THEN n::VARCHAR || ' (' || {_PCT} || '%)' ELSE printf('%.0f', round(median,0)) || ' (' || printf('%.0f', round(p25,0)) || ', ' || printf('%.0f', round(p75,0)) || ')' END"


@query(sql(f"""SELECT variable, level, max(s) FILTER (arm='pfizer') AS pfizer, max(s) FILTER (arm='az') AS az, max(s) FILTER (arm='none') AS "none"
 FROM (SELECT *, {_STAT} AS s FROM ({_T1_SQL})) GROUP BY 1, 2""", "people"))
def table1_wide(spark, sf):
    return report.baseline_wide(table1(spark, sf), ["pfizer", "az", "none"], "arm")


@query(fx.with_sql("ev") + """SELECT patient_id, date, count(*) AS n FROM ev GROUP BY 1, 2 HAVING count(*) > 1""")
def duplicate_keys(spark, sf):
    return summary.duplicates(fx.events(spark, sf), ["patient_id", "date"])


@query(fx.with_sql("person") + """SELECT unnest(['patient_id','sex','imd','ethnicity','cev']) AS variable,
 unnest([bool_or(patient_id IS NULL), bool_or(sex IS NULL), bool_or(imd IS NULL), bool_or(ethnicity IS NULL), bool_or(cev IS NULL)]) AS has_missing FROM person""")
def any_missing(spark, sf):
    return summary.any_missing(fx.persons(spark, sf).select("patient_id", "sex", "imd", "ethnicity", "cev"))


@query("""SELECT o_orderpriority, count(*) FILTER (o_orderstatus='F') AS "o_orderstatus_F", count(*) FILTER (o_orderstatus='O') AS "o_orderstatus_O", count(*) FILTER (o_orderstatus='P') AS "o_orderstatus_P" FROM orders GROUP BY 1""")
def cross_counts(spark, sf):
    return summary.cross_counts(fx.load(spark, sf, "orders"), "o_orderpriority", "o_orderstatus", ["F", "O", "P"])


@query(" UNION ALL ".join(f"SELECT o_orderstatus, 'o_totalprice' AS variable, {p}::DOUBLE AS prob, quantile_cont(o_totalprice, {p}) AS quantile FROM orders GROUP BY 1"
                          for p in (0.2, 0.4, 0.6, 0.8)))
def spline_knots(spark, sf):
    return quantiles(fx.load(spark, sf, "orders"), ["o_totalprice"], [0.2, 0.4, 0.6, 0.8], ["o_orderstatus"], kind=7)


@query("""SELECT CAST(CASE WHEN o_totalprice < 1000 THEN 0 WHEN o_totalprice >= 400000 THEN 21 ELSE floor((o_totalprice-1000)/(399000/20.0)) + 1 END AS BIGINT) AS bin, count(*) AS n FROM orders GROUP BY 1""")
def histogram(spark, sf):
    return summary.histogram(fx.load(spark, sf, "orders"), F.col("o_totalprice"), 1000.0, 400000.0, 20)


# -- formatting and reports -----------------------------------------------------------------------

@query("""SELECT o_custkey, printf('%.2f', round(n/7.0, 2)) AS two, CASE WHEN n=m THEN '>99%' WHEN printf('%.0f', round(100.0*n/m, 0)) = '100' THEN '>99%' ELSE printf('%.0f', round(100.0*n/m, 0)) || '%' END AS pct,
 printf('%.2f', round(n/7.0, 2)) || ' (' || printf('%.2f', round(n/8.3, 2)) || '-' || printf('%.2f', round(n/6.1, 2)) || ')' AS est,
 'n=' || n::VARCHAR || ' of ' || m::VARCHAR AS filled, CASE WHEN length(txt) <= 8 THEN txt ELSE substr(txt,1,5) || '...' END AS short,
 regexp_extract(txt, '(\\d+)-', 1) AS num FROM (SELECT o_custkey, count(*) AS n, count(*) FILTER (o_orderstatus<>'P') + 3 AS m, max(o_orderpriority) AS txt FROM orders GROUP BY 1)""")
def text_formatting(spark, sf):
    df = fx.load(spark, sf, "orders").groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("n"), (F.count(F.when(F.col("o_orderstatus") != "P", 1)) + 3).alias("m"), F.max("o_orderpriority").alias("txt"))
    n, m = F.col("n"), F.col("m")
    return df.select(
        "o_custkey", c.fixed(n / 7).alias("two"), c.percent_text(n / m).alias("pct"), c.estimate_text(n / 7, n / 8.3, n / 6.1).alias("est"),
        c.fill_template(F.lit("n={n} of {m}"), {"n": n.cast("string"), "m": m.cast("string")}).alias("filled"),
        c.truncate_text(F.col("txt"), 8).alias("short"), F.regexp_extract("txt", r"(\d+)-", 1).alias("num"))


@query("""SELECT p_partkey, regexp_replace(regexp_replace(p_name || ' ' || p_type || ' ' || p_brand, '(.{1,12})(\\s+|$)', '\\1\n', 'g'), '\n$', '') AS wrapped FROM part""")
def wrapped_text(spark, sf):
    text = F.concat_ws(" ", "p_name", "p_type", "p_brand")
    return fx.load(spark, sf, "part").select("p_partkey", c.wrap_text(text, 12).alias("wrapped"))


@query("""SELECT p_partkey, CASE WHEN p_size < 10 THEN '1-9' WHEN p_size < 25 THEN '10-24' ELSE '25+' END AS closed_left,
 CASE WHEN p_size <= 10 THEN '(0,10]' WHEN p_size <= 25 THEN '(10,25]' WHEN p_size <= 40 THEN '(25,40]' END AS closed_right,
 CASE WHEN p_size % 5 = 0 THEN 'Never' WHEN p_size < 20 THEN 'recent' ELSE 'old' END AS with_missing,
 CASE WHEN p_size % 5 = 0 THEN '31+' WHEN p_size - 10 <= 0 THEN 'pre' WHEN p_size - 10 <= 7 THEN '1-7' WHEN p_size - 10 <= 30 THEN '8-30' ELSE '31+' END AS since FROM part""")
def cut_bands(spark, sf):
    x = F.col("p_size")
    gap = F.when(x % 5 != 0, x)
    return fx.load(spark, sf, "part").select(
        "p_partkey", c.cut_band(x, [1, 10, 25, c.INF], ["1-9", "10-24", "25+"]).alias("closed_left"),
        c.cut_band(x, [0, 10, 25, 40], ["(0,10]", "(10,25]", "(25,40]"], right=True).alias("closed_right"),
        c.cut_band_missing(gap, [-c.INF, 20, c.INF], ["recent", "old"], "Never").alias("with_missing"),
        c.timesince_cut(gap - 10, [0, 7, 30]).alias("since"))


@query("""SELECT p_partkey, p_size, n_nationkey, n_regionkey, p_size - n_nationkey AS gap FROM part LEFT JOIN nation ON abs(p_size - n_nationkey) <= 1""")
def fuzzy_join_distance(spark, sf):
    x = fx.load(spark, sf, "part").select("p_partkey", "p_size")
    y = fx.load(spark, sf, "nation").select("n_nationkey", "n_regionkey")
    return joins.predicate_join(x, y, {"p_size": "n_nationkey"}, lambda a, b: F.abs(a - b) <= 1, "left", distance=("gap", lambda a, b: a - b))


_EST = """SELECT o_orderpriority AS brand, o_orderstatus AS subgroup_level, avg(o_totalprice)/250000 AS coxhazr, stddev_samp(o_totalprice)/sqrt(count(*))/avg(o_totalprice) AS coxhr_se,
 avg(o_totalprice)/250000*0.9 AS coxhr_ll, avg(o_totalprice)/250000*1.1 AS coxhr_ul FROM orders GROUP BY 1, 2"""
_META = """SELECT brand, sum(ln(coxhazr)/(coxhr_se*coxhr_se))/sum(1/(coxhr_se*coxhr_se)) AS loghr, sqrt(1/sum(1/(coxhr_se*coxhr_se))) AS loghr_se FROM est GROUP BY 1"""
_POOL = "SELECT *, exp(loghr) AS hr, loghr/loghr_se AS statistic, exp(loghr-1.959963984540054*loghr_se) AS conf_low, exp(loghr+1.959963984540054*loghr_se) AS conf_high FROM m"


def _estimates(spark, sf):
    x = F.avg("o_totalprice")
    return fx.load(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("brand"), F.col("o_orderstatus").alias("subgroup_level")).agg(
        (x / 250000).alias("coxhazr"), (F.stddev_samp("o_totalprice") / F.sqrt(F.count(F.lit(1))) / x).alias("coxhr_se"))


@query(f"WITH est AS ({_EST}), m AS ({_META}) {_POOL}")
def meta_analysis(spark, sf):
    return report.meta_analysis(_estimates(spark, sf), ["brand"], with_p=False)


@query(f"""WITH est AS ({_EST}), m AS ({_META}), p AS ({_POOL}), t AS (SELECT brand, 'death' AS outcome, d AS days,
 printf('%.3f', round(hr,3)) || ' (' || printf('%.3f', round(conf_low,3)) || ', ' || printf('%.3f', round(conf_high,3)) || ')' AS v FROM p, (VALUES ('29-35'),('36+*')) x(d))
SELECT brand, outcome, days, max(CASE WHEN days='29-35' THEN v END) AS "Single trial", max(CASE WHEN days<>'29-35' THEN v END) AS "Sequential trial" FROM t GROUP BY 1, 2, 3""")
def pooled_effect_table(spark, sf):
    pooled = report.meta_analysis(_estimates(spark, sf), ["brand"], with_p=False).withColumn("outcome", F.lit("death"))
    a = pooled.withColumns({"approach": F.lit("Single trial"), "period_start": F.lit(28), "period_end": F.lit(35)})
    b = pooled.withColumns({"approach": F.lit("Sequential trial"), "period_start": F.lit(35), "period_end": F.lit(70)})
    return report.pooled_table(bind_rows(a, b))


@query()
def meta_analysis_p_values(spark, sf):
    return report.meta_analysis(_estimates(spark, sf), ["brand"])


@query("""SELECT o_orderpriority, o_orderstatus, count(*) AS n, CASE o_orderpriority WHEN '1-URGENT' THEN 'Urgent' WHEN '2-HIGH' THEN 'High' END AS o_orderpriority_descr,
 CAST(CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 END AS INT) AS o_orderpriority_ord, CASE o_orderstatus WHEN 'O' THEN 'Open' WHEN 'F' THEN 'Filled' END AS o_orderstatus_descr,
 CAST(CASE o_orderstatus WHEN 'O' THEN 1 WHEN 'F' THEN 2 END AS INT) AS o_orderstatus_ord FROM orders GROUP BY 1, 2""")
def add_descriptions(spark, sf):
    n = fx.load(spark, sf, "orders").groupBy("o_orderpriority", "o_orderstatus").agg(F.count(F.lit(1)).alias("n"))
    return report.add_descriptions(n, {
        "o_orderpriority": {"1-URGENT": "Urgent", "2-HIGH": "High"}, "o_orderstatus": {"O": "Open", "F": "Filled"}})


@query("""SELECT CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'middle' ELSE 'large' END AS size_class, CASE WHEN p_type IN ('ECONOMY','SMALL') THEN 'cheap' ELSE p_type END AS type_group,
 CAST(CASE WHEN p_size < 10 THEN 3 WHEN p_size < 30 THEN 2 ELSE 1 END AS INT) AS reversed, count(*) AS n FROM part GROUP BY 1, 2, 3""")
def ordered_recode(spark, sf):
    size, levels = c.case_levels([(F.col("p_size") < 10, "small"), (F.col("p_size") < 30, "middle")], "large")
    df = fx.load(spark, sf, "part").select(size.alias("size_class"), c.collapse(F.col("p_type"), {"cheap": ["ECONOMY", "SMALL"]}).alias("type_group"))
    return df.groupBy("size_class", "type_group", c.reverse_order(c.level_order(F.col("size_class"), levels), 3).alias("reversed")).agg(
        F.count(F.lit(1)).alias("n"))


@query(sql(f"""SELECT arm, variable, level, NOT coalesce(redacted, false) AS shown, CASE WHEN NOT redacted THEN n END AS n FROM (
 SELECT arm, variable, level, n, redacted FROM ({_redact_sql("SELECT arm, variable, level, n FROM (SELECT arm, variable, level, n FROM t1 WHERE n IS NOT NULL UNION ALL SELECT arm, variable, NULL, max(n_miss) FROM t1 WHERE n IS NOT NULL GROUP BY 1, 2)", 'arm, variable', 'level NULLS FIRST', 60, '')})
 WHERE level IS NOT NULL)""", "people", t1=_T1_SQL))
def redacted_table1(spark, sf):
    t = summary.redact_baseline(table1(spark, sf), 60).where("level <> ''")
    return t.select("arm", "variable", "level", (~F.col("redacted")).alias("shown"), "n")
