"""Model fits against independent small-scale computations."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortspark.operators import cox, design as dg, ipw, logistic as lg
from cohortspark.operators.design import Factor, Number, Powers, Product, Spline
from cohortspark.operators.intervals import split_follow_up
from cohortspark.operators.report import forest_data
from cohortspark.session import written

CUTS = [0, 3, 7, 15]


def newton_logit(x, y, w):
    b = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ b))
        b = b + np.linalg.solve(x.T @ (x * (w * p * (1 - p))[:, None]), x.T @ (w * (y - p)))
    return b


@pytest.fixture(scope="module")
def panel(spark):
    rng = np.random.default_rng(4)
    rows = []
    for pid in range(150):
        age, g = float(rng.integers(60, 90)), str(rng.choice(["a", "b", "c"]))
        for t in range(1, int(rng.integers(3, 9))):
            z = -2 + 0.03 * (age - 75) + (g == "b") * 0.8 - 0.1 * t + rng.normal()
            rows.append((pid, age, g, t, int(rng.random() < 1 / (1 + np.exp(-z))), float(rng.integers(0, 3))))
    return rows, spark.createDataFrame(rows, "patient_id long, age double, g string, t int, y int, w double").cache()


def test_logistic_and_robust_variance(panel):
    rows, df = panel
    df = df.withColumn("twice", F.col("t") * 2)
    fit = lg.fit_logistic(df, [Number("age"), Factor("g"), Number("t"), Number("twice")], "y", "w")
    assert fit.dropped == ("twice",) and fit.names == ["(Intercept)", "age", "gb", "gc", "t"]
    x = np.array([[1, r[1], r[2] == "b", r[2] == "c", r[3]] for r in rows], dtype=float)
    y, w = np.array([r[4] for r in rows]), np.array([r[5] for r in rows])
    b = newton_logit(x, y, w)
    assert np.allclose(fit.coef, b, atol=1e-5)
    p = 1 / (1 + np.exp(-x @ b))
    bread = np.linalg.inv(x.T @ (x * (w * p * (1 - p))[:, None]))
    u = x * (w * (y - p))[:, None]
    sums = np.array([u[[r[0] == i for r in rows]].sum(axis=0) for i in range(150)])
    fit = lg.robust_logistic(df, fit, "y", "patient_id", "w")
    assert np.allclose(fit.variance, bread @ sums.T @ sums @ bread, rtol=1e-4, atol=1e-9)
    got = [r[0] for r in fit.prepare(df).orderBy("patient_id", "t").select(fit.probability()).collect()]
    assert np.allclose(got, p, atol=1e-6)


def test_convergence_and_separation(spark, panel):
    rows, df = panel
    fit = lg.fit_logistic(df, [Number("age"), Factor("g")], "y")
    assert fit.converged and fit.iterations < 10 and not fit.diverging
    assert not lg.fit_logistic(df, [Number("age"), Factor("g")], "y", max_iter=1).converged
    # nobody with g = z has the event: its coefficient has no finite estimate, the others are as without these rows
    more = df.unionByName(df.limit(40).withColumns({"g": F.lit("z"), "y": F.lit(0)}))
    apart = lg.fit_logistic(more, [Factor("g")], "y")
    alone = lg.fit_logistic(df, [Factor("g")], "y")
    assert apart.diverging == ("gz",) and np.allclose(apart.coef[:3], alone.coef, atol=1e-5) and apart.coef[3] < -8


def test_equal_rows_count_with_their_weights(panel):
    """A row many times over, or once with that weight: the same fit, however large the weights are."""
    _, df = panel
    terms = [Factor("g"), Number("t")]
    one = lg.fit_logistic(df.withColumn("m", F.lit(100_000.0)), terms, "y", "m")
    assert np.allclose(one.coef, lg.fit_logistic(df, terms, "y").coef, atol=1e-8) and one.converged
    assert lg.patterns(df.unionByName(df), ["g", "t", "y"], F.lit(1.0)).agg(F.sum("_w")).first()[0] == 2 * df.count()


def test_coefficient_and_forest_tables(spark, panel):
    _, df = panel
    fit = lg.robust_logistic(df, lg.fit_logistic(df, [Number("age"), Factor("g")], "y"), "y", "patient_id")
    table = lg.coefficient_table(spark, fit, reference_rows=True)
    ref = table.where("reference_row").collect()
    assert [(r["term"], r["or"]) for r in ref] == [("ga", 1.0)]
    rows = {r["term"]: r for r in forest_data(table).collect()}
    assert rows["ga"]["row"] == 1 and rows["ga"]["text"] == "a (ref)" and rows["gb"]["row"] == 2
    assert {rows["age"]["shade"], rows["ga"]["shade"]} == {0, 1} and rows["gb"]["shade"] == 0


def test_spline_spans_natural_cubics(spark, panel):
    rows, df = panel
    d = dg.fit_design(df, [Spline("age", 4), Product(Spline("age", 4), Factor("g"))])
    assert len(d.entries) == 4 + 4 * 2
    ready = d.prepare(df).select("age", d.array().alias("x")).distinct().collect()
    knots = d.terms[0].knots
    ages = np.array([r["age"] for r in ready])
    assert knots[0] == min(ages) and knots[-1] == max(ages)
    assert np.allclose(knots, np.quantile([r[1] for r in rows], [0, 0.25, 0.5, 0.75, 1]))
    # linear beyond the outer knots
    far = spark.createDataFrame([(knots[-1] + i, "a") for i in range(4)], "age double, g string")
    basis = np.array([r[0][:4] for r in d.prepare(far).orderBy("age").select(d.array()).collect()])
    assert np.allclose(np.diff(basis, n=2, axis=0), 0, atol=1e-8)


def test_linear_predictor_matches_columns(panel):
    _, df = panel
    d = dg.fit_design(df, [Powers("age"), Factor("g"), Spline("t", 3), Product(Spline("t", 3), Factor("g"))])
    coef = list(np.linspace(-1, 1, len(d.names)))
    got = d.prepare(df).select(d.linear(coef).alias("a"), d.array().alias("x")).collect()
    assert np.allclose([r["a"] for r in got], [np.dot(r["x"], coef) for r in got])


def test_stabilised_weights(panel):
    rows, df = panel
    df = df.withColumn("risk", F.col("t") <= 4).withColumn("tstop", F.col("t"))
    vary, fixed = [Number("age"), Factor("g"), Number("t")], [Number("age"), Factor("g")]
    pair = ipw.treatment_models(df, "y", "risk", vary, fixed, "random_n", 100)
    out = ipw.with_stabilised_weight(df, pair, "y", "risk", "w1")
    out = ipw.add_weights(out, {"a": F.col("w1")}).withColumns({
        "p1": pair[0].probability(), "p0": pair[1].probability()}).collect()
    cum = {}
    for r in sorted(out, key=lambda r: (r["patient_id"], r["t"])):
        ratio = (r["p0"] / r["p1"] if r["y"] else (1 - r["p0"]) / (1 - r["p1"])) if r["risk"] else 1.0
        assert r["ipweight_a"] == pytest.approx(ratio)
        cum[r["patient_id"]] = cum.get(r["patient_id"], 1.0) * ratio
        assert r["cmlipweight"] == pytest.approx(cum[r["patient_id"]])


def efron_loglik(beta, rows):
    total = 0.0
    for period, stop in {(r[1], r[2]) for r in rows if r[3]}:
        risk = [r for r in rows if r[1] == period and r[2] >= stop]
        dead = [r for r in risk if r[2] == stop and r[3]]
        s = sum(np.exp(r[4] @ beta) for r in risk)
        e = sum(np.exp(r[4] @ beta) for r in dead)
        total += sum(r[4] @ beta for r in dead) - sum(np.log(s - k / len(dead) * e) for k in range(len(dead)))
    return total


def numeric(f, b, h=1e-4):
    p = len(b)
    eye = np.eye(p) * h
    g = np.array([(f(b + e) - f(b - e)) / (2 * h) for e in eye])
    hess = np.array([[(f(b + i + j) - f(b + i - j) - f(b - i + j) + f(b - i - j)) / (4 * h * h) for j in eye] for i in eye])
    return g, hess


@pytest.fixture(scope="module")
def pieces(spark):
    rng = np.random.default_rng(8)
    rows = []
    for i in range(160):
        tr, z = int(rng.integers(0, 2)), int(rng.integers(0, 2))
        t = int(min(15, 1 + rng.exponential(9 * np.exp(-0.5 * tr + 0.4 * z))))
        rows.append((i // 2, i % 2, tr, z, t, bool(t < 15 and rng.random() < 0.8)))
    df = spark.createDataFrame(rows, "patient_id long, k int, treated int, z int, tte_outcome int, ind_outcome boolean")
    return split_follow_up(df, "tte_outcome", "ind_outcome", CUTS).cache()


@pytest.mark.parametrize("ties", ["efron", "breslow"])
def test_cox_maximises_the_partial_likelihood(pieces, ties):
    fit = cox.cox_fit(pieces, [Number("z")], 3, ties=ties)
    rows = [(r["patient_id"], r["period_id"], r["tstop"], r["ind_outcome"],
             np.array([r["treated"] * (r["period_id"] == k) for k in (1, 2, 3)] + [r["z"]], dtype=float)) for r in pieces.collect()]
    if ties == "efron":
        f = lambda b: efron_loglik(b, rows)
    else:
        f = lambda b: sum(r[4] @ b - np.log(sum(np.exp(q[4] @ b) for q in rows if q[1] == r[1] and q[2] >= r[2])) for r in rows if r[3])
    g, hess = numeric(f, fit.coef)
    assert np.abs(g).max() < 1e-4 and f(fit.coef) == pytest.approx(fit.loglik, abs=1e-8)
    assert np.allclose(-hess, fit.information, rtol=1e-3, atol=1e-3)


def test_cox_robust_variance_from_case_weights(pieces):
    """Score residuals are the derivatives of the score in each row's weight; check them numerically."""
    fit = cox.cox_fit(pieces, [Number("z")], 3, ties="breslow")
    rows = [(r["patient_id"], r["period_id"], r["tstop"], r["ind_outcome"],
             np.array([r["treated"] * (r["period_id"] == k) for k in (1, 2, 3)] + [r["z"]], dtype=float)) for r in pieces.collect()]
    b = fit.coef
    u = {}
    for i, (pid, s, t, d, x) in enumerate(rows):
        score = np.zeros(4)
        for _, s2, t2, d2, _x in [q for q in rows if q[3] and q[1] == s and q[2] <= t]:
            risk = [q for q in rows if q[1] == s and q[2] >= t2]
            s0 = sum(np.exp(q[4] @ b) for q in risk)
            mean = sum(np.exp(q[4] @ b) * q[4] for q in risk) / s0
            score -= np.exp(x @ b) * (x - mean) / s0
        if d:
            risk = [q for q in rows if q[1] == s and q[2] >= t]
            s0 = sum(np.exp(q[4] @ b) for q in risk)
            score += x - sum(np.exp(q[4] @ b) * q[4] for q in risk) / s0
        u[pid] = u.get(pid, 0) + score
    m = np.array(list(u.values()))
    inv = np.linalg.inv(fit.information)
    assert np.allclose(fit.robust, inv @ m.T @ m @ inv, rtol=1e-6, atol=1e-10)


def test_cox_efron_residuals_add_up_to_the_score(pieces):
    fit = cox.cox_fit(pieces, [Number("z")], 3, cluster="k")
    assert fit.robust.shape == (4, 4) and np.all(np.diag(fit.robust) >= 0)
    plain = cox.cox_fit(pieces, [Number("z")], 3, cluster="patient_id")
    assert np.allclose(np.sqrt(np.diag(plain.robust)), np.sqrt(np.diag(plain.variance)), rtol=0.5)


def test_cox_table_leaves_empty_periods_blank(spark, pieces):
    fit = cox.cox_fit(pieces.where("period_id < 3"), [Number("z")], 3)
    out = cox.cox_contrasts(spark, fit, CUTS, brand="x").orderBy("period_id").collect()
    assert out[2]["coxhazr"] is None and out[0]["coxhr_ll"] < out[0]["coxhazr"] < out[0]["coxhr_ul"]
    assert out[1]["fup_period"] == "3-7" and out[1]["brand"] == "x"


def test_curves_are_looked_up_by_day_and_region(spark):
    from cohortspark.operators import ipw, logistic
    from cohortspark.operators.design import Factor, Number, Product, Spline

    rows = [(i, 1 + i * 7 % 40, "abc"[i % 3] if i % 11 else None, i % 2, int(i * 37 % 10 < 3)) for i in range(600)]
    days = spark.createDataFrame(rows, "patient_id long, tstop int, region string, flu int, vax int")
    terms = [Number("flu"), Spline("tstop", 3), Factor("region", ("a", "b", "c")), Product(Spline("tstop", 3), Factor("region", ("a", "b", "c")))]
    model = logistic.fit_logistic(days.where("region is not null"), terms, "vax")
    got = []
    for most in (0, 1000):
        ready, (p,) = ipw.with_curves(days, (model,), most)
        got.append({r[0]: r[1] for r in ready.select("patient_id", p.alias("p")).collect()})
        assert ("_curve0" in ready.columns) == (most > 0)
    assert len(got[0]) == 600 and got[0].keys() == got[1].keys()
    assert all(abs(got[0][i] - got[1][i]) < 1e-12 for i in got[0])


def test_numeric_summary_counts_values_once(spark, monkeypatch):
    from cohortspark.operators import ranking, summary

    made = []
    count = ranking.value_counts_long
    for module in (ranking, summary):
        monkeypatch.setattr(module, "value_counts_long", lambda *a, **k: made.append(1) or count(*a, **k))
    df = spark.createDataFrame([(1.0, 5), (1.0, None), (4.0, 7), (None, 7)], "a double, b int")
    rows = {r["variable"]: r for r in summary.numeric_summary(df, ["a", "b"]).collect()}
    assert made == [1]
    a = rows["a"]
    assert (a["n"], a["n_nonmiss"], a["n_miss"], a["unique"], a["min"], a["max"], a["p50"]) == (4, 3, 1, 2, 1.0, 4.0, 1.0)
    assert abs(a["mean"] - 2) < 1e-12 and abs(a["sd"] - 3 ** 0.5) < 1e-12


def test_fits_on_counted_rows_are_those_on_the_rows(spark):
    """Knots, coefficients and clustered variance come out alike; the counted days are read instead of the days."""
    rng = random.Random(5)
    data = [(p, d, rng.choice("abc"), int(rng.random() < 0.1 + 0.01 * d), p % 4 != 0) for p in range(60) for d in range(1, rng.randint(4, 25))]
    days = spark.createDataFrame(data, "patient_id long, t int, g string, y int, risk boolean")
    spline = Spline("t", 3)
    vary, fixed = [spline, Factor("g", ("a", "b", "c"))], [spline]
    kinds = lg.counted(days, ["g", "risk", "t", "y"], "_rows")
    plain = ipw.treatment_models(days, "y", "risk", vary, fixed, "random_n", None, robust=True)
    counted = ipw.treatment_models(days.select("*"), "y", "risk", vary, fixed, "random_n", None, robust=True, kinds=kinds, rows="_rows")
    for a, b in zip(plain, counted):
        assert a.design.terms == b.design.terms and np.allclose(a.coef, b.coef, atol=1e-9)
    assert np.allclose(plain[0].variance, counted[0].variance)
    no_days = days.where("risk is null")
    again = ipw.treatment_models(no_days, "y", "risk", vary, fixed, "random_n", None, kinds=kinds, rows="_rows")
    assert np.allclose(again[0].coef, plain[0].coef, atol=1e-9)


def test_written_rows_come_back_whole(spark):
    df = spark.createDataFrame([(1, None, [1, 2], True), (2, "x", None, None)], "a int, b string, c array<int>, d boolean")
    back = written(df)
    assert back.dtypes == df.dtypes and sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, df.collect()), key=str)
    assert back._jdf.queryExecution().executedPlan().toString().count("parquet")


def test_weights_are_added_up_in_tasks_of_few_people(spark):
    """Adaptive execution would merge these small rows into one or two tasks."""
    days = spark.createDataFrame([(p, d) for p in range(200) for d in range(1, 4)], "patient_id long, tstop int").repartition(1)
    out = ipw.add_weights(days, {"a": 1 + F.col("tstop") / 10}, tasks=13)
    assert out.rdd.getNumPartitions() == 13
    assert {(r["tstop"], round(r["cmlipweight"], 9)) for r in out.collect()} == {(1, 1.1), (2, 1.32), (3, 1.716)}


def test_weights_of_two_brands_are_compiled(spark, tmp_path):
    """The JVM interprets methods of over 8000 bytes, ten times as slowly; two brands' weights in one pass came to 8388."""
    from cohortspark.operators import ipw
    from cohortspark.operators.design import Factor, Number, Powers, Product, Spline, fit_design

    regions, bands = ("a", "b", "c", "d", "e"), ("none", "in", "1-21", "22-28")
    rows = [(i, 1 + i % 50, 60 + i % 30, "FM"[i % 2], regions[i % 5], i % 2, i % 3, i % 4, bands[i % 4], bands[i % 3], i % 2, i % 5 // 4, True, i % 7 > 0)
            for i in range(300)]
    names = "patient_id long, tstop int, age int, sex string, region string, flu int, dia int, chd int, h1 string, h2 string, v1 int, v2 int, r1 boolean, r2 boolean"
    spark.createDataFrame(rows, names).write.parquet(str(tmp_path / "days"))
    days = spark.read.parquet(str(tmp_path / "days"))
    region, time = Factor("region", regions), Spline("tstop", 3, (1.0, 17.0, 33.0, 50.0))
    fixed = [Powers("age", 2), Factor("sex", ("F", "M")), Number("flu"), Number("dia"), Number("chd"), time, region, Product(time, region)]
    varying = [*fixed, Factor("h1", bands), Factor("h2", bands)]

    def fit(terms, shift):
        design = fit_design(days, terms)
        return lg.LogisticFit(design, (-1.0, *[(shift + j) % 7 / 1000 for j in range(len(design.names))]), ())

    pairs = [(fit(varying, 1), fit(fixed, 2)), (fit(varying, 3), fit(fixed, 5))]
    out = ipw.with_stabilised_weights(days, {"w1": (pairs[0], "v1", "r1"), "w2": (pairs[1], "v2", "r2")}, days.select("tstop", "region"))
    plain = pairs[1][0].prepare(days).select("patient_id", "v2", "r2", pairs[1][0].probability().alias("p"), pairs[1][1].probability().alias("q"))
    want = {r[0]: ((r["q"] / r["p"] if r["v2"] else (1 - r["q"]) / (1 - r["p"])) if r["r2"] else 1.0) for r in plain.collect()}
    got = {r[0]: r[1] for r in out.select("patient_id", "w2").collect()}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-9 for i in got)
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        made = out.select("*")._jdf.queryExecution().debug().codegenToSeq()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    assert max(made.apply(i)._3().maxMethodCodeSize() for i in range(made.length())) < 8000


def test_outcome_model_from_counted_rows(spark):
    rows = [(i % 40, "abc"[i % 3], i % 5, int(i * 37 % 10 < 3 + i % 3), [0.5, 2.0, None, 0.0, 1.25][i * 7 % 5]) for i in range(900)]
    df = spark.createDataFrame(rows, "patient_id long, g string, t int, y int, w double")
    terms = [Factor("g"), Number("t")]
    plain = lg.robust_logistic(df, lg.fit_logistic(df, terms, "y", "w"), "y", "patient_id", "w")
    kinds = lg.counted(df, ["g", "t", "y"], "_rows", "w")
    assert kinds.agg({"_rows": "sum"}).first()[0] == 900 and kinds.count() < 60
    one = lg.fit_logistic(kinds, terms, "y", "w", rows="_rows", summed=True)
    one = lg.robust_logistic(df, one, "y", "patient_id", "w", kinds=kinds, rows="_rows", summed=True)
    assert np.allclose(one.coef, plain.coef, atol=1e-9) and np.allclose(one.variance, plain.variance, atol=1e-9)
