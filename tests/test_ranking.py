"""Bucketed ranks and quantiles equal the plain definitions, also when one group holds most rows."""

import random

import numpy as np
import pytest

from cohortspark.operators import ranking, sampling


@pytest.fixture(scope="module")
def skewed(spark):
    rnd = random.Random(3)
    ids = rnd.sample(range(1, 10**7), 3000)
    rows = [("hot" if rnd.random() < 0.7 else rnd.choice("abc"), i, rnd.choice([None, *range(40)]), rnd.gauss(0, 5)) for i in ids]
    return rows, spark.createDataFrame(rows, "g string, id long, v int, x double").cache()


@pytest.mark.parametrize("size", [10**6, 150])
def test_row_numbers(skewed, size):
    rows, df = skewed
    got = {(r["g"], r["id"]): r["rank"] for r in ranking.row_numbers(df, ["g"], "id", rows_per_bucket=size).collect()}
    want = {}
    for g in {r[0] for r in rows}:
        for k, i in enumerate(sorted(r[1] for r in rows if r[0] == g)):
            want[(g, i)] = k + 1
    assert got == want


@pytest.mark.parametrize("size", [10**6, 20])
@pytest.mark.parametrize("kind,method", [(1, "inverted_cdf"), (2, "averaged_inverted_cdf"), (7, "linear")])
def test_quantiles(skewed, size, kind, method):
    rows, df = skewed
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 1.0]
    got = ranking.quantiles(df, ["v", "x"], probs, ["g"], kind, rows_per_bucket=size).collect()
    assert len(got) == 4 * 2 * len(probs)
    for r in got:
        col = 2 if r["variable"] == "v" else 3
        vals = [t[col] for t in rows if t[0] == r["g"] and t[col] is not None]
        assert r["quantile"] == pytest.approx(np.quantile(vals, r["prob"], method=method), abs=1e-9), r


def test_kth_smallest(skewed):
    rows, df = skewed
    ids = sorted(r[1] for r in rows)
    for k in (1, 2, 777, 2999, 3000, 5000):
        assert ranking.kth_smallest(df, "id", k, fanout=16) == ids[min(k, 3000) - 1]
    assert ranking.kth_smallest(df, "id", 0) is None
    assert ranking.kth_smallest(df.limit(0), "id", 3) is None


def test_sampling_without_any_outcome(spark):
    df = spark.createDataFrame([(i, False) for i in (5, 3, 9, 7, 1)], "patient_id long, had boolean")
    keep = lambda d: sorted(r[0] for r in d.where("sampled").collect())
    assert keep(sampling.sample_nonoutcomes_n(df, 2, "had")) == [1, 3]
    assert keep(sampling.sample_nonoutcomes_prop(df, 0.2, "had")) == [1, 3]
    assert keep(sampling.sample_random_prop(df, 0.5)) == [1, 3, 5]
    assert keep(sampling.sample_random_n(df, 0)) == []


def test_sample_weights(spark):
    df = spark.createDataFrame([(1, True), (2, False), (3, False), (4, False)], "patient_id long, had boolean")
    out = sampling.sample_weights(sampling.sample_nonoutcomes_n(df, 2, "had"), "had").orderBy("patient_id").collect()
    assert [r["sample_weight"] for r in out] == [1.0, 1.5, 1.5, 0.0]


def test_buckets_of_all_variables_take_one_pass(spark, monkeypatch):
    rows = [(i, float(i * 7919 % 1009), float(i % 13), 5.0 if i % 4 else None) for i in range(1000)]
    df = spark.createDataFrame(rows, "i int, a double, b double, c double")
    monkeypatch.setattr(type(df), "unionByName", lambda *a, **k: (_ for _ in ()).throw(AssertionError("a pass for each variable")))
    probs = (0.0, 0.1, 0.5, 0.9, 1.0)
    got = {(r["variable"], r["prob"]): r["quantile"] for r in ranking.quantiles(df, ["a", "b", "c"], probs, rows_per_bucket=20).collect()}
    for j, c in enumerate("abc", 1):
        values = sorted(r[j] for r in rows if r[j] is not None)
        for p in probs:
            assert got[c, p] == values[max(-(-round(len(values) * p * 10) // 10), 1) - 1]
