"""Intervals and person-days against a plain day-by-day computation; survival by hand."""

import random

import pytest
from pyspark.sql import functions as F

from cohortspark.operators import intervals as iv, survival as sv


def test_intervals_and_days_equal_day_loop(spark):
    rnd = random.Random(11)
    people, moves = [], []
    for p in range(60):
        stop = rnd.randint(1, 30)
        onset = rnd.choice([None, *range(-3, 34)])
        event = rnd.choice([None, *range(1, 34)])
        people.append((p, stop, onset, event))
        for k in range(rnd.randint(0, 6)):
            moves.append((p, rnd.randint(-5, 35), rnd.randint(0, 1), k))
    base = spark.createDataFrame(people, "patient_id long, stop int, onset int, ev int")
    ch = spark.createDataFrame(moves, "patient_id long, t int, v int, k int").join(base.select("patient_id", "stop"), "patient_id")
    arrays = iv.status_changes(ch, "t", "v", ["k"], "stop", "hosp_changes")
    out = iv.to_intervals(base.join(arrays, "patient_id", "left"), "stop", {"treated": "onset"}, {"hit": "ev"}, ["hosp_changes"], ["patient_id", "onset"])
    spans = out.collect()
    for p, stop, onset, _ in people:
        mine = sorted((r["tstart"], r["tstop"]) for r in spans if r["patient_id"] == p)
        assert mine[0][0] == 0 and mine[-1][1] == stop and all(a[1] == b[0] for a, b in zip(mine, mine[1:]))
    days = iv.person_days(out, ["hit"]).withColumn("since", iv.days_since(F.col("onset"), F.col("tstop")))
    got = {(r["patient_id"], r["tstop"]): (r["treated"], r["hit"], r["hosp"], r["since"]) for r in days.collect()}
    want = {}
    for p, stop, onset, ev in people:
        run = 0
        for d in range(1, stop + 1):
            tr = int(onset is not None and onset <= d - 1)
            run += tr
            past = [(t, k, v) for q, t, v, k in moves if q == p and t <= d - 1]
            want[(p, d)] = (tr, int(ev == d), max(past)[2] if past else 0, run)
    assert got == want


def test_time_since_discharge(spark):
    df = spark.createDataFrame([(0, None, 5), (1, 3, 5), (0, 3, 3), (0, 3, 4), (0, 3, 24), (0, 3, 25), (0, 3, 31), (0, 3, 32)], "s int, o int, d int")
    got = [r[0] for r in df.select(iv.time_since_discharge(F.col("s"), F.col("o"), F.col("d"))).collect()]
    assert got == ["Not in hospital", "In hospital", "Not in hospital", "1-21", "1-21", "22-28", "22-28", "Not in hospital"]


def test_split_follow_up(spark):
    df = spark.createDataFrame([(1, 5, True), (2, 3, True), (3, 10, False)], "id int, tte int, ind boolean")
    got = sorted((r["id"], r["period_id"], r["tstart"], r["tstop"], r["ind"]) for r in iv.split_follow_up(df, "tte", "ind", [0, 3, 10]).collect())
    assert got == [(1, 1, 0, 3, 0), (1, 2, 3, 5, 1), (2, 1, 0, 3, 1), (3, 1, 0, 3, 0), (3, 2, 3, 10, 0)]


def test_null_safe_spells_and_checks(spark):
    s = spark.createDataFrame([(1, 1, None), (1, 2, 3), (2, 1, None)], "patient_id long, admitted_date int, discharged_date int")
    assert sorted(tuple(r) for r in iv.without_spells(s, s.where("patient_id = 1 and admitted_date = 1")).collect()) == [(1, 2, 3), (2, 1, None)]
    assert iv.check(s, F.col("admitted_date") < 0, "negative").count() == 3
    with pytest.raises(ValueError, match="two"):
        iv.check(s, F.col("admitted_date") == 2, "two")


def test_kaplan_meier_by_hand(spark):
    df = spark.createDataFrame([(1, True), (2, False), (2, True), (4, True), (4, False)], "tte_outcome int, ind_outcome boolean")
    df = df.withColumn("arm", F.lit(1))
    counts = sv.km_counts(df, ["arm"], 5)
    km = {r["time"]: r for r in sv.km_estimates(counts, ["arm"]).collect()}
    assert [km[t]["n_risk"] for t in range(1, 6)] == [5, 4, 2, 2, 0]
    assert km[1]["surv"] == pytest.approx(0.8) and km[2]["surv"] == pytest.approx(0.6)
    assert km[4]["surv"] == pytest.approx(0.3) and km[5]["surv"] is None
    assert km[2]["surv_se"] == pytest.approx(0.6 * (1 / 4 - 1 / 5 + 1 / 3 - 1 / 4) ** 0.5)
    assert km[4]["surv_ll"] < 0.3 < km[4]["surv_ul"]
    rounded = {r["time"]: r for r in sv.km_estimates(counts, ["arm"], 3).collect()}
    assert [rounded[t]["cml_event"] for t in range(1, 6)] == [2, 2, 2, 2, 2]
    assert rounded[1]["n_risk"] == 5 and rounded[1]["n_event"] == 2


def test_contrasts_drop_periods_nobody_enters(spark):
    df = spark.createDataFrame([(1, 2, True), (1, 3, False), (0, 2, False), (0, 5, True)], "treated int, tte_outcome int, ind_outcome boolean")
    km = sv.km_estimates(sv.km_counts(df, ["treated"], 6), ["treated"])
    out = {r["period_start"]: r for r in sv.period_contrasts(km, [], [0, 3, 6]).collect()}
    assert out[0]["n_atrisk_1"] == 2 and out[0]["persontime_1"] == 5 and out[0]["n_event_1"] == 1
    assert out[3]["surv_1"] is None and out[3]["n_event_0"] == 1
    daily = sv.period_contrasts(km, []).count()
    assert daily == 6


def test_person_tables_have_tasks_by_their_size(spark):
    from cohortspark.session import by_person

    people = spark.range(1000).select(F.col("id").alias("patient_id"))
    assert by_person(people).rdd.getNumPartitions() == people.rdd.getNumPartitions()
    dealt = by_person(people, per_task=100)
    counts = dealt.groupBy("patient_id").count()
    assert dealt.rdd.getNumPartitions() == 10 and counts.rdd.getNumPartitions() == 10
    assert counts.where("count = 1").count() == 1000
