"""The block-wise match equals a plain greedy loop for every block size."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from cohortspark.operators import matching

START = dt.date(2020, 1, 1)


def brute(treated, controls, width):
    used, out = set(), []
    for tid, g, age, day in sorted(treated, key=lambda t: (t[3], t[0])):
        fit = [c for c in controls if c[1] == g and abs(c[2] - age) <= width and (c[3] is None or c[3] > day) and c[0] not in used]
        if fit:
            best = min(fit)
            used.add(best[0])
            out.append((tid, best[0], START + dt.timedelta(day)))
    return sorted(out)


def population(seed, n_t, n_c, hot, days=12):
    rnd = random.Random(seed)
    ids = rnd.sample(range(1, 100000), n_t + n_c)
    group = lambda: "hot" if rnd.random() < hot else rnd.choice(["a", "b", None])
    treated = [(i, group(), rnd.randint(70, 80), rnd.randint(0, days)) for i in ids[:n_t]]
    controls = [(i, group(), rnd.randint(68, 84), rnd.choice([None, rnd.randint(0, days + 3)])) for i in ids[n_t:]]
    # people treated later may serve as controls before
    controls += [t for t in treated if rnd.random() < 0.7]
    return treated, controls


def frames(spark, treated, controls):
    day = lambda d: None if d is None else START + dt.timedelta(d)
    t = spark.createDataFrame([(i, g, a, day(d)) for i, g, a, d in treated], "patient_id long, g string, age int, trial_date date")
    c = spark.createDataFrame([(i, g, a, day(d)) for i, g, a, d in controls], "patient_id long, g string, age int, treated_date date")
    return t, c


@pytest.mark.parametrize("seed,n_t,n_c,hot,size", [(1, 60, 50, 0.3, 10**6), (2, 150, 90, 0.8, 40), (3, 120, 400, 0.9, 25)])
def test_blocks_equal_greedy_loop(spark, seed, n_t, n_c, hot, size):
    treated, controls = population(seed, n_t, n_c, hot)
    known = [t for t in treated if t[1]], [c for c in controls if c[1]]
    pairs = matching.sequential_match(*frames(spark, treated, controls), ["g"], {"age": 3}, block_rows=size)
    got = sorted((r["treated_id"], r["control_id"], r["trial_date"]) for r in pairs.collect())
    assert got == brute(*known, 3)


def test_one_crowded_day_is_cut_by_id(spark):
    treated, controls = population(5, 120, 130, 1.0, days=0)
    pairs = matching.sequential_match(*frames(spark, treated, controls), ["g"], {"age": 2}, block_rows=30)
    got = sorted((r["treated_id"], r["control_id"], r["trial_date"]) for r in pairs.collect())
    assert got == brute(treated, controls, 2)


def test_exact_only_rank_match_equals_greedy_loop(spark):
    treated, controls = population(7, 90, 70, 0.6)
    pool = [c for c in controls if c[3] is None and c[1]]
    t, c = frames(spark, treated, pool)
    want = brute([x for x in treated if x[1]], pool, 1000)
    for size in (10**6, 15):
        pairs = matching.exact_rank_match(t, c, ["g"], rows_per_bucket=size)
        assert sorted((r["treated_id"], r["control_id"], r["trial_date"]) for r in pairs.collect()) == want
    pairs = matching.sequential_match(t, c, ["g"], {})
    assert sorted((r["treated_id"], r["control_id"], r["trial_date"]) for r in pairs.collect()) == want


def test_both_sides_from_one_table(spark):
    treated, controls = population(9, 40, 60, 0.5)
    people = {p[0]: p for p in treated + controls if p[1]}
    role = {p[0] for p in treated if p[1]}
    t, _ = frames(spark, list(people.values()), list(people.values()))
    t = t.withColumn("treated_date", F.when(F.col("patient_id").isin(*role), F.col("trial_date")))
    got = matching.sequential_match(t.where("treated_date is not null"), t, ["g"], {"age": 3}, block_rows=20)
    want = brute([p for p in people.values() if p[0] in role],
                 [(p[0], p[1], p[2], p[3] if p[0] in role else None) for p in people.values()], 3)
    assert sorted((r["treated_id"], r["control_id"], r["trial_date"]) for r in got.collect()) == want


def test_caliper_must_be_whole(spark):
    t, c = frames(spark, [(1, "a", 70, 0)], [(2, "a", 70, None)])
    with pytest.raises(ValueError):
        matching.sequential_match(t, c.withColumn("age", F.col("age") + 0.5), ["g"], {"age": 3})


def test_nobody_treated(spark):
    t, c = frames(spark, [(1, "a", 70, 0)], [(2, "a", 70, None)])
    assert matching.sequential_match(t.where("false"), c, ["g"], {"age": 3}).count() == 0


def test_pair_bookkeeping(spark):
    t, c = frames(spark, [(1, "a", 70, 0), (4, "a", 71, 0), (5, "a", 90, 1)], [(2, "a", 70, 5), (3, "a", 72, None)])
    pairs = matching.number_pairs(matching.sequential_match(t, c, ["g"], {"age": 3}))
    status = matching.match_status(t, pairs, START)
    rows = {(r["patient_id"], r["treated"]): r for r in status.collect()}
    assert rows[(1, 1)]["match_id"] == 1 and rows[(4, 1)]["match_id"] == 2 and rows[(5, 1)]["matched"] == 0
    assert rows[(5, 1)]["control"] is None and rows[(1, 1)]["control"] == 0
    # both members carry the date on which the control is treated
    assert rows[(1, 1)]["controlistreated_date"] == rows[(2, 0)]["controlistreated_date"] == START + dt.timedelta(5)
    assert [r["n_duplicated"] for r in matching.duplicated_members(matching.pair_members(pairs)).collect()] == [0, 0]
    kept = matching.success_share(matching.pair_members(pairs), matching.pair_members(pairs.where("match_id = 1"))).first()
    assert (kept["kept"], kept["proposed"], kept["pct"]) == (1, 2, 50.0)


def test_pack():
    assert matching.pack([(1, 3), (2, 4), (3, 9), (4, 1)], 8) == [(1, 2), (3, 3), (4, 4)]


FIRST = dt.date(1997, 1, 1)
PEOPLE = ("patient_id long, age int, sex string, region string, ethnicity_combined string, imd_quintile string, ageband2 string, hscworker boolean,"
          "care_home boolean, housebound boolean, endoflife boolean, has_follow_up_previous_year boolean, vax1_date date, vax1_type string, vax2_date date")


def study_population(seed, n):
    """People, dated events and hospital stays of the first weeks; every criterion fails for some."""
    rnd = random.Random(seed)
    day = lambda lo, hi: FIRST + dt.timedelta(rnd.randint(lo, hi))
    people, events, spells = [], [], []
    for i in range(1, n + 1):
        odd = lambda p=0.04: rnd.random() < p
        vax = day(-3, 40) if rnd.random() < 0.45 else None
        people.append((
            i, rnd.randint(78, 84), None if odd() else rnd.choice("FM"), "north", None if odd() else "White", "Unknown" if odd() else "2", "80+", odd(), odd(),
            odd(), odd(), not odd(), vax, None if vax is None else rnd.choice(["pfizer", "pfizer", "az"]), None))
        for kind, p in (("postest", 0.25), ("death", 0.08), ("dereg", 0.05)):
            if rnd.random() < p:
                events.append((i, day(-20, 45), len(events), 1.0, kind))
        if rnd.random() < 0.35:
            start = day(-15, 40)
            spells.append((i, len(spells), start, None if odd(0.2) else start + dt.timedelta(rnd.randint(0, 12)), False))
    return people, events, spells


def plain_rounds(people, events, spells, treated_ids, n_rounds, gap, width):
    """(round, treated id, control id, trial date, kept) of every proposed pair, person by person."""
    by_id = {p[0]: dict(zip([c.split()[0] for c in PEOPLE.split(",")], p)) for p in people}

    def fit(i, on):
        p = by_id[i]
        kinds = {k for j, d, _, _, k in events if j == i and d < on}
        stays = sorted(((a, z or dt.date.max) for j, _, a, z, _ in spells if j == i and a < on), reverse=True)
        return not (
            kinds & {"postest", "death", "dereg"} or p["vax1_date"] and p["vax1_date"] <= on or p["hscworker"] or p["care_home"] or p["housebound"]
            or p["endoflife"] or not p["has_follow_up_previous_year"] or p["sex"] is None or p["ethnicity_combined"] is None
            or p["imd_quintile"] == "Unknown" or stays and stays[0][1] >= on)

    out, done, ever = [], set(), set(by_id)
    for r in range(1, n_rounds + 1):
        ever = {i for i in ever if fit(i, FIRST + dt.timedelta((r - 1) * gap))}
        used = set()
        for t in sorted((i for i in treated_ids if (i, 1) not in done), key=lambda i: (by_id[i]["vax1_date"], i)):
            a = by_id[t]
            free = [c for c in ever - used if (c, 0) not in done and by_id[c]["sex"] == a["sex"] and abs(by_id[c]["age"] - a["age"]) <= width
                    and (by_id[c]["vax1_date"] is None or by_id[c]["vax1_date"] > a["vax1_date"])]
            if free:
                used.add(min(free))
                out.append((r, t, min(free), a["vax1_date"], fit(min(free), a["vax1_date"])))
        done |= {x for q, t, c, _, ok in out if q == r and ok for x in ((t, 1), (c, 0))}
    return sorted(out)


@pytest.mark.parametrize("seed", [1])
def test_rounds_like_a_plain_loop(spark, seed):
    """Rounds take eligible controls only, re-check them on the trial date, and later rounds find further pairs."""
    from dataclasses import replace

    from cohortspark.config import StudyConfig
    from cohortspark.plans import cohorts, sequential_trial as seq

    cfg = replace(StudyConfig(), n_rounds=3, round_gap=9)
    people, events, spells = study_population(seed, 160)
    who = spark.createDataFrame(people, PEOPLE)
    happened = spark.createDataFrame(events, "patient_id long, date date, event_id long, value double, kind string")
    stays = spark.createDataFrame(spells, "patient_id long, event_id long, admitted_date date, discharged_date date, infectious boolean")
    mine = cohorts.treated_cohort(who, happened, stays, cfg).where("include and vax1_type = 'pfizer'")
    ids = [r.patient_id for r in mine.collect()]
    want = plain_rounds(people, events, spells, ids, 3, 9, 3)
    rounds = seq.run_rounds(mine, who, happened, stays, cfg, "pfizer")
    got = []
    for r in rounds:
        kept = {(x.trial_date, x.match_id) for x in r.kept.collect()}
        pairs = {}
        for x in r.proposed.collect():
            pairs.setdefault((x.trial_date, x.match_id), {})[x.treated] = x.patient_id
        got += [(r.number, p[1], p[0], key[0], key in kept) for key, p in pairs.items()]
    assert sorted(got) == want
    assert any(r > 1 and ok for r, *_, ok in want) and not all(ok for *_, ok in want)  # round 2 finds pairs, some fail
    success = {x.matching_round: (x.proposed, x.kept) for x in seq.round_success(rounds).collect()}
    assert success == {k: (sum(r == k for r, *_ in want), sum(r == k and ok for r, *_, ok in want)) for k in (1, 2, 3)}


def test_criteria_at_several_dates_of_a_person(spark):
    from cohortspark.config import StudyConfig
    from cohortspark.plans import cohorts

    people, events, spells = study_population(5, 40)
    anchors = [(i, FIRST + dt.timedelta(d), d) for i in range(1, 41) for d in (0, 9, 18) if i != 7] + [(99, FIRST, 0)]
    out = cohorts.controls_as_of(
        spark.createDataFrame(people, PEOPLE), spark.createDataFrame(events, "patient_id long, date date, event_id long, value double, kind string"),
        spark.createDataFrame(spells, "patient_id long, event_id long, admitted_date date, discharged_date date, infectious boolean"),
        spark.createDataFrame(anchors, "patient_id long, anchor_date date, k int"), StudyConfig()).where("include").collect()
    got = {(r.patient_id, r.k) for r in out}
    assert len(got) == len(out) and not any(i in (7, 99) for i, _ in got)
    for k in (0, 9, 18):  # the same people as with one date for everybody
        one = cohorts.controls_as_of(
            spark.createDataFrame(people, PEOPLE), spark.createDataFrame(events, "patient_id long, date date, event_id long, value double, kind string"),
            spark.createDataFrame(spells, "patient_id long, event_id long, admitted_date date, discharged_date date, infectious boolean"),
            spark.createDataFrame([a for a in anchors if a[2] == k], "patient_id long, anchor_date date, k int"), StudyConfig())
        assert {r.patient_id for r in one.where("include").collect()} == {i for i, x in got if x == k}
