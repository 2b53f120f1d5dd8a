"""Predicate joins in every mode and on both paths; lookups on hand-made cases."""

import datetime as dt
import operator
import random

import pytest
from pyspark.sql import functions as F

from cohortspark.operators import joins, lookup as lk
from cohortspark.operators.lookup import Find

D = dt.date


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("small_side", [50_000, 3])
def test_predicate_join_modes(spark, small_side):
    xs = [(i, v) for i, v in enumerate([1, 1, 4, 9, None, 20])]
    ys = [(i, v) for i, v in enumerate([0, 3, 3, 8, 50, None, 7])]
    x, y = spark.createDataFrame(xs, "id int, v int"), spark.createDataFrame(ys, "id int, w int")
    ok = lambda a, b: a is not None and b is not None and abs(a - b) <= 1
    hits = [(i, v, j, w) for i, v in xs for j, w in ys if ok(v, w)]
    join = lambda how: joins.predicate_join(x, y, {"v": "w"}, lambda a, b: F.abs(a - b) <= 1, how, small_side=small_side)
    lone_x = [(i, v, None, None) for i, v in xs if not any(ok(v, w) for _, w in ys)]
    lone_y = [(None, None, j, w) for j, w in ys if not any(ok(v, w) for _, v in xs)]
    key = lambda t: sorted(t, key=str)
    assert join("inner").columns == ["id_x", "v", "id_y", "w"]
    assert rows(join("inner")) == key(hits)
    assert rows(join("left")) == key(hits + lone_x)
    assert rows(join("right")) == key(hits + lone_y)
    assert rows(join("full")) == key(hits + lone_x + lone_y)
    assert rows(join("semi")) == key([(i, v) for i, v in xs if any(ok(v, w) for _, w in ys)])
    assert rows(join("anti")) == key([(i, v) for i, v in xs if not any(ok(v, w) for _, w in ys)])


def test_predicate_join_several_columns(spark):
    x = spark.createDataFrame([(1, "abc"), (2, "abd"), (9, "zzz")], "n int, s string")
    y = spark.createDataFrame([(1, "ab"), (2, "bd")], "m int, t string")
    out = joins.predicate_join(x, y, {"n": "m", "s": "t"}, [lambda a, b: a >= b, lambda a, b: a.contains(b)])
    assert rows(out) == [(1, "abc", 1, "ab"), (2, "abd", 1, "ab"), (2, "abd", 2, "bd")]
    with pytest.raises(ValueError):
        joins.predicate_join(x, y, {"n": "m", "s": "t"}, [lambda a, b: a >= b])


MODES = ("inner", "left", "right", "full", "semi", "anti")


def plain_join(xs, ys, ok, how):
    hits = [(*a, *b) for a in xs for b in ys if ok(a, b)]
    lone_x = [(*a, *[None] * len(ys[0])) for a in xs if not any(ok(a, b) for b in ys)]
    lone_y = [(*[None] * len(xs[0]), *b) for b in ys if not any(ok(a, b) for a in xs)]
    out = {"inner": hits, "left": hits + lone_x, "right": hits + lone_y, "full": hits + lone_x + lone_y,
           "semi": [a for a in xs if any(ok(a, b) for b in ys)], "anti": [a for a in xs if not any(ok(a, b) for b in ys)]}[how]
    return sorted(out, key=str)


def no_pairwise_plan(df):
    plan = df._jdf.queryExecution().toString()
    return "NestedLoop" not in plan and "Cartesian" not in plan


@pytest.mark.parametrize("lo, hi, closed", [(-1.5, 1.5, "both"), (0.0, 0.0, "both"), (-3.0, -0.5, "left"), (2.0, 1.0, "both"), (0.1, 0.3, "right"), (-1.0, 1.0, "neither")])
def test_band_join(spark, lo, hi, closed):
    rng = random.Random(1)
    xs = [(i, rng.choice([None, float("nan"), float("inf"), 1e15, 0.1 * rng.randint(-60, 60)])) for i in range(60)] + [(60, 0.3), (61, 0.3)]
    ys = [(i, rng.choice([None, -float("inf"), 1e15, 0.1 * rng.randint(-60, 60), float(rng.randint(-5, 5))])) for i in range(50)]
    x, y = spark.createDataFrame(xs, "id int, v double"), spark.createDataFrame(ys, "id int, w double")
    low = {"both": "le", "left": "le", "right": "lt", "neither": "lt"}[closed]
    high = {"both": "le", "right": "le", "left": "lt", "neither": "lt"}[closed]

    def ok(a, b):
        v, w = a[1], b[1]
        return v is not None and w is not None and abs(v) < 1e300 and abs(w) < 1e300 and getattr(operator, low)(lo, v - w) and getattr(operator, high)(v - w, hi)

    for how in MODES if lo == -1.5 else ("full",):
        out = joins.predicate_join(x, y, {"v": "w"}, joins.Band(lo, hi, closed), how)
        assert str(rows(out)) == str(plain_join(xs, ys, ok, how))  # as text, for not-a-number
        assert no_pairwise_plan(out)


@pytest.mark.parametrize("closed", ["both", "right"])
def test_between_join_with_intervals_of_any_length(spark, closed):
    """Lengths from nothing to a billion, empty and missing ends, one crowded region."""
    rng = random.Random(2)
    xs = [(i, rng.choice([None, rng.randint(0, 40), rng.randint(0, 10**9), 7])) for i in range(120)]
    ys = []
    for i in range(80):
        a = rng.choice([None, rng.randint(0, 40), rng.randint(0, 10**9)])
        ys.append((i, a, None if a is None or i % 11 == 0 else a + rng.choice([-1, 0, 1, 5, 1000, 10**9])))
    x, y = spark.createDataFrame(xs, "id int, v long"), spark.createDataFrame(ys, "id int, lo long, hi long")
    ok = lambda a, b: None not in (a[1], b[1], b[2]) and (b[1] <= a[1] if closed == "both" else b[1] < a[1]) and a[1] <= b[2]
    for how in MODES if closed == "both" else ("full",):
        out = joins.predicate_join(x, y, {"v": ("lo", "hi")}, joins.Between(closed), how)
        assert rows(out) == plain_join(xs, ys, ok, how)
        assert no_pairwise_plan(out)
    none = joins.predicate_join(x, y.where("id < 0"), {"v": ("lo", "hi")}, joins.Between(closed), "left")
    assert rows(none) == sorted([(*a, None, None, None) for a in xs], key=str)


def test_band_with_further_predicates_and_dates(spark):
    xs = [(i, "ab"[i % 2], D(2020, 1, 1 + i)) for i in range(20)]
    ys = [(i, "abc"[i % 3], D(2020, 1, 1 + 2 * i)) for i in range(10)]
    x, y = spark.createDataFrame(xs, "id int, g string, d date"), spark.createDataFrame(ys, "id int, h string, e date")
    out = joins.predicate_join(x, y, {"g": "h", "d": "e"}, [lambda a, b: a < b, joins.Band(-2, 2)])
    assert rows(out) == plain_join(xs, ys, lambda a, b: a[1] < b[1] and abs((a[2] - b[2]).days) <= 2, "inner") and no_pairwise_plan(out)
    out = joins.predicate_join(x, y, {"g": "h", "d": "e"}, [operator.eq, joins.Band(-2, 0)], "anti")
    assert rows(out) == plain_join(xs, ys, lambda a, b: a[1] == b[1] and -2 <= (a[2] - b[2]).days <= 0, "anti")


def test_band_join_of_many_values_stays_small(spark):
    """A hundred thousand distinct values on each side, where all pairs would be ten billion."""
    x = spark.range(100_000).select((F.col("id") * 3).alias("v"))
    y = spark.range(100_000).select((F.col("id") * 3 + 1).alias("w"))
    assert joins.predicate_join(x, y, {"v": "w"}, joins.Band(-1, 1)).count() == 100_000
    assert joins.predicate_join(x, y.withColumn("z", F.col("w") + 3), {"v": ("w", "z")}, joins.Between()).count() == 99_999


@pytest.mark.parametrize("how", MODES)
def test_band_join_lists_no_pairs(spark, how):
    nan, inf = float("nan"), float("inf")
    xs = [(i, v) for i, v in enumerate([1.0, 1.0, 2.5, -7.0, 40.0, None, None, nan, inf, -inf])]
    ys = [(i, v) for i, v in enumerate([0.5, 0.5, 3.0, 41.0, 99.0, None, nan, nan, inf, -inf])]
    x, y = spark.createDataFrame(xs, "id int, v double"), spark.createDataFrame(ys, "id int, w double")
    ok = lambda a, b: a[1] is not None and b[1] is not None and abs(a[1]) < inf and abs(b[1]) < inf and -1 <= a[1] - b[1] < 2
    out = joins.predicate_join(x, y, {"v": "w"}, joins.Band(-1, 2, "left"), how)
    assert str(rows(out)) == str(plain_join(xs, ys, ok, how))  # as text, for not-a-number
    # both sides meet directly (twice in the full mode): a list of pairs would have to be joined with each of them
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == (2 if how == "full" else 1)


def test_between_join_lists_no_pairs(spark, monkeypatch):
    """Rows meet in buckets: a list of pairs would be as long as the result where values don't repeat."""
    rnd = random.Random(11)
    xs = [(i, rnd.choice([None, float("nan"), 5.0, rnd.uniform(-50, 300)]), i % 3) for i in range(150)]
    ends = [(rnd.uniform(-60, 300), rnd.choice([0.0, 0.5, 3.0, 40.0, 500.0, -2.0])) for _ in range(90)]
    ys = [(i, a, a + w, i % 4) for i, (a, w) in enumerate(ends)] + [(90, None, 3.0, 1), (91, 0.0, None, 1), (92, 4.0, 6.0, None), (92, 4.0, 6.0, 1)]
    x, y = spark.createDataFrame(xs * 2, "id int, v double, k int"), spark.createDataFrame(ys, "id int, lo double, hi double, m int")
    monkeypatch.setattr(joins, "spread", lambda df: (_ for _ in ()).throw(AssertionError("a list of pairs")))
    ok = lambda a, b: None not in (a[1], b[1], b[2]) and b[1] <= a[1] < b[2]
    out = joins.predicate_join(x, y, {"v": ("lo", "hi")}, joins.Between("left"))
    assert out.columns == ["id_x", "v", "k", "id_y", "lo", "hi", "m"] and rows(out) == plain_join(xs * 2, ys, ok, "inner")
    more = lambda a, b: ok(a, b) and b[3] is not None and a[2] <= b[3]
    out = joins.predicate_join(x, y, {"v": ("lo", "hi"), "k": "m"}, [joins.Between("left"), lambda a, b: a <= b])
    assert rows(out) == plain_join(xs * 2, ys, more, "inner")


def test_default_keys_and_index_function(spark):
    xs, ys = [(1, 5), (2, 6), (3, None), (4, 5)], [(1, 5), (9, 7)]
    x, y = spark.createDataFrame(xs, "a int, k int"), spark.createDataFrame(ys, "b int, k int")
    out = joins.predicate_join(x, y, match=lambda a, b: a >= b - 1)
    assert out.columns == ["a", "k_x", "b", "k_y"] and rows(out) == [(1, 5, 1, 5), (2, 6, 1, 5), (2, 6, 9, 7), (4, 5, 1, 5)]
    assert rows(joins.predicate_join(x, y, ["k"], operator.eq)) == [(1, 5, 1, 5), (4, 5, 1, 5)]
    pairs = lambda a, b: a.join(b, F.col("k") + 2 == F.col("k_y")).withColumn("why", F.lit("two more"))
    out = joins.predicate_join(x, y, how="full", index=pairs)
    assert out.columns == ["a", "k_x", "b", "k_y", "why"]
    assert rows(out) == sorted([(1, 5, 9, 7, "two more"), (4, 5, 9, 7, "two more"), (2, 6, None, None, None), (3, None, None, None, None),
                                (None, None, 1, 5, None)], key=str)
    with pytest.raises(ValueError):
        joins.predicate_join(x.drop("k"), y, match=operator.eq)
    with pytest.raises(ValueError):
        joins.Band(0, float("inf"))


def test_caliper_join(spark):
    x = spark.createDataFrame([(1, 70, "a"), (2, 80, "b")], "pair int, age int, who string")
    y = spark.createDataFrame([(1, 73, "c"), (2, 84, "d")], "pair int, age int, who string")
    assert rows(joins.caliper_join(x, y, ["pair"], {"age": 3})) == [(1, 70, "a", 73, "c")]


@pytest.fixture(scope="module")
def events(spark):
    e = [(1, D(2020, 1, d), k, v) for d, k, v in
         [(1, "a", 1.0), (1, "a", 5.0), (3, "b", 2.0), (5, "a", None), (9, "a", 7.0), (9, "b", 8.0)]]
    e += [(2, D(2020, 1, 4), "b", 3.0)]
    e += [(7, D(2020, 1, 1 + i % 20), "a", float(i)) for i in range(4000)]  # one person owns nearly everything
    return spark.createDataFrame(e, "patient_id long, date date, kind string, value double")


def test_lookup_kinds_and_bounds(spark, events):
    who = spark.createDataFrame([(1, D(2020, 1, 5)), (1, D(2020, 1, 2)), (3, D(2020, 1, 5)), (7, D(2020, 1, 10))], "patient_id long, at date")
    at = F.col("at")
    out = lk.lookup(events, who, [
        Find("first_after", "date", "first", F.col("kind") == "a", on_or_after=at),
        Find("last_before", "date", "last", F.col("kind") == "a", on_or_before=F.date_sub(at, 1)),
        Find("n", "count", where=F.col("kind") == "a", on_or_before=at),
        Find("any_b", "flag", where=F.col("kind") == "b", on_or_before=at),
        Find("value", "value", "last", F.col("kind") == "a", on_or_before=at, value=F.col("value")),
    ])
    got = {(r["patient_id"], r["at"]): tuple(r)[2:] for r in out.collect()}
    assert got[(1, D(2020, 1, 5))] == (D(2020, 1, 5), D(2020, 1, 1), 3, True, 5.0)
    assert got[(1, D(2020, 1, 2))] == (D(2020, 1, 5), D(2020, 1, 1), 2, False, 5.0)
    assert got[(3, D(2020, 1, 5))] == (None, None, 0, False, None)
    assert got[(7, D(2020, 1, 10))] == (D(2020, 1, 10), D(2020, 1, 9), 2000, False, 3989.0)


def test_hot_person_is_summed_up_before_the_join(events):
    daily = lk.daily_summary(events, [Find("n", "count")], "patient_id", "date")
    assert daily.where("_person = 7").count() == 20


def test_nth_events_carry_one_event_per_day(spark, events):
    got = lk.nth_events(events.where("kind = 'a'"), 2, carry=["value"]).where("patient_id = 1")
    assert rows(got.select("k", "date", "value")) == [(1, D(2020, 1, 1), 5.0), (2, D(2020, 1, 5), None)]


def test_ties_in_mode_and_latest(spark):
    e = spark.createDataFrame([(1, "b"), (1, "a"), (1, "c"), (1, "c"), (2, "z"), (2, "y")], "patient_id long, code string")
    assert rows(lk.most_frequent(e, "code")) == [(1, "c"), (2, "y")]


def test_interval_lookups(spark):
    iv = spark.createDataFrame([
        (1, D(2019, 1, 1), None, "p"), (1, D(2020, 1, 1), D(2020, 1, 10), "q"), (1, D(2020, 1, 1), D(2020, 1, 3), "r"),
        (2, D(2019, 1, 1), D(2019, 6, 1), "p"), (2, D(2019, 6, 2), None, "q")], "patient_id long, start_date date, end_date date, practice string")
    who = spark.createDataFrame([(1, D(2020, 1, 2)), (1, D(2020, 1, 20)), (2, D(2018, 1, 1)), (2, D(2020, 1, 1))], "patient_id long, at date")
    got = lk.as_of(iv, who, F.col("at"), ["practice"], "found")
    assert rows(got) == sorted([(1, D(2020, 1, 2), "q", True), (1, D(2020, 1, 20), "p", True), (2, D(2018, 1, 1), None, False), (2, D(2020, 1, 1), "q", True)], key=str)
    a = F.col("at")
    cont = lk.registered_throughout(iv, who, F.date_sub(a, 300), a, "ok")
    assert {(r[0], r[1]): r[2] for r in cont.collect()} == {
        (1, D(2020, 1, 2)): True, (1, D(2020, 1, 20)): True, (2, D(2018, 1, 1)): False, (2, D(2020, 1, 1)): False}


def test_age(spark):
    df = spark.createDataFrame([(D(1950, 6, 15), D(2020, 6, 14)), (D(1950, 6, 15), D(2020, 6, 15))], "b date, d date")
    assert rows(df.select(lk.age_on(F.col("b"), F.col("d")))) == [(69,), (70,)]


def test_day_of_age(spark):
    """Measurements below the minimum age don't count; on the day itself they do."""
    who = spark.createDataFrame([(1, 72), (2, 70), (3, 69), (4, None)], "patient_id long, age int")
    index = F.lit("2020-02-29").cast("date")
    days = {r.patient_id: str(r.d) for r in who.select("patient_id", lk.day_of_age(F.col("age"), index, 70).alias("d")).collect()}
    assert days == {1: "2018-02-28", 2: "2020-02-29", 3: "2021-02-28", 4: "None"}
    events = spark.createDataFrame(
        [(1, "2018-02-27", 1.0), (2, "2020-02-29", 2.0), (2, "2020-02-28", 3.0), (3, "2020-02-01", 4.0), (4, "2020-02-01", 5.0)],
        "patient_id long, date string, value double").withColumn("date", F.to_date("date"))
    of_age = lk.day_of_age(F.col("age"), index, 70)
    since = F.when(of_age.isNotNull(), F.greatest(F.date_sub(index, 1826), of_age))
    got = lk.lookup(events, who, [lk.Find("v", "value", "last", None, since, index, F.col("value"))])
    assert {r.patient_id: r.v for r in got.collect()} == {1: None, 2: 2.0, 3: None, 4: None}


def _tasks_with_rows(df):
    return df.select(F.spark_partition_id().alias("p")).distinct().count()


def test_few_pairs_are_expanded_by_many_tasks(spark):
    x = spark.range(400).select(F.col("id").alias("a"), (F.col("id") % 2).alias("v")).coalesce(1)
    y = spark.range(60).select(F.col("id").alias("b"), (F.col("id") % 2).alias("w")).coalesce(1)
    multi = joins.predicate_join(x, y, {"v": "w"}, lambda a, b: (a >= b) & (a <= b), multi=True)
    assert multi.count() == 400 * 30
    assert _tasks_with_rows(multi) > 4
    ranges = y.select("b", (F.col("b") - 0.5).alias("low"), (F.col("b") + 0.5).alias("high"))
    between = joins.predicate_join(x.withColumn("v", F.col("a") % 40), ranges, {"v": ("low", "high")}, joins.Between("left"))
    assert between.count() == 400
    assert _tasks_with_rows(between) > 4
