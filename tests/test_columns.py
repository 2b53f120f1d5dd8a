"""Hand-computed cases for the column helpers and disclosure control."""

import datetime as dt

from pyspark.sql import functions as F

from cohortspark.functions import columns as c, disclosure as dc, stats

INF = float("inf")
D = dt.date


def values(df, *cols):
    return [tuple(r) for r in df.select(*cols).collect()]


def one(spark, rows, schema, col):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(col).collect()]


def test_case_levels_keeps_branch_order_and_falls_through_null(spark):
    col, levels = c.case_levels([(F.col("x") > 5, "high"), (F.col("x") > 2, "mid")], "low")
    assert levels == ["high", "mid", "low"]
    assert one(spark, [(9,), (3,), (1,), (None,)], "x int", col) == ["high", "mid", "low", "low"]


def test_recode_collapse_and_order(spark):
    rows, schema = [("a",), ("b",), ("z",), (None,)], "x string"
    assert one(spark, rows, schema, c.recode(F.col("x"), {"a": "A", "b": "B"})) == ["A", "B", None, None]
    assert one(spark, rows, schema, c.collapse(F.col("x"), {"ab": ["a", "b"]})) == ["ab", "ab", "z", None]
    assert one(spark, rows, schema, c.level_order(F.col("x"), ["b", "a"])) == [2, 1, None, None]
    assert one(spark, rows, schema, c.reverse_order(c.level_order(F.col("x"), ["b", "a"]), 2)) == [1, 2, None, None]


def test_bands_are_closed_on_the_chosen_side(spark):
    rows, schema = [(0,), (1,), (2,), (3,), (None,)], "x int"
    left = c.cut_band(F.col("x"), [0, 1, 2, INF], ["0", "1", "2+"])
    assert one(spark, rows, schema, left) == ["0", "1", "2+", "2+", None]
    right = c.cut_band(F.col("x"), [0, 1, 3], ["a", "b"], right=True)
    assert one(spark, rows, schema, right) == [None, "a", "b", "b", None]
    lowest = c.cut_band(F.col("x"), [0, 1, 3], ["a", "b"], right=True, include_lowest=True)
    assert one(spark, rows, schema, lowest) == ["a", "a", "b", "b", None]
    missing = c.cut_band_missing(F.col("x"), [-INF, 2, INF], ["few", "many"], "none")
    assert one(spark, rows, schema, missing) == ["few", "few", "many", "many", "none"]


def test_time_since_bands(spark):
    assert c.timesince_labels([0, 3, 7], "pre-vax") == ["pre-vax", "1-3", "4-7", "8+"]
    got = one(spark, [(-1,), (0,), (1,), (3,), (4,), (7,), (8,), (None,)], "x int", c.timesince_cut(F.col("x"), [0, 3, 7], "pre"))
    assert got == ["pre", "pre", "1-3", "1-3", "4-7", "4-7", "8+", "8+"]


def test_time_to_event_and_censoring(spark):
    o = D(2020, 1, 1)
    rows = [(o, D(2020, 1, 5), D(2020, 1, 9)), (o, D(2020, 1, 9), D(2020, 1, 5)), (o, None, D(2020, 1, 5)), (o, D(2020, 1, 5), None)]
    df = spark.createDataFrame(rows, "o date, e date, c date")
    e, k = F.col("e"), F.col("c")
    assert values(df, c.tte(F.col("o"), e, k), c.tte(F.col("o"), e, k, True), c.censor_indicator(e, k)) == [
        (4, 4, True), (4, None, False), (4, None, False), (4, None, True)]
    assert values(df, c.censor_event(e, k), c.censor_event(e, k, False)) == [
        (D(2020, 1, 5), D(2020, 1, 5)), (None, D(2020, 1, 5)), (None, None), (None, None)]
    assert values(df, c.earliest_known(e, k), c.latest(e, k))[2] == (None, D(2020, 1, 5))
    assert values(df, c.day_index(e, D(2020, 1, 1)))[0] == (5,)
    assert one(spark, [(0,), (1,), (7,), (8,)], "x int", c.round_tte(F.col("x"))) == [0, 1, 1, 2]


def test_rounding_rules(spark):
    rows, schema = [(0,), (1,), (6,), (7,), (12,), (13,)], "x int"
    assert one(spark, rows, schema, dc.roundmid_any(F.col("x"), 6)) == [0, 3, 3, 9, 9, 15]
    assert one(spark, rows, schema, dc.roundmid_any(F.col("x"))) == [0, 1, 6, 7, 12, 13]
    assert one(spark, rows, schema, dc.ceiling_any(F.col("x"), 6)) == [0, 6, 6, 12, 12, 18]
    assert one(spark, [(0.3,)], "x double", dc.ceiling_any(F.col("x") * 10 / 3, 1)) == [1]


def test_redaction_hides_small_counts_and_a_second_cell(spark):
    def flags(ns, t=5):
        df = spark.createDataFrame(list(enumerate(ns)), "i int, n int")
        out = dc.redaction_flag(df, "n", t, order=["i"]).orderBy("i").collect()
        return [r["redacted"] for r in out]

    assert flags([3, 20, 30]) == [True, True, False]
    assert flags([3, 4, 30]) == [True, True, False]
    assert flags([3, 0, 30]) == [True, True, False]
    assert flags([10, 0, 30]) == [False, False, False]
    assert flags([2, 9, 9]) == [True, True, False]


def test_logic_and_text(spark):
    df = spark.createDataFrame([(True, None), (False, True), (None, None)], "a boolean, b boolean")
    assert values(df, c.satisfied(F.col("a") & F.col("b"))) == [(False,), (False,), (False,)]
    assert values(df, c.count_true(F.col("a"), F.col("a")))[:2] == [(2,), (0,)]
    t = spark.createDataFrame([(0.999, 1.234, "long text here")], "p double, x double, s string")
    assert values(t, c.percent_text(F.col("p"))) == [(">99%",)]
    assert values(t, c.percent_text(F.col("p"), 1)) == [("99.9%",)]
    assert values(t, c.estimate_text(F.col("x"), F.lit(1.0), F.lit(2.0))) == [("1.23 (1.00-2.00)",)]
    assert values(t, c.truncate_text(F.col("s"), 7)) == [("long...",)]
    assert values(t, c.fill_template(F.lit("with {b} and {b}"), {"b": F.lit("X")})) == [("with X and X",)]


def test_normal_distribution(spark):
    df = spark.createDataFrame([(0.0,), (1.959963984540054,), (-1.0,), (None,)], "z double")
    got = values(df, stats.normal_cdf(F.col("z")), stats.two_sided_p(F.col("z")))
    assert abs(got[0][0] - 0.5) < 1e-12 and abs(got[1][0] - 0.975) < 1e-12
    assert abs(got[1][1] - 0.05) < 1e-12 and abs(got[2][0] - 0.15865525393145707) < 1e-12


def test_convert_types(spark):
    df = spark.createDataFrame([(True, 1.0)], "f boolean, tte_x double")
    assert dict(c.convert_types(c.convert_types(df, "boolean", "int"), "double", "int", "tte_").dtypes) == {"f": "int", "tte_x": "int"}
