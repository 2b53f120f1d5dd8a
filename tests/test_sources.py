"""Readers, writers, codelists, schema checks and summaries on hand-made data."""

import datetime as dt
import gzip
from pathlib import Path

import pytest
from pyspark.sql import functions as F, types as T

from cohortspark.operators import summary
from cohortspark.sources import codelists as cl, tables as tb


def test_round_trips(spark, tmp_path):
    df = spark.createDataFrame([(1, dt.date(2020, 1, 2), "x"), (2, None, "y")], "patient_id long, d date, kind string")
    tb.write_table(df, str(tmp_path / "t"), ["kind"])
    assert (tmp_path / "t" / "kind=x").exists()
    back = tb.read_table(spark, str(tmp_path / "t"), "patient_id long, d date, kind string")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    tb.write_csv(df, str(tmp_path / "c"))
    part = next(Path(tmp_path / "c").glob("*.csv.gz"))
    assert gzip.open(part, "rt").readline().strip() == "patient_id,d,kind"
    again = tb.read_csv(spark, str(tmp_path / "c"), "patient_id long, d date, kind string")
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, df.collect()))
    tb.write_text_report(df, str(tmp_path / "r"), "two people")
    lines = next(Path(tmp_path / "r").glob("*.txt")).read_text().splitlines()
    assert lines[0] == "two people" and "1\t2020-01-02\tx" in lines and "2\tNA\ty" in lines


def test_codelists_keep_leading_zeros(spark, tmp_path):
    (tmp_path / "l.csv").write_text("CTV3ID,Grouping\n00123,1\nXaB1.,2\n")
    a = cl.read_codelist(spark, str(tmp_path / "l.csv"), "eth", "ctv3", "CTV3ID", "Grouping")
    assert sorted(map(tuple, a.collect())) == [("ctv3", "eth", "00123", "1"), ("ctv3", "eth", "XaB1.", "2")]
    both = cl.combine_codelists(a.withColumn("category", F.lit(None).cast("string")), cl.codelist(spark, ["00123", "Z"], "more", "ctv3"), name="all")
    assert sorted(r["code"] for r in both.collect()) == ["00123", "XaB1.", "Z"]


def test_schema_checks(spark):
    df = spark.createDataFrame([(1, "2020-01-01")], "patient_id long, seen_date string")
    want = T.StructType().add("seen_date", "date").add("patient_id", "long")
    with pytest.raises(ValueError, match="seen_date is string"):
        tb.assert_schema(df, want)
    fixed = tb.assert_schema(tb.normalise_dates(df), want)
    assert fixed.columns == ["seen_date", "patient_id"]
    assert tb.schema_differences(df.select("patient_id").schema, want) == ["missing column seen_date"]


def test_combining(spark):
    a, b = spark.createDataFrame([(1, 2)], "x int, y int"), spark.createDataFrame([(3,)], "x int")
    assert [tuple(r) for r in tb.combine([({"src": "a"}, a), ({"src": "b"}, b)]).orderBy("x").collect()] == [("a", 1, 2), ("b", 3, None)]
    vals = spark.createDataFrame([(1, "v")], "patient_id int, v string")
    who = spark.createDataFrame([(1,), (2,)], "patient_id int")
    assert sorted(map(tuple, tb.attach_values(who, vals, ["v"]).collect()), key=str) == [(1, "v"), (2, None)]
    assert [tuple(r) for r in tb.restrict_to(who, vals).collect()] == [(1,)]


def test_categorical_summary_keeps_empty_levels(spark):
    df = spark.createDataFrame([("a",)] * 10 + [("b",)] * 2 + [(None,)] * 3, "x string")
    got = {r["level"]: r for r in summary.cat_summary(df, ["x"], {"x": ["a", "b", "z"]}, threshold=0).collect()}
    assert got["z"]["n"] == 0 and got["a"]["pct"] == pytest.approx(10 / 15) and got["a"]["pct_nonmiss"] == pytest.approx(10 / 12)
    hidden = {r["level"]: r["n"] for r in summary.cat_summary(df, ["x"], threshold=2).collect()}
    # hiding b alone would give it away, so the next smallest goes too
    assert hidden == {"a": 10, "b": None, "(missing)": None}


def test_two_way_total_and_table_redaction(spark):
    df = spark.createDataFrame([("a", "u")] * 9 + [("b", "u")] * 8 + [("a", "v")] * 7 + [("b", "v")] * 1, "x string, y string")
    out = {(r["level1"], r["level2"]): r["n"] for r in summary.catcat_summary(df, "x", "y", threshold=2, total="all").collect()}
    assert out[("b", "v")] is None and out[("a", "v")] is None and out[("b", "u")] is None and out[("a", "u")] == 9
    assert out[("a", "all")] == 16
    table = summary.baseline_table(df, "y", ["x"])
    red = {(r["arm"], r["level"]): r["n"] for r in summary.redact_baseline(table, 2).collect()}
    assert red[("u", "a")] == 9 and red[("v", "b")] is None


def test_weighted_mean_ignores_missing(spark):
    df = spark.createDataFrame([(1.0, 1.0), (4.0, 2.0), (None, 5.0)], "x double, w double")
    assert df.agg(summary.weighted_mean(F.col("x"), F.col("w"))).first()[0] == pytest.approx(3.0)
