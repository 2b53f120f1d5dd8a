"""Registered queries against their SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
from oracle import compare, duck

SF = "/root/testdata/sf0.001"
# one query per area; tests/oracle.py runs them all
CHECKED = ["first_event_after", "nth_spell_wide", "dependent_window_lookup", "asof_interval_lookup", "recode_demographics",
           "flowchart_rounded", "sequential_match", "exact_rank_match", "split_follow_up", "km_contrasts", "counting_process",
           "time_since_bands", "fuzzy_join_full", "dense_grid_fill", "sample_weights", "numeric_summary", "table1"]


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", CHECKED)
def test_query_matches_sql(spark, con, name):
    ok, note = compare(entry.queries()[name](spark, SF), con, entry.oracle_sql()[name])
    assert ok, note


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "surv" in df.columns
