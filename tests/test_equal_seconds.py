"""Rows of one second go by id: every order in which files are read gives the same result."""

import itertools

import pytest
from pyspark.sql import functions as F

from marketlens.operators import alarms as al
from marketlens.operators import cohort as co
from marketlens.operators import features as ft
from marketlens.operators import joins as jn
from marketlens.operators import outcomes as oc

OBS = "id long, mint long, ts long, mc double, price double, liq double, bad double"
ROWS = [(1, 1, 0, 1.0, 10.0, 5.0, 1.0), (2, 1, 0, 2.0, 20.0, 6.0, 1.0), (3, 1, 100, 3.0, 30.0, 7.0, 1.0), (4, 1, 100, 4.0, 40.0, 8.0, 1.0), (5, 1, 200, 5.0, 50.0, 4.0, 1.0), (6, 1, 200, 7.0, 70.0, 2.0, 1.0)]


def orders(spark):
    """The rows in several orders, each in one partition as it stands."""
    for k, rows in enumerate(itertools.islice(itertools.permutations(ROWS), 0, 720, 103)):
        yield spark.createDataFrame(list(rows), OBS).coalesce(1)


def same(spark, run):
    got = [sorted(map(repr, run(df).collect())) for df in orders(spark)]
    assert all(g == got[0] for g in got[1:]) and got[0]
    return got[0]


def test_endpoint(spark):
    cases = spark.createDataFrame([(9, 1, 0)], "case long, mint long, cts long")
    run = lambda df: jn.endpoint_join(cases, df, ["mint"], "cts", "ts", ["mc"], 200, 50).select("endpoint.mc")
    assert same(spark, run) == ["Row(mc=5.0)"]


def test_case_state(spark):
    cases = spark.createDataFrame([(9, 1, 0, 1.0)], "id long, mint long, decision_ts long, entry_mc double")
    assert "last_mc=7.0" in same(spark, lambda df: oc.case_state(cases, df, ["mint"], 300).select("last_mc", "peak_mc", "trough_mc"))[0]


def test_endpoint_of_a_decision(spark):
    decisions = spark.createDataFrame([(9, 1, 110, "WATCH")], "id long, mint long, decision_ts long, action string")
    none = decisions.select("mint").limit(0)
    got = same(spark, lambda df: co.classify_endpoint(decisions, df, none, 10_000, 1000, 90, 50, 180).select("reason", F.round("multiple", 6).alias("m")))
    assert got == ["Row(reason='timely_observed_market_endpoint', m=1.25)"]


def test_path_labels(spark):
    got = same(spark, lambda df: ft.label_paths(df, 200, 50, 180).filter("ts = 0").select("id", *[c for c in ft.label_paths(df, 200, 50, 180).columns if c not in df.columns]))
    assert len(got) == 2


def test_movement(spark):
    got = same(spark, lambda df: ft.movement(df, 200, 50, 180).filter("id = 6").select(F.round("move_pct", 6).alias("p")))
    assert got == ["Row(p=250.0)"]


@pytest.mark.parametrize("newest", [100, 200])
def test_references(spark, newest):
    got = same(spark, lambda df: al.liquidity_drop(df.withColumn("vol_m5", F.lit(1.0)), 250, newest, 0.85, 1, 180).select("id", "liq_ratio"))
    assert got
