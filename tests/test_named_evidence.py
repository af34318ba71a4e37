"""Absent or doubled evidence never passes."""

import pytest
from pyspark.sql import functions as F

from marketlens.operators import policy as po

CHECK = "array<struct<name:string,status:string,reason:string,observed_at:long,refs:array<string>>>"


def entry(name, status="PASS", at=990):
    return (name, status, "r", at, ["ref"])


ALL = [entry(n) for n in po.CHECKS]
REQUIRED = [n for n in po.CHECKS if n in po.REQUIRED]
CASES = {
    "whole": (ALL, "PASS", "PASS", "SHADOW_ELIGIBLE", True), "none": (None, "HOLD", "HOLD", "HOLD", False), "empty": ([], "HOLD", "HOLD", "HOLD", False),
    "null status": ([entry(n, None if n == REQUIRED[0] else "PASS") for n in po.CHECKS], "HOLD", "HOLD", "HOLD", False),
    "doubled": ([*ALL[:-1], ALL[-2]], "HOLD", "HOLD", "HOLD", False), "null entry": ([*ALL[:-1], None], "HOLD", "HOLD", "HOLD", False),
    "pass and unknown": ([*ALL, entry(REQUIRED[0], "UNKNOWN")], "HOLD", "HOLD", "HOLD", False), "pass and reject": ([*ALL, entry(REQUIRED[0], "REJECT")], "REJECT", "REJECT", "REJECT", False),
    "null name": ([*ALL[:-1], (None, "PASS", "r", 990, ["ref"])], "HOLD", "HOLD", "HOLD", False),
}


@pytest.mark.parametrize("case", CASES)
def test_named(spark, case):
    checks, verdict, seven, variant, relay = CASES[case]
    df = spark.createDataFrame([(1, checks)], f"id long, checks {CHECK}")
    r = po.prealert_verdict(df, "checks", 1000, F.lit(True), F.lit(1000), F.lit("REVOKED")).first()
    assert r["verdict"] == verdict
    d = df.select("*", F.lit(9).alias("score"), F.lit(.1).alias("band"), F.lit(2.).alias("vol_accel"), F.lit(.0).alias("liq_change_now"))
    action = {"PASS": "ENTER_REVIEW", "HOLD": "WATCH", "REJECT": "SKIP"}[seven]
    got = d.select(po.seven_check_verdict("checks").alias("s"), po.paper_decision("checks")[0].alias("a"), po.all_passed("checks", REQUIRED, lambda k: po.evidence_valid(k, 1000)).alias("r"), po.relay_class(1000, "checks").alias("c")).first()
    assert got["s"] == seven and got["a"] == action and (not relay or got["r"]) and (got["r"] is not None)
    assert po.policy_variants(df, "checks", {"current": {}}).first()["verdict"] == variant


def test_evidence_is_made_once(spark):
    """A plan that filters on the verdict does not write the list, and the parsing behind it, at every mention."""
    from marketlens.plans import QUERIES
    plan = QUERIES["relay_eligible"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("trading_mechanics, status") == 1 and plan.count("get_json_object") < 20
