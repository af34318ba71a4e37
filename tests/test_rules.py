"""Boundary semantics on hand fixtures."""

import pytest
from pyspark.sql import functions as F

from marketlens.functions import text as tx
from marketlens.functions.numeric import wilson
from marketlens.operators import cohort as co
from marketlens.operators import features as ft
from marketlens.operators import graph as gr
from marketlens.operators import joins as jn
from marketlens.operators import ledger as lg
from marketlens.operators import outcomes as oc
from marketlens.operators import policy as po

COLS = ("id long, mint string, pair string, ts long, price double, mc double, liq double, vol_m5 double, vol_h1 double, "
        "buys_m5 int, sells_m5 int, buys_h1 int, sells_h1 int, pc_m5 double, pc_h1 double")


def row(i, ts, mc=50000.0, **kw):
    d = dict(id=i, mint="m", pair="p", ts=ts, price=1.0, mc=mc, liq=30000.0, vol_m5=4000.0, vol_h1=30000.0, buys_m5=15, sells_m5=5,
             buys_h1=70, sells_h1=30, pc_m5=3.0, pc_h1=10.0)
    d.update(kw)
    return tuple(d[c.strip().split(" ")[0]] for c in COLS.split(","))


def path(n, changes=None, drop=()):
    return [row(i, 10000 + 60 * i, **(changes or {}).get(i, {})) for i in range(n) if i not in drop]


def frame(spark, rows):
    return spark.createDataFrame(rows, COLS)


def test_full_score_and_extended_hour(spark):
    d = ft.score_signals(ft.trailing_features(frame(spark, path(12))))
    last = d.orderBy(F.desc("ts")).first()
    assert (last["gate"], last["score"], last["failed"]) == ("pass", 11, [])
    d = ft.score_signals(ft.trailing_features(frame(spark, path(12, {11: {"pc_h1": 170.0}}))))
    last = d.orderBy(F.desc("ts")).first()
    assert (last["score"], last["failed"]) == (10, ["h1_not_extended"])


@pytest.mark.parametrize("rows, reason, label, top, end", [
    (path(64), "covered", "non_run", 1.0, 1.0),
    (path(64, {20: {"mc": 110000.0}}), "covered", "run", 2.2, 1.0),
    (path(64, {60: {"mc": 75000.0}}), "covered", "intermediate", 1.5, 1.5),
    (path(60), "missing_endpoint", None, None, None),
    (path(64, drop=(30, 31, 32, 33)), "gap", None, None, None),
    (path(64, {20: {"mc": 0.0}}), "invalid_mc", None, None, None),
    (path(60) + [row(99, 10000 + 3780)], "gap", None, None, None),
    ([row(0, 10000), row(1, 10000 + 3700)], "gap", None, None, None),
])
def test_path_labels(spark, rows, reason, label, top, end):
    r = ft.label_paths(frame(spark, rows)).filter("ts = 10000").first()
    assert (r["reason"], r["label"]) == (reason, label)
    if top:
        assert r["max_multiple"] == pytest.approx(top) and r["endpoint_multiple"] == pytest.approx(end)


def test_late_spike_is_no_run(spark):
    rows = path(60) + [row(60, 10000 + 3610, 110000.0)]
    r = ft.label_paths(frame(spark, rows)).filter("ts = 10000").first()
    assert (r["label"], r["endpoint_multiple"]) == ("non_run", pytest.approx(2.2))


def test_endpoint_window_is_inclusive_and_same_pair(spark):
    cases = spark.createDataFrame([(1, "m", "p", 1000)], "id long, mint string, pair string, cts long")
    obs = lambda *r: spark.createDataFrame(list(r), "mint string, pair string, ts long, mc double")
    ends = lambda o, now=None: jn.endpoint_join(cases, o, ["mint", "pair"], "cts", "ts", ["mc"], now=now).first()
    assert ends(obs(("m", "p", 4780, 5.0)))["lateness"] == 180
    assert ends(obs(("m", "p", 4600, 5.0), ("m", "p", 4599, 9.0)))["lateness"] == 0
    assert ends(obs(("m", "p", 4781, 5.0)))["endpoint_status"] == "missing"
    assert ends(obs(("m", "q", 4700, 5.0)))["endpoint_status"] == "missing"
    assert ends(obs(("m", "p", 4700, 5.0)), now=4780)["endpoint_status"] == "window_open"


def test_horizon_metric_excludes_late_peak(spark):
    cases = spark.createDataFrame([(1, "m", 1000, 100.0)], "id long, mint string, decision_ts long, entry_mc double")
    obs = [("m", 1000 + 60 * i, 100.0 if i != 30 else 200.0) for i in range(1, 61)] + [("m", 4601, 500.0)]
    m = oc.horizon_metrics(cases, spark.createDataFrame(obs, "mint string, ts long, mc double"), ["mint"], [3600]).first()
    assert (m["max_mult"], m["coverage_ok"], m["max_gap"]) == (2.0, True, 60)
    sparse = spark.createDataFrame([("m", 1100, 100.0)], "mint string, ts long, mc double")
    m = oc.horizon_metrics(cases, sparse, ["mint"], [3600]).first()
    assert (m["coverage_ok"], m["samples"]) == (False, 1)


@pytest.mark.parametrize("change, reason", [({}, "eligible"), ({"coverage_ok": False}, "incomplete_coverage"), ({"lateness": 181}, "invalid_timing"),
                                            ({"observed_ts": 4600}, "invalid_timing"), ({"max_gap": 181}, "incomplete_coverage"),
                                            ({"multiple": float("nan")}, "invalid_outcome"), ({"observed_ts": None}, "missing_endpoint")])
def test_endpoint_reasons(spark, change, reason):
    d = dict(decision_ts=1000, horizon=3600, observed_ts=4601, lateness=1, metric_ts=4601, coverage_ok=True, max_gap=180, multiple=2.0)
    d.update(change)
    if "observed_ts" in change:
        d["metric_ts"] = change["observed_ts"]
    df = spark.createDataFrame([tuple(d.values())], "decision_ts long, horizon long, observed_ts long, lateness long, metric_ts long, coverage_ok boolean, max_gap long, multiple double")
    assert df.select(oc.valid_endpoint().alias("r")).first()["r"] == reason


@pytest.mark.parametrize("entry, top, last, liq, want", [
    (100.0, 3.0, 1.0, 2000.0, "PEAK_THEN_FAILURE_OBSERVED"), (100.0, 1.2, 90.0, None, "NO_2X_OBSERVED_YET"), (0.0, 3.0, 1.0, 1.0, "INVALID_ENTRY"),
    (100.0, None, 1.0, 1.0, "INVALID_STATE"), (100.0, 1.0, 99.0, 5000.0, "FAILURE_OBSERVED"), (100.0, 2.0, 200.0, 9e9, "PEAK_2X_OBSERVED")])
def test_assessment(spark, entry, top, last, liq, want):
    df = spark.createDataFrame([(entry, top, 0.01, last, liq)], "entry_mc double, max_mult double, min_mult double, last_mc double, last_liq double")
    assert df.select(ft.assess_case().alias("a")).first()["a"] == want


def checks(spark, **status):
    rows = [(n, status.get(n, "PASS"), "r", 990, ["ref"]) for n in po.CHECKS]
    return spark.createDataFrame([(1, rows)], "id int, checks array<struct<name:string,status:string,reason:string,observed_at:long,refs:array<string>>>")


def verdict(df, authority="REVOKED", at=999, same=True):
    r = po.prealert_verdict(df, "checks", 1000, F.lit(same), F.lit(at), F.lit(authority)).first()
    return r["verdict"], r["reasons"]


def test_verdict_precedence(spark):
    assert verdict(checks(spark)) == ("PASS", [])
    assert verdict(checks(spark, wallet_age="UNKNOWN")) == ("PASS", [])
    assert verdict(checks(spark, liquidity_control="UNKNOWN")) == ("HOLD", ["liquidity_control:unresolved"])
    assert verdict(checks(spark, wallet_age="REJECT", liquidity_control="UNKNOWN")) == ("REJECT", ["wallet_age", "liquidity_control:unresolved"])
    assert verdict(checks(spark), authority="ACTIVE")[0] == "REJECT"
    assert verdict(checks(spark), at=699) == ("HOLD", ["stale_or_invalid_review"])
    assert verdict(checks(spark), same=False) == ("HOLD", ["identity_or_policy_mismatch"])


def test_unknown_never_passes(spark):
    stale = checks(spark).withColumn("checks", F.transform("checks", lambda c: c.withField("observed_at", F.lit(600).cast("long"))))
    assert verdict(stale)[0] == "HOLD"
    blank = checks(spark).withColumn("checks", F.transform("checks", lambda c: c.withField("refs", F.array(F.lit(" ")))))
    assert verdict(blank)[0] == "HOLD"


def test_matching_ignores_outcomes(spark):
    rows = [(i, f"m{i}", "R", 1000 + i, float(i % 7), float(i % 5)) for i in range(60)]
    d = spark.createDataFrame(rows, "id long, mint string, regime string, decision_ts long, lmc double, lliq double")
    run = lambda x: sorted(tuple(r) for r in jn.nearest_controls(
        x.filter("id < 20"), x.filter("id >= 20"), ["regime"], [("decision_ts", 300, 300), ("lmc", 1.0, 1.0), ("lliq", 1.0, 1.0)], "id", "id").select("id", "r_id").collect())
    assert run(d) == run(d.withColumn("multiple", F.rand(3))) and run(d)


def test_ledger_detects_tampering(spark):
    df = spark.createDataFrame([("a", i, "k", f"body{i}") for i in range(1, 9)], "chain string, seq long, kind string, body string")
    c = lg.build_chain(df, "chain", "seq", ["seq", "kind", "body"], "0" * 64)
    fault = lambda x: lg.first_fault(lg.verify_chain(x, "chain", "seq", ["seq", "kind", "body"], "0" * 64), "chain", "seq").first()
    assert fault(c)["first_bad"] is None
    assert (fault(c.withColumn("body", F.expr("if(seq = 4, 'x', body)")))["first_bad"]) == 4
    assert fault(c.filter("seq <> 3"))["fault"] == "sequence"


def test_stop_waits_for_unresolved(spark):
    df = spark.createDataFrame([(i, None if i == 7 else i % 2 == 1) for i in range(1, 12)], "seq long, eligible boolean")
    r = co.sequential_stop(df, "seq", "eligible", 3).first()
    assert (r["cutoff"], r["first_unresolved"], r["eligible_before"]) == (5, 7, 3)
    assert co.sequential_stop(df, "seq", "eligible", 4).first()["cutoff"] is None


def test_failed_transaction_has_no_edges(spark):
    ins = "array<struct<program:string,kind:string,source:string,target:string,amount:long,asset:string>>"
    schema = (f"sig string, slot long, failed boolean, block_time long, signers array<string>, balances array<struct<account:string,owner:string,mint:string>>, instructions {ins}, "
              f"inner array<struct<index:int,instructions:{ins}>>")
    one = ("system", "transfer", "a", "b", 5, None)
    tok = ("token", "transferChecked", "x", "y", 7, "T")
    plain = ("token", "transfer", "x", "y", 7, None)
    rows = [("s1", 9, False, 1, ["a"], [("x", "X", "M")], [one], [(0, [tok, plain])]), ("s2", 9, True, 1, [], [], [one], []), ("s3", 9, False, 1, [], [("x", "W", "M"), ("x", "X", "M"), ("y", "Y", "N")], [plain], [])]
    got = {(r["sig"], r["path"], r["relation"], r["source"], r["target"], r["owner_resolution"]) for r in gr.extract_transfers(spark.createDataFrame(rows, schema)).collect()}
    assert got == {("s1", "0", "native_transfer", "a", "b", None), ("s1", "0.0", "token_transfer", "X", "y", False), ("s1", "0.1", "token_transfer", "X", "y", False), ("s3", "0", "token_transfer", "X", "Y", True)}
    assert {r["asset"] for r in gr.extract_transfers(spark.createDataFrame(rows, schema)).filter("path <> '0' OR sig = 's3'").collect()} == {"T", "M"}
    assert gr.extract_transfers(spark.createDataFrame(rows, schema), lambda c: F.length(c) > 1).count() == 0


def test_reconciliation(spark):
    bal = spark.createDataFrame([("t", "a", "S", 100, 35, 5), ("t", "b", "S", 0, 60, 0)], "tx string, account string, asset string, pre long, post long, fee long")
    mv = spark.createDataFrame([("t", 1, "a", "b", "S", 60)], "tx string, seq long, source string, target string, asset string, amount long")
    assert gr.reconcile_endpoints(bal, mv).first()["status"] == "ENDPOINT_AMOUNTS_MATCH"
    assert gr.reconcile_endpoints(bal, mv, fee=False).first()["blockers"] == ["balance_residual"]
    big = mv.withColumn("amount", F.lit(96).cast("long"))
    assert "balance_underflow" in gr.reconcile_endpoints(bal, big).first()["blockers"]


def test_page_fields(spark):
    html = ("<html><head><title>Alpha &amp; Beta</title><meta name='Description' content='d e'><style>p{}</style></head>"
            "<body>one<script>var x='<p>';</script><noscript>no</noscript> two</body></html>")
    r = spark.createDataFrame([(html,)], "h string").select(tx.page_fields(F.col("h")).alias("f")).first()["f"]
    assert r["title"] == "Alpha & Beta" and r["description"] == "d e"
    assert "one" in r["visible"] and "two" in r["visible"] and "var x" not in r["visible"] and "no" not in r["visible"].replace("one", "")


def test_page_fields_by_any_order(spark):
    pages = [("<meta content=\"a b &#8217;\" name='description'><title>T</title>x", "T", "a b \u2019", "T x"), ("<META NAME=description CONTENT='one'><meta name=description content='two'>", "", "two", ""),
             ("<meta name='description'>&#x2019;&#38;lt;&#x110000;&#0;&lt;", "", "", "\u2019&lt;\ufffd\ufffd<"), ("<meta name='twitter:description' content='no'>é", "", "", "é"), (None, "", "", "")]
    got = spark.createDataFrame([(i, p[0]) for i, p in enumerate(pages)], "i int, h string").select("i", tx.page_fields(F.col("h")).alias("f")).orderBy("i").collect()
    assert [tuple(r["f"]) for r in got] == [p[1:] for p in pages]


def test_text_and_interval(spark):
    r = spark.range(1).select(tx.tidy(F.lit("a\u0000b   c\n d"), 2).alias("t"), tx.claim_quote(F.lit("x" * 50 + "we boost your volume now"), tx.TOOLING_CLAIM).alias("q")).first()
    assert r["t"] == "ab c" and r["q"].startswith("x" * 37 + "we boost your volume")
    p, lo, hi = spark.range(1).select(*[c.alias(n) for n, c in zip("plh", wilson(F.lit(0), F.lit(10)))]).first()
    assert (p, lo) == (0.0, 0.0) and hi == pytest.approx(0.27753, abs=1e-4)
    assert tuple(spark.range(1).select(*[c.alias(n) for n, c in zip("plh", wilson(F.lit(0), F.lit(0)))]).first()) == (None, None, None)
