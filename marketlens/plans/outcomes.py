"""Joins in time, horizon outcomes, rates and audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketlens import bindings as b
from marketlens.operators import features as ft
from marketlens.operators import joins as jn
from marketlens.operators import outcomes as oc
from marketlens.plans.market import REGIME_SQL, SCORED, r6, scored
from marketlens.registry import query
from marketlens.session import cut_lineage

HOURS = [b.DAY, 3 * b.DAY, b.HORIZON]
TOP = max(HOURS)

CASES = SCORED + f""",
cases AS (SELECT id, mint, ts AS decision_ts, pair, CASE pair WHEN 'purchase' THEN 'ALERT' ELSE 'SHADOW' END AS source,
   score, {REGIME_SQL} AS regime, mc AS entry_mc, liq AS entry_liq, points, history_s, vol_h1, band, net, buy_ratio, pc_h1, pc_m5
   FROM scored WHERE pair IN ('purchase', 'signup'))
"""


def cases(spark, sf):
    """Purchases stand for alerts and sign-ups for shadow observations."""
    d = scored(spark, sf).filter("pair in ('purchase', 'signup')")
    return d.select("id", "mint", F.col("ts").alias("decision_ts"), "pair",
                    F.when(F.col("pair") == "purchase", "ALERT").otherwise("SHADOW").alias("source"), "score",
                    ft.classify_regime().alias("regime"), F.col("mc").alias("entry_mc"), F.col("liq").alias("entry_liq"),
                    "points", "history_s", "mc", "liq", "vol_h1", "band", "net", "buy_ratio", "pc_h1", "pc_m5")


OUT = CASES + f""",
hz AS (SELECT unnest([{', '.join(map(str, HOURS))}]::BIGINT[]) AS horizon),
outs AS (SELECT c.id, h.horizon, arg_min(s.ts, s.ts) AS ots, arg_min(s.mc, s.ts) AS mc, arg_min(s.liq, s.ts) AS liq,
    arg_min(s.pair, s.ts) AS end_pair FROM cases c CROSS JOIN hz h JOIN snap s ON s.mint = c.mint
    AND s.ts BETWEEN c.decision_ts + h.horizon AND c.decision_ts + h.horizon + {b.LATE} GROUP BY ALL),
outcomes AS (SELECT o.id, o.horizon, ots + CASE WHEN end_pair = 'error' THEN 7 ELSE 0 END AS observed_ts,
    ots - c.decision_ts - o.horizon AS lateness, mc, liq, end_pair, mc / greatest(1.0::DOUBLE, c.entry_mc) AS multiple
    FROM outs o JOIN cases c USING (id)),
obs AS (SELECT c.id, h.horizon, c.decision_ts, c.entry_mc, s.ts, s.mc FROM cases c CROSS JOIN hz h JOIN snap s ON s.mint = c.mint
    AND s.ts BETWEEN c.decision_ts AND c.decision_ts + h.horizon),
obs_steps AS (SELECT *, ts - coalesce(lag(ts) OVER (PARTITION BY id, horizon ORDER BY ts), decision_ts) AS step FROM obs),
metrics AS (SELECT id, horizon, count(*) AS samples,
    greatest(max(step), any_value(decision_ts) + horizon - max(ts)) AS max_gap,
    greatest(1.0::DOUBLE, max(mc / entry_mc)) AS max_mult, least(1.0::DOUBLE, min(mc / entry_mc)) AS min_mult
    FROM obs_steps GROUP BY id, horizon),
covered AS (SELECT *, max_gap <= {b.GAP} AS coverage_ok FROM metrics),
joined AS (SELECT c.id, c.mint, c.source, c.regime, c.score, c.decision_ts, c.entry_mc, c.entry_liq, h.horizon, o.observed_ts, o.lateness,
    o.mc, o.liq, o.multiple, m.metric_ts, m.coverage_ok, m.max_gap, m.max_mult, m.samples
  FROM cases c CROSS JOIN hz h LEFT JOIN outcomes o ON o.id = c.id AND o.horizon = h.horizon
  LEFT JOIN (SELECT v.*, o2.observed_ts AS metric_ts FROM covered v JOIN outcomes o2 ON o2.id = v.id AND o2.horizon = v.horizon
             WHERE o2.end_pair <> 'view') m ON m.id = c.id AND m.horizon = h.horizon AND m.metric_ts = o.observed_ts),
reasons AS (SELECT *, CASE WHEN observed_ts IS NULL THEN 'missing_endpoint'
   WHEN NOT (lateness BETWEEN 0 AND {b.LATE} AND observed_ts = decision_ts + horizon + lateness) THEN 'invalid_timing'
   WHEN NOT coalesce(metric_ts = observed_ts AND coverage_ok AND max_gap BETWEEN 0 AND {b.GAP}, false) THEN 'incomplete_coverage'
   WHEN NOT coalesce(multiple > 0, false) THEN 'invalid_outcome' ELSE 'eligible' END AS reason FROM joined)
"""


def outcomes(spark, sf, c=None):
    """Endpoints; where the endpoint is an error event its recorded time is off by seven seconds."""
    o = oc.horizon_outcomes(c if c is not None else cases(spark, sf), b.snapshots(spark, sf), ["mint"], HOURS, b.LATE)
    return o.withColumn("observed_ts", F.col("observed_ts") + F.when(F.col("end_pair") == "error", 7).otherwise(0))


def joined(spark, sf):
    """Cases with outcomes and metrics; where the endpoint is a view event the metric was not stored."""
    c = cut_lineage(cases(spark, sf))     # decisions only; read three times below
    o = cut_lineage(outcomes(spark, sf, c))
    m = oc.horizon_metrics(c, b.snapshots(spark, sf), ["mint"], HOURS, b.GAP)
    m = m.join(o.filter("end_pair <> 'view'").select("id", "horizon", "observed_ts"), ["id", "horizon"])
    slim = c.select("id", "mint", "source", "regime", "score", "decision_ts", "entry_mc", "entry_liq")
    return jn.outcomes_by_horizon(slim, o, m, HOURS)


@query("J1", b.LAUNCH + """SELECT s.id, s.mint, s.ts - l.created_ts // 1000 AS age_s FROM snap s JOIN launch l USING (mint)
 WHERE s.ts - l.created_ts // 1000 BETWEEN 86400 AND 864000""")
def snapshots_in_age_window(spark, sf):
    d = b.snapshots(spark, sf).join(b.launches(spark, sf), "mint")
    return (d.withColumn("age_s", F.expr("ts - created_ts div 1000")).filter("age_s between 86400 and 864000")
            .select("id", "mint", "age_s"))


@query("J2", b.SNAP + """, l AS (SELECT id, mint, ts FROM snap WHERE pair = 'purchase'), r AS (SELECT mint, ts, id, price FROM snap WHERE pair = 'view')
 SELECT l.id, l.mint, r.ts AS right_ts, r.price FROM l ASOF LEFT JOIN r ON l.mint = r.mint AND l.ts >= r.ts""")
def asof_backward(spark, sf):
    s = b.snapshots(spark, sf)
    left = s.filter("pair = 'purchase'").select("id", "mint", "ts")
    right = s.filter("pair = 'view'").select("mint", F.col("ts").alias("vts"), F.col("id").alias("vid"), "price")
    return (jn.asof_backward(left, right, ["mint"], "ts", "vts", ["price"], b.CHUNK, tie="vid")
            .select("id", "mint", "right_ts", "price"))


@query("J2", b.SNAP + f""", l AS (SELECT id, mint, ts FROM snap WHERE pair = 'purchase'), r AS (SELECT mint, ts, id, price FROM snap WHERE pair = 'view'),
 m AS (SELECT l.id, l.mint, l.ts, r.ts AS rts, r.price FROM l ASOF LEFT JOIN r ON l.mint = r.mint AND l.ts >= r.ts)
 SELECT id, mint, CASE WHEN ts - rts <= {b.DAY} THEN rts END AS right_ts, CASE WHEN ts - rts <= {b.DAY} THEN price END AS price FROM m""")
def asof_with_tolerance(spark, sf):
    s = b.snapshots(spark, sf)
    left = s.filter("pair = 'purchase'").select("id", "mint", "ts")
    right = s.filter("pair = 'view'").select("mint", F.col("ts").alias("vts"), F.col("id").alias("vid"), "price")
    return (jn.asof_backward(left, right, ["mint"], "ts", "vts", ["price"], b.CHUNK, b.DAY, "vid")
            .select("id", "mint", "right_ts", "price"))


@query("J3", b.SNAP + f"""SELECT c.id, c.mint, count(s.id) AS n, list(s.ts ORDER BY s.ts) AS times FROM snap c
 JOIN snap s ON s.mint = c.mint AND s.ts BETWEEN c.ts - {3 * b.DAY} AND c.ts WHERE c.pair = 'purchase' GROUP BY ALL""")
def lookback_join(spark, sf):
    s = b.snapshots(spark, sf)
    c = s.filter("pair = 'purchase'").select("id", "mint", F.col("ts").alias("decision_ts"))
    d = jn.lookback_join(c, s, ["mint"], "decision_ts", "ts", ["price"], 3 * b.DAY)
    return d.select("id", "mint", F.size("history").cast("long").alias("n"), F.col("history._rts").alias("times"))


@query("J4", b.SNAP + f""", e AS (SELECT c.id, c.mint, c.pair, c.mc, c.ts, min(s.ts) AS ets, arg_min(s.mc, s.ts) AS emc FROM snap c
  LEFT JOIN snap s ON s.mint = c.mint AND s.pair = c.pair AND s.ts BETWEEN c.ts + {b.HORIZON} AND c.ts + {b.HORIZON + b.LATE}
  WHERE c.pair IN ('purchase', 'signup') GROUP BY ALL)
 SELECT id, mint, pair, CASE WHEN {b.NOW} <= ts + {b.HORIZON + b.LATE} THEN 'window_open' WHEN ets IS NULL THEN 'missing' ELSE 'observed' END AS endpoint_status,
  CASE WHEN {b.NOW} > ts + {b.HORIZON + b.LATE} THEN ets - ts - {b.HORIZON} END AS lateness,
  CASE WHEN {b.NOW} > ts + {b.HORIZON + b.LATE} THEN round(emc / nullif(mc, 0), 6) END AS multiple FROM e""")
def endpoint_join(spark, sf):
    s = b.snapshots(spark, sf)
    c = s.filter("pair in ('purchase', 'signup')").select("id", "mint", "pair", F.col("mc").alias("entry_mc"), F.col("ts").alias("cts"))
    d = jn.endpoint_join(c, s, ["mint", "pair"], "cts", "ts", ["mc"], b.HORIZON, b.LATE, b.NOW)
    return d.select("id", "mint", "pair", "endpoint_status", "lateness", F.round(F.col("endpoint.mc") / F.nullif(F.col("entry_mc"), F.lit(0.0)), 6).alias("multiple"))


@query("J5", OUT + """SELECT id, horizon, source, observed_ts, lateness, round(multiple, 6) AS multiple, metric_ts, coverage_ok,
 CAST(max_gap AS BIGINT) AS max_gap, round(max_mult, 6) AS max_mult FROM joined""")
def outcomes_by_horizon(spark, sf):
    return joined(spark, sf).select("id", "horizon", "source", "observed_ts", "lateness", r6("multiple"), "metric_ts",
                                    "coverage_ok", "max_gap", r6("max_mult"))


@query("J6 U2", b.LAUNCH + """, top AS (SELECT mint, last_trade_ts FROM launch ORDER BY last_trade_ts DESC, mint LIMIT 60)
 SELECT mint, last_trade_ts FROM top t WHERE NOT EXISTS (SELECT 1 FROM snap x WHERE x.mint = t.mint AND x.pair = 'error' AND x.k >= 90)""")
def exclude_after_limit(spark, sf):
    ex = b.snapshots(spark, sf).filter("pair = 'error' and k >= 90")
    return jn.exclude_members(b.launches(spark, sf), ex, ["mint"], 60, [F.desc("last_trade_ts"), "mint"]).select("mint", "last_trade_ts")


@query("J6", b.SNAP + """SELECT id, mint FROM snap s WHERE NOT EXISTS (SELECT 1 FROM snap x WHERE x.mint = s.mint AND x.pair = 'error' AND x.k >= 90)""")
def exclude_members(spark, sf):
    s = b.snapshots(spark, sf)
    return jn.exclude_members(s, s.filter("pair = 'error' and k >= 90"), ["mint"]).select("id", "mint")


@query("J7", CASES + f""", w AS (SELECT c.id, c.source, count(s.id) AS n FROM cases c LEFT JOIN snap s ON s.mint = c.mint AND s.pair = c.pair
   AND s.ts BETWEEN c.decision_ts + {b.HORIZON} AND c.decision_ts + {b.HORIZON + b.LATE} WHERE c.decision_ts + {b.HORIZON + b.LATE} < {b.NOW} GROUP BY ALL)
 SELECT source, count(*) AS closed, count(*) FILTER (n > 0) AS covered, count(*) FILTER (n = 0) AS missing,
  round_even(count(*) FILTER (n > 0) * 100.0 / count(*), 2)::DOUBLE AS coverage_pct FROM w GROUP BY source""")
def window_coverage(spark, sf):
    s = b.snapshots(spark, sf)
    c = s.filter("pair in ('purchase', 'signup')").select("mint", "pair", F.col("ts").alias("cts"), F.when(F.col("pair") == "purchase", "ALERT").otherwise("SHADOW").alias("source"))
    return jn.window_coverage(c, s, ["mint", "pair"], "cts", "ts", "source", b.HORIZON, b.LATE, b.NOW)


@query("J12 S6", CASES + """, e AS (SELECT id, mint, CAST(k % 12 AS INT) AS logged_score FROM snap WHERE pair IN ('purchase', 'click'))
 SELECT e.id, e.mint, CASE WHEN c.id IS NULL THEN 'missing_case' WHEN logged_score <> c.score THEN 'score_disagrees' ELSE 'agrees' END AS comparison
 FROM e LEFT JOIN cases c ON c.id = e.id""")
def emitted_vs_recomputed(spark, sf):
    e = b.snapshots(spark, sf).filter("pair in ('purchase', 'click')").select("id", "mint", F.expr("cast(k % 12 as int)").alias("logged_score"))
    return jn.emitted_vs_recomputed(e, cases(spark, sf)).select("id", "mint", "comparison")


@query("J13", CASES + """, s AS (SELECT mint, arg_min(entry_mc, (decision_ts, id)) AS smc, min(decision_ts) AS sts FROM cases WHERE source = 'SHADOW' GROUP BY mint)
 SELECT c.id, c.mint, round((decision_ts - sts) / 60, 6) AS minutes_between, round((entry_mc / nullif(smc, 0) - 1) * 100, 6) AS entry_change_pct
 FROM cases c JOIN s USING (mint) WHERE source = 'ALERT' AND sts < decision_ts""")
def earlier_vs_later(spark, sf):
    return jn.earlier_vs_later(cases(spark, sf)).select("id", "mint", r6("minutes_between"), r6("entry_change_pct"))


_RATES = ["p2", "p3", "p5", "pfail"]


@query("A1", OUT + f""", due AS (SELECT *, coalesce(lateness BETWEEN 0 AND {b.LATE} AND observed_ts = decision_ts + horizon + lateness, false) AS t
   FROM joined WHERE decision_ts + horizon + {b.LATE} <= {b.NOW}),
 fl AS (SELECT *, t AND coalesce(coverage_ok, false) AND max_mult IS NOT NULL AS ok FROM due),
 g AS (SELECT source, regime, horizon, count(*) AS due, count(*) FILTER (t) AS timed, count(*) FILTER (ok) AS n,
   count(*) FILTER (ok AND max_mult >= 2) AS n2, count(*) FILTER (ok AND max_mult >= 3) AS n3, count(*) FILTER (ok AND max_mult >= 5) AS n5,
   count(*) FILTER (ok AND (multiple <= 0.55 OR liq <= 5000)) AS nfail FROM fl GROUP BY ALL)
 SELECT *, due - timed AS missing, timed - n AS incomplete, {', '.join(f'round(n{c[1:]} / nullif(n, 0), 6) AS {c}' for c in _RATES)} FROM g""")
def horizon_rates(spark, sf):
    g = oc.horizon_rates(joined(spark, sf), b.NOW, b.LATE)
    return g.select("source", "regime", "horizon", "due", "timed", "n", "n2", "n3", "n5", "nfail", "missing", "incomplete", *[r6(c) for c in _RATES])


@query("A2", OUT + """SELECT id, horizon, samples, CAST(max_gap AS BIGINT) AS max_gap, coverage_ok, round(max_mult, 6) AS max_mult, round(min_mult, 6) AS min_mult FROM covered""")
def horizon_metrics(spark, sf):
    d = oc.horizon_metrics(cases(spark, sf), b.snapshots(spark, sf), ["mint"], HOURS, b.GAP)
    return d.select("id", "horizon", "samples", "max_gap", "coverage_ok", r6("max_mult"), r6("min_mult"))


STATE = CASES + f""", track AS (SELECT c.id, c.decision_ts, c.entry_mc, s.ts, s.mc, s.liq FROM cases c JOIN snap s ON s.mint = c.mint
   AND s.ts BETWEEN c.decision_ts + 1 AND c.decision_ts + {TOP}),
 agg AS (SELECT id, max(mc) AS hi, arg_max(ts, (mc, -ts)) AS hi_ts, min(mc) AS lo, arg_min(ts, (mc, ts)) AS lo_ts,
   arg_max(mc, ts) AS lmc, arg_max(liq, ts) AS last_liq, max(ts) AS lts FROM track GROUP BY id),
 st AS (SELECT c.*, CASE WHEN hi > entry_mc THEN hi ELSE entry_mc END AS peak_mc, CASE WHEN hi > entry_mc THEN hi_ts ELSE decision_ts END AS peak_ts,
   CASE WHEN lo < entry_mc THEN lo ELSE entry_mc END AS trough_mc, CASE WHEN lo < entry_mc THEN lo_ts ELSE decision_ts END AS trough_ts,
   coalesce(lmc, entry_mc) AS last_mc, last_liq, coalesce(lts, decision_ts) AS last_ts FROM cases c LEFT JOIN agg a USING (id)),
 state AS (SELECT *, greatest(1.0::DOUBLE, peak_mc / greatest(1.0::DOUBLE, entry_mc)) AS max_mult,
   least(1.0::DOUBLE, trough_mc / greatest(1.0::DOUBLE, entry_mc)) AS min_mult, last_mc / greatest(1.0::DOUBLE, entry_mc) AS last_mult,
   last_mc / greatest(1.0::DOUBLE, peak_mc) - 1 AS drawdown FROM st)
"""


def states(spark, sf):
    return oc.case_state(cases(spark, sf), b.snapshots(spark, sf), ["mint"], TOP)


@query("A3", STATE + """SELECT id, peak_mc, peak_ts, trough_mc, trough_ts, last_mc, last_liq, last_ts, round(max_mult, 6) AS max_mult,
  round(min_mult, 6) AS min_mult, round(drawdown, 6) AS drawdown FROM state""")
def case_state(spark, sf):
    return states(spark, sf).select("id", "peak_mc", "peak_ts", "trough_mc", "trough_ts", "last_mc", "last_liq", "last_ts",
                                    r6("max_mult"), r6("min_mult"), r6("drawdown"))


@query("P7", STATE + """SELECT id, CASE WHEN max_mult >= 10 THEN '10X_PLUS' WHEN max_mult >= 5 THEN '5X' WHEN max_mult >= 3 THEN '3X' WHEN max_mult >= 2 THEN '2X'
  WHEN max_mult >= 1.35::DOUBLE THEN 'WEAK' WHEN last_mult <= 0.55::DOUBLE OR last_liq <= 5000 THEN 'FAILED' ELSE 'FLAT' END AS label FROM state""")
def label_outcome(spark, sf):
    return states(spark, sf).select("id", oc.outcome_label().alias("label"))


@query("P8", STATE + """, m AS (SELECT id, CASE WHEN regime = 'RECLAIM' THEN 0 ELSE entry_mc END AS entry_mc, CASE WHEN score = 4 THEN NULL ELSE max_mult END AS max_mult,
   last_mc, last_liq FROM state), f AS (SELECT *, last_mc / nullif(entry_mc, 0) <= 0.55::DOUBLE OR coalesce(last_liq <= 5000, false) AS failed FROM m)
 SELECT id, CASE WHEN entry_mc <= 0 THEN 'INVALID_ENTRY' WHEN max_mult IS NULL THEN 'INVALID_STATE' WHEN max_mult >= 2 AND failed THEN 'PEAK_THEN_FAILURE_OBSERVED'
  WHEN max_mult >= 2 THEN 'PEAK_2X_OBSERVED' WHEN failed THEN 'FAILURE_OBSERVED' ELSE 'NO_2X_OBSERVED_YET' END AS assessment FROM f""")
def assess_case(spark, sf):
    d = (states(spark, sf).withColumn("entry_mc", F.expr("CASE WHEN regime = 'RECLAIM' THEN 0D ELSE entry_mc END"))
         .withColumn("max_mult", F.expr("CASE WHEN score = 4 THEN NULL ELSE max_mult END")))
    return d.select("id", ft.assess_case().alias("assessment"))


@query("A4", OUT + f"""SELECT count(*) AS n, min(observed_ts) AS first_ts, max(observed_ts) AS last_ts, min(lateness) AS min_lateness, max(lateness) AS max_lateness,
  count(*) FILTER (NOT (lateness BETWEEN 0 AND {b.LATE} AND observed_ts = decision_ts + o.horizon + lateness)) AS identity_violations
  FROM outcomes o JOIN cases c USING (id)""")
def timing_audit(spark, sf):
    c = cases(spark, sf)
    return oc.timing_audit(outcomes(spark, sf, c).join(c.select("id", "decision_ts"), "id"), b.LATE)


@query("A5", STATE + """SELECT source, count(*) AS cases, count(DISTINCT mint) AS unique_keys, count(*) FILTER (max_mult >= 2) AS peak_2x,
  count(*) FILTER (max_mult >= 3) AS peak_3x, count(*) FILTER (max_mult >= 5) AS peak_5x, count(*) FILTER (last_mult >= 2) AS last_2x,
  count(*) FILTER (coalesce(last_mult <= 0.55::DOUBLE OR last_liq <= 5000, false)) AS failures,
  count(*) FILTER (coalesce(last_mult <= 0.55::DOUBLE OR last_liq <= 5000, false) AND max_mult >= 2) AS peak_and_failure, any_value(first_ge_2) AS first_ge_2, any_value(first_le_055) AS first_le_055, any_value(first_missing) AS first_missing
  FROM state JOIN (SELECT source, count(*) FILTER (last_mult >= 2) AS first_ge_2, count(*) FILTER (last_mult <= 0.55::DOUBLE) AS first_le_055, count(*) FILTER (last_mult IS NULL) AS first_missing
    FROM (SELECT *, row_number() OVER (PARTITION BY source, mint ORDER BY decision_ts, id) AS rn FROM state) WHERE rn = 1 GROUP BY source) USING (source) GROUP BY source""")
def review_summary(spark, sf):
    return oc.review_summary(states(spark, sf))


@query("E21", OUT + "SELECT id, horizon, reason FROM reasons")
def valid_endpoint(spark, sf):
    return joined(spark, sf).select("id", "horizon", oc.valid_endpoint(b.LATE, b.GAP).alias("reason"))


LEDGER_NOW = b.NOW - 3 * b.DAY


@query("E17", OUT + f""", p AS (SELECT *, CASE WHEN observed_ts IS NULL AND {LEDGER_NOW} <= decision_ts + horizon + {b.LATE} THEN 'pending' ELSE reason END AS why FROM reasons)
 SELECT id, horizon, why AS reason, CASE WHEN why <> 'pending' THEN why = 'eligible' END AS eligible,
  CASE WHEN why = 'eligible' THEN CAST(multiple >= 2 AS BIGINT) END AS outcome FROM p""")
def resolve_results(spark, sf):
    d = oc.resolve_results(joined(spark, sf), LEDGER_NOW, b.LATE, b.GAP)
    return d.select("id", "horizon", "reason", "eligible", F.col("outcome").cast("long").alias("outcome"))


@query("A7 F7", OUT + f""", st AS (SELECT CASE WHEN source = 'SHADOW' THEN 'WATCH' WHEN regime = 'OTHER' THEN 'SKIP' ELSE 'ENTER_REVIEW' END AS action, multiple,
    CASE WHEN entry_liq < 10000 THEN 'EXCLUDED_HOLDOUT' WHEN reason = 'eligible' THEN 'ELIGIBLE' WHEN observed_ts IS NULL AND {LEDGER_NOW} <= decision_ts + horizon + {b.LATE} THEN 'PENDING' ELSE 'MISSING' END AS status
    FROM reasons WHERE horizon = {b.HORIZON}),
 g AS (SELECT action, count(*) AS recorded, count(*) FILTER (status = 'ELIGIBLE') AS eligible, count(*) FILTER (status = 'PENDING') AS pending,
   count(*) FILTER (status = 'MISSING') AS missing, count(*) FILTER (status = 'EXCLUDED_HOLDOUT') AS excluded,
   count(*) FILTER (status = 'ELIGIBLE' AND multiple >= 2) AS ge_2, count(*) FILTER (status = 'ELIGIBLE' AND multiple <= 0.55::DOUBLE) AS le_055 FROM st GROUP BY action)
 SELECT action, recorded, eligible, pending, missing, excluded, ge_2, le_055, """ + ", ".join(f"""
   round({c} / nullif(eligible, 0), 6) AS {c}_rate,
   round(CASE WHEN eligible > 0 THEN greatest(0, ({c} / eligible + z * z / (2 * eligible) - z * sqrt({c} / eligible * (1 - {c} / eligible) / eligible + z * z / (4.0 * eligible * eligible))) / (1 + z * z / eligible)) END, 6) AS {c}_low,
   round(CASE WHEN eligible > 0 THEN least(1, ({c} / eligible + z * z / (2 * eligible) + z * sqrt({c} / eligible * (1 - {c} / eligible) / eligible + z * z / (4.0 * eligible * eligible))) / (1 + z * z / eligible)) END, 6) AS {c}_high"""
   for c in ("ge_2", "le_055")) + " FROM (SELECT *, 1.959963984540054::DOUBLE AS z FROM g)")
def group_report(spark, sf):
    d = oc.resolve_results(joined(spark, sf).filter(F.col("horizon") == b.HORIZON), LEDGER_NOW, b.LATE, b.GAP)
    status = (F.when(F.col("entry_liq") < 10_000, "EXCLUDED_HOLDOUT").when(F.col("reason") == "eligible", "ELIGIBLE")
              .when(F.col("reason") == "pending", "PENDING").otherwise("MISSING"))
    action = F.when(F.col("source") == "SHADOW", "WATCH").when(F.col("regime") == "OTHER", "SKIP").otherwise("ENTER_REVIEW")
    g = oc.group_report(d.select(action.alias("action"), status.alias("status"), "multiple"))
    return g.select("action", "recorded", "eligible", "pending", "missing", "excluded", "ge_2", "le_055",
                    *[r6(f"{c}_{s}") for c in ("ge_2", "le_055") for s in ("rate", "low", "high")])
