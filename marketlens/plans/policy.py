"""Eligibility, validation and evidence-policy queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketlens import bindings as b
from marketlens.operators import policy as po
from marketlens.operators.features import SIGNALS
from marketlens.plans.market import SCORED, r6, scored
from marketlens.registry import query

MS = 1000 * b.DAY
NAMES = "[" + ", ".join(f"'{c}'" for c in po.CHECKS) + "]"


@query("P1", b.LAUNCH + f"""SELECT mint, current_mc FROM launch WHERE created_ts BETWEEN {b.NOW * 1000 - 29 * MS} AND {b.NOW * 1000 - MS} AND last_trade_ts >= {b.NOW * 1000 - MS // 2}
 AND current_mc BETWEEN 10000 AND 750000 AND (ath_mc IS NULL OR ath_mc <= 0 OR current_mc >= ath_mc * 0.2::DOUBLE)""")
def eligible_candidates(spark, sf):
    rule = po.eligible_candidates(b.NOW * 1000, (MS, 29 * MS), MS // 2, (10_000, 750_000), 0.2)
    return b.launches(spark, sf).filter(rule).select("mint", "current_mc")


@query("T1 P1", b.LAUNCH + "SELECT mint, last_trade_ts FROM launch ORDER BY last_trade_ts DESC, mint LIMIT 60")
def newest_candidates(spark, sf):
    return b.launches(spark, sf).orderBy(F.desc("last_trade_ts"), "mint").limit(60).select("mint", "last_trade_ts")


_SUM = " + ".join(f"sig_{s}::INT" for s in SIGNALS)
VALID = SCORED + f""", l AS (SELECT mint, min(ts) AS created_ts FROM snap GROUP BY mint),
 cap AS (SELECT s.*, created_ts, s.ts AS captured_ts, s.ts - (k % 30) * 60 AS snapshot_ts, CASE WHEN pair = 'error' THEN 99 ELSE {_SUM} END AS emitted,
   CASE WHEN k = 13 THEN 'nothex' ELSE sha256(id::VARCHAR) END AS input_sha256, ts // 3600 * 3600 + 3600 AS cycle_ts FROM scored s JOIN l USING (mint)),
 v AS (SELECT id, mint, cycle_ts, list_filter([CASE WHEN NOT (captured_ts - created_ts BETWEEN 86400 AND 2160000) THEN 'age' END, CASE WHEN captured_ts - snapshot_ts > 1500 THEN 'snapshot' END,
   CASE WHEN cycle_ts - captured_ts > 1500 THEN 'contemporaneous' END, CASE WHEN emitted <> {_SUM} THEN 'score' END, CASE WHEN k = 13 THEN 'hash' END], lambda x: x IS NOT NULL) AS violations FROM cap)
"""


def captured(spark, sf):
    d = scored(spark, sf)
    created = b.snapshots(spark, sf).groupBy("mint").agg(F.min("ts").alias("created_ts"))
    total = sum((F.col(f"sig_{s}").cast("int") for s in SIGNALS), F.lit(0))
    d = (d.join(created, "mint").withColumn("captured_ts", F.col("ts")).withColumn("snapshot_ts", F.expr("ts - (k % 30) * 60"))
         .withColumn("score", F.when(F.col("pair") == "error", 99).otherwise(total)).withColumn("vol1", F.col("vol_h1"))
         .withColumn("input_sha256", F.expr("CASE WHEN k = 13 THEN 'nothex' ELSE sha2(cast(id as string), 256) END"))
         .withColumn("cycle_ts", F.expr("ts div 3600 * 3600 + 3600")))
    return po.validate_rows(d, F.col("cycle_ts"), (b.DAY, 25 * b.DAY), 1500, [f"sig_{s}" for s in SIGNALS], "cycle_ts")


@query("P9", VALID + """, pk AS (SELECT cycle_ts, mint, count(*) AS n, max(len(violations)) AS w FROM v GROUP BY ALL), ok AS (SELECT cycle_ts, max(n) = 1 AND max(w) = 0 AS cycle_valid FROM pk GROUP BY cycle_ts)
 SELECT id, v.mint, violations, cycle_valid FROM v JOIN ok USING (cycle_ts)""")
def validate_rows(spark, sf):
    return captured(spark, sf).select("id", "mint", "violations", "cycle_valid")


@query("A9", VALID + """, pk AS (SELECT cycle_ts, mint, count(*) AS n, max(len(violations)) AS w FROM v GROUP BY ALL), ok AS (SELECT cycle_ts, max(n) = 1 AND max(w) = 0 AS cycle_valid FROM pk GROUP BY cycle_ts),
 r AS (SELECT cycle_ts, count(*) AS entries FROM v JOIN ok USING (cycle_ts) WHERE NOT cycle_valid GROUP BY cycle_ts)
 SELECT strftime(to_timestamp(cycle_ts) AT TIME ZONE 'UTC', '%Y-%m-%d') AS utc_day, CASE WHEN grouping(cycle_ts // 3600) = 1 THEN -1 ELSE cycle_ts // 3600 END AS utc_hour, CAST(grouping(cycle_ts // 3600) AS BIGINT) AS is_daily,
  count(*) AS cycles, CAST(sum(entries) AS BIGINT) AS discarded_entries FROM r GROUP BY GROUPING SETS ((strftime(to_timestamp(cycle_ts) AT TIME ZONE 'UTC', '%Y-%m-%d'), cycle_ts // 3600), (strftime(to_timestamp(cycle_ts) AT TIME ZONE 'UTC', '%Y-%m-%d')))""")
def rejection_rollup(spark, sf):
    from marketlens.operators.reports import rejection_rollup as roll
    r = captured(spark, sf).filter("NOT cycle_valid").groupBy("cycle_ts").agg(F.count(F.lit(1)).alias("entries"))
    return roll(r, "cycle_ts", {"discarded_entries": "entries"})


# Seven checks per observation, derived from its activity figure.
CHK = SCORED + f""", chk AS (SELECT s.*, i, ({NAMES})[i + 1] AS name, CASE WHEN (k * 3 + i * 29) % 97 < 78 THEN 'PASS' WHEN (k * 3 + i * 29) % 97 < 90 THEN 'UNKNOWN' ELSE 'REJECT' END AS status,
   CASE WHEN (k * 3 + i * 29) % 2 = 0 THEN 'young_wallet_exposure' ELSE 'concentration_policy_exceeded' END AS reason,
   ts - ((k + i * 11) % 100) * 4 AS observed_at, CASE WHEN (k + i) % 41 = 0 THEN [' '] WHEN (k + i) % 43 = 0 THEN [] ELSE ['ref-' || id] END AS refs FROM scored s, range(7) r(i)),
 ev7 AS (SELECT *, (ts - observed_at BETWEEN 0 AND 300) AND len(refs) > 0 AND len(list_filter(refs, lambda x: trim(x) = '')) = 0 AS ok FROM chk)
"""


def checked(spark, sf):
    parts = []
    for i, name in enumerate(po.CHECKS):
        h = f"(k * 3 + {i * 29}) % 97"
        parts.append(F.struct(
            F.lit(name).alias("name"), F.expr(f"CASE WHEN {h} < 78 THEN 'PASS' WHEN {h} < 90 THEN 'UNKNOWN' ELSE 'REJECT' END").alias("status"),
            F.expr(f"CASE WHEN (k * 3 + {i * 29}) % 2 = 0 THEN 'young_wallet_exposure' ELSE 'concentration_policy_exceeded' END").alias("reason"),
            F.expr(f"ts - ((k + {i * 11}) % 100) * 4").alias("observed_at"),
            F.expr(f"CASE WHEN (k + {i}) % 41 = 0 THEN array(' ') WHEN (k + {i}) % 43 = 0 THEN cast(array() as array<string>) ELSE array(concat('ref-', id)) END").alias("refs")))
    # A row to a row: the list is made once, where a filter on it would go down to the scan and make it, and parse ``k``, at every mention.
    return scored(spark, sf).withColumn("checks", F.explode(F.array(F.array(*parts))))


@query("P10", CHK + "SELECT id, name, ok AS valid FROM ev7")
def evidence_valid(spark, sf):
    d = checked(spark, sf).select("id", "ts", F.explode("checks").alias("c"))
    return d.select("id", F.col("c.name").alias("name"), po.evidence_valid(F.col("c"), F.col("ts")).alias("valid"))


VERDICT = CHK + """, req AS (SELECT id, list(name ORDER BY i) FILTER (status = 'REJECT') AS rej,
   list(name || CASE WHEN NOT ok THEN ':evidence_missing_or_stale' ELSE ':unresolved' END ORDER BY i) FILTER (i >= 4 AND status <> 'REJECT' AND (NOT ok OR status <> 'PASS')) AS held FROM ev7 GROUP BY id),
 vd AS (SELECT s.id, s.k, s.pair, coalesce(rej, []) AS rej, CASE WHEN k % 10 = 3 THEN ['token_authority_unverified'] ELSE [] END || coalesce(held, []) AS open FROM scored s JOIN req USING (id)),
 pv AS (SELECT id, CASE WHEN pair = 'error' OR k % 23 = 0 THEN 'HOLD' WHEN k % 31 = 0 THEN 'REJECT' WHEN len(rej) > 0 THEN 'REJECT' WHEN len(open) > 0 THEN 'HOLD' ELSE 'PASS' END AS verdict,
   CASE WHEN pair = 'error' THEN ['identity_or_policy_mismatch'] WHEN k % 23 = 0 THEN ['stale_or_invalid_review'] WHEN k % 31 = 0 THEN ['active_token_authority'] WHEN len(rej) > 0 THEN rej || open ELSE open END AS reasons FROM vd)
"""


def verdicts(spark, sf):
    return po.prealert_verdict(checked(spark, sf), "checks", F.col("ts"), F.col("pair") != "error", F.expr("CASE WHEN k % 23 = 0 THEN ts - 301 ELSE ts - 10 END"),
                               F.expr("CASE WHEN k % 31 = 0 THEN 'ACTIVE' WHEN k % 10 = 3 THEN 'UNKNOWN' ELSE 'REVOKED' END"))


@query("P11", VERDICT + "SELECT id, verdict, reasons FROM pv")
def screening_verdict(spark, sf):
    return verdicts(spark, sf).select("id", "verdict", "reasons")


@query("P11", CHK + "SELECT id, CASE WHEN bool_or(status = 'REJECT') THEN 'REJECT' WHEN bool_and(ok AND status = 'PASS') THEN 'PASS' ELSE 'HOLD' END AS verdict FROM ev7 GROUP BY id")
def seven_check_verdict(spark, sf):
    # A reject stands whatever its age; only passes need fresh evidence.
    d = checked(spark, sf)
    soft = F.transform("checks", lambda c: c.withField("status", F.when(po.evidence_valid(c, F.col("ts")) | (c["status"] == "REJECT"), c["status"]).otherwise("UNKNOWN")))
    return d.withColumn("checks", soft).select("id", po.seven_check_verdict("checks").alias("verdict"))


GAPS = b.SNAP + f""", g AS (SELECT id, ts, k % 6 AS g FROM snap),
 e AS (SELECT id, g, ({NAMES})[CASE WHEN g = 0 AND i = 6 THEN 6 WHEN i = 7 THEN CASE g WHEN 3 THEN 1 ELSE 6 END ELSE i + 1 END] AS name,
   CASE WHEN g = 1 AND i = 4 THEN NULL WHEN g = 3 AND i = 7 THEN 'REJECT' ELSE 'PASS' END AS status, NOT (g = 4 AND i = 7) AS ok FROM g, range(8) r(i) WHERE g <> 2 AND (i < 7 OR g IN (3, 4))),
 n AS (SELECT id, i, ({NAMES})[i + 1] AS name FROM g, range(7) r(i)),
 w AS (SELECT n.id, n.i, n.name, count(e.name) AS there, coalesce(bool_or(status = 'REJECT'), false) AS rej, coalesce(bool_and(coalesce(status = 'PASS', false)), false) AS good, coalesce(bool_and(ok), false) AS ok FROM n LEFT JOIN e ON e.id = n.id AND e.name = n.name GROUP BY ALL),
 v AS (SELECT id, list(name ORDER BY i) FILTER (rej) AS rej, list(name || CASE WHEN there = 0 THEN ':missing' WHEN NOT ok THEN ':evidence_missing_or_stale' ELSE ':unresolved' END ORDER BY i) FILTER (i >= 4 AND NOT rej AND NOT (there > 0 AND ok AND good)) AS held,
   bool_and(there > 0 AND good) AS seven, bool_and(i < 4 OR (there > 0 AND good AND ok)) AS need, bool_and(i >= 4 OR (there > 0 AND good AND ok)) AS rest, bool_and(there > 0 AND (good OR rej)) AS known FROM w GROUP BY id)
"""


def gapped(spark, sf):
    """Reviews that pass but for one flaw: a check doubled over another one, one without a status, no list, a second entry that rejects or is stale, or none."""
    entry = lambda n, st="'PASS'", age=10: f"named_struct('name', '{n}', 'status', {st}, 'reason', 'r', 'observed_at', ts - {age}, 'refs', array('ref'))"
    base = [entry(n) for n in po.CHECKS]
    kinds = [[*base[:6], base[5]], [*base[:4], entry(po.CHECKS[4], "CAST(NULL AS STRING)"), *base[5:]], None, [*base, entry(po.CHECKS[0], "'REJECT'")], [*base, entry(po.CHECKS[5], age=301)], base]
    cases = " ".join(f"WHEN {i} THEN array({', '.join(k)})" for i, k in enumerate(kinds) if k)
    return b.snapshots(spark, sf).select("id", "ts", F.expr(f"CASE k % 6 {cases} END").alias("checks"))


@query("P11 P12 P13 P21", GAPS + """SELECT g.id, CASE WHEN g = 2 THEN 'HOLD' WHEN rej IS NOT NULL THEN 'REJECT' WHEN held IS NOT NULL THEN 'HOLD' ELSE 'PASS' END AS verdict, CASE WHEN g = 2 THEN ['missing_checks'] ELSE coalesce(rej, []) || coalesce(held, []) END AS reasons,
 CASE WHEN rej IS NOT NULL THEN 'REJECT' WHEN seven THEN 'PASS' ELSE 'HOLD' END AS seven, CASE WHEN rej IS NOT NULL THEN 'SKIP' WHEN seven THEN 'ENTER_REVIEW' ELSE 'WATCH' END AS action,
 CASE WHEN rej IS NOT NULL THEN 'REJECT' WHEN known THEN 'SHADOW_ELIGIBLE' ELSE 'HOLD' END AS variant, rej IS NULL AND need AS relay, CASE WHEN rest THEN 'SCREENING COMPLETE' ELSE 'EARLY WATCH' END AS class FROM g JOIN v USING (id)""")
def named_evidence(spark, sf):
    d = po.prealert_verdict(gapped(spark, sf), "checks", F.col("ts"), F.lit(True), F.col("ts"), F.lit("REVOKED"))
    d = d.withColumns({"score": F.lit(9), "band": F.lit(0.1), "vol_accel": F.lit(2.0), "liq_change_now": F.lit(0.0), "last_alert_ts": F.col("ts"), "checked_at": F.col("ts"), "mc": F.lit(9000.0), "liq": F.lit(1.0), "price": F.lit(1.0),
                       "mint": F.lit("m"), "pair": F.lit("p"), "review_mint": F.lit("m"), "review_pair": F.lit("p"), "said": F.col("verdict")}).withColumn("verdict", F.lit("PASS"))
    relay = po.relay_eligible(F.col("ts"), "checks", (5_000, 200_000), 0)
    d = po.policy_variants(d.withColumns({"seven": po.seven_check_verdict("checks"), "action": po.paper_decision("checks")[0], "relay": relay, "class": po.relay_class(F.col("ts"), "checks")}).drop("verdict"), "checks", {"current": {}})
    return d.select("id", F.col("said").alias("verdict"), "reasons", "seven", "action", F.col("verdict").alias("variant"), "relay", "class")


VARIANTS = {"current": {}, "age_warning": {"wallet_age": "young_wallet_exposure"},
            "age_and_concentration_warning": {"wallet_age": "young_wallet_exposure", "top_holder_ownership": "concentration_policy_exceeded"}}


@query("P12", CHK + """, w AS (SELECT *, unnest(['current', 'age_warning', 'age_and_concentration_warning']) AS variant FROM chk),
 s AS (SELECT *, (variant <> 'current' AND name = 'wallet_age' AND reason = 'young_wallet_exposure') OR (variant = 'age_and_concentration_warning' AND name = 'top_holder_ownership' AND reason = 'concentration_policy_exceeded') AS soft FROM w),
 t AS (SELECT id, variant, CASE WHEN bool_or(status = 'REJECT' AND NOT soft) THEN 'REJECT' WHEN bool_or(status = 'UNKNOWN') THEN 'HOLD' ELSE 'SHADOW_ELIGIBLE' END AS verdict, count(*) FILTER (status = 'REJECT' AND soft) AS w FROM s GROUP BY ALL)
 SELECT variant, verdict, count(*) AS n, CAST(sum(w) AS BIGINT) AS warnings FROM t GROUP BY ALL""")
def policy_variants(spark, sf):
    d = po.policy_variants(checked(spark, sf).select("id", "checks"), "checks", VARIANTS)
    return d.groupBy("variant", "verdict").agg(F.count(F.lit(1)).alias("n"), F.sum("warnings").alias("warnings"))


@query("A16", CHK + 'SELECT name AS "check", status, reason, count(*) AS n FROM chk GROUP BY ALL')
def check_reason_histogram(spark, sf):
    return po.reason_histogram(checked(spark, sf), "checks")


PAPER = CHK + """, n7 AS (SELECT id, bool_or(ok AND status = 'REJECT') AS rej, count(*) FILTER (ok AND status = 'PASS') AS np FROM ev7 GROUP BY id),
 pd7 AS (SELECT s.*, CASE WHEN rej THEN 'explicit_screening_reject' WHEN np < 7 THEN 'incomplete_seven_check_evidence' WHEN liq_change_now IS NULL THEN 'missing_features'
   WHEN score >= 5 AND band <= 8 AND vol_accel >= 0.5::DOUBLE AND liq_change_now >= -0.9::DOUBLE THEN 'frozen_paper_filter_only' ELSE 'paper_market_filter_not_met' END AS why FROM scored s JOIN n7 USING (id))
"""


def papers(spark, sf):
    d = checked(spark, sf).withColumn("checks", po.normalise_checks("checks", F.col("ts")))
    action, why = po.paper_decision("checks", 5, 8.0, 0.5, -0.9)
    return d.withColumn("action", action).withColumn("reason", why)


@query("P13", PAPER + """SELECT id, CASE why WHEN 'explicit_screening_reject' THEN 'SKIP' WHEN 'frozen_paper_filter_only' THEN 'ENTER_REVIEW' ELSE 'WATCH' END AS action, why AS reason FROM pd7""")
def paper_decision(spark, sf):
    return papers(spark, sf).select("id", "action", "reason")


@query("A8", PAPER + """SELECT ts // 86400 AS day, count(*) AS cases, count(*) FILTER (pair <> 'error') AS after_exclusion, count(*) FILTER (pair <> 'error' AND points >= 4) AS valid_features,
 count(*) FILTER (pair <> 'error' AND points >= 4 AND why NOT IN ('explicit_screening_reject', 'incomplete_seven_check_evidence')) AS all_seven_pass,
 count(*) FILTER (pair <> 'error' AND points >= 4 AND why = 'frozen_paper_filter_only') AS entered FROM pd7 GROUP BY 1""")
def journal_funnel(spark, sf):
    from marketlens.operators.reports import staged_funnel
    return staged_funnel(papers(spark, sf).withColumn("day", F.expr("ts div 86400")), ["day"], [
        ("after_exclusion", F.col("pair") != "error"), ("valid_features", F.col("points") >= 4),
        ("all_seven_pass", ~F.col("reason").isin("explicit_screening_reject", "incomplete_seven_check_evidence")),
        ("entered", F.col("reason") == "frozen_paper_filter_only")], total="cases")


@query("P14", b.SNAP + """, p AS (SELECT mint, pair, max(liq) AS liq FROM snap WHERE pair <> 'view' GROUP BY ALL), pin AS (SELECT mint, CASE WHEN max(k) >= 97 THEN 'purchase' WHEN max(k) >= 95 THEN 'nowhere' END AS pinned FROM snap GROUP BY mint),
 r AS (SELECT p.*, pinned, row_number() OVER (PARTITION BY mint ORDER BY liq DESC, pair) AS rn FROM p JOIN pin USING (mint) WHERE CASE WHEN pinned IS NOT NULL THEN pair = pinned ELSE pair <> 'error' END)
 SELECT mint, pair, liq, pinned IS NOT NULL AS was_pinned FROM r WHERE rn = 1""")
def choose_pair(spark, sf):
    s = b.snapshots(spark, sf)
    p = s.filter("pair <> 'view'").groupBy("mint", "pair").agg(F.max("liq").alias("liq"))
    pin = s.groupBy("mint").agg(F.expr("CASE WHEN max(k) >= 97 THEN 'purchase' WHEN max(k) >= 95 THEN 'nowhere' END").alias("pinned"))
    d = p.join(pin, "mint").withColumn("quote", F.expr("CASE WHEN pair = 'error' THEN 'USDC' ELSE 'SOL' END"))
    return po.choose_pair(d).join(pin, "mint").select("mint", "pair", "liq", F.col("pinned").isNotNull().alias("was_pinned"))


@query("P15", b.SNAP + """, a AS (SELECT id, k, CASE WHEN k % 11 = 0 THEN 'unverified_token_account' WHEN k % 7 = 0 OR k % 13 = 0 THEN 'active_mint_or_freeze_authority' WHEN k = 0 THEN 'unverified_token_account'
  WHEN k % 5 = 0 THEN 'unsupported_token_extensions' ELSE 'revoked_authorities' END AS reason FROM snap)
 SELECT id, CASE reason WHEN 'active_mint_or_freeze_authority' THEN 'REJECT' WHEN 'revoked_authorities' THEN 'PASS' ELSE 'UNKNOWN' END AS status, reason FROM a""")
def check_token_controls(spark, sf):
    doc = F.struct((F.col("k") % 11 != 0).alias("program_ok"), F.lit(False).alias("executable"), F.lit(True).alias("initialized"),
                   F.when(F.col("k") % 7 == 0, F.lit("a")).alias("mint_authority"), F.when(F.col("k") % 13 == 0, F.lit("f")).alias("freeze_authority"),
                   F.col("k").alias("supply"), F.expr("CASE WHEN k % 5 = 0 THEN array('metadataPointer', 'transferHook') ELSE array('tokenMetadata') END").alias("extensions"))
    d = b.snapshots(spark, sf).withColumn("account", doc).withColumn("c", po.check_token_controls())
    return d.select("id", "c.status", "c.reason")


@query("P20", b.SNAP + """, w AS (SELECT mint AS pool, pair AS side, max(k) AS mk, min(k) AS amount FROM snap WHERE pair IN ('view', 'click') GROUP BY ALL), v AS (SELECT pool, side, CASE WHEN mk % 17 = 0 THEN -1 ELSE pool END AS owner, CASE WHEN mk % 19 = 0 THEN 'd' END AS delegate, amount FROM w),
 g AS (SELECT pool, count(DISTINCT side) AS sides, bool_or(owner <> pool) AS bad, bool_or(delegate IS NOT NULL) AS del, min(amount) AS lo FROM v GROUP BY pool),
 p AS (SELECT mint AS pool, max(k) % 4 AS lp FROM snap GROUP BY mint),
 r AS (SELECT pool, CASE WHEN coalesce(sides, 0) < 2 THEN 'missing_lp_or_vault_accounts' WHEN bad THEN 'vault_relationship_or_state_mismatch' WHEN del THEN 'vault_delegate_or_close_authority' WHEN lo <= 0 THEN 'empty_pool_reserve'
   WHEN lp = 0 THEN 'authenticated_vaults_zero_redeemable_lp' ELSE 'unresolved_lp_or_pool_controls' END AS reason FROM p LEFT JOIN g USING (pool))
 SELECT pool, CASE reason WHEN 'empty_pool_reserve' THEN 'REJECT' WHEN 'authenticated_vaults_zero_redeemable_lp' THEN 'PASS' ELSE 'UNKNOWN' END AS status, reason FROM r""")
def check_liquidity(spark, sf):
    s = b.snapshots(spark, sf)
    v = s.filter("pair in ('view', 'click')").groupBy(F.col("mint").alias("pool"), F.col("pair").alias("side")).agg(
        F.max("k").alias("mk"), F.min("k").alias("amount"))
    v = v.select("pool", "side", F.expr("CASE WHEN mk % 17 = 0 THEN -1 ELSE pool END").alias("owner"), F.lit(True).alias("mint_ok"),
                 F.lit("initialized").alias("state"), F.expr("CASE WHEN mk % 19 = 0 THEN 'd' END").alias("delegate"), "amount")
    p = s.groupBy(F.col("mint").alias("pool")).agg(F.expr("max(k) % 4").alias("lp_supply")).select(
        "pool", "lp_supply", F.col("pool").alias("lp_authority"), F.lit(None).cast("string").alias("freeze"), F.lit(True).alias("flags_ok"))
    return po.check_liquidity(p, v).select("pool", "status", "reason")


RELAY = VERDICT + """, rl AS (SELECT s.id, s.k, s.pair, s.mc, s.liq, p.verdict, s.ts FROM scored s JOIN pv p USING (id)),
 good AS (SELECT id, count(*) FILTER (i >= 4 AND ok AND status = 'PASS') AS req, count(*) FILTER (i < 4 AND ok AND status = 'PASS') AS rest, bool_or(status = 'REJECT') AS rej FROM ev7 GROUP BY id)
"""


@query("P21", RELAY + """SELECT id, CASE WHEN rest = 4 THEN 'SCREENING COMPLETE' ELSE 'EARLY WATCH' END AS class FROM rl JOIN good USING (id)
 WHERE verdict = 'PASS' AND mc BETWEEN 5000 AND 200000 AND liq > 0 AND k % 6 <> 0 AND req = 3 AND NOT rej""")
def relay_eligible(spark, sf):
    d = verdicts(spark, sf).select("id", "mint", "pair", "k", "mc", "liq", "price", "verdict", "checks", "ts", F.col("ts").alias("now"), F.col("ts").alias("last_alert_ts"),
                                   F.col("ts").alias("checked_at"), F.expr("CASE WHEN k % 6 = 0 THEN -1 ELSE mint END").alias("review_mint"), F.col("pair").alias("review_pair"))
    d = d.filter(po.relay_eligible(F.col("now"), "checks", (5_000, 200_000), 0))
    return d.select("id", po.relay_class(F.col("now"), "checks").alias("class"))
