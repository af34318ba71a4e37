"""Holdings, transfer-graph and reconciliation queries over orders and line items."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketlens import bindings as b
from marketlens.operators import accounting as acc
from marketlens.operators import graph as gr
from marketlens.operators import holdings as ho
from marketlens.operators import joins as jn
from marketlens.operators import policy as po
from marketlens.operators import reports as rp
from marketlens.plans.market import r6
from marketlens.registry import query
from marketlens.session import cut_lineage, written

SINCE = 999_302_400      # 2001-09-01
WALLET_NOW = 1_004_832_000   # 2001-11-04

LINES = """WITH ln AS (SELECT l_orderkey, l_linenumber, l_partkey AS token, l_suppkey, 'c' || o_custkey AS owner, l_orderkey * 10 + l_linenumber AS account, CAST(l_quantity AS BIGINT) AS amount,
  l_returnflag AS rf, l_linestatus AS ls, epoch_us(l_shipdate) // 1000000 AS block_time, o_orderstatus, o_orderpriority FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
"""
HOLD = LINES + """, tok0 AS (SELECT token, sum(amount) AS total, arg_min(owner, (account, owner)) AS creator, arg_max(owner, (account, owner)) AS pool, max(account) AS vault FROM ln GROUP BY token),
 tok AS (SELECT t.*, CAST(total + CASE WHEN p_size % 4 = 0 THEN 5 ELSE 0 END AS BIGINT) AS supply, p_size FROM tok0 t JOIN part ON p_partkey = token),
 own AS (SELECT l.token, l.owner, sum(amount) AS amount, count(*) AS accounts, sum(amount) / any_value(supply) * 100 AS pct FROM ln l JOIN tok USING (token) GROUP BY ALL)
"""


def lines(spark, sf):
    li, od = b.table(spark, sf, "lineitem"), b.table(spark, sf, "orders")
    d = li.join(od, li.l_orderkey == od.o_orderkey)
    return d.select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("token"), "l_suppkey", F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("owner"),
                    F.expr("l_orderkey * 10 + l_linenumber").alias("account"), F.col("l_quantity").cast("long").alias("amount"), F.col("l_returnflag").alias("rf"),
                    F.col("l_linestatus").alias("ls"), b.epoch("l_shipdate").alias("block_time"), "o_orderstatus", "o_orderpriority")


def tokens(spark, sf, ln=None):
    d = (ln if ln is not None else lines(spark, sf))
    o = F.struct("account", "owner")
    t = d.groupBy("token").agg(F.sum("amount").alias("total"), F.min_by("owner", o).alias("creator"), F.max_by("owner", o).alias("pool"), F.max("account").alias("vault"))
    p = b.table(spark, sf, "part").select(F.col("p_partkey").alias("token"), "p_size")
    return t.join(p, "token").withColumn("supply", F.col("total") + F.when(F.col("p_size") % 4 == 0, 5).otherwise(0))


def census(spark, sf):
    ln = lines(spark, sf)
    return ho.holder_census(ln, tokens(spark, sf, ln))


def stored_census(spark, sf):
    """The census as a written table, for checks that read it more than once."""
    return stored_holdings(spark, sf)[0]


def stored_holdings(spark, sf):
    """The census and the tokens it rests on, each made once and written compressed."""
    ln = lines(spark, sf)
    t = written(tokens(spark, sf, ln))
    return written(ho.holder_census(ln, t)), t


@query("A11", HOLD + "SELECT token, owner, CAST(amount AS BIGINT) AS amount, accounts, round(pct, 6) AS pct FROM own")
def holder_census(spark, sf):
    return census(spark, sf).select("token", "owner", "amount", "accounts", r6("pct"))


@query("A11", HOLD + """SELECT token, count(*) AS accounts, CAST(sum(amount) AS BIGINT) AS verified, round(sum(amount) / any_value(supply) * 100, 6) AS verified_pct, round(greatest(0, 100 - sum(amount) / any_value(supply) * 100), 6) AS unseen_pct,
 round(coalesce(sum(amount) FILTER (owner = creator), 0) / any_value(supply) * 100, 6) AS creator_pct, round(coalesce(sum(amount) FILTER (account = vault), 0) / any_value(supply) * 100, 6) AS vault_pct FROM ln JOIN tok USING (token) GROUP BY token""")
def census_summary(spark, sf):
    d = ho.census_summary(lines(spark, sf), tokens(spark, sf))
    return d.select("token", "accounts", "verified", *[r6(c) for c in ("verified_pct", "unseen_pct", "creator_pct", "vault_pct")])


@query("A12", HOLD + """, a AS (SELECT token, account, count(*) AS n, sum(amount) AS amount, max(owner) AS owner FROM ln GROUP BY ALL),
 g AS (SELECT token, any_value(supply) AS supply, sum(n) AS accounts, max(n) AS dup, sum(amount) AS total, count(*) FILTER (account <> vault AND owner = pool) AS other, count(*) FILTER (account = vault AND owner <> pool) AS vo, count(*) FILTER (account = vault) AS v FROM a JOIN tok USING (token) GROUP BY token)
 SELECT token, CAST(accounts AS BIGINT) AS accounts, CAST(total AS BIGINT) AS total, supply, CASE WHEN dup > 1 THEN 'census_account_mismatch' WHEN other > 0 THEN 'unverified_pool_owned_account' WHEN vo > 0 THEN 'pool_vault_owner_mismatch'
   WHEN v = 0 OR total <> supply THEN 'census_supply_not_reconciled' ELSE 'reconciled' END AS reason FROM g""")
def reconcile_supply(spark, sf):
    return ho.reconcile_supply(lines(spark, sf), tokens(spark, sf))


@query("A13 T3", HOLD + """, r AS (SELECT o.*, c_mktsegment IN ('AUTOMOBILE', 'MACHINERY') AS infra FROM own o JOIN customer ON owner = 'c' || c_custkey),
 k AS (SELECT *, row_number() OVER (PARTITION BY token ORDER BY pct DESC, owner) AS rk FROM r WHERE NOT infra), t AS (SELECT token, max(pct) AS lp, sum(pct) AS tp FROM k WHERE rk <= 10 GROUP BY token)
 SELECT token, round(coalesce(sum(pct) FILTER (infra), 0), 6) AS infrastructure_pct, count(*) FILTER (infra) AS infrastructure_owners, count(*) AS owners, round(any_value(lp), 6) AS largest_pct, round(any_value(tp), 6) AS top10_pct
 FROM r LEFT JOIN t USING (token) GROUP BY token""")
def concentration_profile(spark, sf):
    c = b.table(spark, sf, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("owner"), "c_mktsegment")
    role = F.when(F.col("c_mktsegment") == "AUTOMOBILE", "CEX").when(F.col("c_mktsegment") == "MACHINERY", "DEX")
    d = ho.concentration_profile(stored_census(spark, sf).join(c, "owner"), role)
    return d.select("token", r6("infrastructure_pct"), "infrastructure_owners", "owners", r6("largest_pct"), r6("top10_pct"))


COVER = LINES + """, req AS (SELECT DISTINCT 'c' || o_custkey AS owner, o_orderkey AS address FROM orders),
 win AS (SELECT owner, l_orderkey AS address, min(block_time) AS window_start, max(block_time) AS head_at, bool_or(ls = 'F') AS complete, count(*) FILTER (rf = 'R' AND amount > 45) AS pending, count(*) FILTER (amount = 50 AND ls = 'F') AS null_ts FROM ln GROUP BY ALL),
 prog AS (SELECT DISTINCT owner, l_suppkey AS program FROM ln WHERE amount = 1),
 cov AS (SELECT r.owner, count(DISTINCT r.address) AS addresses_required, (SELECT count(DISTINCT program) FROM prog p WHERE p.owner = r.owner) AS unknown_programs FROM req r GROUP BY r.owner),
 got AS (SELECT owner, max(window_start) AS window_start, min(head_at) AS head_at, bool_and(complete) AS allc, sum(pending) AS pending, sum(null_ts) AS null_ts, count(*) AS addresses_reviewed FROM win GROUP BY owner),
 fin AS (SELECT c.*, g.* EXCLUDE (owner), coalesce(addresses_reviewed = addresses_required AND allc, false) AS pagination_complete, addresses_reviewed IS NOT NULL AS observed,
   addresses_reviewed IS NOT NULL AND NOT (1004832000 - head_at BETWEEN 0 AND 86400 * 700) AS stale FROM cov c LEFT JOIN got g USING (owner))
"""


def _coverage(spark, sf):
    od = b.table(spark, sf, "orders")
    req = od.select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("owner"), F.col("o_orderkey").alias("address"))
    ln = lines(spark, sf)
    win = ln.groupBy("owner", F.col("l_orderkey").alias("address")).agg(
        F.min("block_time").alias("window_start"), F.max("block_time").alias("head_at"), F.max(F.col("ls") == "F").alias("complete"),
        F.count_if((F.col("rf") == "R") & (F.col("amount") > 45)).alias("pending"), F.count_if((F.col("amount") == 50) & (F.col("ls") == "F")).alias("null_ts"))
    prog = ln.filter("amount = 1").select("owner", F.col("l_suppkey").alias("program"))
    return ho.owner_coverage(req, win, prog, WALLET_NOW, 86400 * 700)


@query("A14", COVER + "SELECT owner, addresses_required, addresses_reviewed, window_start, head_at, CAST(pending AS BIGINT) AS pending, CAST(null_ts AS BIGINT) AS null_ts, unknown_programs, pagination_complete, stale FROM fin")
def owner_coverage(spark, sf):
    return _coverage(spark, sf).select("owner", "addresses_required", "addresses_reviewed", "window_start", "head_at", "pending", "null_ts", "unknown_programs", "pagination_complete", "stale")


@query("A14", COVER + """SELECT count(*) AS owners_required, count(*) FILTER (observed) AS owners_observed, count(*) FILTER (NOT observed) AS owners_missing, CAST(sum(addresses_required) AS BIGINT) AS addresses_required, CAST(sum(addresses_reviewed) AS BIGINT) AS addresses_observed,
 count(*) FILTER (observed AND pagination_complete AND pending = 0 AND null_ts = 0 AND unknown_programs = 0 AND NOT stale) AS owners_complete_fresh, count(*) FILTER (observed AND addresses_reviewed < addresses_required) AS owners_missing_addresses,
 count(*) FILTER (observed AND NOT pagination_complete) AS owners_incomplete_pagination, count(*) FILTER (pending > 0) AS owners_pending, count(*) FILTER (null_ts > 0) AS owners_null_timestamps,
 count(*) FILTER (observed AND unknown_programs > 0) AS owners_unsupported_programs, count(*) FILTER (stale) AS owners_stale FROM fin""")
def coverage_blockers(spark, sf):
    return ho.coverage_blockers(_coverage(spark, sf))


@query("A15", COVER + """SELECT addresses_required AS addresses, count(*) AS requirements, count(*) FILTER (observed) AS known, count(*) FILTER (observed AND pagination_complete AND NOT stale) AS complete_fresh, count(*) = count(*) FILTER (observed) AS denominator_verified FROM fin GROUP BY 1""")
def coverage_kpi(spark, sf):
    d = rp.coverage_kpi(_coverage(spark, sf), ["addresses_required"], F.col("observed"), F.col("pagination_complete") & ~F.col("stale"))
    return d.withColumnRenamed("addresses_required", "addresses")


@query("A17", LINES + "SELECT l_suppkey AS program, count(DISTINCT owner) AS owner_incidences FROM ln WHERE amount <= 5 GROUP BY 1")
def blocker_incidence(spark, sf):
    d = lines(spark, sf).filter("amount <= 5").groupBy("owner", "l_orderkey").agg(F.collect_set("l_suppkey").alias("programs"))
    return rp.blocker_incidence(d, "owner", "programs")


@query("A19", LINES + f"""SELECT owner, count(*) AS returned, count(*) FILTER (o_orderstatus <> 'P' AND block_time <= {WALLET_NOW}) AS successful, min(block_time) FILTER (o_orderstatus <> 'P') AS earliest, max(block_time) FILTER (o_orderstatus <> 'P') AS latest,
 count(*) >= 60 AS page_limit_reached, {WALLET_NOW} - min(block_time) FILTER (o_orderstatus <> 'P') AS age_lower_bound FROM ln GROUP BY owner""")
def wallet_activity(spark, sf):
    return rp.wallet_activity(lines(spark, sf), "owner", "block_time", F.col("o_orderstatus") == "P", WALLET_NOW, 60)


# --- token policies ---------------------------------------------------------------------------

TOKC = HOLD + """, tc AS (SELECT t.token, t.pool, t.creator, t.p_size, coalesce(sum(o.pct) FILTER (o.owner = t.creator), 0) AS creator_pct, CASE WHEN p_size = 13 THEN NULL ELSE CAST(p_size % 20 AS DOUBLE) END AS unseen_pct FROM tok t JOIN own o USING (token) GROUP BY ALL),
 ow AS (SELECT token, owner, CASE WHEN amount = 7 AND accounts = 1 AND token % 50 = 0 THEN 101.0::DOUBLE ELSE pct END AS pct FROM own)
"""


def _owners(own):
    bad = (F.col("amount") == 7) & (F.col("accounts") == 1) & (F.col("token") % 50 == 0)
    return own.select("token", "owner", F.when(bad, 101.0).otherwise(F.col("pct")).alias("pct"))


def _tokens_with_creator(own, t):
    c = own.select("token", "owner", F.col("pct").alias("_p"))
    mine = t.join(c, (t.token == c.token) & (t.creator == c.owner), "left").select(t.token, "pool", "creator", "p_size", F.coalesce("_p", F.lit(0.0)).alias("creator_pct"))
    return written(mine.withColumn("unseen_pct", F.expr("CASE WHEN p_size = 13 THEN NULL ELSE cast(p_size % 20 as double) END")))


@query("P16 T3", TOKC + """, vo AS (SELECT token, max((NOT pct BETWEEN 0 AND 100)::INT) AS void FROM ow GROUP BY token),
 k AS (SELECT o.*, row_number() OVER (PARTITION BY token ORDER BY o.pct DESC, owner) AS rk FROM ow o JOIN tc USING (token) WHERE o.pct BETWEEN 0 AND 100 AND owner <> pool),
 t AS (SELECT token, round(max(pct), 9) AS lp, round(sum(pct), 9) AS tp FROM k WHERE rk <= 10 GROUP BY token),
 r AS (SELECT tc.token, lp, tp, CASE WHEN void = 1 OR unseen_pct IS NULL THEN 'missing_evidence' WHEN lp > 10 OR tp > 60 OR creator_pct > 6 THEN 'concentration_policy_exceeded' WHEN unseen_pct > 10 THEN 'top_account_sample_insufficient'
   ELSE 'sample_concentration_with_bounded_unseen_supply' END AS reason FROM tc JOIN vo USING (token) LEFT JOIN t USING (token))
 SELECT token, CASE reason WHEN 'concentration_policy_exceeded' THEN 'REJECT' WHEN 'sample_concentration_with_bounded_unseen_supply' THEN 'PASS' ELSE 'UNKNOWN' END AS status, reason, round(lp, 6) AS largest_pct, round(tp, 6) AS top10_pct FROM r""")
def check_concentration(spark, sf):
    own, t = stored_holdings(spark, sf)
    d = po.check_concentration(_owners(own), _tokens_with_creator(own, t), (10.0, 60.0, 6.0, 10.0))
    return d.select("token", "status", "reason", r6("largest_pct"), r6("top10_pct"))


HIST = f"""hist AS (SELECT owner AS wallet, CASE WHEN max(amount) = 49 THEN NULL ELSE {WALLET_NOW} - min(block_time) END AS activity_age, {WALLET_NOW} - min(block_time) + CASE WHEN count(*) % 2 = 0 THEN 40000000 ELSE 0 END AS covered_span, CASE WHEN count(*) % 11 > 0 THEN min(amount) < 3 END AS complete FROM ln GROUP BY owner)"""


@query("P17", TOKC + f""", {HIST}, nd AS (SELECT o.token, o.owner, o.pct, o.owner = t.creator AS ic FROM own o JOIN tc t USING (token) WHERE o.owner <> t.pool
   UNION ALL SELECT token, creator, 0, true FROM tc t WHERE creator = pool),
 j AS (SELECT nd.*, activity_age, covered_span, complete, CASE WHEN ic THEN 215000000 ELSE 212000000 END AS need FROM nd LEFT JOIN hist ON wallet = owner),
 y AS (SELECT *, activity_age IS NOT NULL AND activity_age < need AND covered_span >= need AND coalesce(complete, false) AS young, activity_age IS NULL OR (activity_age < need AND NOT (covered_span >= need AND coalesce(complete, false))) AS unk FROM j),
 g AS (SELECT token, max((young AND ic)::INT) AS cy, round(sum(CASE WHEN young THEN pct ELSE 0 END), 9) AS ys, count(*) FILTER (unk) AS unknown_wallets, count(*) AS wallets FROM y GROUP BY token)
 SELECT token, round(ys, 6) AS young_share, unknown_wallets, wallets, CASE WHEN cy = 1 OR ys > 30 THEN 'REJECT' WHEN unknown_wallets > 0 THEN 'UNKNOWN' ELSE 'PASS' END AS status FROM g""")
def check_wallet_age(spark, sf):
    h = lines(spark, sf).groupBy(F.col("owner").alias("wallet")).agg(
        F.expr(f"CASE WHEN max(amount) = 49 THEN NULL ELSE {WALLET_NOW} - min(block_time) END").alias("activity_age"),
        F.expr(f"{WALLET_NOW} - min(block_time) + CASE WHEN count(*) % 2 = 0 THEN 40000000 ELSE 0 END").alias("covered_span"),
        F.expr("CASE WHEN count(*) % 11 > 0 THEN min(amount) < 3 END").alias("complete"))
    own, t = stored_holdings(spark, sf)
    d = po.check_wallet_age(own.select("token", "owner", "pct"), _tokens_with_creator(own, t), h, 212_000_000, 215_000_000, 30.0)
    return d.select("token", r6("young_share"), "unknown_wallets", "wallets", "status")


DEV = HOLD + f""", evn AS (SELECT owner AS source, CASE WHEN rf = 'R' AND ls = 'F' THEN 'sell' WHEN rf = 'R' AND amount > 40 THEN 'withdraw' ELSE 'other' END AS relation, CASE WHEN token % 2 = 0 THEN owner ELSE 'c' || l_suppkey END AS target, block_time FROM ln WHERE block_time >= {SINCE}),
 rep AS (SELECT token, bool_or(amount = 50 AND ls = 'F') AS fl, count(*) FILTER (amount <> 3) AS got, count(*) AS n FROM ln WHERE l_suppkey % 4 <> 0 GROUP BY token)
"""


@query("P18", DEV + """, w AS (SELECT source, count(*) FILTER (relation = 'withdraw') AS w FROM evn GROUP BY source), s AS (SELECT DISTINCT source, target FROM evn WHERE relation = 'sell'),
 r AS (SELECT t.token, CASE WHEN p_size % 9 = 0 THEN 'developer_history_or_attribution_incomplete' WHEN p_size % 7 = 0 THEN 'current_token_provider_risk_unresolved' WHEN s.source IS NOT NULL THEN 'developer_sold_current_pool_in_review_window'
   WHEN w > 0 THEN 'developer_withdrawal_requires_review' WHEN fl THEN 'associated_token_provider_risk_requires_review' WHEN NOT (coalesce(got, 0) = p_size % 5 + 2 AND coalesce(n, 0) = p_size % 5 + 2) THEN 'associated_token_reports_incomplete' ELSE 'no_trigger' END AS reason
   FROM tok t LEFT JOIN w ON w.source = t.creator LEFT JOIN s ON s.source = t.creator AND s.target = t.pool LEFT JOIN rep USING (token))
 SELECT token, CASE WHEN reason IN ('developer_sold_current_pool_in_review_window', 'developer_withdrawal_requires_review') THEN 'REJECT' WHEN reason = 'no_trigger' THEN 'PASS' ELSE 'UNKNOWN' END AS status, reason FROM r""")
def check_developer(spark, sf):
    ln = lines(spark, sf)
    ev = ln.select(F.col("owner").alias("source"), F.expr("CASE WHEN rf = 'R' AND ls = 'F' THEN 'sell' WHEN rf = 'R' AND amount > 40 THEN 'withdraw' ELSE 'other' END").alias("relation"),
                   F.expr("CASE WHEN token % 2 = 0 THEN owner ELSE concat('c', l_suppkey) END").alias("target"), "block_time")
    rep = ln.filter("l_suppkey % 4 <> 0").select("token", F.expr("amount = 50 AND ls = 'F'").alias("flagged"), F.expr("amount <> 3").alias("retrieved"))
    t = tokens(spark, sf, ln).withColumn("associated", F.col("p_size") % 5 + 2).withColumn("attributed", F.col("p_size") % 9 != 0).withColumn("provider_flag", F.col("p_size") % 7 == 0)
    return po.check_developer(t, ev, rep, SINCE).select("token", "status", "reason")


@query("P19", HOLD + f""", g AS (SELECT t.token, count(DISTINCT CASE WHEN owner <> creator AND {WALLET_NOW} - block_time BETWEEN 0 AND 20000000 AND amount > 10 THEN owner END) AS sellers, bool_and(p_size % 6 <> 0 AND p_size % 5 <> 0) AS ready FROM tok t LEFT JOIN ln USING (token) GROUP BY t.token)
 SELECT token, sellers, CASE WHEN sellers >= 3 AND ready THEN 'PASS' ELSE 'UNKNOWN' END AS status FROM g""")
def check_trading(spark, sf):
    rc = lines(spark, sf).select("token", F.col("owner").alias("seller"), F.col("block_time").alias("time"), (F.col("amount") - 10).alias("quote_received"), F.col("amount").alias("base_sent"))
    t = tokens(spark, sf).select("token", "creator", F.when(F.col("p_size") % 6 != 0, True).alias("sell_enabled"), F.when(F.col("p_size") % 5 != 0, "PASS").otherwise("UNKNOWN").alias("controls"))
    return po.check_trading(rc, t, WALLET_NOW, 20_000_000, 3)


# --- graph ------------------------------------------------------------------------------------

EDGES = HOLD + """, tr AS (SELECT 'native_transfer' AS relation, 's' || l_suppkey AS source, owner AS target, NULL AS asset, NULL AS resolved, block_time FROM ln WHERE rf = 'N'
   UNION ALL SELECT 'token_transfer', owner, 'c' || (l_suppkey * 3), token::VARCHAR, ls = 'F', block_time FROM ln WHERE rf = 'A'
   UNION ALL SELECT CASE WHEN ls = 'F' THEN 'sell' ELSE 'withdraw' END, owner, 'c' || l_suppkey, NULL, NULL, block_time FROM ln WHERE rf = 'R')
"""


def transfers(spark, sf):
    ln = lines(spark, sf)
    sup = F.col("l_suppkey").cast("string")
    none = F.lit(None)
    cols = lambda rel, s, t, a, r: [rel.alias("relation"), s.alias("source"), t.alias("target"), a.cast("string").alias("asset"), r.cast("boolean").alias("owner_resolution"), "block_time"]
    n = ln.filter("rf = 'N'").select(*cols(F.lit("native_transfer"), F.concat(F.lit("s"), sup), F.col("owner"), none, none))
    t = ln.filter("rf = 'A'").select(*cols(F.lit("token_transfer"), F.col("owner"), F.concat(F.lit("c"), (F.col("l_suppkey") * 3).cast("string")), F.col("token"), F.col("ls") == "F"))
    r = ln.filter("rf = 'R'").select(*cols(F.when(F.col("ls") == "F", "sell").otherwise("withdraw"), F.col("owner"), F.concat(F.lit("c"), sup), none, none))
    return n.unionByName(t).unionByName(r)


@query("G2", EDGES + """, p AS (SELECT source, target, count(*) AS n FROM tr WHERE relation = 'native_transfer' AND target IN (SELECT owner FROM own WHERE pct > 4) GROUP BY ALL)
 SELECT source, count(*) AS recipients, CAST(sum(n) AS BIGINT) AS transfers FROM p GROUP BY source HAVING count(*) > 1""")
def shared_senders(spark, sf):
    sel = census(spark, sf).filter("pct > 4").select(F.col("owner").alias("wallet"))
    return gr.shared_senders(transfers(spark, sf), sel)


LINKED = EDGES.replace("WITH", "WITH RECURSIVE", 1) + f""", nd AS (SELECT DISTINCT x.token, x.owner, t.pool FROM (SELECT token, owner FROM own UNION ALL SELECT token, creator FROM tok) x JOIN tok t USING (token) WHERE x.owner <> t.pool),
 inn AS (SELECT nd.token, nd.pool, tr.* FROM tr JOIN nd ON nd.owner = tr.target WHERE block_time >= {SINCE}),
 dir AS (SELECT i.token, i.source AS a, i.target AS b FROM inn i WHERE i.source <> i.target AND (relation = 'native_transfer' OR (relation = 'token_transfer' AND asset = i.token::VARCHAR AND resolved))
    AND EXISTS (SELECT 1 FROM nd m WHERE m.token = i.token AND m.owner = i.source)),
 fun AS (SELECT DISTINCT token, source, target FROM inn WHERE relation = 'native_transfer' AND source <> pool),
 hub AS (SELECT token, source, min(target) AS hub FROM fun GROUP BY ALL HAVING count(*) > 1),
 eg AS (SELECT * FROM dir UNION SELECT f.token, hub, f.target FROM fun f JOIN hub h USING (token, source) WHERE f.target <> hub),
 un AS (SELECT token, a, b FROM eg UNION SELECT token, b, a FROM eg),
 reach AS (SELECT token, a AS node, a AS lab FROM un UNION SELECT u.token, u.b, r.lab FROM reach r JOIN un u ON u.token = r.token AND u.a = r.node),
 comp AS (SELECT token, node, min(lab) AS component FROM reach GROUP BY ALL),
 gx AS (SELECT c.token, component, count(*) AS wallets, sum(coalesce(amount, 0)) AS amt, any_value(supply) AS supply, sum(coalesce(amount, 0)) / any_value(supply) * 100 AS share, bool_or(node = creator) AS hc FROM comp c LEFT JOIN own o ON o.token = c.token AND o.owner = node JOIN tok t ON t.token = c.token GROUP BY ALL)
"""


def _clusters(spark, sf, own, t):
    return gr.linked_exposure(own, t, transfers(spark, sf), SINCE)


@query("G3", LINKED + "SELECT token, component, wallets, round(share, 6) AS share_pct, hc AS has_creator, amt * 100 > supply * 10 OR (hc AND amt * 100 > supply * 2) AS excessive FROM gx")
def linked_exposure(spark, sf):
    d = _clusters(spark, sf, *stored_holdings(spark, sf))
    return d.select("token", "component", "wallets", r6("share_pct"), "has_creator", "excessive")


@query("G3 P11", LINKED + """, bad AS (SELECT token, bool_or(amt * 100 > supply * 10 OR (hc AND amt * 100 > supply * 2)) AS bad, count(*) AS clusters FROM gx GROUP BY token),
 ok AS (SELECT owner, bool_and(ls = 'F' OR amount <= 49) AS complete FROM ln GROUP BY owner HAVING min(l_suppkey) % 7 <> 0),
 need AS (SELECT nd.token, count(*) AS req, count(complete) AS obs, count(*) FILTER (complete IS NOT TRUE) AS open_ FROM nd LEFT JOIN ok USING (owner) GROUP BY nd.token)
 SELECT t.token, coalesce(clusters, 0) AS clusters, coalesce(req, 0) AS owners_required, coalesce(obs, 0) AS owners_observed, CASE WHEN bad THEN 'REJECT' WHEN req > 0 AND open_ = 0 THEN 'PASS' ELSE 'UNKNOWN' END AS status
 FROM tok t LEFT JOIN bad USING (token) LEFT JOIN need USING (token)""")
def cluster_verdict(spark, sf):
    """The linked-wallet check per token, with the coverage a pass needs."""
    own, t = stored_holdings(spark, sf)
    both = own.select("token", "owner").unionByName(t.select("token", F.col("creator").alias("owner")))
    sel = both.join(t.select("token", "pool"), "token").filter("owner <> pool").select("token", "owner")
    hist = lines(spark, sf).groupBy("owner").agg(F.min((F.col("ls") == "F") | (F.col("amount") <= 49)).alias("complete"), F.min("l_suppkey").alias("_s")).filter("_s % 7 <> 0")
    return gr.cluster_verdict(t, _clusters(spark, sf, own, t), sel, hist)


@query("G4", EDGES + """, d AS (SELECT t.token, count(*) AS n FROM tr JOIN tok t ON t.creator = tr.source WHERE relation IN ('native_transfer', 'token_transfer') AND source <> target AND (relation = 'native_transfer' OR resolved)
   AND EXISTS (SELECT 1 FROM own o WHERE o.token = t.token AND o.owner = tr.target) GROUP BY 1),
 a AS (SELECT source, count(*) FILTER (relation = 'withdraw') AS w, count(*) FILTER (relation = 'sell') AS s FROM tr GROUP BY source)
 SELECT t.token, t.creator, coalesce(d.n, 0) AS creator_to_holder, coalesce(w, 0) AS withdrawals, coalesce(s, 0) AS sales FROM tok t LEFT JOIN d USING (token) LEFT JOIN a ON a.source = t.creator""")
def creator_flows(spark, sf):
    h = census(spark, sf).select("token", "owner")
    return gr.creator_flows(tokens(spark, sf), h, transfers(spark, sf)).select("token", "creator", "creator_to_holder", "withdrawals", "sales")


@query("G5", HOLD + """, i AS (SELECT owner AS source, 'm' || token AS target, 'c' || (l_suppkey * 5) AS signer FROM ln WHERE rf = 'R' AND amount > 40),
 c AS (SELECT creator, min(pool) AS pool, 'm' || min(token) AS lp FROM tok GROUP BY creator),
 l AS (SELECT source AS creator, source, target, true AS am FROM i UNION ALL SELECT signer, source, target, false FROM i),
 g AS (SELECT l.creator, target, bool_or(am) AS authority_match, bool_or(target = lp AND source = pool) AS is_lp FROM l JOIN c USING (creator) GROUP BY ALL)
 SELECT creator, target AS mint, authority_match, CASE WHEN is_lp THEN 'pool_lp' ELSE 'associated' END AS role FROM g""")
def associated_entities(spark, sf):
    ev = lines(spark, sf).filter("rf = 'R' and amount > 40").select(
        F.col("owner").alias("source"), F.expr("concat('m', token)").alias("target"), F.lit("mint_authority_at_initialization").alias("relation"),
        F.array(F.expr("concat('c', l_suppkey * 5)")).alias("signers"))
    c = tokens(spark, sf).groupBy("creator").agg(F.min("pool").alias("pool"), F.expr("concat('m', min(token))").alias("lp_mint"))
    return gr.associated_entities(c, ev)


TXS = LINES + """, o AS (SELECT *, l_linenumber > 4 AS is_inner, row_number() OVER (PARTITION BY l_orderkey, l_linenumber > 4 ORDER BY l_linenumber, token, l_suppkey, amount, rf, ls) - 1 AS rn FROM ln WHERE o_orderstatus <> 'P'),
 x AS (SELECT *, CASE WHEN is_inner THEN '1.' || rn ELSE rn::VARCHAR END AS path FROM o)
"""


def tx_documents(spark, sf):
    """One nested transaction per order: lines up to four are top-level, later ones inner instructions of the second."""
    ln = lines(spark, sf)
    prog = F.when(F.col("rf") == "N", "system").when((F.col("rf") == "R") & (F.col("ls") == "O"), "memo").otherwise("token")
    kind = F.when(F.col("rf") == "N", "transfer").when(F.col("rf") == "A", "transferChecked").otherwise("initializeMint")
    sup = F.col("l_suppkey").cast("string")
    ins = F.struct(prog.alias("program"), kind.alias("kind"), F.concat(F.lit("a"), sup).alias("source"), F.col("owner").alias("target"), F.col("amount").alias("amount"),
                   F.when((F.col("rf") != "A") | (F.col("l_linenumber") % 2 == 0), F.col("token").cast("string")).alias("asset"))
    row = F.struct("l_linenumber", "token", "l_suppkey", F.col("amount").alias("_amount"), "rf", "ls", ins.alias("ins"))
    pick = lambda cond: F.transform(F.sort_array(F.collect_list(F.when(cond, row))), lambda r: r["ins"])
    # Source accounts of most suppliers have a balance row; the order's target has one if an even token moved to it.
    own = F.struct(F.concat(F.lit("a"), sup).alias("account"), F.concat(F.lit("o"), sup).alias("owner"), F.concat(F.lit("m"), sup).alias("mint"))
    got = F.struct(F.col("owner").alias("account"), F.concat(F.lit("w"), F.col("owner")).alias("owner"), F.lit(None).cast("string").alias("mint"))
    rows = F.concat(F.collect_set(F.when(F.col("l_suppkey") % 3 != 0, own)), F.collect_set(F.when((F.col("rf") == "A") & (F.col("token") % 2 == 0), got)))
    d = ln.groupBy("l_orderkey").agg(F.max(F.col("o_orderstatus") == "P").alias("failed"), F.max("block_time").alias("block_time"), pick(F.col("l_linenumber") <= 4).alias("instructions"),
                                     pick(F.col("l_linenumber") > 4).alias("_in"), rows.alias("balances"), F.array(F.max("owner")).alias("signers"))
    return d.select(F.col("l_orderkey").alias("sig"), (F.col("l_orderkey") * 2).alias("slot"), "signers", "failed", "block_time", "instructions", F.array(F.struct(F.lit(1).alias("index"), F.col("_in").alias("instructions"))).alias("inner"), "balances")


@query("G1", TXS + """, y AS (SELECT *, l_suppkey % 3 <> 0 AS so, bool_or(rf = 'A' AND token % 2 = 0) OVER (PARTITION BY l_orderkey) AS tgt FROM ln WHERE o_orderstatus <> 'P'),
 z AS (SELECT x.*, x.l_suppkey % 3 <> 0 AS so, t.tgt FROM x JOIN (SELECT DISTINCT l_orderkey, tgt FROM y) t USING (l_orderkey))
 SELECT l_orderkey AS sig, l_orderkey * 2 AS slot, path, CASE rf WHEN 'N' THEN 'native_transfer' WHEN 'A' THEN 'token_transfer' ELSE 'mint_authority_at_initialization' END AS relation,
 CASE WHEN rf = 'A' AND so THEN 'o' || l_suppkey ELSE 'a' || l_suppkey END AS source, CASE WHEN rf = 'A' AND tgt THEN 'w' || owner ELSE owner END AS target,
 CASE WHEN rf = 'N' THEN 'SOL' WHEN rf = 'A' AND l_linenumber % 2 = 1 THEN CASE WHEN so THEN 'm' || l_suppkey END ELSE token::VARCHAR END AS asset, amount, CASE WHEN rf = 'A' THEN so AND tgt END AS owner_resolution, CASE WHEN rf = 'R' THEN owner END AS signer
 FROM z WHERE NOT (rf = 'R' AND ls = 'O')""")
def extract_transfers(spark, sf):
    return gr.extract_transfers(tx_documents(spark, sf)).select("sig", "slot", "path", "relation", "source", "target", "asset", "amount", "owner_resolution", F.try_element_at("signers", F.lit(1)).alias("signer"))


TRACE = LINES + """, p AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, token, l_suppkey, amount, rf, ls) AS pos FROM ln),
 t AS (SELECT l_orderkey AS tx, pos, least(pos, 1 + token % 3) AS depth, rf, amount FROM p),
 j AS (SELECT *, depth > coalesce(lag(depth) OVER (PARTITION BY tx ORDER BY pos), 0) + 1 AS jump FROM t), v AS (SELECT *, bool_or(jump) OVER (PARTITION BY tx) AS void FROM j)
"""


def trace(spark, sf):
    from pyspark.sql.window import Window
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "token", "l_suppkey", "amount", "rf", "ls")
    d = lines(spark, sf).withColumn("pos", F.row_number().over(w).cast("long"))
    return d.select(F.col("l_orderkey").alias("tx"), "pos", F.expr("least(pos, 1 + token % 3)").alias("depth"), "rf", "amount")


@query("G7", TRACE + """SELECT tx, pos, depth, CASE WHEN NOT void THEN (SELECT max(q.pos) FROM v q WHERE q.tx = v.tx AND q.pos < v.pos AND q.depth = v.depth - 1) END AS parent, CASE WHEN void THEN 'invalid_stack_height' END AS trace_reason FROM v""")
def parent_paths(spark, sf):
    return gr.parent_paths(trace(spark, sf), "tx", "pos", "depth").select("tx", "pos", "depth", "parent", "trace_reason")


@query("G7", """WITH t AS (SELECT conv_id AS tx, turn AS pos, CASE role WHEN 'system' THEN 1 WHEN 'user' THEN 2 ELSE 3 END AS depth FROM conversations),
 j AS (SELECT *, depth > coalesce(lag(depth) OVER (PARTITION BY tx ORDER BY pos), 1) + 1 AS jump FROM t), v AS (SELECT *, bool_or(jump) OVER (PARTITION BY tx) AS void FROM j)
 SELECT tx, pos, CASE WHEN NOT void AND depth > 1 THEN (SELECT max(q.pos) FROM v q WHERE q.tx = v.tx AND q.pos < v.pos AND q.depth = v.depth - 1) END AS parent, CASE WHEN void THEN 'invalid_stack_height' END AS trace_reason
 FROM v""")
def conversation_parents(spark, sf):
    """Turns as steps under an implicit root: a conversation may open with its system or its user turn."""
    d = b.table(spark, sf, "conversations").select(F.col("conv_id").alias("tx"), F.col("turn").alias("pos"), F.expr("CASE role WHEN 'system' THEN 1 WHEN 'user' THEN 2 ELSE 3 END").alias("depth"))
    root = d.select("tx").distinct().select("tx", F.lit(-1).cast("long").alias("pos"), F.lit(1).alias("depth"))
    out = gr.parent_paths(d.unionByName(root), "tx", "pos", "depth").filter("pos >= 0")
    return out.select("tx", "pos", F.when(F.col("parent") >= 0, F.col("parent")).alias("parent"), "trace_reason")


@query("G6", TRACE + """, s AS (SELECT * FROM v WHERE NOT void), d AS (SELECT c.tx, c.pos AS invocation, r.rf, r.amount FROM s c JOIN s r ON r.tx = c.tx AND r.pos > c.pos AND r.depth > c.depth
   AND NOT EXISTS (SELECT 1 FROM s m WHERE m.tx = c.tx AND m.pos > c.pos AND m.pos < r.pos AND m.depth <= c.depth) WHERE c.rf = 'R')
 SELECT tx, invocation, CAST(sum(CASE WHEN rf = 'A' THEN amount ELSE 0 END) AS BIGINT) AS base_sent, CAST(sum(CASE WHEN rf = 'N' THEN amount ELSE 0 END) AS BIGINT) AS quote_received FROM d GROUP BY ALL
 HAVING sum(CASE WHEN rf = 'A' THEN amount ELSE 0 END) > 0 AND sum(CASE WHEN rf = 'N' THEN amount ELSE 0 END) > 0""")
def two_leg_receipts(spark, sf):
    p = gr.parent_paths(trace(spark, sf), "tx", "pos", "depth")
    return gr.two_leg_receipts(p, "tx", "pos", F.col("rf") == "R", F.col("rf") == "A", F.col("rf") == "N", "amount")


BAL = LINES + """, mv AS (SELECT l_orderkey AS tx, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, token, l_suppkey, amount, rf, ls) AS seq, owner AS source, 's' || l_suppkey AS target, amount, l_suppkey, o_orderpriority FROM ln),
 tot AS (SELECT tx, source AS account, sum(amount) AS paid, any_value(o_orderpriority) AS pr FROM mv GROUP BY ALL),
 bal AS (SELECT tx, account, CAST(o_totalprice AS BIGINT) % 300 AS pre, CAST(o_totalprice AS BIGINT) % 300 - 5 - paid + CASE WHEN pr = '1-URGENT' THEN 1 ELSE 0 END AS post, 5 AS fee FROM tot JOIN orders ON o_orderkey = tx
   UNION ALL SELECT tx, target, 0, sum(amount), 0 FROM mv WHERE l_suppkey % 13 <> 0 GROUP BY tx, target),
 legs AS (SELECT tx, source AS account, seq, -amount AS delta, 0 AS known FROM mv UNION ALL SELECT tx, target, seq, amount, 0 FROM mv UNION ALL SELECT tx, account, -1, pre - fee, 1 FROM bal),
 run AS (SELECT *, sum(delta) OVER (PARTITION BY tx, account ORDER BY seq, delta ROWS UNBOUNDED PRECEDING) AS r FROM legs),
 ac AS (SELECT r.tx, r.account, sum(delta) AS fin, min(r) AS low, max(known) AS known, any_value(post) AS post FROM run r LEFT JOIN bal b ON b.tx = r.tx AND b.account = r.account GROUP BY ALL),
 wy AS (SELECT *, CASE WHEN known = 0 THEN 'missing_endpoint_account_state' WHEN low < 0 THEN 'balance_underflow' WHEN fin <> post THEN 'balance_residual' END AS why FROM ac),
 rec AS (SELECT tx, count(*) AS accounts, list_sort(list_distinct(coalesce(list(why) FILTER (why IS NOT NULL), []))) AS blockers, CAST(sum(CASE WHEN known = 1 THEN abs(post - fin) ELSE 0 END) AS BIGINT) AS residual FROM wy GROUP BY tx)
"""


def _balances(spark, sf):
    from pyspark.sql.window import Window
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "token", "l_suppkey", "amount", "rf", "ls")
    mv = lines(spark, sf).select(F.col("l_orderkey").alias("tx"), F.row_number().over(w).cast("long").alias("seq"), F.col("owner").alias("source"),
                                 F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("target"), F.lit("SOL").alias("asset"), "amount", "l_suppkey", "o_orderpriority")
    tot = mv.groupBy("tx", F.col("source").alias("account")).agg(F.sum("amount").alias("paid"), F.max("o_orderpriority").alias("pr"))
    od = b.table(spark, sf, "orders").select(F.col("o_orderkey").alias("tx"), F.round("o_totalprice").cast("long").alias("_p"))
    payer = tot.join(od, "tx").select("tx", "account", F.lit("SOL").alias("asset"), F.expr("_p % 300").alias("pre"),
                                      F.expr("_p % 300 - 5 - paid + CASE WHEN pr = '1-URGENT' THEN 1 ELSE 0 END").alias("post"), F.lit(5).alias("fee"))
    got = (mv.filter("l_suppkey % 13 <> 0").groupBy("tx", F.col("target").alias("account")).agg(F.sum("amount").alias("post"))
           .select("tx", "account", F.lit("SOL").alias("asset"), F.lit(0).cast("long").alias("pre"), "post", F.lit(0).alias("fee")))
    return payer.unionByName(got), mv


@query("G8", BAL + "SELECT tx, accounts, blockers, residual, CASE WHEN len(blockers) = 0 THEN 'ENDPOINT_AMOUNTS_MATCH' ELSE 'UNKNOWN' END AS status FROM rec")
def reconcile_endpoints(spark, sf):
    bal, mv = _balances(spark, sf)
    return gr.reconcile_endpoints(bal, mv).select("tx", "accounts", "blockers", "residual", "status")


BAL2 = BAL + """, legs0 AS (SELECT tx, account, seq, CASE WHEN known = 1 AND seq = -1 AND account LIKE 'c%' THEN delta + 5 ELSE delta END AS delta, known FROM legs),
 run0 AS (SELECT *, sum(delta) OVER (PARTITION BY tx, account ORDER BY seq, delta ROWS UNBOUNDED PRECEDING) AS r FROM legs0),
 ac0 AS (SELECT r.tx, r.account, sum(delta) AS fin, min(r) AS low, max(known) AS known, any_value(post) AS post FROM run0 r LEFT JOIN bal b ON b.tx = r.tx AND b.account = r.account GROUP BY ALL),
 rec0 AS (SELECT tx, bool_and(known = 1 AND low >= 0 AND fin = post) AS good FROM ac0 GROUP BY tx),
 both_ AS (SELECT CASE WHEN good THEN 'ENDPOINT_AMOUNTS_MATCH' ELSE 'UNKNOWN' END AS status_base, CASE WHEN len(blockers) = 0 THEN 'ENDPOINT_AMOUNTS_MATCH' ELSE 'UNKNOWN' END AS status_candidate FROM rec JOIN rec0 USING (tx))
"""


@query("G9", BAL2 + """SELECT status_base, status_candidate, CASE WHEN status_base = status_candidate THEN 'unchanged' WHEN status_candidate = 'ENDPOINT_AMOUNTS_MATCH' THEN 'improved' ELSE 'regressed' END AS change, count(*) AS n FROM both_ GROUP BY ALL""")
def paired_replay(spark, sf):
    """A decoder that forgets fees against the one that knows them."""
    bal, mv = _balances(spark, sf)
    return gr.paired_replay(gr.reconcile_endpoints(bal, mv, fee=False), gr.reconcile_endpoints(bal, mv))


LIFE = LINES + """, p AS (SELECT l_orderkey AS tx, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, token, l_suppkey, amount, rf, ls) AS pos, l_suppkey % 6 AS script, amount % 30 AS n, o_orderpriority AS pr FROM ln),
 u AS (SELECT tx, pos, unnest(CASE script WHEN 0 THEN [{k: 'create', t: 'x', n: 20}, {k: 'init', t: 'x', n: 0}, {k: 'in', t: 'x', n: n}, {k: 'out', t: 's', n: n}, {k: 'close', t: 'p', n: 0}]
   WHEN 1 THEN [{k: 'pay', t: 's', n: 5}] WHEN 2 THEN [{k: 'mint', t: 't', n: n}, {k: 'burn', t: 't', n: n}] WHEN 3 THEN [{k: 'create', t: 'x', n: 20}, {k: 'init', t: 'x', n: 0}, {k: 'close', t: 's', n: 0}]
   WHEN 4 THEN [{k: 'send', t: 's', n: n}] ELSE [{k: 'create', t: 'x', n: 20}, {k: 'init', t: 'x', n: 0}, {k: 'in', t: 'x', n: n}, {k: 'close', t: 'p', n: 0}] END, recursive := true),
   generate_subscripts(CASE script WHEN 0 THEN [1, 2, 3, 4, 5] WHEN 1 THEN [1] WHEN 2 THEN [1, 2] WHEN 3 THEN [1, 2, 3] WHEN 4 THEN [1] ELSE [1, 2, 3, 4] END, 1) AS j FROM p),
 f AS (SELECT *, pos * 10 + j - 1 AS seq, row_number() OVER (PARTITION BY tx ORDER BY pos, j) AS i FROM u),
 ends AS (SELECT tx, CAST(floor(any_value(o_totalprice)) AS BIGINT) % 300 AS pre_p, CAST(floor(any_value(o_totalprice)) AS BIGINT) % 400 AS pre_t, count(*) FILTER (script = 1) * 5 + count(*) FILTER (script = 3) * 20 AS out_p,
   coalesce(sum(n) FILTER (script IN (0, 4)), 0) AS out_t, CASE WHEN any_value(pr) = '1-URGENT' THEN 1 ELSE 0 END AS off_p, CASE WHEN any_value(pr) = '2-HIGH' THEN 1 ELSE 0 END AS off_s FROM p JOIN orders ON o_orderkey = tx GROUP BY tx),
 st AS (SELECT tx, 0::BIGINT AS i, pre_p - 5 AS np, 10::BIGINT AS ns, 0::BIGINT AS nx, pre_t AS tt, 0::BIGINT AS tx_, 0::BIGINT AS ts, 'none' AS x, false AS made, false AS supply, 0 AS gen, CASE WHEN pre_p < 5 THEN 'fee_exceeds_balance' END AS err FROM ends
   UNION ALL
   SELECT tx, ni, CASE WHEN e IS NOT NULL THEN np WHEN k IN ('create', 'pay') THEN np - n WHEN k = 'close' AND t = 'p' THEN np + nx ELSE np END, CASE WHEN e IS NOT NULL THEN ns WHEN k = 'pay' THEN ns + n WHEN k = 'close' AND t = 's' THEN ns + nx ELSE ns END,
    CASE WHEN e IS NOT NULL THEN nx WHEN k = 'create' THEN nx + n WHEN k = 'close' THEN 0 ELSE nx END, CASE WHEN e IS NOT NULL THEN tt WHEN k IN ('in', 'send', 'burn') THEN tt - n WHEN k = 'mint' THEN tt + n ELSE tt END,
    CASE WHEN e IS NOT NULL THEN tx_ WHEN k = 'in' THEN tx_ + n WHEN k = 'out' THEN tx_ - n WHEN k = 'init' THEN 0 ELSE tx_ END, CASE WHEN e IS NOT NULL THEN ts WHEN k IN ('out', 'send') THEN ts + n ELSE ts END,
    CASE WHEN e IS NOT NULL THEN x WHEN k = 'create' THEN 'none' WHEN k = 'init' THEN 'open' WHEN k = 'close' THEN 'closed' ELSE x END, CASE WHEN e IS NULL AND k = 'create' THEN true ELSE made END,
    supply OR (e IS NULL AND k IN ('mint', 'burn')), gen + CASE WHEN e IS NULL AND k = 'init' THEN 1 ELSE 0 END, e
   FROM (SELECT st.*, f.k, f.t, f.n, coalesce(err, CASE
     WHEN k = 'create' AND x = 'closed' AND nx <> 0 THEN 'recreated_token_account_unverified' WHEN k IN ('create', 'pay') AND np < f.n THEN 'native_underflow' WHEN k = 'create' AND x <> 'closed' AND made THEN 'native_account_reinitialization'
     WHEN k = 'init' AND x <> 'none' THEN 'account_reinitialization' WHEN k IN ('in', 'out') AND x <> 'open' THEN 'missing_transfer_account_state' WHEN k IN ('in', 'send') AND tt < f.n THEN 'token_underflow' WHEN k = 'out' AND tx_ < f.n THEN 'token_underflow'
     WHEN k = 'burn' AND tt < f.n THEN 'mint_burn_amount_bounds' WHEN k = 'close' AND x <> 'open' THEN 'missing_close_state' WHEN k = 'close' AND tx_ <> 0 THEN 'nonempty_close' END) AS e, f.i AS ni FROM st JOIN f ON f.tx = st.tx AND f.i = st.i + 1)),
 z AS (SELECT st.*, pre_p, pre_t, out_p, out_t, off_p, off_s FROM st JOIN ends USING (tx) QUALIFY row_number() OVER (PARTITION BY st.tx ORDER BY i DESC) = 1),
 q AS (SELECT *, CASE WHEN err IS NOT NULL THEN [] ELSE [r for r in [{account: 'p', residual: CAST(pre_p - 5 - out_p + off_p - np AS HUGEINT)}, {account: 's', residual: 10 + out_p - ns}, {account: 'x', residual: -nx}] if r.residual <> 0] END AS nat,
   CASE WHEN err IS NOT NULL THEN [] ELSE [r for r in [{account: 's', residual: CAST(out_t - off_s - ts AS HUGEINT)}, {account: 't', residual: pre_t - out_t - tt}] if r.residual <> 0] END AS tok FROM z),
 rec AS (SELECT *, list_sort([b for b in [err, CASE WHEN supply THEN 'mint_burn_authority_and_supply_unverified' END, CASE WHEN err IS NULL THEN 'downstream_program_semantics_unverified' END, CASE WHEN err IS NULL AND x = 'open' THEN 'missing_endpoint_account_state' END,
   CASE WHEN len(nat) > 0 THEN 'native_balance_residual' END, CASE WHEN len(tok) > 0 THEN 'token_balance_residual' END] if b IS NOT NULL]) AS blockers FROM q)
"""


def _lives(spark, sf):
    """Accounts and steps of a transaction an order: each line is a short script on payer p, token account t, a passing account x and a receiver s."""
    from pyspark.sql.window import Window
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "token", "l_suppkey", "amount", "rf", "ls")
    p = written(lines(spark, sf).select(F.col("l_orderkey").alias("tx"), F.row_number().over(w).cast("long").alias("pos"), (F.col("l_suppkey") % 6).alias("script"), (F.col("amount") % 30).alias("n"), F.col("o_orderpriority").alias("pr")))

    def step(kind, source, target, amount="0", mint="NULL", owner="NULL", program=f"'{acc.TOKEN}'"):
        source = f"'{source}'" if source else "NULL"
        return f"named_struct('kind', '{kind}', 'source', {source}, 'target', '{target}', 'amount', CAST({amount} AS LONG), 'mint', {mint}, 'owner', {owner}, 'program', {program})"

    new = [step("create", "p", "x", 20, owner=f"'{acc.TOKEN}'"), step("init", "", "x", mint="'M'", owner="'p'")]
    move = lambda a, b: step("token_transfer", a, b, "n", "'M'")
    scripts = [[*new, move("t", "x"), move("x", "s"), step("close", "x", "p")], [step("transfer", "p", "s", 5)], [step("mint", "", "t", "n", "'M'"), step("burn", "", "t", "n", "'M'")],
               [*new, step("close", "x", "s")], [move("t", "s")], [*new, move("t", "x"), step("close", "x", "p")]]
    pick = "CASE script " + " ".join(f"WHEN {i} THEN array({', '.join(s)})" for i, s in enumerate(scripts)) + " END"
    e = p.select("tx", "pos", F.posexplode(F.expr(pick)).alias("_j", "_e"))
    e = e.select("tx", (F.col("pos") * 10 + F.col("_j")).alias("seq"), "_e.*", F.lit(None).cast("long").alias("parent"), F.lit(None).cast("int").alias("space"))
    od = b.table(spark, sf, "orders").select(F.col("o_orderkey").alias("tx"), F.floor("o_totalprice").alias("_p"))
    g = p.groupBy("tx").agg(F.sum(F.expr("CASE script WHEN 1 THEN 5 WHEN 3 THEN 20 ELSE 0 END")).alias("out_p"), F.sum(F.expr("CASE WHEN script IN (0, 4) THEN n ELSE 0 END")).alias("out_t"), F.max("pr").alias("pr")).join(od, "tx")
    token = lambda owner, amount: f"named_struct('mint', 'M', 'owner', '{owner}', 'program', '{acc.TOKEN}', 'amount', CAST({amount} AS LONG))"
    none = f"CAST(NULL AS {'struct<mint:string,owner:string,program:string,amount:long>'})"
    row = lambda name, pre, post, fee, t0, t1: f"named_struct('account', '{name}', 'pre', CAST({pre} AS LONG), 'post', CAST({post} AS LONG), 'fee', CAST({fee} AS LONG), 'token_pre', {t0}, 'token_post', {t1}, 'signer', {str(name == 'p').lower()}, 'writable', true)"
    rows = [row("p", "_p % 300", "_p % 300 - 5 - out_p + CASE WHEN pr = '1-URGENT' THEN 1 ELSE 0 END", 5, none, none), row("t", 10, 10, 0, token("p", "_p % 400"), token("p", "_p % 400 - out_t")),
            row("x", 0, 0, 0, none, none), row("s", 10, "10 + out_p", 0, token("q", 0), token("q", "out_t - CASE WHEN pr = '2-HIGH' THEN 1 ELSE 0 END"))]
    return g.select("tx", F.explode(F.expr(f"array({', '.join(rows)})")).alias("_a")).select("tx", "_a.*"), e


def _plain(c):
    return F.transform(c, lambda r: F.concat_ws(":", r["account"], r["residual"].cast("string")))


@query("G8", LIFE.replace("WITH", "WITH RECURSIVE", 1) + """SELECT tx, CASE WHEN len([b for b in blockers if b NOT IN ('downstream_program_semantics_unverified', 'mint_burn_authority_and_supply_unverified')]) = 0 THEN 'ENDPOINT_AMOUNTS_MATCH' ELSE 'UNKNOWN' END AS status, blockers,
 [r.account || ':' || r.residual for r in nat] AS native_residuals, [r.account || ':' || r.residual for r in tok] AS token_residuals FROM rec""")
def reconcile_lifecycle(spark, sf):
    """Transactions whose accounts are created, closed and created again, with refunds, supply changes and fees."""
    return acc.reconcile_lifecycle(*_lives(spark, sf)).select("tx", "status", "blockers", _plain("native_residuals").alias("native_residuals"), _plain("token_residuals").alias("token_residuals"))


@query("G8", LIFE + """, o AS (SELECT tx, seq, k, t, n, sum(CASE WHEN k = 'init' THEN 1 ELSE 0 END) OVER (PARTITION BY tx ORDER BY seq) - 1 AS g FROM f),
 x AS (SELECT tx, 'x' AS account, g AS generation, min(seq) FILTER (k = 'init') AS opened, max(seq) FILTER (k = 'close') AS shut, CASE WHEN count(*) FILTER (k = 'close') > 0 THEN 20 END AS refund, coalesce(sum(n) FILTER (k IN ('in', 'out')), 0) AS moved
   FROM o WHERE g >= 0 AND k <> 'create' GROUP BY ALL),
 y AS (SELECT f.tx, a AS account, 0 AS generation, -1 AS opened, NULL AS shut, NULL AS refund, coalesce(sum(n) FILTER ((a = 't' AND k IN ('in', 'send')) OR (a = 's' AND k IN ('out', 'send'))), 0) AS moved FROM f, (VALUES ('t'), ('s')) v(a) GROUP BY ALL)
 SELECT tx, account, generation, opened, shut, CAST(refund AS BIGINT) AS refund, CAST(moved AS BIGINT) AS moved FROM (FROM x UNION ALL FROM y)""")
def account_generations(spark, sf):
    d = acc.account_generations(*_lives(spark, sf))
    return d.select("tx", "account", "generation", "opened", "shut", F.col("refund").cast("long"), F.col("moved").cast("long"))


@query("J11 U2", LINES + """, e AS (SELECT DISTINCT 'c' || o_custkey AS owner, o_orderkey AS address FROM orders), a AS (SELECT DISTINCT owner, l_orderkey AS address FROM ln WHERE ls = 'F'),
 f AS (SELECT coalesce(e.owner, a.owner) AS owner, e.address AS e, a.address AS a FROM e FULL JOIN a ON a.owner = e.owner AND a.address = e.address)
 SELECT owner, count(e) AS expected, count(a) AS actual, count(*) FILTER (a IS NULL) AS missing, count(*) FILTER (e IS NULL) AS unexpected, count(*) FILTER (a IS NULL OR e IS NULL) = 0 AS complete FROM f GROUP BY owner""")
def reconcile_sets(spark, sf):
    e = b.table(spark, sf, "orders").select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("owner"), F.col("o_orderkey").alias("address"))
    a = lines(spark, sf).filter("ls = 'F'").select("owner", F.col("l_orderkey").alias("address"))
    return jn.reconcile_sets(e, a, "owner", "address")
