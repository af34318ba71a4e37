"""Alarm and change-detection queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketlens import bindings as b
from marketlens.operators import alarms as al
from marketlens.operators import features as ft
from marketlens.plans.market import MOVES, PATHS, moves, paths, r6
from marketlens.registry import query

LEVELS = [20.0, 60.0, 120.0]
RECURSIVE = b.SNAP.replace("WITH", "WITH RECURSIVE", 1)


def recursive(prefix: str) -> str:
    return prefix.replace("WITH", "WITH RECURSIVE", 1)


def spaced(source: str, keys: str, sep: int) -> str:
    """CTE ``picked``: rows of ``source`` in (keys, ts) order kept when ``sep`` has passed since the last kept."""
    cols = keys.split(", ")
    on = " AND ".join(f"n.{c} = w.{c}" for c in cols)
    return f""",
 numbered AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY ts, id) AS rn FROM {source}),
 walk AS (SELECT {keys}, rn, ts, id, ts AS last_ts, true AS hit FROM numbered WHERE rn = 1
   UNION ALL SELECT {', '.join('n.' + c for c in cols)}, n.rn, n.ts, n.id, CASE WHEN n.ts >= w.last_ts + {sep} THEN n.ts ELSE w.last_ts END,
    n.ts >= w.last_ts + {sep} FROM walk w JOIN numbered n ON {on} AND n.rn = w.rn + 1),
 picked AS (SELECT s.* FROM {source} s SEMI JOIN (SELECT * FROM walk WHERE hit) w ON {' AND '.join(f's.{c} = w.{c}' for c in cols)} AND s.id = w.id)
"""


GAPPED = recursive(b.SNAP) + f""",
 g AS (SELECT *, ts - lag(ts) OVER (PARTITION BY mint ORDER BY ts, id) AS gap FROM snap),
 seg AS (SELECT *, sum(CASE WHEN gap > {b.GAP} THEN 1 ELSE 0 END) OVER (PARTITION BY mint ORDER BY ts, id) AS segment,
   gap IS NULL OR gap > {b.GAP} AS opens FROM g)
"""


@query("R3 X1", GAPPED + f""", lv AS (SELECT *, unnest({LEVELS}::DOUBLE[]) AS level FROM seg),
 sig AS (SELECT *, CASE WHEN opens THEN (price < level)::INT WHEN price <= level * 0.9::DOUBLE THEN 1 WHEN price >= level THEN 0 END AS moved FROM lv),
 arm AS (SELECT *, last_value(moved IGNORE NULLS) OVER (PARTITION BY mint, segment, level ORDER BY ts, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS armed FROM sig),
 cand AS (SELECT mint, segment, level, ts, id, price FROM arm WHERE NOT opens AND price >= level AND armed = 1)"""
       + spaced("cand", "mint, segment, level", b.COOLDOWN) + "SELECT id, mint, ts, level, price FROM picked")
def level_cross(spark, sf):
    d = al.level_cross(b.snapshots(spark, sf), LEVELS, 10.0, b.COOLDOWN, b.GAP, b.CHUNK)
    return d.select("id", "mint", "ts", "level", "price")


@query("R4", b.SNAP + """, t AS (SELECT unnest([100000.0, 200000.0, 300000.0]::DOUBLE[]) AS target),
 m AS (SELECT *, CASE WHEN pair = 'error' THEN NULL ELSE mc END AS cap FROM snap)
 SELECT mint, target, min(ts) AS ts, arg_min(id, (ts, id)) AS id, arg_min(cap, (ts, id)) AS cap FROM m JOIN t ON cap >= target GROUP BY mint, target""")
def one_shot_targets(spark, sf):
    d = b.snapshots(spark, sf).withColumn("cap", F.expr("CASE WHEN pair <> 'error' THEN mc END"))
    return al.one_shot_targets(d, [100_000, 200_000, 300_000], value="cap").select("mint", "target", "ts", "id", "cap")


@query("R5", GAPPED + ", cand AS (SELECT mint, ts, id, price FROM seg WHERE opens AND price >= 20)" + spaced("cand", "mint", 7 * b.DAY)
       + "SELECT id, mint, ts, price FROM picked")
def gap_baseline(spark, sf):
    return al.gap_baseline(b.snapshots(spark, sf), LEVELS, 7 * b.DAY, b.GAP).select("id", "mint", "ts", "price")


REF = GAPPED + f""", ref AS (SELECT *, last_value(liq) OVER w AS rliq, last_value(price) OVER w AS rprice, last_value(vol_m5) OVER w AS rvol,
   last_value(segment) OVER w AS rseg FROM seg WINDOW w AS (PARTITION BY mint ORDER BY ts RANGE BETWEEN {3 * b.DAY} PRECEDING AND {b.DAY} PRECEDING))
"""


@query("R6", REF + ", cand AS (SELECT id, mint, ts, liq / nullif(rliq, 0) AS q FROM ref WHERE rseg = segment AND liq / nullif(rliq, 0) <= 0.85::DOUBLE)"
       + spaced("cand", "mint", 2 * b.COOLDOWN) + "SELECT id, mint, ts, round(q, 6) AS liq_ratio FROM picked")
def liquidity_drop(spark, sf):
    d = al.liquidity_drop(b.snapshots(spark, sf), 3 * b.DAY, b.DAY, 0.85, 2 * b.COOLDOWN, b.GAP)
    return d.select("id", "mint", "ts", r6("liq_ratio"))


@query("R7", REF + """, cand AS (SELECT id, mint, ts, price FROM ref WHERE rseg = segment AND rvol >= 100 AND vol_m5 >= 2 * rvol AND buys_m5 + sells_m5 >= 20
   AND buys_m5 / nullif(buys_m5 + sells_m5, 0) >= 0.6::DOUBLE AND price > rprice AND price >= 20 * 0.95::DOUBLE AND rliq > 0 AND liq >= rliq * 0.95::DOUBLE)"""
       + spaced("cand", "mint", 2 * b.COOLDOWN) + "SELECT id, mint, ts, price FROM picked")
def activity_watch(spark, sf):
    d = al.activity_watch(b.snapshots(spark, sf), 20.0, 3 * b.DAY, b.DAY, 2 * b.COOLDOWN, b.GAP)
    return d.select("id", "mint", "ts", "price")


@query("R8", recursive(MOVES) + ", cand AS (SELECT id, mint, ts, move_pct FROM moves WHERE abs(move_pct) + 1e-9 >= CASE WHEN mint % 2 = 0 THEN 50 ELSE 80 END)"
       + spaced("cand", "mint", 3 * b.COOLDOWN) + "SELECT id, mint, ts, round(move_pct, 6) AS move_pct FROM picked")
def movement_alarm(spark, sf):
    limit = F.expr("CASE WHEN mint % 2 = 0 THEN 50D ELSE 80D END")
    return al.movement_alarm(moves(spark, sf), limit, 3 * b.COOLDOWN).select("id", "mint", "ts", r6("move_pct"))


@query("R8", recursive(MOVES) + f""", cand AS (SELECT id, mint, ts, move_pct, id % 3 <> 0 AS ok, row_number() OVER (PARTITION BY mint ORDER BY ts, id) AS n FROM moves WHERE abs(move_pct) + 1e-9 >= CASE WHEN mint % 2 = 0 THEN 50 ELSE 80 END),
 walk AS (SELECT *, true AS fired, CASE WHEN ok THEN ts END AS sent, ts AS tried FROM cand WHERE n = 1
  UNION ALL SELECT c.*, go, CASE WHEN go AND c.ok THEN c.ts ELSE sent END, CASE WHEN go THEN c.ts ELSE tried END
  FROM (SELECT mint AS m, n AS k, sent, tried FROM walk) JOIN cand c ON c.mint = m AND c.n = k + 1, LATERAL (SELECT coalesce(c.ts - sent >= {3 * b.COOLDOWN}, true) AND c.ts - tried >= {b.COOLDOWN // 2} AS go))
 SELECT id, mint, ts, round(move_pct, 6) AS move_pct FROM walk WHERE fired""")
def movement_alarm_with_delivery(spark, sf):
    """One message in three fails: its key may try again after the retry wait, long before the cooldown."""
    limit = F.expr("CASE WHEN mint % 2 = 0 THEN 50D ELSE 80D END")
    d = al.movement_alarm_with_delivery(moves(spark, sf).withColumn("ok", F.col("id") % 3 != 0), limit, "ok", 3 * b.COOLDOWN, b.COOLDOWN // 2, width=4 * b.DAY)
    return d.select("id", "mint", "ts", r6("move_pct"))


@query("R9", RECURSIVE + """, numbered AS (SELECT mint, ts, price, row_number() OVER (PARTITION BY mint ORDER BY ts, id) AS rn FROM snap),
 walk AS (SELECT mint, rn, ts, price, price AS ref, false AS hit FROM numbered WHERE rn = 1
  UNION ALL SELECT n.mint, n.rn, n.ts, n.price, CASE WHEN n.price >= w.ref * 1.1::DOUBLE THEN n.price ELSE w.ref END, n.price >= w.ref * 1.1::DOUBLE
  FROM walk w JOIN numbered n ON n.mint = w.mint AND n.rn = w.rn + 1)
 SELECT mint, ts, price FROM walk WHERE hit""")
def trailing_reference(spark, sf):
    return al.trailing_reference(b.snapshots(spark, sf), 1.1, b.CHUNK).select("mint", "ts", "price")


@query("R2", b.SNAP + """SELECT id, mint, CASE WHEN k = 99 THEN 'invalid_time' WHEN k - 30 < -5 THEN 'future' WHEN k - 30 > 60 THEN 'stale' WHEN id % 90 > 60 THEN 'cached_too_long' WHEN abs(id % 300 - 150) > 120 THEN 'server_clock' ELSE 'fresh' END AS freshness FROM snap""")
def freshness_filter(spark, sf):
    d = b.snapshots(spark, sf).withColumn("source_ts", F.expr("CASE WHEN k <> 99 THEN ts - k + 30 END"))
    d = d.withColumn("cached", F.expr("CASE WHEN id % 7 > 0 OR id % 90 > 60 THEN id % 90 END")).withColumn("served", F.expr("ts + id % 300 - 150"))
    return d.select("id", "mint", al.freshness(behind=60, cached="cached", served="served").alias("freshness"))


@query("R10", b.SNAP + f""", r AS (SELECT *, sum((pair NOT IN ('error', 'view', 'signup'))::INT) OVER (PARTITION BY mint ORDER BY ts, id) AS run, pair NOT IN ('error', 'view', 'signup') AS ok FROM snap),
 s AS (SELECT *, min(ts) OVER (PARTITION BY mint, run) AS since FROM r WHERE NOT ok),
 w AS (SELECT mint, run, since, min(ts) AS ts FROM s WHERE ts - since >= {b.DAY} GROUP BY ALL)
 SELECT mint, ts, since, 'outage' AS notice FROM w UNION ALL
 SELECT r.mint, r.ts, w.since, 'recovered' FROM r JOIN w ON r.mint = w.mint AND r.run = w.run + 1 WHERE r.ok""")
def feed_health(spark, sf):
    ok = ~F.col("pair").isin("error", "view", "signup")
    return al.feed_health(b.snapshots(spark, sf), ok, b.DAY, b.CHUNK).select("mint", "ts", "since", "notice")


STATUS = b.SNAP + f""", l AS (SELECT *, last_value(CASE WHEN pair IN ('purchase', 'click') THEN ts END IGNORE NULLS) OVER (PARTITION BY mint ORDER BY ts, id) AS ok_ts FROM snap),
 status AS (SELECT *, CASE WHEN k >= 95 THEN 'paused' WHEN k < 3 THEN 'unhealthy' WHEN ts < {b.NOW - 2 * b.DAY} AND coalesce(ts - ok_ts > {b.DAY}, true) THEN 'stalled'
   WHEN ts >= {b.NOW - 2 * b.DAY} THEN 'stopped' ELSE 'collecting' END AS status FROM l)
"""


def statuses(spark, sf):
    d = b.snapshots(spark, sf)
    return al.stall_detection(d, F.col("pair").isin("purchase", "click"), b.DAY, b.CHUNK, stopped=F.col("ts") >= b.NOW - 2 * b.DAY,
                              paused=F.col("k") >= 95, unhealthy=F.col("k") < 3)


@query("R13", STATUS + "SELECT id, mint, ok_ts AS last_success, status FROM status")
def stall_detection(spark, sf):
    return statuses(spark, sf).select("id", "mint", "last_success", "status")


@query("R12", recursive(STATUS) + f""", numbered AS (SELECT id, mint, ts, status, CASE WHEN status IN ('paused', 'stalled', 'unhealthy', 'unavailable') THEN status END AS inc,
   row_number() OVER (PARTITION BY mint ORDER BY ts, id) AS rn FROM status),
 walk AS (SELECT mint, id, rn, CASE WHEN inc IS NOT NULL THEN inc END AS was, CASE WHEN inc IS NOT NULL THEN ts END AS at_ts, CASE WHEN inc IS NULL THEN 'idle' ELSE 'sent' END AS delivery FROM numbered WHERE rn = 1
  UNION ALL SELECT mint, id, rn, CASE WHEN delivery = 'sent' THEN inc ELSE was END, CASE WHEN delivery = 'sent' THEN ts ELSE at_ts END, delivery FROM (
   SELECT n.*, w.was, w.at_ts, CASE WHEN n.inc IS NULL AND NOT (n.status = 'collecting' AND w.was IS NOT NULL) THEN 'idle' WHEN n.inc = w.was THEN 'idle'
     WHEN n.ts < w.at_ts + {b.DAY // 2} THEN 'retry_wait' ELSE 'sent' END AS delivery FROM walk w JOIN numbered n ON n.mint = w.mint AND n.rn = w.rn + 1))
 SELECT id, mint, delivery FROM walk""")
def incident_transitions(spark, sf):
    return al.incident_transitions(statuses(spark, sf), b.DAY // 2, b.CHUNK).select("id", "mint", "delivery")


@query("R16", b.SNAP + f""", f AS (SELECT *, k // 34 AS fp FROM snap), c AS (SELECT *, coalesce(fp <> lag(fp) OVER (PARTITION BY mint ORDER BY ts, id), false)::INT AS ch FROM f),
 e AS (SELECT *, sum(ch) OVER (PARTITION BY mint ORDER BY ts, id) AS epoch FROM c),
 m AS (SELECT *, last_value(price) OVER (PARTITION BY mint, epoch ORDER BY ts RANGE BETWEEN {b.DAY + b.DAY // 2} PRECEDING AND {b.DAY // 4} PRECEDING) AS base FROM e)
 SELECT id, mint, CAST(epoch AS BIGINT) AS epoch, round((price / nullif(base, 0) - 1) * 100, 6) AS move_pct FROM m""")
def identity_reset(spark, sf):
    d = al.identity_epochs(b.snapshots(spark, sf).withColumn("fp", F.expr("k div 34")), "fp", b.CHUNK)
    d = ft.movement(d, b.DAY // 4, b.DAY + b.DAY // 4, 30 * b.DAY, keys=("mint", "epoch"))
    return d.select("id", "mint", "epoch", r6("move_pct"))


MESSAGES = b.SNAP + f""", msg AS (SELECT mint, pair, ts, id, substr(sha256(mint || '|' || pair || '|' || (ts // {b.DAY})), 1, 16) AS event FROM snap),
 box AS (SELECT event, min(ts) AS ts, arg_min(id, (ts, id)) AS id FROM msg GROUP BY event),
 st AS (SELECT *, CASE WHEN ts + {7 * b.DAY} <= {b.NOW} THEN 'expired' ELSE 'pending' END AS status FROM box)
"""


def _outbox(spark, sf):
    d = b.snapshots(spark, sf).select("ts", "id", "mint", "pair")
    key = F.concat_ws("|", F.col("mint").cast("string"), "pair", F.expr(f"cast(ts div {b.DAY} as string)"))
    return al.outbox(d, key, b.NOW, 7 * b.DAY)


@query("R11", MESSAGES + "SELECT event, ts, id, status FROM st")
def outbox(spark, sf):
    return _outbox(spark, sf)[0].select("event", "ts", "id", "status")


@query("R11", MESSAGES + "SELECT event, ts, id FROM st WHERE status = 'pending' ORDER BY ts, event LIMIT 3")
def outbox_pending(spark, sf):
    return _outbox(spark, sf)[1].select("event", "ts", "id")


CHANGES = b.SNAP + f""", o AS (SELECT id, mint, ts, k * 1000 AS amount, 100000 AS supply, pair AS terms, id - (k % 9) * 300 AS slot, {b.NOW - 10 * b.DAY} AS cliff FROM snap),
 t AS (SELECT *, max(slot) OVER (PARTITION BY mint ORDER BY ts, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM o),
 v AS (SELECT *, lag(amount) OVER w AS pa, lag(terms) OVER w AS pt, lag(ts) OVER w AS pts FROM t WHERE top IS NULL OR slot >= top WINDOW w AS (PARTITION BY mint ORDER BY ts, id)),
 ch AS (SELECT id, mint, ts, terms, unnest(list_filter([CASE WHEN pa - amount >= supply * 0.001::DOUBLE THEN 'amount_drop' END, CASE WHEN pt <> terms THEN 'terms_changed' END,
   CASE WHEN cliff - pts > 86400 AND cliff - ts BETWEEN 0 AND 86400 THEN 'cliff_86400' END, CASE WHEN cliff - pts > 604800 AND cliff - ts BETWEEN 0 AND 604800 THEN 'cliff_604800' END],
   lambda x: x IS NOT NULL)) AS change FROM v WHERE pts IS NOT NULL)
"""


def changes(spark, sf):
    d = b.snapshots(spark, sf).select("id", "mint", "ts", F.expr("k * 1000").alias("amount"), F.lit(100_000).alias("supply"),
                                      F.col("pair").alias("terms"), F.expr("id - (k % 9) * 300").alias("slot"),
                                      F.lit(b.NOW - 10 * b.DAY).alias("cliff"))
    return al.detect_changes(d, b.CHUNK, terms=["terms"], cliff="cliff")


@query("W10", CHANGES + "SELECT id, mint, change FROM ch")
def detect_changes(spark, sf):
    return changes(spark, sf).select("id", "mint", "change")


@query("R15", CHANGES + """SELECT sha256(mint || '|' || change || '|' || terms) AS event_id, count(*) AS seen, arg_min(id, (ts, id)) AS id FROM ch GROUP BY mint, change, terms""")
def change_events_once(spark, sf):
    return al.change_events_once(changes(spark, sf), ["mint"], ["change", "terms"]).select("event_id", "seen", "id")


THIN = RECURSIVE + """, numbered AS (SELECT *, row_number() OVER (PARTITION BY mint ORDER BY ts DESC, id DESC) AS rn FROM snap),
 walk AS (SELECT mint, rn, ts, id, ts AS last_ts, 0 AS picks, true AS hit FROM numbered WHERE rn = 1
  UNION ALL SELECT n.mint, n.rn, n.ts, n.id, CASE WHEN w.last_ts - n.ts >= 86400 THEN n.ts ELSE w.last_ts END,
   CASE WHEN w.last_ts - n.ts >= 86400 THEN w.picks + 1 ELSE w.picks END, w.last_ts - n.ts >= 86400 FROM walk w JOIN numbered n ON n.mint = w.mint AND n.rn = w.rn + 1),
 thin AS (SELECT s.*, w.picks FROM walk w JOIN snap s ON s.id = w.id WHERE w.hit AND w.picks < 3)
"""


@query("W7", THIN + "SELECT id, mint, CAST(picks AS BIGINT) AS step_back FROM thin")
def thin_observations(spark, sf):
    return al.thin_observations(b.snapshots(spark, sf), b.DAY).select("id", "mint", "step_back")


@query("W7 F14", THIN + """, g AS (SELECT mint, count(*) AS n, count(*) FILTER (buys_m5 > sells_m5 AND vol_m5 > 0) AS buy_heavy, arg_min(liq, ts) AS l0, arg_max(liq, ts) AS l1 FROM thin GROUP BY mint)
 SELECT mint, n, buy_heavy, CASE WHEN n < 3 THEN 'INSUFFICIENT_HISTORY' WHEN buy_heavy >= 2 AND l0 > 0 AND l1 >= l0 * 0.9::DOUBLE THEN 'ACTIVITY_SUPPORTED' ELSE 'MIXED_OR_WEAK' END AS status,
  CASE WHEN n >= 3 THEN round_even((l1 / nullif(l0, 0) - 1) * 100, 1) END AS liquidity_change_pct FROM g""")
def activity_status(spark, sf):
    return al.activity_status(al.thin_observations(b.snapshots(spark, sf), b.DAY))


@query("E10", recursive(PATHS) + ", cand AS (SELECT id, mint, ts FROM labelled WHERE label = 'run')" + spaced("cand", "mint", b.HORIZON)
       + "SELECT id, mint, ts FROM picked")
def nonoverlapping_episodes(spark, sf):
    runs = paths(b.snapshots(spark, sf)).filter("label = 'run'").select("id", "mint", "ts")
    return al.cooled(runs, ["mint"], "ts", b.HORIZON)
