"""Feature, label and window queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketlens import bindings as b
from marketlens.operators import features as ft
from marketlens.operators import timeline as tl
from marketlens.registry import query


def r6(c: str):
    return F.round(F.col(c), 6).alias(c)


FEAT = b.SNAP + f""",
frames AS (SELECT *, count(*) OVER w AS points, ts - min(ts) OVER w AS history_s,
                  list(price) FILTER (price > 0) OVER w AS ps,
                  coalesce(list(liq) FILTER (liq > 0) OVER w, []) AS ls
           FROM snap WINDOW w AS (PARTITION BY mint ORDER BY ts RANGE BETWEEN {b.SPAN} PRECEDING AND CURRENT ROW)),
feat AS (SELECT * EXCLUDE (ps, ls), len(ps) AS n_prices,
    (list_max(ps) - list_min(ps)) / list_min(ps) AS band, ps[-1] / ps[1] - 1 AS net, price / ps[1] - 1 AS net_now,
    buys_h1 / greatest(1.0::DOUBLE, buys_h1 + sells_h1) AS buy_ratio, vol_h1 / greatest(1.0::DOUBLE, mc) AS vol_mc,
    vol_m5 / greatest(1.0::DOUBLE, vol_h1 / 12) AS vol_accel, ps[-1] / list_min(ps) - 1 AS reclaim,
    (list_position(ps, list_min(ps)) - 1) / greatest(1, len(ps) - 1) AS low_pos,
    CASE WHEN len(ls) > 1 THEN ls[-1] / ls[1] - 1 ELSE 0.0::DOUBLE END AS liq_change, liq / ls[1] - 1 AS liq_change_now,
    list_min(ps[len(ps) - greatest(1, len(ps) // 3) + 1:]) >= list_min(ps[1:greatest(1, len(ps) // 3)]) * 0.97::DOUBLE AS higher_low,
    coalesce(liq >= ls[1] * 0.9::DOUBLE, false) AS liq_stable FROM frames)
"""

SCORED = FEAT + """,
gated AS (SELECT *, CASE WHEN points < 4 OR history_s < 600 THEN 'history'
      WHEN NOT (mc BETWEEN 30000 AND 750000 AND liq >= 25000 AND vol_h1 >= 20000) THEN 'base_gate'
      WHEN n_prices < 4 THEN 'price_history' ELSE 'pass' END AS gate FROM feat),
signs AS (SELECT *, liq >= 25000 AS sig_liq25k, vol_mc >= 0.25::DOUBLE AS sig_vol_mc25, buy_ratio >= 0.52::DOUBLE AS sig_buy52,
   pc_h1 BETWEEN -8 AND 22 AS sig_h1_not_extended, pc_m5 BETWEEN -5 AND 10 AS sig_m5_not_extended,
   band <= 0.25::DOUBLE AS sig_band_compact, net_now BETWEEN -0.10::DOUBLE AND 0.20::DOUBLE AS sig_net_constructive,
   higher_low AS sig_higher_low, liq_stable AS sig_liq_stable,
   vol_h1 > 0 AND vol_m5 >= vol_h1 / 12 * 1.2::DOUBLE AS sig_volume_accel, buys_h1 + sells_h1 >= 100 AS sig_txns100 FROM gated),
scored AS (SELECT *, CASE WHEN gate = 'pass' THEN """ + " + ".join(f"sig_{s}::INT" for s in ft.SIGNALS) + """ ELSE 0 END AS score,
   CASE WHEN gate = 'pass' THEN list_filter([""" + ", ".join(f"CASE WHEN NOT sig_{s} THEN '{s}' END" for s in ft.SIGNALS) + """], lambda x: x IS NOT NULL)
        ELSE [gate] END AS failed FROM signs)
"""


REGIME_SQL = """CASE WHEN points < 4 THEN 'INSUFFICIENT'
  WHEN pc_h1 >= 35 AND vol_mc >= 0.75 AND buy_ratio >= 0.50 AND liq >= 25000 THEN 'CONTINUATION'
  WHEN band <= 0.35::DOUBLE AND net BETWEEN -0.12::DOUBLE AND 0.25::DOUBLE AND liq >= 25000 THEN 'COMPRESSION'
  WHEN band >= 0.30::DOUBLE AND reclaim >= 0.15::DOUBLE AND buy_ratio >= 0.51::DOUBLE AND low_pos > 0 THEN 'RECLAIM'
  ELSE 'OTHER' END"""


def features(spark, sf):
    return ft.trailing_features(b.snapshots(spark, sf), b.SPAN)


def scored(spark, sf):
    return ft.score_signals(features(spark, sf))


_FCOLS = ["band", "net", "net_now", "buy_ratio", "vol_mc", "vol_accel", "reclaim", "low_pos", "liq_change", "liq_change_now"]


@query("W1", FEAT + "SELECT id, mint, ts, points, history_s, n_prices, higher_low, liq_stable, "
       + ", ".join(f"round({c}, 6) AS {c}" for c in _FCOLS) + " FROM feat")
def trailing_features(spark, sf):
    d = features(spark, sf)
    return d.select("id", "mint", "ts", "points", "history_s", F.col("n_prices").cast("long").alias("n_prices"),
                    "higher_low", "liq_stable", *[r6(c) for c in _FCOLS])


@query("P2 P4", SCORED + "SELECT id, mint, ts, gate, CAST(score AS BIGINT) AS score, failed FROM scored")
def score_signals(spark, sf):
    return scored(spark, sf).select("id", "mint", "ts", "gate", F.col("score").cast("long").alias("score"), "failed")


@query("P3", FEAT + """SELECT id, mint, points >= 4 AND history_s >= 600 AND mc BETWEEN 30000 AND 750000
 AND liq >= 25000 AND vol_h1 >= 20000 AS eligible FROM feat""")
def match_eligible(spark, sf):
    return features(spark, sf).select("id", "mint", ft.match_eligible().alias("eligible"))


@query("P5", SCORED + """, lv AS (SELECT *, CASE WHEN score >= 8 THEN 2 WHEN score >= 6 THEN 1 ELSE 0 END AS level FROM scored),
 pv AS (SELECT *, coalesce(max(level) OVER (PARTITION BY mint ORDER BY ts, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS previous_level FROM lv)
 SELECT id, mint, ts, CAST(score AS BIGINT) AS score, CAST(level AS BIGINT) AS level, CAST(previous_level AS BIGINT) AS previous_level
 FROM pv WHERE level > previous_level""")
def alert_upgrades(spark, sf):
    d = ft.alert_upgrades(scored(spark, sf), b.CHUNK, (6, 8))
    return d.select("id", "mint", "ts", *[F.col(c).cast("long").alias(c) for c in ("score", "level", "previous_level")])


@query("P6", FEAT + f"SELECT id, mint, ts, {REGIME_SQL} AS regime FROM feat")
def classify_regime(spark, sf):
    return features(spark, sf).select("id", "mint", "ts", ft.classify_regime().alias("regime"))


PATHS = b.SNAP + f""",
steps AS (SELECT *, ts - lag(ts) OVER (PARTITION BY mint ORDER BY ts) AS step FROM snap),
segs AS (SELECT *, sum(CASE WHEN step > {b.GAP} THEN 1 ELSE 0 END) OVER (PARTITION BY mint ORDER BY ts) AS seg FROM steps),
ends AS (SELECT *, first_value(ts) OVER e AS ets, first_value(mc) OVER e AS emc, first_value(seg) OVER e AS eseg,
   max(mc) OVER i AS top, count(*) OVER i AS n_in FROM segs
   WINDOW e AS (PARTITION BY mint ORDER BY ts RANGE BETWEEN {b.HORIZON} FOLLOWING AND {b.HORIZON + b.LATE} FOLLOWING),
          i AS (PARTITION BY mint ORDER BY ts RANGE BETWEEN 1 FOLLOWING AND {b.HORIZON} FOLLOWING)),
why AS (SELECT *, CASE WHEN ets IS NULL THEN 'missing_endpoint' WHEN eseg > seg THEN 'gap'
   WHEN n_in = 0 THEN 'missing_within_window' ELSE 'covered' END AS reason FROM ends),
paths AS (SELECT *, CASE WHEN reason = 'covered' THEN top / mc END AS max_multiple,
   CASE WHEN reason = 'covered' THEN emc / mc END AS endpoint_multiple,
   CASE WHEN reason = 'covered' THEN ets - ts - {b.HORIZON} END AS endpoint_late FROM why),
labelled AS (SELECT *, CASE WHEN max_multiple >= 2 THEN 'run' WHEN max_multiple < 1.35::DOUBLE THEN 'non_run'
   WHEN max_multiple IS NOT NULL THEN 'intermediate' END AS label FROM paths)
"""


def paths(df):
    return ft.label_paths(df, b.HORIZON, b.LATE, b.GAP)


@query("W3", PATHS + """SELECT id, mint, ts, reason, round(max_multiple, 6) AS max_multiple,
 round(endpoint_multiple, 6) AS endpoint_multiple, endpoint_late, label FROM labelled""")
def label_runs(spark, sf):
    d = paths(b.snapshots(spark, sf))
    return d.select("id", "mint", "ts", "reason", r6("max_multiple"), r6("endpoint_multiple"), "endpoint_late", "label")


@query("A16 F4", PATHS + """SELECT strftime(to_timestamp(ts) AT TIME ZONE 'UTC', '%Y-%m-%d') AS utc_day, reason,
 coalesce(label, 'none') AS label, count(*) AS n FROM labelled GROUP BY ALL""")
def label_reasons_by_day(spark, sf):
    d = paths(b.snapshots(spark, sf))
    return (d.groupBy(F.date_format(F.timestamp_seconds("ts"), "yyyy-MM-dd").alias("utc_day"), "reason",
                      F.coalesce("label", F.lit("none")).alias("label")).agg(F.count(F.lit(1)).alias("n")))


@query("W2", b.SNAP + f""", g AS (SELECT *, ts - lag(ts) OVER (PARTITION BY mint ORDER BY ts, id) AS gap FROM snap),
 s AS (SELECT *, CAST(sum(CASE WHEN gap > {b.GAP} THEN 1 ELSE 0 END) OVER (PARTITION BY mint ORDER BY ts, id) AS BIGINT) AS segment FROM g)
 SELECT id, mint, gap, segment FROM s""")
def continuity(spark, sf):
    return ft.continuity(b.snapshots(spark, sf), b.GAP, b.CHUNK).select("id", "mint", "gap", "segment")


PREHISTORY_SQL = b.SNAP + f""", a AS (SELECT *, ts - lag(ts) OVER (PARTITION BY mint ORDER BY ts, id) AS step FROM snap),
 c AS (SELECT *, sum(CASE WHEN step > {b.GAP} THEN 1 ELSE 0 END) OVER (PARTITION BY mint ORDER BY ts, id) AS bad FROM a),
 d AS (SELECT *, count(*) OVER w AS n, min(ts) OVER w AS t0, first_value(bad) OVER w AS bad0 FROM c
       WINDOW w AS (PARTITION BY mint ORDER BY ts RANGE BETWEEN {b.PRE} PRECEDING AND CURRENT ROW)),
 pre AS (SELECT *, n >= 4 AND t0 <= ts - {b.PRE} + {b.GAP} AND bad0 = bad AS prehistory_ok FROM d)
"""


@query("W2", PREHISTORY_SQL + "SELECT id, mint, prehistory_ok FROM pre")
def prehistory_complete(spark, sf):
    return ft.prehistory_complete(b.snapshots(spark, sf), b.PRE, b.GAP).select("id", "mint", "prehistory_ok")


@query("W4", b.SNAP + """, f AS (SELECT *, first_value(mc) OVER w AS a, first_value(ts) OVER w AS a_ts FROM snap
 WINDOW w AS (PARTITION BY mint, pair ORDER BY ts, id))
 SELECT id, mint, pair, round(mc / a, 6) AS anchor_multiple, ts - a_ts AS anchor_age FROM f""")
def anchor_gain(spark, sf):
    return ft.anchor_gain(b.snapshots(spark, sf), b.CHUNK).select("id", "mint", "pair", r6("anchor_multiple"), "anchor_age")


@query("W5", b.SNAP + f"""SELECT id, mint, min(pair) OVER w <> max(pair) OVER w AS pair_switch FROM snap
 WINDOW w AS (PARTITION BY mint ORDER BY ts RANGE BETWEEN {b.DAY} PRECEDING AND {b.DAY // 2} FOLLOWING)""")
def pair_switch(spark, sf):
    return ft.pair_switch(b.snapshots(spark, sf), b.DAY, b.DAY // 2).select("id", "mint", "pair_switch")


MOVES = b.SNAP + f""", a AS (SELECT *, ts - lag(ts) OVER (PARTITION BY mint ORDER BY ts, id) AS step FROM snap),
 c AS (SELECT *, sum(CASE WHEN step > {b.DAY} THEN 1 ELSE 0 END) OVER (PARTITION BY mint ORDER BY ts, id) AS bad FROM a),
 d AS (SELECT *, last_value(ts) OVER w AS bts, last_value(price) OVER w AS bprice, last_value(bad) OVER w AS bbad FROM c
   WINDOW w AS (PARTITION BY mint ORDER BY ts RANGE BETWEEN {b.DAY + b.DAY // 2} PRECEDING AND {b.DAY} PRECEDING)),
 moves AS (SELECT *, CASE WHEN bbad = bad THEN (price / nullif(bprice, 0) - 1) * 100 END AS move_pct,
   CASE WHEN bbad = bad THEN ts - bts END AS elapsed FROM d)
"""


def moves(spark, sf):
    return ft.movement(b.snapshots(spark, sf), b.DAY, b.DAY // 2, b.DAY)


@query("W6", MOVES + "SELECT id, mint, round(move_pct, 6) AS move_pct, elapsed FROM moves")
def movement(spark, sf):
    return moves(spark, sf).select("id", "mint", r6("move_pct"), "elapsed")


@query("W8 J6", b.SNAP + """SELECT mint, id AS first_id, ts AS first_ts, CAST(n - 1 AS BIGINT) AS repeats FROM
 (SELECT *, row_number() OVER (PARTITION BY mint ORDER BY ts, id) AS rn, count(*) OVER (PARTITION BY mint) AS n
  FROM snap WHERE pair = 'purchase') WHERE rn = 1""")
def first_per_key(spark, sf):
    from marketlens.operators.tables import first_per_key as first
    d = b.snapshots(spark, sf).filter("pair = 'purchase'")
    return first(d, ["mint"], ["ts", "id"]).select("mint", F.col("id").alias("first_id"), F.col("ts").alias("first_ts"), "repeats")


@query("W9", b.SNAP + f"""SELECT id, mint, round(mc / max(mc) OVER (PARTITION BY mint ORDER BY ts
 RANGE BETWEEN {b.PRE} PRECEDING AND 1 PRECEDING), 6) AS prior_peak_ratio FROM snap""")
def prior_peak_ratio(spark, sf):
    return ft.prior_peak_ratio(b.snapshots(spark, sf), b.PRE).select("id", "mint", r6("prior_peak_ratio"))


@query("W11", b.SNAP.replace("WITH", "WITH RECURSIVE", 1) + """,
 t AS (SELECT id, mint, ts - CASE WHEN k % 5 = 0 THEN 90000 ELSE 0 END AS local_ts, ts - (k % 7) * 20000 AS source_ts,
       row_number() OVER (PARTITION BY mint ORDER BY id) AS rn FROM snap),
 walk AS (SELECT id, mint, rn, local_ts AS t, source_ts AS s, 'accepted' AS sequence_reason FROM t WHERE rn = 1
  UNION ALL SELECT n.id, n.mint, n.rn,
   CASE WHEN n.local_ts > w.t AND n.source_ts >= w.s THEN n.local_ts ELSE w.t END,
   CASE WHEN n.local_ts > w.t AND n.source_ts >= w.s THEN n.source_ts ELSE w.s END,
   CASE WHEN n.local_ts <= w.t THEN 'clock_or_duplicate' WHEN n.source_ts < w.s THEN 'source_time_reversed' ELSE 'accepted' END
  FROM walk w JOIN t n ON n.mint = w.mint AND n.rn = w.rn + 1)
 SELECT id, mint, sequence_reason FROM walk""")
def sequence_guard(spark, sf):
    d = b.snapshots(spark, sf).select("id", "mint", F.expr("ts - (k % 7) * 20000").alias("source_ts"),
                                      F.expr("ts - CASE WHEN k % 5 = 0 THEN 90000 ELSE 0 END").alias("local_ts"))
    return ft.sequence_guard(d, 5_000, ts="local_ts").select("id", "mint", "sequence_reason")
