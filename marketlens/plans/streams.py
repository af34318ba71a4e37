"""Streaming queries over the event file; each must return what its batch form returns."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketlens import bindings as b
from marketlens.plans import alarms as pa
from marketlens.registry import ORACLES, query
from marketlens.streaming import rules
from marketlens.streaming import streams as st

EVENT_SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def event_stream(spark, sf):
    d = spark.readStream.schema(EVENT_SCHEMA).option("pathGlobFilter", "events.parquet").parquet(sf)
    return d.select(F.col("event_id").alias("id"), F.col("user_id").alias("mint"), F.col("ts").cast("timestamp").alias("at"), b.epoch("ts").alias("ts"),
                    F.col("event_type").alias("pair"), F.col("value").alias("price"), F.expr("cast(get_json_object(props, '$.k') as bigint)").alias("k"))


def ruled(stream, rule, output, name, **more):
    """A rule per instrument over the whole source; none of its rows can be late, as it is complete when the clock strikes."""
    return st.run_rule(stream, ["mint"], rule, output, name, **more).filter("reason IS NULL").drop("reason")


@query("R1", b.SNAP + """, w AS (SELECT (max(epoch_us(ts)) // 1000 - 86400000) AS mark FROM events)
 SELECT mint, ts // 21600 * 21600 AS bucket, arg_max(id, ts) AS id, arg_max(price, ts) AS price FROM snap, w WHERE (ts // 21600 * 21600 + 21600) * 1000 <= mark GROUP BY mint, ts // 21600""")
def stream_snapshots(spark, sf):
    """Six-hour bars that the one-day watermark has closed."""
    d = st.stream_snapshots(event_stream(spark, sf), "at", "mint", ["id", "price"], 21_600, 86_400)
    return st.run_available(d, "bars").select("mint", "bucket", "id", "price")


@query("R3 X2", ORACLES["level_cross"])
def stream_level_cross(spark, sf):
    rule = rules.level_cross(pa.LEVELS, 10.0, b.COOLDOWN, b.GAP)
    return ruled(event_stream(spark, sf).select("id", "mint", "ts", "price"), rule, "id long, mint long, ts long, level double, price double", "level-cross")


@query("R4 X2", ORACLES["one_shot_targets"])
def stream_one_shot_targets(spark, sf):
    d = event_stream(spark, sf).select("id", "mint", "ts", F.expr("CASE WHEN pair <> 'error' THEN price * 1000 END").alias("cap"))
    return ruled(d, rules.one_shot_targets([100_000, 200_000, 300_000]), "mint long, target double, ts long, id long, cap double", "targets")


@query("R8 X2", ORACLES["movement_alarm"])
def stream_movement_alarm(spark, sf):
    rule = rules.movement_alarm(lambda r: 50.0 if r["mint"] % 2 == 0 else 80.0, b.DAY, b.DAY // 2, b.DAY, 3 * b.COOLDOWN)
    return ruled(event_stream(spark, sf).select("id", "mint", "ts", "price"), rule, "id long, mint long, ts long, move_pct double", "movement")


@query("R9 X2", ORACLES["trailing_reference"])
def stream_trailing_reference(spark, sf):
    return ruled(event_stream(spark, sf).select("id", "mint", "ts", "price"), rules.trailing_reference(1.1), "mint long, ts long, price double", "reference")


@query("R10 X2", ORACLES["feed_health"])
def stream_feed_health(spark, sf):
    d = event_stream(spark, sf).select("id", "mint", "ts", (~F.col("pair").isin("error", "view", "signup")).alias("ok"))
    return ruled(d, rules.feed_health(b.DAY), "mint long, ts long, since long, notice string", "feeds")


@query("R8 X2", ORACLES["movement_alarm_with_delivery"])
def stream_movement_alarm_with_delivery(spark, sf):
    """Samples and, half a minute later, what became of the message of each: one in three fails."""
    s = event_stream(spark, sf).select("id", "mint", "ts", "price")
    none = F.lit(None)
    rows = s.select("id", "mint", "ts", "price", none.cast("long").alias("attempt"), none.cast("boolean").alias("ok"))
    told = s.select("id", "mint", (F.col("ts") + 30).alias("ts"), none.cast("double").alias("price"), F.col("id").alias("attempt"), (F.col("id") % 3 != 0).alias("ok"))
    rule = rules.movement_alarm_with_delivery(lambda r: 50.0 if r["mint"] % 2 == 0 else 80.0, b.DAY, b.DAY // 2, b.DAY, 3 * b.COOLDOWN, b.COOLDOWN // 2)
    return ruled(rows.unionByName(told), rule, "id long, mint long, ts long, move_pct double", "movement-delivery")


@query("R14", b.SNAP + f""", h AS (SELECT unnest([{b.DAY}, {3 * b.DAY}]::BIGINT[]) AS horizon), e AS (SELECT event_id AS id, user_id AS mint, epoch_us(ts) AS at, event_type AS pair, value * 1000 AS mc FROM events),
 c AS (SELECT c.id, c.mint, c.at, c.mc AS entry, h.horizon FROM e c CROSS JOIN h WHERE c.pair = 'purchase'),
 f AS (SELECT c.id, c.horizon, min(o.at) AS seen, arg_min(o.mc, (o.at, o.id)) / greatest(1.0::DOUBLE, any_value(c.entry)) AS multiple FROM c JOIN e o ON o.mint = c.mint AND o.at BETWEEN c.at + c.horizon * 1000000 AND c.at + (c.horizon + {b.DAY // 4}) * 1000000 AND o.mc IS NOT NULL GROUP BY ALL)
 SELECT c.id, c.mint, c.horizon, CASE WHEN seen IS NULL THEN 'EXPIRED' ELSE 'OBSERVED' END AS status, seen, round(multiple, 6) AS multiple FROM c LEFT JOIN f ON f.id = c.id AND f.horizon = c.horizon""")
def stream_track_outcomes(spark, sf):
    """Every purchase at two horizons: the first observation in time, or its expiry."""
    s = event_stream(spark, sf).withColumn("ts", F.unix_micros("at"))
    none = F.lit(None).cast("double")
    cases = s.filter("pair = 'purchase'").select("id", "mint", "ts", (F.col("price") * 1000).alias("entry"), none.alias("mc"))
    rows = cases.unionByName(s.select("id", "mint", "ts", none.alias("entry"), (F.col("price") * 1000).alias("mc")))
    rule = st.track_outcomes([h * 1_000_000 for h in (b.DAY, 3 * b.DAY)], b.DAY // 4 * 1_000_000)
    d = ruled(rows, rule, "id long, mint long, horizon long, status string, seen long, multiple double", "outcomes", unit=0.001)
    return d.withColumns({"horizon": F.expr("horizon div 1000000"), "multiple": F.round("multiple", 6)})


@query("R11 R15", b.SNAP + """SELECT DISTINCT sha256(mint || '|' || pair) AS event_id FROM snap""")
def stream_events_once(spark, sf):
    d = event_stream(spark, sf).select(F.sha2(F.concat_ws("|", F.col("mint").cast("string"), "pair"), 256).alias("event_id"))
    return st.run_available(st.once(d, "event_id"), "once")


def wide_stream(spark, sf):
    return event_stream(spark, sf).select("id", "mint", "ts", "pair", "price", "k", F.expr("cast(k * 1000 as double)").alias("liq"), F.expr("cast((k * 13) % 50 * 200 as double)").alias("vol_m5"),
                                          F.expr("k % 20").alias("buys_m5"), F.expr("(k * 3) % 20").alias("sells_m5"))


REACH = {"oldest": 3 * b.DAY, "newest": b.DAY, "max_gap": b.GAP}


@query("R5 X2", ORACLES["gap_baseline"])
def stream_gap_baseline(spark, sf):
    rule = rules.quiet(rules.gap_baseline(min(pa.LEVELS), b.GAP), 7 * b.DAY)
    return ruled(wide_stream(spark, sf), rule, "id long, mint long, ts long, price double", "gap-baseline")


@query("R6 X2", ORACLES["liquidity_drop"])
def stream_liquidity_drop(spark, sf):
    rule = rules.quiet(rules.liquidity_drop(0.85, **REACH), 2 * b.COOLDOWN)
    d = ruled(wide_stream(spark, sf), rule, "id long, mint long, ts long, liq_ratio double", "liquidity")
    return d.select("id", "mint", "ts", F.round("liq_ratio", 6).alias("liq_ratio"))


@query("R7 X2", ORACLES["activity_watch"])
def stream_activity_watch(spark, sf):
    rule = rules.quiet(rules.activity_watch(20.0, **REACH), 2 * b.COOLDOWN)
    return ruled(wide_stream(spark, sf), rule, "id long, mint long, ts long, price double", "activity")


def check_stream(spark, sf):
    return event_stream(spark, sf).select("id", "mint", "ts", F.col("pair").isin("purchase", "click").alias("ok"), (F.col("ts") >= b.NOW - 2 * b.DAY).alias("stopped"),
                                          (F.col("k") >= 95).alias("paused"), (F.col("k") < 3).alias("unhealthy"))


@query("R13 X2", ORACLES["stall_detection"])
def stream_stall_detection(spark, sf):
    return ruled(check_stream(spark, sf), rules.stall(b.DAY), "id long, mint long, last_success long, status string", "stalls")


@query("R12 X2", ORACLES["incident_transitions"])
def stream_incident_transitions(spark, sf):
    return ruled(check_stream(spark, sf), rules.incidents_of_checks(b.DAY, b.DAY // 2), "id long, mint long, delivery string", "incidents")


@query("R16 X2", ORACLES["identity_reset"])
def stream_identity_reset(spark, sf):
    d = wide_stream(spark, sf).withColumn("fp", F.expr("k div 34"))
    rule = rules.identity_reset(b.DAY // 4, b.DAY + b.DAY // 4)
    return ruled(d, rule, "id long, mint long, epoch long, move_pct double", "identity")
