"""The test tables seen as market data, in Spark and, word for word, in SQL.

``events`` supplies one observation per row: the user is the instrument, the event type its trading
pair, ``value`` the price and ``props.k`` (0..99) everything that depends on trading activity. The
observations are hours apart, so every duration of the operators is passed on a coarser scale.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DAY = 86_400
SPAN = 10 * DAY          # trailing feature window
PRE = 5 * DAY            # prehistory
HORIZON = 5 * DAY        # outcome horizon
LATE = DAY               # endpoint lateness
GAP = 2 * DAY            # largest gap of a covered path
COOLDOWN = DAY
CHUNK = 5 * DAY          # chunk width of running scans
NOW = 1_706_659_200      # 2024-01-31T00:00:00Z, just after the last event


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def epoch(col: str):
    return F.expr(f"unix_micros(cast({col} as timestamp)) div 1000000")


def events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(
        F.col("event_id").alias("id"), F.col("user_id").alias("mint"), epoch("ts").alias("ts"),
        F.col("event_type").alias("pair"), F.col("value").alias("price"),
        F.expr("cast(get_json_object(props, '$.k') as bigint)").alias("k"))


def snapshots(spark: SparkSession, sf: str) -> DataFrame:
    return events(spark, sf).select(
        "id", "mint", "ts", "pair", "price", "k",
        F.expr("price * 1000").alias("mc"),
        F.expr("cast(k * 1000 as double)").alias("liq"),
        F.expr("cast((k * 13) % 50 * 200 as double)").alias("vol_m5"),
        F.expr("cast((k * 7) % 100 * 1000 as double)").alias("vol_h1"),
        F.expr("k % 20").alias("buys_m5"), F.expr("(k * 3) % 20").alias("sells_m5"),
        F.expr("k + 30").alias("buys_h1"), F.expr("(k * 17) % 100 + 10").alias("sells_h1"),
        F.expr("cast((k * 19) % 30 - 10 as double)").alias("pc_m5"),
        F.expr("cast((k * 11) % 60 - 20 as double)").alias("pc_h1"))


SNAP = """WITH
ev AS (SELECT event_id AS id, user_id AS mint, epoch_us(ts) // 1000000 AS ts, event_type AS pair,
              value AS price, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events),
snap AS (SELECT id, mint, ts, pair, price, k, price * 1000 AS mc, CAST(k * 1000 AS DOUBLE) AS liq,
                CAST((k * 13) % 50 * 200 AS DOUBLE) AS vol_m5, CAST((k * 7) % 100 * 1000 AS DOUBLE) AS vol_h1,
                k % 20 AS buys_m5, (k * 3) % 20 AS sells_m5, k + 30 AS buys_h1, (k * 17) % 100 + 10 AS sells_h1,
                CAST((k * 19) % 30 - 10 AS DOUBLE) AS pc_m5, CAST((k * 11) % 60 - 20 AS DOUBLE) AS pc_h1 FROM ev)
"""


def launches(spark: SparkSession, sf: str) -> DataFrame:
    """One row per instrument. ``ath_mc`` is missing where the last observation was an error."""
    s = snapshots(spark, sf)
    o = F.struct("ts", "id")
    return s.groupBy("mint").agg(
        (F.min("ts") * 1000).alias("created_ts"), (F.max("ts") * 1000).alias("last_trade_ts"),
        F.max_by("mc", o).alias("current_mc"),
        F.expr("CASE WHEN max_by(pair, struct(ts, id)) <> 'error' THEN max(mc) END").alias("ath_mc"),
        F.min_by("pair", o).alias("pinned_pair"), F.max_by("k", o).alias("last_k"))


LAUNCH = SNAP + """,
launch AS (SELECT mint, min(ts) * 1000 AS created_ts, max(ts) * 1000 AS last_trade_ts,
                  arg_max(mc, (ts, id)) AS current_mc,
                  CASE WHEN arg_max(pair, (ts, id)) <> 'error' THEN max(mc) END AS ath_mc,
                  arg_min(pair, (ts, id)) AS pinned_pair, arg_max(k, (ts, id)) AS last_k
           FROM snap GROUP BY mint)
"""
