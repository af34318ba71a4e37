"""Event logs and exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The two line formats.
ALERT_LINE = r"^(\d{4}-\d\d-\d\d \d\d:\d\d:\d\d),\d+ INFO ALERT (\S+) level=(\d+) score=(\d+)"
CHECKPOINT_LINE = r"v2 checkpoint id=(\S+) horizon_min=(\d+) observed_ts=(\d+) lateness_s=(\d+) multiple=([\d.]+)"


def parse_alerts(lines: DataFrame, text: str = "value") -> DataFrame:
    g = lambda i: F.regexp_extract(text, ALERT_LINE, i)
    ts = F.unix_timestamp(F.to_timestamp(g(1), "yyyy-MM-dd HH:mm:ss"))
    d = lines.filter(F.col(text).rlike(ALERT_LINE))
    d = d.select(g(2).alias("mint"), ts.alias("decision_ts"), g(3).cast("int").alias("level"), g(4).cast("int").alias("logged_score"))
    return d.withColumn("id", F.concat_ws(":", "mint", F.lit("alert"), F.col("decision_ts").cast("string")))


def parse_checkpoints(lines: DataFrame, text: str = "value", order: str = "line_no") -> DataFrame:
    """Checkpoint lines; the first line of each case and horizon counts."""
    g = lambda i: F.regexp_extract(text, CHECKPOINT_LINE, i)
    d = lines.filter(F.col(text).rlike(CHECKPOINT_LINE)).select(
        order, g(1).alias("id"), g(2).cast("int").alias("horizon_min"), g(3).cast("long").alias("observed_ts"),
        g(4).cast("long").alias("lateness"), g(5).cast("double").alias("multiple"))
    first = F.min_by(F.struct("observed_ts", "lateness", "multiple"), order)
    return d.groupBy("id", "horizon_min").agg(first.alias("_r")).select("id", "horizon_min", "_r.*")


def export_candidates(df: DataFrame, needed: list[str], priority: list[Column], top: int = 40) -> tuple[DataFrame, DataFrame]:
    """Candidates with a complete identity as a queue of ``top``, and the deferred rest with what they miss."""
    missing = F.array_compact(F.array(*[F.when(F.col(c).isNull() | (F.col(c) == ""), F.lit(c)) for c in needed]))
    d = df.withColumn("missing", missing)
    return d.filter(F.size("missing") == 0).drop("missing").orderBy(*priority).limit(top), d.filter(F.size("missing") > 0)


def due(df: DataFrame, now: int, reviews: DataFrame, key: str = "mint", born: tuple = (1800, 21_600), traded: int = 720, cap: tuple = (30_000, 750_000), recent: int = 900) -> DataFrame:
    """Candidates that are due: of the right age, traded lately, inside the cap band; ``urgent`` is the highest level a recent
    review gave them (0 without one). ``df``: key, created_ts, last_trade_ts, mc; ``reviews``: key, level, checked_at."""
    age = F.lit(now) - F.col("created_ts")
    d = df.filter(age.between(*born) & (F.col("last_trade_ts") >= now - traded) & F.col("mc").between(*cap))
    level = reviews.filter(F.col("checked_at") >= now - recent).groupBy(key).agg(F.max("level").alias("urgent"))
    return d.join(level, key, "left").fillna(0, ["urgent"])


def export_history(cases: DataFrame, outcomes: DataFrame, features: list[str], cutoff: int, longest: int) -> DataFrame:
    """Cases whose longest follow-up ended before ``cutoff`` with whitelisted finite features and their
    outcomes by horizon, both as maps. A case has one outcome per horizon, so its list is short."""
    from marketlens.functions.numeric import finite

    d = cases.filter(F.col("decision_ts") + longest < cutoff)
    pairs = F.array_compact(F.array(*[F.when(finite(f), F.struct(F.lit(f).alias("k"), F.col(f).cast("double").alias("v"))) for f in features]))
    body = F.struct("observed_ts", "lateness", "multiple", "liq")
    o = outcomes.filter(F.col("observed_ts") < cutoff).groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("horizon", body))).alias("outcomes"))
    return d.join(o, "id", "left").withColumn("features", F.map_from_entries(pairs))


def write_audit_report(calls: DataFrame, summary: DataFrame, path: str) -> None:
    """Call-level CSV and a JSON summary, written by the executors."""
    calls.write.mode("overwrite").option("header", True).csv(f"{path}/calls")
    summary.write.mode("overwrite").json(f"{path}/summary")
