"""Counting reports: funnels, roll-ups, coverage and incidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def staged_funnel(df: DataFrame, by: list[str], stages: list[tuple[str, Column]], total: str = "n") -> DataFrame:
    """Rows that survive each stage and all earlier ones."""
    cols, sofar = [F.count(F.lit(1)).alias(total)], F.lit(True)
    for name, rule in stages:
        sofar = sofar & F.coalesce(rule, F.lit(False))
        cols.append(F.count_if(sofar).alias(name))
    return df.groupBy(*by).agg(*cols)


def rejection_rollup(df: DataFrame, ts: str, sums: dict[str, str]) -> DataFrame:
    """Hourly counts and sums with a daily total row (``utc_hour`` -1)."""
    d = df.select(F.date_format(F.timestamp_seconds(ts), "yyyy-MM-dd").alias("utc_day"), F.floor(F.col(ts) / 3600).alias("hour"), *sums.values())
    g = d.rollup("utc_day", "hour").agg(F.grouping("utc_day").alias("_all"), F.grouping("hour").cast("long").alias("is_daily"),
                                        F.count(F.lit(1)).alias("cycles"), *[F.sum(c).alias(n) for n, c in sums.items()])
    return g.filter("_all = 0").select("utc_day", F.when(F.col("is_daily") == 1, F.lit(-1)).otherwise(F.col("hour")).alias("utc_hour"),
                                       "is_daily", "cycles", *sums)


def coverage_kpi(df: DataFrame, by: list[str], known: Column, complete: Column) -> DataFrame:
    """Requirements, those known, those complete and fresh, and whether the denominator is fully known."""
    n, k = F.count(F.lit(1)), F.count_if(known)
    return df.groupBy(*by).agg(n.alias("requirements"), k.alias("known"), F.count_if(known & complete).alias("complete_fresh"),
                               (n == k).alias("denominator_verified"))


def blocker_incidence(df: DataFrame, owner: str, programs: str) -> DataFrame:
    """Distinct owners per blocking program."""
    d = df.select(owner, F.explode(programs).alias("program")).distinct()
    return d.groupBy("program").agg(F.count(F.lit(1)).alias("owner_incidences"))


def log_error_counts(df: DataFrame, by: list[str], message: str, patterns: dict[str, str]) -> DataFrame:
    m = F.lower(F.col(message))
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("records"), *[F.count_if(m.rlike(p)).alias(n) for n, p in patterns.items()])


def wallet_activity(df: DataFrame, wallet: str, ts: str, failed: Column, now: int, page_limit: int = 1000) -> DataFrame:
    ok = ~failed & (F.col(ts) > 0) & (F.col(ts) <= now)
    oldest = F.min(F.when(ok, F.col(ts)))
    return df.groupBy(wallet).agg(F.count(F.lit(1)).alias("returned"), F.count_if(ok).alias("successful"), oldest.alias("earliest"),
                                  F.max(F.when(ok, F.col(ts))).alias("latest"), (F.count(F.lit(1)) >= page_limit).alias("page_limit_reached"),
                                  (F.lit(now) - oldest).alias("age_lower_bound"))


def pilot_status(events: DataFrame, now: int, activation: int, recent: int = 1800) -> DataFrame:
    """One row of counts over an event log (kind, body JSON): cycles, rejections, cohorts and their controls."""
    body = lambda p, t: F.get_json_object("body", p).cast(t)
    is_ = lambda k: F.col("kind") == k
    ts, controls = body("$.cycle_ts", "long"), F.json_array_length(F.get_json_object("body", "$.controls"))
    last = F.max(F.when(is_("cycle"), ts))
    return events.agg(
        F.count_if(is_("cycle")).alias("cycles"), F.count_if(is_("rejected_cycle")).alias("rejected_cycles"), F.count_if(is_("cohort")).alias("qualified"),
        F.count_if(is_("rejected_cycle") & (ts >= now - recent)).alias("rejected_recent"), last.alias("last_cycle_ts"),
        (F.lit(now) - F.coalesce(last, F.lit(activation))).alias("seconds_since_cycle"),
        F.count_if(is_("cohort") & (controls > 0)).alias("matched"), F.coalesce(F.sum(F.when(is_("cohort"), controls)), F.lit(0)).alias("control_entries"))


def feed_coverage(df: DataFrame, status: str) -> DataFrame:
    """Universe size, fresh feeds and the unavailable ones by reason, with an overall status."""
    g = df.groupBy(status).agg(F.count(F.lit(1)).alias("n"))
    total = g.agg(F.sum("n")).scalar()
    fresh = F.coalesce(g.filter(F.col(status) == "fresh").agg(F.sum("n")).scalar(), F.lit(0))
    return g.select(F.col(status).alias("feed_status"), "n", total.alias("universe"), F.when(fresh == total, "active").otherwise("active_partial").alias("overall"))
