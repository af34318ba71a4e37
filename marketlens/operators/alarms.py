"""Alarm rules over stored observations; ``marketlens.streaming`` runs them on live streams.

Rules that remember only *which side of a limit* the series was on become a running ``last`` over a
column that is null where the memory does not change. Rules with a cooldown thin their candidates
with ``spaced_picks``. Neither needs the whole history of a key in one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marketlens.functions.numeric import finite
from marketlens.operators.timeline import (ladder_fires, opens_series, placed, previous, running, scan_rule, sliding,
                                           spaced_picks)
from marketlens.streaming import rules


def cooled(candidates: DataFrame, keys: list[str], ts: str, cooldown: int) -> DataFrame:
    """Candidates that fire when each firing silences its key for ``cooldown`` seconds."""
    return spaced_picks(candidates, keys, ts, cooldown, tie="id" if "id" in candidates.columns else None)


def level_cross(df: DataFrame, levels: list[float], rearm_pct: float = 2.0, cooldown: int = 300, max_gap: int = 90,
                width: int = 86_400, keys: tuple = ("mint",), order: tuple = ("ts", "id"), value: str = "price") -> DataFrame:
    """Upward crossings ``(keys, ts, level, value)``.

    A level is armed below it and re-armed at ``level * (1 - rearm_pct/100)``; a crossing disarms it,
    also when the cooldown silences it. Start and gaps forget everything: the first row of a segment
    only arms.
    """
    ts = order[0]
    opened = opens_series(df, list(keys), ts, max_gap, order=list(order))
    p = F.col(value)
    # The opening row always sets the memory, so nothing from before a gap is ever read.
    memory = {"_start": ("last", F.when(F.col("opens"), F.col(ts)))}
    for i, level in enumerate(levels):
        moved = (F.when(F.col("opens"), (p < level).cast("int"))
                 .when(p <= level * (1 - rearm_pct / 100), 1).when(p >= level, 0))
        memory[f"_a{i}"] = ("last", moved)
    d = running(opened, list(keys), list(order), width, memory, exclusive=True)
    hits = F.array_compact(F.array(*[F.when(~F.col("opens") & (p >= level) & (F.col(f"_a{i}") == 1), F.lit(float(level)))
                                     for i, level in enumerate(levels)]))
    cand = d.select(*keys, F.col("_start").alias("series_start"), *order, value, F.explode(hits).alias("level"))
    return cooled(cand, [*keys, "series_start", "level"], ts, cooldown)


def one_shot_targets(df: DataFrame, targets: list[float], strict: bool = False, keys: tuple = ("mint",),
                     order: tuple = ("ts", "id"), value: str = "mc") -> DataFrame:
    """First observation at (or, if ``strict``, above) each target, once per key; null values never count."""
    v = F.col(value)
    hit = [F.min(F.when((v > t) if strict else (v >= t), F.struct(*order, value))) for t in targets]
    g = df.groupBy(*keys).agg(*[h.alias(f"_h{i}") for i, h in enumerate(hit)])
    each = F.array(*[F.struct(F.lit(float(t)).alias("target"), F.col(f"_h{i}").alias("hit")) for i, t in enumerate(targets)])
    return g.select(*keys, F.explode(each).alias("_e")).filter("_e.hit is not null").select(*keys, "_e.target", "_e.hit.*")


def gap_baseline(df: DataFrame, levels: list[float], cooldown: int = 300, max_gap: int = 90,
                 keys: tuple = ("mint",), order: tuple = ("ts", "id"), value: str = "price") -> DataFrame:
    """Rows that open a series (start or gap) already at or above the lowest level, with a cooldown."""
    cand = opens_series(df, list(keys), order[0], max_gap, order=list(order)).filter(F.col("opens") & (F.col(value) >= min(levels)))
    return cooled(cand.select(*keys, *order, value), list(keys), order[0], cooldown)


def with_reference(df: DataFrame, cols: list[str], oldest: int, newest: int, max_gap: int, keys: tuple = ("mint",),
                   ts: str = "ts") -> DataFrame:
    """``ref``: the latest row in ``[ts-oldest, ts-newest]`` of the same gap-free stretch."""

    def frames(d, w):
        step = F.col(ts) - F.lag(ts).over(w)
        d = d.withColumn("_gaps", F.sum((F.coalesce(step, F.lit(0)) > max_gap).cast("int")).over(
            w.rowsBetween(Window.unboundedPreceding, 0)))
        return d.withColumn("ref", F.max(placed(d, ts, *cols, "_gaps")).over(w.rangeBetween(-oldest, -newest)))

    d = sliding(df, list(keys), ts, oldest, 0, frames)
    return d.withColumn("ref", F.when(F.col("ref._gaps") == F.col("_gaps"), F.col("ref"))).drop("_gaps")


def liquidity_drop(df: DataFrame, oldest: int = 360, newest: int = 300, floor: float = 0.85, cooldown: int = 300,
                   max_gap: int = 90, keys: tuple = ("mint",), ts: str = "ts") -> DataFrame:
    d = with_reference(df, ["liq"], oldest, newest, max_gap, keys, ts)
    ratio = F.col("liq") / F.expr("nullif(ref.liq, 0)")
    cand = d.withColumn("liq_ratio", ratio).filter(F.col("liq_ratio") <= floor).select(*keys, ts, "id", "liq_ratio")
    return cooled(cand, list(keys), ts, cooldown)


def activity_watch(df: DataFrame, lowest_level: float, oldest: int = 360, newest: int = 300, cooldown: int = 300,
                   max_gap: int = 90, min_volume: float = 100, keys: tuple = ("mint",), ts: str = "ts") -> DataFrame:
    d = with_reference(df, ["liq", "price", "vol_m5"], oldest, newest, max_gap, keys, ts)
    total = F.col("buys_m5") + F.col("sells_m5")
    known = F.col("vol_m5").isNotNull() & F.col("liq").isNotNull() & total.isNotNull()
    live = ((F.col("ref.vol_m5") >= min_volume) & (F.col("vol_m5") >= 2 * F.col("ref.vol_m5")) & (total >= 20)
            & (F.col("buys_m5") / F.nullif(total, F.lit(0)) >= 0.6) & (F.col("price") > F.col("ref.price"))
            & (F.col("price") >= lowest_level * 0.95) & (F.col("ref.liq") > 0)
            & (F.col("liq") >= F.col("ref.liq") * 0.95))
    cand = d.filter(known & live).select(*keys, ts, "id", "price")
    return cooled(cand, list(keys), ts, cooldown)


def movement_alarm(moved: DataFrame, threshold: Column | float, cooldown: int = 1800, keys: tuple = ("mint",),
                   ts: str = "ts") -> DataFrame:
    """Rows of ``movement`` beyond the threshold percent, silenced for ``cooldown`` after each firing."""
    limit = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    cand = moved.filter(F.abs(F.col("move_pct")) + 1e-9 >= limit)
    return cooled(cand, list(keys), ts, cooldown)


def movement_alarm_with_delivery(moved: DataFrame, threshold: Column | float, delivered: str, cooldown: int = 1800, retry: int = 60, keys: tuple = ("mint",), ts: str = "ts", width: int = 86_400) -> DataFrame:
    """Alarms as messages that may fail: ``delivered`` tells whether the message of a row, if sent, arrives.

    A delivered message silences its key for ``cooldown``, an attempt that failed for ``retry`` seconds only. Delivery is known before the retry time is over.
    """
    limit = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    cand = moved.filter(F.abs(F.col("move_pct")) + 1e-9 >= limit).select(*keys, ts, "id", "move_pct", F.coalesce(F.col(delivered), F.lit(False)).alias("_ok"))

    def step(s, r):
        if s and any(t is not None and r[ts] - t < n for t, n in zip(s, (cooldown, retry))):
            return s, []
        return [r[ts] if r["_ok"] else (s or [None])[0], r[ts]], [{"id": r["id"], "ts": r[ts], "move_pct": r["move_pct"], "delivered": r["_ok"]}]

    return scan_rule(cand, list(keys), [ts, "id"], step, "id long, ts long, move_pct double, delivered boolean", width)


def trailing_reference(df: DataFrame, factor: float = 1.10, width: int = 86_400, keys: tuple = ("mint",), ts: str = "ts",
                       price: str = "price", tie: str | None = None) -> DataFrame:
    """Prices at ``factor`` times the armed reference; firing moves the reference to the fired price."""
    return ladder_fires(df, list(keys), ts, price, factor, width, tie or ("id" if "id" in df.columns else None))


def freshness(received: str = "ts", source: str = "source_ts", ahead: int = 5, behind: int = 120, cached: str | None = None, served: str | None = None,
              max_cached: int = 60, max_skew: int = 120) -> Column:
    """Why a response is not fresh. ``cached`` is the age in seconds a cache reports, ``served`` the server's own time; either may
    be null, which says nothing."""
    age = F.col(received) - F.col(source)
    why = F.when(age.isNull(), "invalid_time").when(age < -ahead, "future").when(age > behind, "stale")
    if cached is not None:
        why = why.when(F.col(cached) > max_cached, "cached_too_long")
    if served is not None:
        why = why.when(F.abs(F.col(received) - F.col(served)) > max_skew, "server_clock")
    return why.otherwise("fresh")


def feed_health(df: DataFrame, ok: Column, outage_after: int = 60, width: int = 86_400, keys: tuple = ("mint",),
                order: tuple = ("ts", "id")) -> DataFrame:
    """Outage notices (first failure at least ``outage_after`` after the run of failures began) and the
    recovery notice of every warned run."""
    ts = order[0]
    d = running(df.withColumn("_ok", ok), list(keys), list(order), width, {"_run": ("sum", F.col("_ok").cast("long"))})
    fails = d.filter(~F.col("_ok"))
    since = fails.groupBy(*keys, "_run").agg(F.min(ts).alias("since"))
    warned = (fails.join(since, [*keys, "_run"]).filter(F.col(ts) - F.col("since") >= outage_after)
              .groupBy(*keys, "_run", "since").agg(F.min(ts).alias(ts)))
    back = (d.filter("_ok").withColumn("_run", F.col("_run") - 1)
            .join(warned.select(*keys, "_run", "since"), [*keys, "_run"])
            .select(*keys, F.col(ts), "since", F.lit("recovered").alias("notice")))
    return warned.select(*keys, ts, "since", F.lit("outage").alias("notice")).unionByName(back)


def stall_detection(df: DataFrame, ok: Column, stale_after: int = 600, width: int = 86_400, keys: tuple = ("mint",),
                    order: tuple = ("ts", "id"), stopped: Column | None = None, paused: Column | None = None,
                    unhealthy: Column | None = None) -> DataFrame:
    """``status`` of every check: paused, unhealthy, stalled or stopped before collecting.

    ``stopped`` turns off the stall test, as nothing is expected any more.
    """
    ts = order[0]
    no = F.lit(False)
    d = running(df, list(keys), list(order), width, {"last_success": ("last", F.when(ok, F.col(ts)))})
    quiet = F.coalesce(F.col(ts) - F.col("last_success") > stale_after, F.lit(True))
    stop = no if stopped is None else stopped
    status = (F.when(no if paused is None else paused, "paused").when(no if unhealthy is None else unhealthy, "unhealthy")
              .when(~stop & quiet, "stalled").when(stop, "stopped").otherwise("collecting"))
    return d.withColumn("status", status)


def incident_transitions(df: DataFrame, retry: int = 300, width: int = 86_400, keys: tuple = ("mint",),
                         order: tuple = ("ts", "id"), status: str = "status",
                         incidents: tuple = ("paused", "stalled", "unhealthy", "unavailable")) -> DataFrame:
    """``delivery`` of every status row: sent once per change of incident, at most every ``retry`` seconds.

    What has been sent decides what is sent next, so the rule runs row by row inside time chunks.
    """
    d = df.select(*keys, *order, F.col(status).alias("status"))
    return scan_rule(d, list(keys), list(order), rules.incident_transitions(retry, incidents), "id long, delivery string", width)


def identity_epochs(df: DataFrame, fingerprint: str, width: int, keys: tuple = ("mint",), order: tuple = ("ts", "id")) -> DataFrame:
    """``epoch`` grows whenever the fingerprint changes, so state keyed by it restarts."""
    d = previous(df, list(keys), list(order), width, {"_fp": fingerprint})
    changed = F.col("_fp").isNotNull() & (F.col("_fp") != F.col(fingerprint))
    return running(d, list(keys), list(order), width, {"epoch": ("sum", changed.cast("long"))}).drop("_fp")


def outbox(df: DataFrame, key: Column, now: int, ttl: int = 300, ts: str = "ts", top: int = 3) -> tuple[DataFrame, DataFrame]:
    """Messages once per event id (first wins) with their status, and the oldest pending ones."""
    d = df.withColumn("event", F.substring(F.sha2(key, 256), 1, 16))
    first = F.min_by(F.struct(*df.columns), F.struct(ts, *[c for c in df.columns if c != ts]))
    d = d.groupBy("event").agg(first.alias("_m")).select("event", "_m.*")
    d = d.withColumn("status", F.when(F.col(ts) + ttl <= now, "expired").otherwise("pending"))
    return d, d.filter("status = 'pending'").orderBy(ts, "event").limit(top)


def detect_changes(df: DataFrame, width: int, keys: tuple = ("mint",), order: tuple = ("ts", "id"), amount: str = "amount",
                   supply: str = "supply", terms: list[str] = (), slot: str = "slot", cliff: str | None = None,
                   drop: float = 0.001, stages: tuple = (86_400, 7 * 86_400)) -> DataFrame:
    """One row per change against the preceding observation: terms changed, amount fell by at least
    ``drop`` of supply, or the time to ``cliff`` passed a stage. Rows whose slot goes back are skipped."""
    ts = order[0]
    d = running(df, list(keys), list(order), width, {"_top": ("max", slot)}, exclusive=True)
    d = d.filter(F.col("_top").isNull() | (F.col(slot) >= F.col("_top"))).drop("_top")
    watch = {f"_p_{c}": c for c in [amount, ts, *terms]}
    d = previous(d, list(keys), list(order), width, watch)
    tests = [F.when(F.col(f"_p_{amount}") - F.col(amount) >= F.col(supply) * drop, F.lit("amount_drop"))]
    tests += [F.when(F.col(f"_p_{c}") != F.col(c), F.lit(f"{c}_changed")) for c in terms]
    if cliff:
        tests += [F.when((F.col(cliff) - F.col(f"_p_{ts}") > s) & (F.col(cliff) - F.col(ts)).between(0, s), F.lit(f"cliff_{s}"))
                  for s in stages]
    known = F.col(f"_p_{ts}").isNotNull()
    return (d.filter(known).withColumn("change", F.explode(F.array_compact(F.array(*tests))))
            .drop(*watch))


def change_events_once(changes: DataFrame, entity: list[str], event: list[str], order: tuple = ("ts", "id")) -> DataFrame:
    """First occurrence of each entity and event, identified by a digest."""
    text = F.concat_ws("|", *[F.col(c).cast("string") for c in [*entity, *event]])
    d = changes.withColumn("event_id", F.sha2(text, 256))
    first = F.min_by(F.struct(*changes.columns), F.struct(*order))
    return d.groupBy("event_id").agg(first.alias("_r"), F.count(F.lit(1)).alias("seen")).select("event_id", "seen", "_r.*")


def thin_observations(df: DataFrame, min_sep: int = 300, k: int = 3, keys: tuple = ("mint",), ts: str = "ts") -> DataFrame:
    """Walking back from the newest row of a key, the first ``k`` rows at least ``min_sep`` apart.

    Each of the ``k`` steps is one partial aggregate, so a hot key is reduced before it is shuffled.
    """
    row = F.struct(*df.columns)
    picks, last = [], None
    for i in range(k):
        pool = df
        if last is not None:
            edge = last.select(*keys, (F.col(ts) - min_sep).alias("_edge"))
            pool = df.join(edge, list(keys)).filter(F.col(ts) <= F.col("_edge"))
        last = (pool.groupBy(*keys).agg(F.max_by(row, F.struct(ts, "id")).alias("_r"))
                .select("_r.*").withColumn("step_back", F.lit(i).cast("long")))
        picks.append(last)
    return reduce(lambda a, z: a.unionByName(z), picks)


def activity_status(thinned: DataFrame, k: int = 3, keys: tuple = ("mint",), ts: str = "ts") -> DataFrame:
    """ACTIVITY_SUPPORTED when two of three thinned windows are buy-heavy and liquidity held 90 %."""
    heavy = (F.col("buys_m5") > F.col("sells_m5")) & (F.col("vol_m5") > 0)
    g = thinned.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_if(heavy).alias("buy_heavy"),
                                   F.min_by("liq", ts).alias("_l0"), F.max_by("liq", ts).alias("_l1"))
    stable = (F.col("_l0") > 0) & (F.col("_l1") >= F.col("_l0") * 0.9)
    status = (F.when(F.col("n") < k, "INSUFFICIENT_HISTORY").when((F.col("buy_heavy") >= 2) & stable, "ACTIVITY_SUPPORTED")
              .otherwise("MIXED_OR_WEAK"))
    change = F.when((F.col("n") >= k) & (F.col("_l0") != 0), F.bround((F.col("_l1") / F.nullif(F.col("_l0"), F.lit(0.0)) - 1) * 100, 1))
    return g.withColumn("status", status).withColumn("liquidity_change_pct", change).drop("_l0", "_l1")
