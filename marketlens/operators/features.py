"""Trailing-window features, gates, signals, regimes and outcome labels of an observation series."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from marketlens.functions.numeric import between, finite, ratio
from marketlens.operators.timeline import placed, running, scan_rule, segments, sliding
from marketlens.streaming import rules

# The signal names, in report order.
SIGNALS = ["liq25k", "vol_mc25", "buy52", "h1_not_extended", "m5_not_extended", "band_compact",
           "net_constructive", "higher_low", "liq_stable", "volume_accel", "txns100"]


class Frames(NamedTuple):
    """Bounded frames of one operator: reach into past and future, the window columns to add, and the
    columns derived from them afterwards. Several of them can share one shuffle (``apply_frames``)."""

    before: int
    after: int
    build: Callable[[DataFrame, WindowSpec], DataFrame]
    finish: Callable[[DataFrame], DataFrame]


def apply_frames(df: DataFrame, keys: tuple | list, ts: str, *specs: Frames) -> DataFrame:
    def build(d, w):
        for s in specs:
            d = s.build(d, w)
        return d

    out = sliding(df, list(keys), ts, max(s.before for s in specs), max(s.after for s in specs), build)
    for s in specs:
        out = s.finish(out)
    return out


def trailing_features(df: DataFrame, span: int = 2100, keys: tuple = ("mint",), ts: str = "ts") -> DataFrame:
    """See ``trailing_frames``."""
    return apply_frames(df, keys, ts, trailing_frames(span, ts))


def trailing_frames(span: int = 2100, ts: str = "ts") -> Frames:
    """Features of the observations in ``[ts-span, ts]``; prices and liquidity count when positive.

    The frame holds one observation per bucket of the source, so the collected lists are bounded by
    ``span / bucket``. ``net`` ends at the last positive price, ``net_now`` at the current price;
    ``liq_change`` ends at the last positive liquidity, ``liq_change_now`` at the current one.
    """

    def frames(d: DataFrame, w) -> DataFrame:
        f = w.rangeBetween(-span, 0)
        return (d.withColumn("points", F.count(F.lit(1)).over(f))
                 .withColumn("history_s", F.col(ts) - F.min(ts).over(f))
                 .withColumn("_ps", F.collect_list(F.when(F.col("price") > 0, F.col("price"))).over(f))
                 .withColumn("_ls", F.collect_list(F.when(F.col("liq") > 0, F.col("liq"))).over(f)))

    return Frames(span, 0, frames, _trailing_columns)


def _trailing_columns(d: DataFrame) -> DataFrame:
    base = [c for c in d.columns if c not in ("_ps", "_ls")]
    d = d.select("*", F.size("_ps").alias("n_prices"), F.array_min("_ps").alias("_low"),
                 F.array_max("_ps").alias("_high"), F.try_element_at("_ps", F.lit(1)).alias("_p0"),
                 F.try_element_at("_ps", F.lit(-1)).alias("_p1"),
                 F.try_element_at("_ls", F.lit(1)).alias("_l0"),
                 F.try_element_at("_ls", F.lit(-1)).alias("_l1"),
                 F.expr("greatest(1, size(_ps) div 3)").alias("_third"))
    n = F.col("n_prices")
    return d.select(
        *base, "n_prices",
        ((F.col("_high") - F.col("_low")) / F.col("_low")).alias("band"),
        (F.col("_p1") / F.col("_p0") - 1).alias("net"),
        (F.col("price") / F.col("_p0") - 1).alias("net_now"),
        ratio(F.col("buys_h1"), F.col("buys_h1") + F.col("sells_h1")).alias("buy_ratio"),
        ratio(F.col("vol_h1"), F.col("mc")).alias("vol_mc"),
        ratio(F.col("vol_m5"), F.col("vol_h1") / 12).alias("vol_accel"),
        (F.col("_p1") / F.col("_low") - 1).alias("reclaim"),
        F.when(n > 0, (F.array_position("_ps", F.col("_low")) - 1) / F.greatest(F.lit(1), n - 1)).alias("low_pos"),
        F.when(F.size("_ls") > 1, F.col("_l1") / F.col("_l0") - 1).otherwise(F.lit(0.0)).alias("liq_change"),
        (F.col("liq") / F.col("_l0") - 1).alias("liq_change_now"),
        F.expr("CASE WHEN n_prices > 0 THEN array_min(slice(_ps, n_prices - _third + 1, _third)) "
               ">= array_min(slice(_ps, 1, _third)) * 0.97D END").alias("higher_low"),
        F.coalesce(F.col("liq") >= F.col("_l0") * 0.9, F.lit(False)).alias("liq_stable"))


def base_gate(min_rows: int = 4, min_history: int = 600, cap: tuple = (30_000, 750_000),
              min_liq: float = 25_000, min_vol: float = 20_000) -> Column:
    """First failing gate of a feature row, or ``pass``."""
    return (F.when((F.col("points") < min_rows) | (F.col("history_s") < min_history), "history")
            .when(~F.coalesce(between("mc", *cap) & (F.col("liq") >= min_liq) & (F.col("vol_h1") >= min_vol),
                              F.lit(False)), "base_gate")
            .when(F.col("n_prices") < 4, "price_history").otherwise("pass"))


def score_signals(df: DataFrame, gate: Column | None = None) -> DataFrame:
    """Eleven signal columns, their sum ``score`` and the array ``failed`` (the gate where it fails)."""
    trades = F.col("buys_h1") + F.col("sells_h1")
    tests = {
        "liq25k": F.col("liq") >= 25_000, "vol_mc25": F.col("vol_mc") >= 0.25,
        "buy52": F.col("buy_ratio") >= 0.52, "h1_not_extended": between("pc_h1", -8, 22),
        "m5_not_extended": between("pc_m5", -5, 10), "band_compact": F.col("band") <= 0.25,
        "net_constructive": between("net_now", -0.10, 0.20), "higher_low": F.col("higher_low"),
        "liq_stable": F.col("liq_stable"),
        "volume_accel": (F.col("vol_h1") > 0) & (F.col("vol_m5") >= F.col("vol_h1") / 12 * 1.2),
        "txns100": trades >= 100}
    d = df.withColumn("gate", base_gate() if gate is None else gate)
    d = d.select("*", *[F.coalesce(tests[s], F.lit(False)).alias(f"sig_{s}") for s in SIGNALS])
    total = sum((F.col(f"sig_{s}").cast("int") for s in SIGNALS), F.lit(0))
    failed = F.filter(F.array(*[F.when(~F.col(f"sig_{s}"), F.lit(s)) for s in SIGNALS]), lambda x: x.isNotNull())
    ok = F.col("gate") == "pass"
    return (d.withColumn("score", F.when(ok, total).otherwise(0))
             .withColumn("failed", F.when(ok, failed).otherwise(F.array("gate"))))


def match_eligible(cap: tuple = (30_000, 750_000), min_liq: float = 25_000, min_vol: float = 20_000) -> Column:
    """Enough finite history and size to be a case or a control."""
    whole = finite("mc") & finite("liq") & finite("vol_h1")
    return F.coalesce(whole & (F.col("points") >= 4) & (F.col("history_s") >= 600) & between("mc", *cap)
                      & (F.col("liq") >= min_liq) & (F.col("vol_h1") >= min_vol), F.lit(False))


def alert_level(score: str = "score") -> Column:
    return F.when(F.col(score) >= 10, 2).when(F.col(score) >= 8, 1).otherwise(0)


def alert_upgrades(df: DataFrame, width: int, thresholds: tuple = (8, 10), keys: tuple = ("mint",),
                   order: tuple = ("ts", "id")) -> DataFrame:
    """Rows whose level exceeds every earlier level of the key."""
    lo, hi = thresholds
    level = F.when(F.col("score") >= hi, 2).when(F.col("score") >= lo, 1).otherwise(0)
    d = running(df.withColumn("level", level), list(keys), list(order), width,
                {"previous_level": ("max", "level")}, exclusive=True)
    d = d.withColumn("previous_level", F.coalesce("previous_level", F.lit(0)))
    return d.filter(F.col("level") > F.col("previous_level"))


def classify_regime() -> Column:
    return (F.when(F.coalesce(F.col("points"), F.lit(0)) < 4, "INSUFFICIENT")
            .when((F.col("pc_h1") >= 35) & (F.col("vol_mc") >= 0.75) & (F.col("buy_ratio") >= 0.50)
                  & (F.col("liq") >= 25_000), "CONTINUATION")
            .when((F.col("band") <= 0.35) & between("net", -0.12, 0.25) & (F.col("liq") >= 25_000), "COMPRESSION")
            .when((F.col("band") >= 0.30) & (F.col("reclaim") >= 0.15) & (F.col("buy_ratio") >= 0.51)
                  & (F.col("low_pos") > 0), "RECLAIM")
            .otherwise("OTHER"))


def label_outcome(max_mult: Column, last_mult: Column, liq: Column) -> Column:
    """The peak decides before the failure does."""
    return (F.when(max_mult >= 10, "10X_PLUS").when(max_mult >= 5, "5X").when(max_mult >= 3, "3X")
            .when(max_mult >= 2, "2X").when(max_mult >= 1.35, "WEAK")
            .when((last_mult <= 0.55) | (liq <= 5000), "FAILED").otherwise("FLAT"))


def assess_case() -> Column:
    """Diagnostic of a tracked case (entry_mc, max_mult, min_mult, last_mc, last_liq).

    Missing liquidity never counts as a failure.
    """
    bad_state = (~finite("max_mult") | ~finite("min_mult") | ~finite("last_mc")
                 | (F.col("max_mult") < 0) | (F.col("min_mult") < 0) | (F.col("last_mc") < 0))
    failed = ((F.col("last_mc") / F.expr("nullif(entry_mc, 0)") <= 0.55)
              | F.coalesce(finite("last_liq") & (F.col("last_liq") <= 5000), F.lit(False)))
    hit = F.col("max_mult") >= 2
    return (F.when(~finite("entry_mc") | (F.col("entry_mc") <= 0), "INVALID_ENTRY")
            .when(bad_state, "INVALID_STATE")
            .when(hit & failed, "PEAK_THEN_FAILURE_OBSERVED").when(hit, "PEAK_2X_OBSERVED")
            .when(failed, "FAILURE_OBSERVED").otherwise("NO_2X_OBSERVED_YET"))


def continuity(df: DataFrame, max_gap: int = 180, width: int = 86_400, keys: tuple = ("mint",),
               order: tuple = ("ts", "id")) -> DataFrame:
    """Gap to the preceding row and a segment id that changes at every larger gap."""
    return segments(df, list(keys), list(order), max_gap, width)


def prehistory_complete(df: DataFrame, span: int = 1800, max_gap: int = 180, keys: tuple = ("mint",),
                        ts: str = "ts") -> DataFrame:
    """See ``prehistory_frames``."""
    return apply_frames(df, keys, ts, prehistory_frames(span, max_gap, ts))


def prehistory_frames(span: int = 1800, max_gap: int = 180, ts: str = "ts") -> Frames:
    """``prehistory_ok``: four valid rows reaching back to within ``max_gap`` of the span, no gap."""

    def frames(d, w):
        f = w.rangeBetween(-span, 0)
        d = d.withColumn("_pre_step", F.col(ts) - F.lag(ts).over(w))
        first = F.min(ts).over(f)
        # The step of the first row of the frame leads out of the frame and does not count.
        gaps = F.sum((F.coalesce(F.col("_pre_step"), F.lit(0)) > max_gap).cast("int")).over(
            w.rowsBetween(Window.unboundedPreceding, 0))
        d = d.withColumn("_pre_gaps", gaps)
        valid = F.min((finite("price") & finite("mc") & (F.col("price") > 0) & (F.col("mc") > 0)).cast("int")).over(f)
        return d.withColumn("prehistory_ok", (F.count(F.lit(1)).over(f) >= 4)
                            & (first <= F.col(ts) - span + max_gap) & (valid == 1)
                            & (F.first("_pre_gaps").over(f) == F.col("_pre_gaps"))).drop("_pre_step", "_pre_gaps")

    return Frames(span, 0, frames, lambda d: d)


def label_paths(df: DataFrame, horizon: int = 3600, late: int = 180, max_gap: int = 180,
                keys: tuple = ("mint",), ts: str = "ts", value: str = "mc",
                run: float = 2.0, non_run: float = 1.35) -> DataFrame:
    """See ``path_frames``."""
    return apply_frames(df, keys, ts, path_frames(horizon, late, max_gap, ts, value, run, non_run))


def path_frames(horizon: int = 3600, late: int = 180, max_gap: int = 180, ts: str = "ts", value: str = "mc",
                run: float = 2.0, non_run: float = 1.35) -> Frames:
    """Forward label of every row, or the reason why its path is not covered.

    A path has a gap exactly when the running count of gaps differs between its two ends, so no path
    is scanned; the counts start at the chunk, which holds every row of the path.
    """
    bad_value = ~F.coalesce(finite(value) & (F.col(value) > 0), F.lit(False))

    def frames(d, w):
        sofar = w.rowsBetween(Window.unboundedPreceding, 0)
        step = F.col(ts) - F.lag(ts).over(w)
        d = (d.withColumn("_bad", bad_value)
              .withColumn("_gaps", F.sum((F.coalesce(step, F.lit(0)) > max_gap).cast("int")).over(sofar))
              .withColumn("_bads", F.sum(bad_value.cast("int")).over(w.rangeBetween(Window.unboundedPreceding, 0))))
        inside = w.rangeBetween(1, horizon)
        return (d.withColumn("_end", F.min(placed(d, ts, F.col(value).alias("v"),
                                                      "_gaps", "_bads")).over(w.rangeBetween(horizon, horizon + late)))
                 .withColumn("_top", F.max(F.when(~F.col("_bad"), F.col(value))).over(inside))
                 .withColumn("_n", F.count(F.lit(1)).over(inside)))

    def finish(d):
        reason = (F.when(F.col("_end").isNull(), "missing_endpoint")
                  .when(F.col("_bad") | (F.col("_end._bads") > F.col("_bads")), "invalid_mc")
                  .when(F.col("_end._gaps") > F.col("_gaps"), "gap")
                  .when(F.col("_n") == 0, "missing_within_window").otherwise("covered"))
        d = d.withColumn("reason", reason)
        ok = F.col("reason") == "covered"
        d = (d.withColumn("max_multiple", F.when(ok, F.col("_top") / F.col(value)))
              .withColumn("endpoint_multiple", F.when(ok, F.col("_end.v") / F.col(value)))
              .withColumn("endpoint_late", F.when(ok, F.col("_end.ts") - F.col(ts) - horizon)))
        top = F.col("max_multiple")
        label = F.when(top >= run, "run").when(top < non_run, "non_run").when(top.isNotNull(), "intermediate")
        return d.withColumn("label", label).drop("_bad", "_gaps", "_bads", "_end", "_top", "_n")

    return Frames(0, horizon + late, frames, finish)


def anchor_gain(df: DataFrame, width: int, keys: tuple = ("mint", "pair"), order: tuple = ("ts", "id"),
                value: str = "mc") -> DataFrame:
    """Multiple and age relative to the first valid value of the key; it never re-anchors."""
    valid = F.when(finite(value) & (F.col(value) > 0), F.struct(F.col(order[0]).alias("at"), F.col(value).alias("v")))
    d = running(df, list(keys), list(order), width, {"_a": ("first", valid)})
    return (d.withColumn("anchor_multiple", F.col(value) / F.col("_a.v"))
             .withColumn("anchor_age", F.col(order[0]) - F.col("_a.at")).drop("_a"))


def pair_switch(df: DataFrame, before: int, after: int, keys: tuple = ("mint",), ts: str = "ts") -> DataFrame:
    """See ``pair_switch_frames``."""
    return apply_frames(df, keys, ts, pair_switch_frames(before, after))


def pair_switch_frames(before: int, after: int) -> Frames:
    """``pair_switch``: another pair of the same instrument was observed in ``[ts-before, ts+after]``."""

    def frames(d, w):
        f = w.rangeBetween(-before, after)
        return d.withColumn("pair_switch", (F.min("pair").over(f) != F.max("pair").over(f)))

    return Frames(before, after, frames, lambda d: d)


def movement(df: DataFrame, window: int = 900, tolerance: int = 90, max_gap: int = 120,
             keys: tuple = ("mint",), ts: str = "ts", value: str = "price") -> DataFrame:
    """Percent change against the latest sample in ``[ts-window-tolerance, ts-window]``.

    Null when there is no such sample or a step from it on exceeds ``max_gap``.
    """
    reach = window + tolerance

    def frames(d, w):
        step = F.col(ts) - F.lag(ts).over(w)
        d = d.withColumn("_gaps", F.sum((F.coalesce(step, F.lit(0)) > max_gap).cast("int")).over(
            w.rowsBetween(Window.unboundedPreceding, 0)))
        return d.withColumn("_base", F.max(placed(d, ts, F.col(value).alias("v"), "_gaps")).over(
            w.rangeBetween(-reach, -window)))

    d = sliding(df, list(keys), ts, reach, 0, frames)
    whole = F.col("_base").isNotNull() & (F.col("_base._gaps") == F.col("_gaps"))
    return (d.withColumn("move_pct", F.when(whole, (F.col(value) / F.nullif(F.col("_base.v"), F.lit(0.0)) - 1) * 100))
             .withColumn("elapsed", F.when(whole, F.col(ts) - F.col("_base.ts")))
             .drop("_gaps", "_base"))


def prior_peak_ratio(df: DataFrame, span: int = 1800, keys: tuple = ("mint",), ts: str = "ts",
                     value: str = "mc") -> DataFrame:
    """Value over the highest value strictly before it within ``span``."""

    def frames(d, w):
        return d.withColumn("prior_peak_ratio", F.col(value) / F.max(F.when(F.col(value) > 0, F.col(value))).over(
            w.rangeBetween(-span, -1)))

    return sliding(df, list(keys), ts, span, 0, frames)


def sequence_guard(df: DataFrame, width: int, keys: tuple = ("mint",), arrival: str = "id", ts: str = "ts",
                   source_ts: str = "source_ts") -> DataFrame:
    """Reject rows whose local time does not advance, or whose source time goes back, in arrival order.

    Both limits come from accepted rows only, so the rule runs row by row inside chunks of arrivals.
    """
    d = df.select(*keys, arrival, F.col(ts).alias("_ts"), F.col(source_ts).alias("_source"))
    out = scan_rule(d, list(keys), [arrival], rules.sequence_guard(arrival), f"{arrival} long, sequence_reason string", width)
    return df.join(out, [*keys, arrival])
