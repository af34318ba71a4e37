"""Studies over candidate rows: funnels, arms, sampling, matching, enrolment and stopping."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlens.operators import features as ft
from marketlens.operators.ledger import set_digest
from marketlens.operators.timeline import prefix_sums, running

HASH_WIDTH = 2 ** 52     # a 60-bit hash prefix falls into 256 chunks


def hash_order(*parts: Column | str) -> Column:
    """60-bit number from the SHA-256 of the joined parts: a reproducible random order."""
    text = F.concat_ws("|", *[(F.col(p) if isinstance(p, str) else p).cast("string") for p in parts])
    return F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("long")


def study_rows(df: DataFrame, lo: int, hi: int, age: tuple = (1800, 21_600), span: int = 2100, pre: int = 1800,
               horizon: int = 3600, late: int = 180, max_gap: int = 180, switch: tuple | None = None,
               width: int = 86_400, keys: tuple = ("mint",), cap: tuple = (30_000, 750_000),
               min_liq: float = 25_000, min_vol: float = 20_000) -> DataFrame:
    """Candidate rows with features, forward label and ``study_reason``: the first failing gate, or ``eligible``.

    Needs ``created_s``. All bounded frames share one shuffle; only the anchor needs the whole past.
    """
    before, after = switch or (span, horizon + late)
    d = ft.apply_frames(df, keys, "ts", ft.trailing_frames(span), ft.prehistory_frames(pre, max_gap),
                        ft.path_frames(horizon, late, max_gap), ft.pair_switch_frames(before, after))
    d = ft.score_signals(d, ft.base_gate(cap=cap, min_liq=min_liq, min_vol=min_vol))
    d = ft.anchor_gain(d, width, (*keys, "pair"))
    d = d.withColumn("age_s", F.col("ts") - F.col("created_s"))
    base = (ft.finite("price") & ft.finite("mc") & ft.finite("liq") & F.col("mc").between(*cap) & (F.col("price") > 0)
            & (F.col("liq") >= min_liq) & (F.col("vol_h1") >= min_vol))
    outside = (F.col("ts") - pre < lo) | (F.col("ts") + horizon + late >= hi)
    reason = (F.when(F.col("pair").isNull() | ~F.coalesce(F.col("age_s").between(*age), F.lit(False)), "age_or_pair")
              .when(~base, "base_or_invalid").when(F.col("gate") != "pass", "scorer_history").when(outside, "split_or_immature")
              .when(F.col("reason") != "covered", F.col("reason")).when(~F.col("prehistory_ok"), "partial_prehistory")
              .when(F.col("pair_switch"), "pair_switch").when(F.col("anchor_multiple").isNull(), "anchor_missing")
              .otherwise("eligible"))
    return d.withColumn("study_reason", reason)


def select_arms(df: DataFrame, g: float, min_score: int = 8) -> DataFrame:
    """One row per nested arm: A0 score, A1 adds the one-hour gate, A2 adds anchor multiple <= g."""
    a0 = F.col("score") >= min_score
    a1 = a0 & F.col("sig_h1_not_extended")
    a2 = a1 & F.coalesce(F.col("anchor_multiple") <= g, F.lit(False))
    arms = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in (("A0", a0), ("A1", a1), ("A2", a2))]))
    return df.withColumn("arm", F.explode(arms))


def arm_summary(df: DataFrame, by: list[str], key: str = "mint") -> DataFrame:
    n, runs = F.count(F.lit(1)), F.count_if(F.col("label") == "run")
    return df.groupBy(*by).agg(
        n.alias("minutes"), runs.alias("run_minutes"), F.count_if(F.col("label") == "non_run").alias("non_run_minutes"),
        (runs / n).alias("run_rate"), (F.count_if(F.col("endpoint_multiple") >= 2) / n).alias("endpoint_2x_rate"),
        F.count_distinct(key).alias("unique_tokens"), F.count_distinct(F.expr("ts div 86400")).alias("utc_days"))


def grid_search(df: DataFrame, grid: list[float], min_score: int = 8, need: tuple = (20, 20, 2)) -> DataFrame:
    """Arm summary at every threshold, whether it qualifies, and the chosen one (best rate, then smallest).

    The grid is a literal array, so each row is expanded in place rather than joined.
    """
    base = df.filter((F.col("score") >= min_score) & F.col("sig_h1_not_extended"))
    fits = F.filter(F.array(*[F.lit(float(g)) for g in grid]), lambda g: F.col("anchor_multiple") <= g)
    g = arm_summary(base.withColumn("g", F.explode(fits)), ["g"])
    ok = (F.col("run_minutes") >= need[0]) & (F.col("non_run_minutes") >= need[1]) & (F.col("utc_days") >= need[2])
    g = g.withColumn("qualifies", ok)
    best = g.filter("qualifies").agg(F.min(F.struct((-F.col("run_rate")).alias("r"), "g"))["g"]).scalar()
    return g.withColumn("chosen", F.coalesce(F.col("g") == best, F.lit(False)))


def hash_sample_by_stratum(df: DataFrame, stratum: Column, want: Column, pool: Column, seed: str, ids: list[str]) -> DataFrame:
    """Per stratum as many ``pool`` rows as there are ``want`` rows, in the order of a seeded hash.

    Ranks come from a running count over hash ranges, so one stratum may hold most of the data.
    """
    d = df.withColumn("_s", stratum)
    need = d.filter(want).groupBy("_s").agg(F.count(F.lit(1)).alias("_need"))
    p = d.filter(pool).withColumn("_h", hash_order(F.lit(seed), *ids))
    p = running(p, ["_s"], ["_h", *ids], HASH_WIDTH, {"_rank": ("sum", F.lit(1))})
    return p.join(need, "_s").filter(F.col("_rank") <= F.col("_need")).drop("_s", "_h", "_need")


def seeded_control_draw(df: DataFrame, decision: Column, cycle: str, key: str, seed: str) -> DataFrame:
    """For every decision one other row of its cycle, uniform by a seeded hash.

    The other rows are taken in key order; place ``hash mod (size - 1)`` of them is the draw, given as ``draw_index``.
    ``universe_digest`` binds the members of the cycle and the key that is left out of them.
    """
    d = df.withColumn("_o", hash_order(F.col(key)))
    d = running(d, [cycle], ["_o", key], HASH_WIDTH, {"_rank": ("sum", F.lit(1))}).withColumn("_place", F.col("_rank") - 1)
    size = df.groupBy(cycle).agg(F.count(F.lit(1)).alias("size"))
    a = (d.filter(decision).join(size, cycle).withColumn("universe_size", F.col("size") - 1)
         .withColumn("_i", F.when(F.col("universe_size") > 0,
                                  hash_order(F.lit(seed), key, cycle) % F.nullif(F.col("universe_size"), F.lit(0)))))
    a = a.withColumn("_want", F.when(F.col("_i") >= F.col("_place"), F.col("_i") + 1).otherwise(F.col("_i")))
    c = d.select(cycle, F.col("_place").alias("_want"), F.col(key).alias("control"))
    sets = set_digest(df, [cycle], key).select(cycle, F.col("digest").alias("_set"))
    bound = F.sha2(F.concat_ws("|", "_set", F.col(key).cast("string")), 256).alias("universe_digest")
    return a.join(c, [cycle, "_want"], "left").join(sets, cycle).select(key, cycle, "universe_size", F.col("_i").alias("draw_index"), "control", bound)


def first_eligible_split(df: DataFrame, reason: Column, width: int, key: str = "mint", order: tuple = ("decision_ts", "id")) -> DataFrame:
    """``exclusion``: null for the first valid row per key, ``repeat_mint`` for every later row of it,
    the row's own first failing ``reason`` before."""
    d = df.withColumn("_why", reason)
    d = running(d, [key], list(order), width, {"_n": ("sum", F.col("_why").isNull().cast("int"))}, exclusive=True)
    return d.withColumn("exclusion", F.when(F.coalesce(F.col("_n"), F.lit(0)) > 0, "repeat_mint").otherwise(F.col("_why"))).drop("_n", "_why")


def cohort_enroll(df: DataFrame, qualifies: Column, invalid: Column, excluded: DataFrame, key: str = "mint",
                  order: tuple = ("ts", "id")) -> DataFrame:
    """First qualification per key outside ``excluded``. An invalid first attempt still uses the key up."""
    d = df.filter(qualifies).join(excluded.select(key).distinct(), key, "left_anti").withColumn("valid", ~invalid)
    first = F.min_by(F.struct(*[c for c in d.columns if c != key]), F.struct(*order))
    return d.groupBy(key).agg(first.alias("_r"), F.count(F.lit(1)).alias("attempts")).select(key, "_r.*", "attempts")


def sequential_stop(df: DataFrame, seq: str, eligible: str, target: int, now: int | None = None, deadline: int | None = None) -> DataFrame:
    """One row: first unresolved place, eligible results before it, the place reaching ``target`` and why to stop.

    ``sample_limit`` once the target is reached, else ``time_limit`` from the deadline on, else null.
    """
    wall = df.agg(F.min(F.when(F.col(eligible).isNull(), F.col(seq)))).scalar()
    open_ = df.filter(F.coalesce(F.col(seq) < wall, F.lit(True)))
    d = prefix_sums(open_, [seq], {"_n": F.col(eligible).cast("long")})
    g = d.agg(F.max("_n").alias("eligible_before"), F.min(F.when(F.col("_n") == target, F.col(seq))).alias("cutoff"))
    late = F.lit(deadline is not None and now is not None and now >= deadline)
    return g.withColumn("first_unresolved", F.lit(wall)).withColumn("stop_reason", F.when(F.col("cutoff").isNotNull(), "sample_limit").when(late, "time_limit"))


def rate_shift(df: DataFrame, keys: list[str], order: list[str], hits: str, total: str, width: int,
               points: float = 5.0, minimum: int = 20) -> DataFrame:
    """Change of a rate between consecutive readings of growing counters, in percentage points."""
    from marketlens.operators.timeline import previous

    d = previous(df, keys, order, width, {"_h": hits, "_t": total})
    d = previous(d.withColumn("_dh", F.col(hits) - F.col("_h")).withColumn("_dt", F.col(total) - F.col("_t")), keys, order, width,
                 {"_ph": "_dh", "_pt": "_dt"}).filter("_pt is not null")
    back = (F.col("_dh") < 0) | (F.col("_dt") < 0) | (F.col("_ph") < 0) | (F.col("_pt") < 0)
    small = (F.col("_dt") < minimum) | (F.col("_pt") < minimum)
    shift = 100 * (F.col("_dh") / F.nullif(F.col("_dt"), F.lit(0)) - F.col("_ph") / F.nullif(F.col("_pt"), F.lit(0)))
    d = d.withColumn("shift_points", F.when(~back & ~small, shift))
    status = (F.when(back, "reversed").when(small, "too_few").when(F.abs("shift_points") >= points, "triggered").otherwise("steady"))
    return d.withColumn("status", status).drop("_h", "_t", "_dh", "_dt", "_ph", "_pt")


def paired_differences(pairs: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs (case_id, control_id) with both endpoints per horizon; one row per pair and horizon.

    ``left``/``right`` hold (id, horizon, reason, multiple).
    """
    a = left.select(F.col("id").alias("case_id"), "horizon", F.col("reason").alias("case_reason"), F.col("multiple").alias("case_multiple"))
    c = right.select(F.col("id").alias("control_id"), "horizon", F.col("reason").alias("control_reason"), F.col("multiple").alias("control_multiple"))
    d = pairs.join(a, "case_id").join(c, ["control_id", "horizon"])
    whole = (F.col("case_reason") == "eligible") & (F.col("control_reason") == "eligible")
    return (d.withColumn("complete", whole)
            .withColumn("difference", F.when(whole, F.col("case_multiple") - F.col("control_multiple")))
            .withColumn("excluded", F.when(~whole, F.concat_ws(" / ", "case_reason", "control_reason"))))


def matching_funnel(events: DataFrame, rows: DataFrame, cycle: str, rules: list[tuple[str, Column]], key: str = "mint") -> DataFrame:
    """Other rows of the events' cycles that survive each rule in turn, and events with any survivor.

    Row rules never need a pair: survivors are counted per cycle and the event itself is taken out.
    """
    flags, sofar = [], F.lit(True)
    for name, rule in rules:
        sofar = sofar & rule
        flags.append((name, sofar))
    marked = rows.select(cycle, key, *[f.cast("int").alias(n) for n, f in flags])
    size = marked.groupBy(cycle).agg(F.count(F.lit(1)).alias("_all"), *[F.sum(n).alias(f"_c_{n}") for n, _ in flags])
    own = events.select(cycle, key).join(marked, [cycle, key], "left").join(size, cycle)
    left = [(n, F.col(f"_c_{n}") - F.coalesce(F.col(n), F.lit(0))) for n, _ in flags]
    last = left[-1][1]
    return own.agg(F.sum(F.col("_all") - 1).alias("other_entries"), *[F.sum(v).alias(n) for n, v in left],
                   F.count_if(last > 0).alias("events_with_survivor"))


def control_reuse(pairs: DataFrame, case_id: str, control: str, day: Column) -> DataFrame:
    """Matched cases, control entries, distinct controls, reuse and days."""
    by_control = pairs.groupBy(control).agg(F.count(F.lit(1)).alias("_n"))
    use = by_control.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("control_entries"), F.count(F.lit(1)).alias("unique_controls"),
                         F.max("_n").alias("max_control_reuse"))
    d = pairs.agg(F.count_distinct(case_id).alias("matched"), F.count_distinct(day).alias("days"))
    return (use.withColumn("matched", d.select("matched").scalar()).withColumn("days", d.select("days").scalar())
            .withColumn("reused_entries", F.col("control_entries") - F.col("unique_controls")))


def classify_endpoint(decisions: DataFrame, obs: DataFrame, excluded: DataFrame, now: int, width: int, horizon: int = 3600,
                      late: int = 180, max_gap: int = 180, baseline_age: int = 120, key: str = "mint") -> DataFrame:
    """Paper decisions (id, key, decision_ts, action) to a status, reason and multiples.

    Exclusion is settled before any market row is read. The baseline is the last observation before
    the decision; the endpoint is the earliest one inside the lateness window, never a later one.
    """
    from marketlens.functions.numeric import finite
    from marketlens.operators.joins import window_lookup
    from marketlens.operators.timeline import opens_series

    held = excluded.select(key).distinct().withColumn("_held", F.lit(True))
    d = decisions.join(held, key, "left")
    open_ = d.filter("_held is null").drop("_held")
    bad = ~(finite("price") & finite("mc") & finite("liq") & (F.col("price") > 0) & (F.col("mc") > 0) & (F.col("liq") > 0))
    # Rows of one second go by id, or else by their values.
    order = ["ts", *(["id"] if "id" in obs.columns else []), "mc", "price", "liq"]
    line = opens_series(obs.select(key, *order), [key], "ts", max_gap, order=order)
    line = running(line.withColumn("_bad", bad), [key], order, width, {
        "seg": ("sum", F.col("opens").cast("long")), "bads": ("sum", F.col("_bad").cast("long"))})
    cols = ["price", "mc", "liq", "seg", "bads"]
    e = window_lookup(open_, line, [key], "decision_ts", "ts", cols, -baseline_age, horizon + late, {
        "_b": (-baseline_age, 0, lambda r: F.max(r)),
        "_e": (horizon, horizon + late, lambda r: F.min(r))})
    target = F.col("decision_ts") + horizon
    base_bad = ~F.coalesce(finite("_b.mc") & (F.col("_b.mc") > 0), F.lit(False))
    reason = (F.when(F.lit(now) < target, "not_due").when(F.col("_b").isNull(), "missing_saved_baseline").when(base_bad, "invalid_saved_baseline")
              .when(F.col("_e").isNull() & (F.lit(now) <= target + late), "awaiting_endpoint").when(F.col("_e").isNull(), "deadline_missed_no_backfill")
              .when(F.col("_e.bads") > F.col("_b.bads"), "invalid_market_observation").when(F.col("_e.seg") > F.col("_b.seg"), "incomplete_coverage")
              .otherwise("timely_observed_market_endpoint"))
    e = e.withColumn("reason", reason)
    ok = F.col("reason") == "timely_observed_market_endpoint"
    e = (e.withColumn("status", F.when(ok, "ELIGIBLE").when(F.col("reason").isin("not_due", "awaiting_endpoint"), "PENDING").otherwise("MISSING"))
         .withColumn("multiple", F.when(ok, F.col("_e.mc") / F.col("_b.mc"))).withColumn("price_multiple", F.when(ok, F.col("_e.price") / F.nullif(F.col("_b.price"), F.lit(0.0))))
         .withColumn("lateness", F.when(ok, F.col("_e._rts") - target)).drop("_b", "_e"))
    out = d.filter("_held").drop("_held").withColumn("reason", F.lit("excluded_before_outcome")).withColumn("status", F.lit("EXCLUDED_HOLDOUT"))
    return e.unionByName(out, allowMissingColumns=True)


def build_journal(cases: DataFrame, reviews: DataFrame, excluded: DataFrame, width: int, review_age: int = 300, key: str = "mint", **policy) -> DataFrame:
    """First alert per key with the latest review before it, decided by the paper policy.

    ``cases``: id, key, decision_ts, pinned, points, score and the policy features; ``reviews``: key,
    checked_at, review_pair, checks. A missing, stale or foreign review overrides the decision to WATCH.
    """
    from marketlens.operators.joins import asof_backward
    from marketlens.operators.policy import normalise_checks, paper_decision
    from marketlens.operators.tables import first_per_key

    first = first_per_key(cases.join(excluded.select(key).distinct(), key, "left_anti"), [key], ["decision_ts", "id"])
    d = asof_backward(first, reviews, [key], "decision_ts", "checked_at", ["review_pair", "checks"], width, review_age)
    d = d.withColumn("checks", normalise_checks("checks", F.col("decision_ts"), review_age))
    override = (F.when(F.col("points") < 4, "insufficient_snapshot_history").when(~F.coalesce(F.col("mc") > 0, F.lit(False)), "invalid_snapshot")
                .when(F.col("right_ts").isNull(), "stale_or_missing_scanner_review")
                .when(~F.coalesce(F.col("review_pair") == F.col("pinned"), F.lit(False)), "pair_mismatch_or_missing"))
    action, why = paper_decision("checks", **policy)
    return (d.withColumn("_o", override).withColumn("action", F.when(F.col("_o").isNotNull(), "WATCH").otherwise(action))
            .withColumn("reason", F.coalesce("_o", why)).drop("_o"))
