"""Forward outcomes of decided cases: endpoints, coverage, states and rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlens.functions.numeric import finite, wilson
from marketlens.operators.features import label_outcome
from marketlens.operators.joins import window_lookup
from marketlens.operators.timeline import chunk_of, previous


def horizon_outcomes(cases: DataFrame, obs: DataFrame, keys: list[str], horizons: list[int], late: int = 180) -> DataFrame:
    """First observation inside each horizon's lateness window; nothing is filled in later."""
    top = max(horizons) + late
    d = window_lookup(cases, obs, keys, "decision_ts", "ts", ["mc", "liq", "pair"], 0, top, {
        f"_e{h}": (h, h + late, lambda r: F.min(r)) for h in horizons})
    each = F.array(*[F.struct(F.lit(h).cast("long").alias("horizon"), F.col(f"_e{h}").alias("e")) for h in horizons])
    d = d.withColumn("_h", F.explode(each)).filter("_h.e is not null")
    return d.select("id", F.col("_h.horizon").alias("horizon"), F.col("_h.e._rts").alias("observed_ts"),
                    (F.col("_h.e._rts") - F.col("decision_ts") - F.col("_h.horizon")).alias("lateness"),
                    F.col("_h.e.mc").alias("mc"), F.col("_h.e.liq").alias("liq"), F.col("_h.e.pair").alias("end_pair"),
                    (F.col("_h.e.mc") / F.greatest(F.lit(1.0), F.col("entry_mc"))).alias("multiple"))


def horizon_metrics(cases: DataFrame, obs: DataFrame, keys: list[str], horizons: list[int], max_gap: int = 180) -> DataFrame:
    """Samples, largest step (decision and due time included), extreme multiples and coverage.

    The peak excludes a timely endpoint after the due time and includes the multiple 1 of the entry. Cases meet
    the observations of their longest horizon in chunks of that length and are aggregated at once: no list is
    built. The step into an observation is known beforehand; into the first one it starts at the decision.
    """
    top = max(horizons)
    order = ["ts", "id"] if "id" in obs.columns else ["ts"]
    o = previous(obs.select(*keys, *order, "mc"), keys, order, 4 * top, {"_pts": "ts"}).withColumn("_chunk", chunk_of("ts", top)).select(*keys, "_chunk", "ts", "mc", "_pts")
    c = cases.select("id", *keys, "decision_ts", "entry_mc")
    at = F.explode(F.sequence(chunk_of("decision_ts", top), chunk_of(F.col("decision_ts") + top, top)))
    met = c.withColumn("_chunk", at).join(o, [*keys, "_chunk"]).withColumn("_after", F.col("ts") - F.col("decision_ts")).filter(F.col("_after").between(0, top))
    step = F.least(F.col("ts") - F.col("_pts"), F.col("_after"))
    in_time = lambda h, x: F.when(F.col("_after") <= h, x)
    g = met.groupBy("id").agg(*[f for h in horizons for f in (
        F.count(in_time(h, F.lit(1))).alias(f"_n{h}"), F.max(in_time(h, step)).alias(f"_s{h}"), F.max(in_time(h, F.col("_after"))).alias(f"_l{h}"),
        F.max(in_time(h, F.col("mc"))).alias(f"_hi{h}"), F.min(in_time(h, F.col("mc"))).alias(f"_lo{h}"))])
    each = F.array(*[F.struct(F.lit(h).cast("long").alias("horizon"), F.coalesce(f"_n{h}", F.lit(0)).cast("long").alias("samples"),
                              F.greatest(F.coalesce(f"_s{h}", F.lit(0)), F.lit(h) - F.coalesce(f"_l{h}", F.lit(0))).cast("long").alias("max_gap"),
                              F.col(f"_hi{h}").alias("hi"), F.col(f"_lo{h}").alias("lo")) for h in horizons])
    d = c.select("id", "entry_mc").join(g, "id", "left").select("id", "entry_mc", F.explode(each).alias("_e")).select("id", "entry_mc", "_e.*")
    ok = F.col("entry_mc") > 0
    mult = lambda x: F.col(x) / F.expr("nullif(entry_mc, 0)")
    return d.select("id", "horizon", "samples", "max_gap",
                    ((F.col("samples") > 0) & (F.col("max_gap") <= max_gap) & ok).alias("coverage_ok"),
                    F.when(ok, F.greatest(F.lit(1.0), mult("hi"))).alias("max_mult"),
                    F.when(ok, F.least(F.lit(1.0), mult("lo"))).alias("min_mult"))


def case_state(cases: DataFrame, obs: DataFrame, keys: list[str], horizon: int) -> DataFrame:
    """Peak and trough with their first times, last value, multiples and drawdown from the peak."""
    top = lambda r: F.max(F.when(r.isNotNull() & (r["mc"] > 0), F.struct(r["mc"].alias("mc"), (-r["_rts"]).alias("t"))))
    low = lambda r: F.min(F.when(r.isNotNull() & (r["mc"] > 0), F.struct(r["mc"].alias("mc"), r["_rts"].alias("t"))))
    d = window_lookup(cases, obs, keys, "decision_ts", "ts", ["mc", "liq"], 0, horizon, {
        "_hi": (1, horizon, top), "_lo": (1, horizon, low),
        "_end": (1, horizon, lambda r: F.max(r))})
    up = F.coalesce(F.col("_hi.mc") > F.col("entry_mc"), F.lit(False))
    down = F.coalesce(F.col("_lo.mc") < F.col("entry_mc"), F.lit(False))
    d = (d.withColumn("peak_mc", F.when(up, F.col("_hi.mc")).otherwise(F.col("entry_mc")))
          .withColumn("peak_ts", F.when(up, -F.col("_hi.t")).otherwise(F.col("decision_ts")))
          .withColumn("trough_mc", F.when(down, F.col("_lo.mc")).otherwise(F.col("entry_mc")))
          .withColumn("trough_ts", F.when(down, F.col("_lo.t")).otherwise(F.col("decision_ts")))
          .withColumn("last_mc", F.coalesce("_end.mc", "entry_mc")).withColumn("last_liq", F.col("_end.liq"))
          .withColumn("last_ts", F.coalesce("_end._rts", "decision_ts")))
    base = F.greatest(F.lit(1.0), F.col("entry_mc"))
    d = (d.withColumn("max_mult", F.greatest(F.lit(1.0), F.col("peak_mc") / base))
          .withColumn("min_mult", F.least(F.lit(1.0), F.col("trough_mc") / base))
          .withColumn("last_mult", F.col("last_mc") / base)
          .withColumn("drawdown", F.col("last_mc") / F.greatest(F.lit(1.0), F.col("peak_mc")) - 1))
    return d.drop("_hi", "_lo", "_end")


def outcome_label() -> Column:
    """Label of a tracked state; unknown liquidity is no failure."""
    return label_outcome(F.col("max_mult"), F.col("last_mult"), F.coalesce(F.col("last_liq"), F.lit(float("inf"))))


def timed(late: int = 180) -> Column:
    """The outcome exists and its time is exactly decision + horizon + lateness within the limit."""
    return F.coalesce(F.col("lateness").between(0, late)
                      & (F.col("observed_ts") == F.col("decision_ts") + F.col("horizon") + F.col("lateness")), F.lit(False))


def horizon_rates(joined: DataFrame, now: int, late: int = 180, by: tuple = ("source", "regime", "horizon")) -> DataFrame:
    """Due, timed and complete counts with raw rates; missing or incomplete cases are no failures."""
    d = joined.filter(F.col("decision_ts") + F.col("horizon") + late <= now)
    t = timed(late)
    ok = t & F.coalesce(F.col("coverage_ok"), F.lit(False)) & F.col("max_mult").isNotNull()
    fail = (F.col("multiple") <= 0.55) | (F.col("liq") <= 5000)
    g = d.groupBy(*by).agg(
        F.count(F.lit(1)).alias("due"), F.count_if(t).alias("timed"), F.count_if(ok).alias("n"),
        *[F.count_if(ok & (F.col("max_mult") >= x)).alias(f"n{x}") for x in (2, 3, 5)],
        F.count_if(ok & F.coalesce(fail, F.lit(False))).alias("nfail"))
    g = g.withColumn("missing", F.col("due") - F.col("timed")).withColumn("incomplete", F.col("timed") - F.col("n"))
    for c in ("2", "3", "5", "fail"):
        g = g.withColumn(f"p{c}", F.when(F.col("n") > 0, F.col(f"n{c}") / F.expr("nullif(n, 0)")))
    return g


def timing_audit(outcomes: DataFrame, late: int = 180) -> DataFrame:
    return outcomes.agg(
        F.count(F.lit(1)).alias("n"), F.min("observed_ts").alias("first_ts"), F.max("observed_ts").alias("last_ts"),
        F.min("lateness").alias("min_lateness"), F.max("lateness").alias("max_lateness"),
        F.count_if(~timed(late)).alias("identity_violations"))


def valid_endpoint(late: int = 180, max_gap: int = 180) -> Column:
    """Ordered reason of an endpoint row: missing, timing, coverage, value, or eligible."""
    covered = F.coalesce((F.col("metric_ts") == F.col("observed_ts")) & F.col("coverage_ok")
                         & F.col("max_gap").between(0, max_gap), F.lit(False))
    return (F.when(F.col("observed_ts").isNull(), "missing_endpoint").when(~timed(late), "invalid_timing")
            .when(~covered, "incomplete_coverage")
            .when(~(finite("multiple") & (F.col("multiple") > 0)), "invalid_outcome").otherwise("eligible"))


def resolve_results(joined: DataFrame, now: int, late: int = 180, max_gap: int = 180) -> DataFrame:
    """Ledger form: ``pending`` until the window has closed, then the first failing reason."""
    reason = valid_endpoint(late, max_gap)
    open_ = F.col("observed_ts").isNull() & (F.lit(now) <= F.col("decision_ts") + F.col("horizon") + late)
    d = joined.withColumn("reason", F.when(open_, "pending").otherwise(reason))
    ok = F.col("reason") == "eligible"
    return d.withColumn("eligible", F.when(F.col("reason") != "pending", ok)).withColumn(
        "outcome", F.when(ok, (F.col("multiple") >= 2).cast("int")))


def review_summary(cases: DataFrame, by: str = "source", key: str = "mint", order: tuple = ("decision_ts", "id")) -> DataFrame:
    """Event counts, distinct keys, observed peaks by threshold, failures and their overlap; then the same
    ends over the first case of each key, with those that have none."""
    one = cases.groupBy(by, key).agg(F.min_by(F.struct("last_mult", "max_mult"), F.struct(*order)).alias("_f"))
    first = one.groupBy(by).agg(F.count_if(F.col("_f.last_mult") >= 2).alias("first_ge_2"), F.count_if(F.col("_f.last_mult") <= 0.55).alias("first_le_055"),
                                F.count_if(F.col("_f.last_mult").isNull()).alias("first_missing"))
    failed = F.coalesce((F.col("last_mult") <= 0.55) | (F.col("last_liq") <= 5000), F.lit(False))
    peak = F.col("max_mult")
    return cases.groupBy(by).agg(
        F.count(F.lit(1)).alias("cases"), F.count_distinct(key).alias("unique_keys"),
        *[F.count_if(peak >= x).alias(f"peak_{x}x") for x in (2, 3, 5)],
        F.count_if(F.col("last_mult") >= 2).alias("last_2x"), F.count_if(failed).alias("failures"),
        F.count_if(failed & (peak >= 2)).alias("peak_and_failure")).join(first, by)


def group_report(decisions: DataFrame, by: str = "action") -> DataFrame:
    """Per action: how many are eligible, pending, missing or excluded, and rates with Wilson bounds."""
    ok = F.col("status") == "ELIGIBLE"
    g = decisions.groupBy(by).agg(
        F.count(F.lit(1)).alias("recorded"), F.count_if(ok).alias("eligible"),
        F.count_if(F.col("status") == "PENDING").alias("pending"), F.count_if(F.col("status") == "MISSING").alias("missing"),
        F.count_if(F.col("status") == "EXCLUDED_HOLDOUT").alias("excluded"),
        F.count_if(ok & (F.col("multiple") >= 2)).alias("ge_2"), F.count_if(ok & (F.col("multiple") <= 0.55)).alias("le_055"))
    for c in ("ge_2", "le_055"):
        p, lo, hi = wilson(F.col(c), F.col("eligible"))
        g = g.withColumn(f"{c}_rate", p).withColumn(f"{c}_low", lo).withColumn(f"{c}_high", hi)
    return g
