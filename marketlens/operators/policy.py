"""Evidence policies: eligibility, validation, check verdicts and counterfactual variants.

A set of checks is an array of ``struct<name, status, reason, observed_at, refs>``. Unknown evidence
never becomes a pass.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlens.functions.numeric import finite

# Check names, in report order, and the three required before an alert.
CHECKS = ["wallet_clusters", "developer_history", "top_holder_ownership", "wallet_age", "token_controls",
          "liquidity_control", "trading_mechanics"]
REQUIRED = ["token_controls", "liquidity_control", "trading_mechanics"]


def _sure(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def eligible_candidates(now_ms: int, age_ms: tuple = (1_800_000, 21_600_000), idle_ms: int = 720_000,
                        cap: tuple = (30_000, 750_000), ath_share: float = 0.35) -> Column:
    """Age, recent trade and cap gates; an unknown or non-positive all-time high passes."""
    ath = F.col("ath_mc")
    return (_sure(F.col("created_ts").between(now_ms - age_ms[1], now_ms - age_ms[0]))
            & _sure(F.col("last_trade_ts") >= now_ms - idle_ms) & _sure(F.col("current_mc").between(*cap))
            & (ath.isNull() | (ath <= 0) | _sure(F.col("current_mc") >= ath * ath_share)))


def validate_rows(df: DataFrame, cycle_ts: Column, age: tuple = (1800, 21_600), stale: int = 120,
                  signals: list[str] = (), cycle: str | None = None, key: str = "mint") -> DataFrame:
    """``violations``: names of all broken rules, empty for a valid row; an invalid row or a duplicate
    key makes its whole ``cycle`` invalid (``cycle_valid``)."""
    c = F.col
    total = reduce(lambda a, z: a + z, [c(s).cast("int") for s in signals], F.lit(0))
    rules = {
        "identity": c(key).isNull() | ~F.length(c(key).cast("string")).between(1, 100),
        "order": ~_sure((c("created_ts") <= c("captured_ts")) & (c("captured_ts") <= cycle_ts)),
        "age": ~_sure((c("captured_ts") - c("created_ts")).between(*age)),
        "snapshot": ~_sure((c("captured_ts") - c("snapshot_ts")).between(0, stale)),
        "contemporaneous": ~_sure(cycle_ts - c("captured_ts") <= stale),
        "numbers": ~(finite("mc", 0) & finite("liq", 0) & finite("vol1", 0)),
        "score": ~_sure(c("score") == total),
        "hash": ~_sure(c("input_sha256").rlike("^[0-9a-f]{64}$"))}
    d = df.withColumn("violations", F.array_compact(F.array(*[F.when(v, F.lit(n)) for n, v in rules.items()])))
    if cycle is None:
        return d
    per_key = d.groupBy(cycle, key).agg(F.count(F.lit(1)).alias("_n"), F.max(F.size("violations")).alias("_v"))
    ok = per_key.groupBy(cycle).agg(((F.max("_n") == 1) & (F.max("_v") == 0)).alias("cycle_valid"))
    return d.join(ok, cycle)


def fresh(ts: Column, now: Column | int, max_age: int = 300) -> Column:
    n = F.lit(now) if isinstance(now, int) else now
    return _sure((n - ts).between(0, max_age))


def evidence_valid(check: Column, now: Column | int, max_age: int = 300) -> Column:
    """Fresh, and backed by a non-empty array of non-blank references."""
    refs = check["refs"]
    real = F.forall(refs, lambda r: F.coalesce(F.trim(r) != "", F.lit(False)))
    return fresh(check["observed_at"], now, max_age) & _sure(F.size(refs) > 0) & _sure(real)


def normalise_checks(checks: str, now: Column | int, max_age: int = 300) -> Column:
    """Checks whose evidence is stale or unbacked fall back to UNKNOWN."""
    return F.transform(F.col(checks), lambda c: c.withField("status", F.when(evidence_valid(c, now, max_age), c["status"]).otherwise("UNKNOWN")))


def _any(checks: str, test) -> Column:
    """Does an entry of the list meet ``test``? A null list, entry or answer does not."""
    return _sure(F.exists(F.col(checks), lambda c: _sure(test(c))))


def tally(checks: str, names, valid=None, stale=None) -> Column:
    """What is known of each name, in one reading of the list: 0 absent, 1 passed (and ``valid``), 2 doubtful, 3 ``stale``, 4 rejected; the worst entry counts.

    Null without a list.
    """
    named = F.array(*[F.lit(n) for n in names])

    def said(c: Column) -> Column:
        good = _sure(c["status"] == "PASS") & (F.lit(True) if valid is None else _sure(valid(c)))
        return F.when(_sure(c["status"] == "REJECT"), 4).when(F.lit(False) if stale is None else stale(c), 3).when(good, 1).otherwise(2)

    return F.aggregate(F.col(checks), F.array_repeat(F.lit(0), len(names)), lambda held, c: F.transform(held, lambda x, j: F.when(_sure(F.get(named, j) == c["name"]), F.greatest(x, said(c))).otherwise(x)))


def all_passed(checks: str, names, valid=None) -> Column:
    return _sure(F.forall(tally(checks, names, valid), lambda x: x == 1))


def prealert_verdict(df: DataFrame, checks: str, now: Column | int, identity_ok: Column, checked_at: Column,
                     authority: Column, max_age: int = 300) -> DataFrame:
    """``verdict`` and ``reasons``: identity, age and active authority first, then any REJECT, then the
    three required checks, each by its name; anything unresolved, doubtful or absent is a HOLD."""
    stale = lambda c: ~_sure(evidence_valid(c, now, max_age))
    names, last = F.array(*[F.lit(n) for n in CHECKS]), [":missing", "", ":unresolved", ":evidence_missing_or_stale"]
    auth = F.when(_sure(authority == "REVOKED"), F.array().cast("array<string>")).otherwise(F.array(F.lit("token_authority_unverified")))
    say = lambda v, r: F.struct(F.lit(v).alias("v"), r.alias("r"))

    def judge(told: Column) -> Column:
        """``told``: every check's state by the order of CHECKS; bound once, as a plan may inline what is named."""
        turned = F.transform(F.filter(told, lambda x: x["state"] == 4), lambda x: x["name"])
        open_ = F.concat(auth, F.transform(F.filter(told, lambda x: x["name"].isin(*REQUIRED) & ~x["state"].isin(1, 4)), lambda x: F.concat(x["name"], F.get(F.array(*[F.lit(w) for w in last]), x["state"]))))
        return (F.when(~_sure(identity_ok), say("HOLD", F.array(F.lit("identity_or_policy_mismatch"))))
                .when(~fresh(checked_at, now, max_age), say("HOLD", F.array(F.lit("stale_or_invalid_review"))))
                .when(_sure(authority == "ACTIVE"), say("REJECT", F.array(F.lit("active_token_authority"))))
                .when(told.isNull(), say("HOLD", F.array(F.lit("missing_checks"))))
                .when(F.size(turned) > 0, say("REJECT", F.concat(turned, open_)))
                .when(F.size(open_) > 0, say("HOLD", open_))
                .otherwise(say("PASS", F.array().cast("array<string>"))))

    told = F.transform(tally(checks, CHECKS, stale=stale), lambda x, j: F.struct(F.get(names, j).alias("name"), x.alias("state")))
    early = F.get(F.transform(F.array(told), judge), F.lit(0))
    return df.withColumn("_e", early).withColumn("verdict", F.col("_e.v")).withColumn("reasons", F.col("_e.r")).drop("_e")


def seven_check_verdict(checks: str) -> Column:
    """REJECT if any rejects, PASS if all seven pass, each by its name, else HOLD."""
    return F.when(_any(checks, lambda c: c["status"] == "REJECT"), "REJECT").when(all_passed(checks, CHECKS), "PASS").otherwise("HOLD")


def policy_variants(df: DataFrame, checks: str, variants: dict[str, dict[str, str]]) -> DataFrame:
    """One row per variant: ``variants`` names, per check, the REJECT reason that only warns there.

    A check that is absent, or has an entry that neither passes nor rejects, is a HOLD.
    """
    rows = []
    known = _sure(F.forall(tally(checks, CHECKS), lambda x: x > 0))
    open_ = ~known | _any(checks, lambda c: ~_sure(c["status"].isin("PASS", "REJECT")))
    for name, soft in variants.items():
        is_soft = lambda c: _sure(reduce(lambda a, z: a | z, [(c["name"] == k) & (c["reason"] == r) for k, r in soft.items()], F.lit(False)))
        hard = _any(checks, lambda c: (c["status"] == "REJECT") & ~is_soft(c))
        warned = F.coalesce(F.size(F.filter(F.col(checks), lambda c: _sure((c["status"] == "REJECT") & is_soft(c)))), F.lit(0))
        verdict = F.when(hard, "REJECT").when(open_, "HOLD").otherwise("SHADOW_ELIGIBLE")
        rows.append(F.struct(F.lit(name).alias("variant"), verdict.alias("verdict"), F.when(F.col(checks).isNull(), 0).otherwise(warned).alias("warnings")))
    return df.withColumn("_v", F.explode(F.array(*rows))).select(*df.columns, "_v.*")


def reason_histogram(df: DataFrame, checks: str) -> DataFrame:
    d = df.select(F.explode(checks).alias("c"))
    return d.groupBy(F.col("c.name").alias("check"), F.col("c.status").alias("status"), F.col("c.reason").alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def paper_decision(checks: str, min_score: int = 8, max_band: float = 0.25, min_accel: float = 1.2, min_liq_change: float = -0.1) -> tuple[Column, Column]:
    """(action, reason): SKIP on a reject, WATCH while evidence or the market filter is incomplete, else ENTER_REVIEW."""
    known = finite("band") & finite("vol_accel") & finite("liq_change_now")
    market = ((F.col("score") >= min_score) & (F.col("band") <= max_band) & (F.col("vol_accel") >= min_accel) & (F.col("liq_change_now") >= min_liq_change))
    why = (F.when(_any(checks, lambda c: c["status"] == "REJECT"), "explicit_screening_reject")
           .when(~all_passed(checks, CHECKS), "incomplete_seven_check_evidence").when(~known, "missing_features")
           .when(_sure(market), "frozen_paper_filter_only").otherwise("paper_market_filter_not_met"))
    action = (F.when(why == "explicit_screening_reject", "SKIP").when(why == "frozen_paper_filter_only", "ENTER_REVIEW").otherwise("WATCH"))
    return action, why


def choose_pair(df: DataFrame, key: str = "mint", quotes: tuple = ("SOL", "WSOL")) -> DataFrame:
    """Per key the pinned pair when one is set (nothing if it is absent), else the most liquid pair with an
    allowed quote; ties by the smaller pair. ``df``: key, pair, quote, liq, pinned."""
    pick = F.max_by(F.struct("pair", "liq"), F.struct(
        (F.col("pair") == F.col("pinned")).alias("p"), F.col("liq"), F.concat(F.transform(F.split("pair", ""), lambda x: -F.ascii(x)), F.array(F.lit(0))).alias("t")))
    usable = F.when(F.col("pinned").isNotNull(), F.col("pair") == F.col("pinned")).otherwise(F.col("quote").isin(*quotes) & F.col("liq").isNotNull())
    return df.filter(usable).groupBy(key).agg(pick.alias("_p")).select(key, "_p.*")


def check_token_controls(doc: str = "account") -> Column:
    """Status of a mint document (program_ok, executable, initialized, mint_authority, freeze_authority, supply, extensions)."""
    d = F.col(doc)
    shape = _sure(d["program_ok"] & ~d["executable"] & d["initialized"])
    odd = F.exists(d["extensions"], lambda e: ~F.coalesce(e.isin("metadataPointer", "tokenMetadata"), F.lit(False)))
    reason = (F.when(~shape, "unverified_token_account")
              .when(d["mint_authority"].isNotNull() | d["freeze_authority"].isNotNull(), "active_mint_or_freeze_authority")
              .when(~_sure(d["supply"] > 0), "unverified_token_account")
              # Extensions that are not known to be harmless, a missing list among them, settle nothing.
              .when(~_sure(~odd), "unsupported_token_extensions")
              .otherwise("revoked_authorities"))
    status = F.when(reason == "active_mint_or_freeze_authority", "REJECT").when(reason == "revoked_authorities", "PASS").otherwise("UNKNOWN")
    return F.struct(status.alias("status"), reason.alias("reason"))


def check_liquidity(pools: DataFrame, vaults: DataFrame) -> DataFrame:
    """Pools (pool, lp_supply, lp_authority, freeze, flags_ok) against their two vaults (pool, side, owner, mint_ok, state, delegate, amount)."""
    bad = ~_sure((F.col("owner") == F.col("pool")) & F.col("mint_ok") & (F.col("state") == "initialized"))
    v = vaults.groupBy("pool").agg(F.count_distinct("side").alias("_sides"), F.max(bad).alias("_bad"),
                                   F.max(F.col("delegate").isNotNull()).alias("_del"), F.min("amount").alias("_min"), F.max(F.col("amount").isNull()).alias("_none"))
    d = pools.join(v, "pool", "left")
    reason = (F.when(F.coalesce(F.col("_sides"), F.lit(0)) < 2, "missing_lp_or_vault_accounts").when(F.col("_bad"), "vault_relationship_or_state_mismatch")
              .when(F.col("_del"), "vault_delegate_or_close_authority").when(F.col("_min") <= 0, "empty_pool_reserve").when(F.col("_none"), "vault_amount_unverified")
              .when(~_sure(F.col("lp_authority") == F.col("pool")) | F.col("freeze").isNotNull(), "unexpected_lp_authorities")
              .when(_sure((F.col("lp_supply") == 0) & F.col("flags_ok")), "authenticated_vaults_zero_redeemable_lp")
              .otherwise("unresolved_lp_or_pool_controls"))
    d = d.withColumn("reason", reason)
    status = (F.when(F.col("reason") == "empty_pool_reserve", "REJECT")
              .when(F.col("reason") == "authenticated_vaults_zero_redeemable_lp", "PASS").otherwise("UNKNOWN"))
    return d.withColumn("status", status).drop("_sides", "_bad", "_del", "_min", "_none")


def relay_eligible(now: Column | int, checks: str, cap: tuple, activation: int, max_age: int = 300) -> Column:
    """Fresh alert, snapshot and review of the same identity, inside the cap band, verdict PASS and each
    required check passed, by its name, on valid evidence."""
    c = F.col
    ok = (fresh(c("last_alert_ts"), now, max_age) & fresh(c("ts"), now, max_age) & fresh(c("checked_at"), now, max_age)
          & (c("last_alert_ts") >= activation) & (c("ts") <= c("last_alert_ts"))
          & finite("mc") & finite("liq") & finite("price") & (c("mc") > 0) & (c("liq") > 0) & (c("price") > 0)
          & c("mc").between(*cap) & (c("review_mint") == c("mint")) & (c("review_pair") == c("pair")))
    none = ~_any(checks, lambda k: k["status"] == "REJECT")
    # From cheap to dear: a plan may work out the verdict here, so it is asked for last.
    return _sure(ok) & none & all_passed(checks, [n for n in CHECKS if n in REQUIRED], lambda k: evidence_valid(k, now, max_age)) & _sure(c("verdict") == "PASS")


def relay_class(now: Column | int, checks: str, max_age: int = 300) -> Column:
    rest = [n for n in CHECKS if n not in REQUIRED]
    return F.when(all_passed(checks, rest, lambda k: evidence_valid(k, now, max_age)), "SCREENING COMPLETE").otherwise("EARLY WATCH")


def assess_attention() -> tuple[Column, Column]:
    """(tier, chasing) of a researched alert; a liquidity drop overrides every better tier."""
    c = F.col
    tier = (F.when(_sure(c("now_liq") < c("liq") * 0.8), "LIQUIDITY DETERIORATING").when(_sure(c("fee_buyback_claim")), "FEE-FUNDED BUYBACK CLAIM")
            .when(_sure(c("tooling_claim")), "ACTIVITY TOOLING CLAIM")
            .when(_sure(c("identity_matched") & (c("activity") == "ACTIVITY_SUPPORTED")), "ACTIVITY-SUPPORTED WATCH")
            .when(_sure(c("activity") == "MIXED_OR_WEAK"), "MIXED PRESSURE").otherwise("THIN THESIS"))
    return tier, _sure(c("now_price") > c("price") * 2)


def check_concentration(owners: DataFrame, tokens: DataFrame, limits: tuple = (5.0, 30.0, 2.0, 10.0)) -> DataFrame:
    """``owners`` (token, owner, pct) and ``tokens`` (token, pool, creator_pct, unseen_pct) to a status per token.

    The pool's own holding does not count; one invalid percentage voids the token. The top ten are cut
    per task before the shuffle, so a token with very many owners stays cheap.
    """
    from pyspark.sql.window import Window

    largest_max, top10_max, creator_max, unseen_max = limits
    d = owners.join(tokens.select("token", "pool"), "token")
    valid = finite("pct") & F.col("pct").between(0, 100) & F.col("owner").isNotNull()
    voided = d.groupBy("token").agg(F.max((~valid).cast("int")).alias("_void"))
    per = d.filter(valid & (F.col("owner") != F.col("pool"))).groupBy("token", "owner").agg(F.sum("pct").alias("pct"))
    w = Window.partitionBy("token").orderBy(F.desc("pct"), "owner")
    top = (per.withColumn("_rk", F.row_number().over(w)).filter("_rk <= 10")
           .groupBy("token").agg(F.round(F.max("pct"), 9).alias("largest_pct"), F.round(F.sum("pct"), 9).alias("top10_pct")))
    d = tokens.join(voided, "token", "left").join(top, "token", "left").fillna(0.0, ["largest_pct", "top10_pct"])
    known = lambda c: finite(c) & F.col(c).between(0, 100)
    reason = (F.when((F.coalesce(F.col("_void"), F.lit(1)) == 1) | ~known("unseen_pct"), "missing_evidence")
              .when(~known("creator_pct"), "creator_balance_unverified")
              .when((F.col("largest_pct") > largest_max) | (F.col("top10_pct") > top10_max) | (F.col("creator_pct") > creator_max), "concentration_policy_exceeded")
              .when(F.col("unseen_pct") > unseen_max, "top_account_sample_insufficient").otherwise("sample_concentration_with_bounded_unseen_supply"))
    d = d.withColumn("reason", reason)
    status = (F.when(F.col("reason") == "concentration_policy_exceeded", "REJECT")
              .when(F.col("reason") == "sample_concentration_with_bounded_unseen_supply", "PASS").otherwise("UNKNOWN"))
    return d.withColumn("status", status).drop("_void")


def check_wallet_age(owners: DataFrame, tokens: DataFrame, histories: DataFrame, min_holder: int, min_creator: int, max_share: float = 5.0) -> DataFrame:
    """Young exposure per token. ``histories`` (wallet, activity_age, covered_span, complete): a short age counts as
    young only where the history covers the required span and is complete (fresh head, all pages, nothing
    pending, every timestamp, only known programs), else it is unknown. One invalid percentage voids the token."""
    nodes = (owners.join(tokens.select("token", "pool", "creator"), "token").filter(F.col("owner") != F.col("pool"))
             .select("token", "owner", "pct", (F.col("owner") == F.col("creator")).alias("is_creator")))
    absent = tokens.select("token", F.col("creator").alias("owner")).join(nodes.select("token", "owner"), ["token", "owner"], "left_anti")
    nodes = nodes.unionByName(absent.select("token", "owner", F.lit(0.0).alias("pct"), F.lit(True).alias("is_creator")))
    d = nodes.join(histories, nodes["owner"] == histories["wallet"], "left")
    need = F.when(F.col("is_creator"), min_creator).otherwise(min_holder)
    aged = finite("activity_age", 0)
    short = aged & (F.col("activity_age") < need)
    young = short & _sure((F.col("covered_span") >= need) & F.col("complete"))
    unknown = ~aged | (short & ~young)
    g = d.groupBy("token").agg(F.max((young & F.col("is_creator")).cast("int")).alias("creator_young"),
                               F.sum(F.when(young, F.col("pct")).otherwise(0.0)).alias("young_share"),
                               F.count_if(unknown).alias("unknown_wallets"), F.count(F.lit(1)).alias("wallets"),
                               F.max(~_sure(finite("pct") & F.col("pct").between(0, 100) & F.col("owner").isNotNull())).alias("_void"))
    g = g.withColumn("young_share", F.round("young_share", 9))  # a sum of shares near the limit does not depend on its order
    status = (F.when(F.col("_void"), "UNKNOWN").when((F.col("creator_young") == 1) | (F.col("young_share") > max_share), "REJECT")
              .when(F.col("unknown_wallets") > 0, "UNKNOWN").otherwise("PASS"))
    return g.withColumn("status", status).drop("_void")


def check_developer(tokens: DataFrame, events: DataFrame, reports: DataFrame, since: int) -> DataFrame:
    """``tokens`` (token, creator, pool, provider_flag, attributed, associated), ``events`` (source, relation, target,
    block_time), ``reports`` (token, retrieved, flagged); the first trigger in order decides.

    ``associated`` counts the other tokens tied to the creator; a pass needs a fresh report of each. With an
    unknown count, or with fewer retrieved reports, the check stays open.
    """
    ev = events.filter(F.col("block_time") >= since).groupBy(F.col("source").alias("creator")).agg(
        F.count_if(F.col("relation") == "withdraw").alias("_w"))
    sold = (events.filter((F.col("block_time") >= since) & (F.col("relation") == "sell"))
            .select(F.col("source").alias("creator"), F.col("target").alias("pool"), F.lit(True).alias("_sold")).distinct())
    rep = reports.groupBy("token").agg(F.max("flagged").alias("_flag"), F.count_if(F.coalesce("retrieved", F.lit(False))).alias("_got"), F.count(F.lit(1)).alias("_rows"))
    d = tokens.join(ev, "creator", "left").join(sold, ["creator", "pool"], "left").join(rep, "token", "left")
    reason = (F.when(~_sure(F.col("attributed")), "developer_history_or_attribution_incomplete")
              .when(~_sure(~F.col("provider_flag")), "current_token_provider_risk_unresolved")
              .when(F.col("_sold"), "developer_sold_current_pool_in_review_window")
              .when(_sure(F.col("_w") > 0), "developer_withdrawal_requires_review")
              .when(_sure(F.col("_flag")), "associated_token_provider_risk_requires_review")
              .when(~_sure((F.coalesce("_got", F.lit(0)) == F.col("associated")) & (F.coalesce("_rows", F.lit(0)) == F.col("associated"))), "associated_token_reports_incomplete")
              .otherwise("no_trigger"))
    d = d.withColumn("reason", reason)
    status = (F.when(F.col("reason").isin("developer_sold_current_pool_in_review_window", "developer_withdrawal_requires_review"), "REJECT")
              .when(F.col("reason") == "no_trigger", "PASS").otherwise("UNKNOWN"))
    return d.withColumn("status", status).drop("_w", "_sold", "_flag", "_got", "_rows")


def check_trading(receipts: DataFrame, tokens: DataFrame, now: int, window: int = 300, min_sellers: int = 3) -> DataFrame:
    """At least ``min_sellers`` distinct sellers other than the creator with both legs positive in the window.

    ``tokens`` (token, creator, sell_enabled, controls): without an open sell switch and passed token controls the
    sales prove nothing, and the check stays UNKNOWN.
    """
    d = tokens.join(receipts, "token", "left")
    good = _sure((F.col("seller") != F.col("creator")) & (F.lit(now) - F.col("time")).between(0, window)
                 & (F.col("quote_received") > 0) & (F.col("base_sent") > 0))
    ready = F.min(_sure(F.col("sell_enabled") & (F.col("controls") == "PASS"))).alias("_ready")
    g = d.groupBy("token").agg(F.count_distinct(F.when(good, F.col("seller"))).alias("sellers"), ready)
    return g.withColumn("status", F.when(F.col("_ready") & (F.col("sellers") >= min_sellers), "PASS").otherwise("UNKNOWN")).drop("_ready")
