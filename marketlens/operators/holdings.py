"""Token holdings: census, supply reconciliation, concentration and owner coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def holder_census(accounts: DataFrame, tokens: DataFrame) -> DataFrame:
    """Owner totals with their percentage of supply; ``accounts`` (token, owner, amount), ``tokens`` (token, supply)."""
    per = accounts.filter("amount > 0").groupBy("token", "owner").agg(F.sum("amount").alias("amount"), F.count(F.lit(1)).alias("accounts"))
    return per.join(tokens.select("token", "supply"), "token").withColumn("pct", F.col("amount") / F.nullif(F.col("supply"), F.lit(0)) * 100)


def census_summary(accounts: DataFrame, tokens: DataFrame) -> DataFrame:
    """Per token: verified and unseen percent, creator's and vault's share."""
    t = tokens.select("token", "supply", "creator", "vault")
    d = accounts.join(t, "token")
    g = d.groupBy("token", "supply").agg(
        F.sum("amount").alias("verified"), F.count(F.lit(1)).alias("accounts"),
        F.sum(F.when(F.col("owner") == F.col("creator"), F.col("amount")).otherwise(0)).alias("_c"),
        F.sum(F.when(F.col("account") == F.col("vault"), F.col("amount")).otherwise(0)).alias("_v"))
    pct = lambda c: c / F.nullif(F.col("supply"), F.lit(0)) * 100
    return g.select("token", "accounts", "verified", pct(F.col("verified")).alias("verified_pct"),
                    F.greatest(F.lit(0.0), 100 - pct(F.col("verified"))).alias("unseen_pct"), pct(F.col("_c")).alias("creator_pct"), pct(F.col("_v")).alias("vault_pct"))


def reconcile_supply(accounts: DataFrame, tokens: DataFrame) -> DataFrame:
    """First failing rule per token: unique accounts, vault present and owned by the pool, no other pool
    account, balances summing to the supply exactly.

    Duplicates are found by counting each address first, so no per-token set of addresses is built.
    """
    t = tokens.select("token", "supply", "pool", "vault")
    per = accounts.groupBy("token", "account").agg(F.count(F.lit(1)).alias("_n"), F.sum("amount").alias("amount"), F.max("owner").alias("owner"))
    d = per.join(t, "token")
    is_vault = F.col("account") == F.col("vault")
    g = d.groupBy("token", "supply").agg(F.sum("_n").alias("accounts"), F.max("_n").alias("_dup"), F.sum("amount").alias("total"),
                                         F.count_if(is_vault).alias("_vault"), F.count_if(is_vault & (F.col("owner") != F.col("pool"))).alias("_vown"),
                                         F.count_if(~is_vault & (F.col("owner") == F.col("pool"))).alias("_other"))
    reason = (F.when(F.col("_dup") > 1, "census_account_mismatch").when(F.col("_other") > 0, "unverified_pool_owned_account")
              .when(F.col("_vown") > 0, "pool_vault_owner_mismatch")
              .when((F.col("_vault") == 0) | (F.col("total") != F.col("supply")), "census_supply_not_reconciled").otherwise("reconciled"))
    return g.select("token", "accounts", "total", "supply", reason.alias("reason"))


def concentration_profile(census: DataFrame, role: Column, infrastructure: tuple = ("AMM", "DEX", "CEX", "EXCHANGE", "LOCKER", "BURN")) -> DataFrame:
    """Per token: top-ten and largest share of unlabelled owners, and the labelled infrastructure share.

    Only the ten largest owners per task reach the shuffle.
    """
    d = census.withColumn("_infra", F.coalesce(role.isin(*infrastructure), F.lit(False)))
    w = Window.partitionBy("token").orderBy(F.desc("pct"), "owner")
    top = (d.filter("NOT _infra").withColumn("_rk", F.row_number().over(w)).filter("_rk <= 10")
           .groupBy("token").agg(F.max("pct").alias("largest_pct"), F.sum("pct").alias("top10_pct")))
    infra = d.groupBy("token").agg(F.sum(F.when(F.col("_infra"), F.col("pct")).otherwise(0.0)).alias("infrastructure_pct"),
                                   F.count_if("_infra").alias("infrastructure_owners"), F.count(F.lit(1)).alias("owners"))
    return infra.join(top, "token", "left")


def owner_coverage(required: DataFrame, windows: DataFrame, programs: DataFrame, now: int, max_age: int = 300) -> DataFrame:
    """Address windows merged to owners.

    ``required`` (owner, address), ``windows`` (owner, address, window_start, head_at, complete, pending,
    null_ts), ``programs`` (owner, program): unsupported programs seen, one row each.
    """
    need = required.groupBy("owner").agg(F.count_distinct("address").alias("addresses_required"))
    matched = windows.join(required.distinct(), ["owner", "address"], "left_semi")
    got = windows.groupBy("owner").agg(
        F.max("window_start").alias("window_start"), F.min("head_at").alias("head_at"), F.min(F.col("complete").cast("int")).alias("_all"),
        F.sum("pending").alias("pending"), F.sum("null_ts").alias("null_ts"), F.count(F.lit(1)).alias("addresses_reviewed"))
    hit = matched.groupBy("owner").agg(F.count_distinct("address").alias("_hit"))
    unk = programs.groupBy("owner").agg(F.count_distinct("program").alias("unknown_programs"))
    d = need.join(got, "owner", "left").join(hit, "owner", "left").join(unk, "owner", "left").fillna(0, ["unknown_programs", "_hit"])
    whole = (F.col("_hit") == F.col("addresses_required")) & (F.col("_hit") == F.col("addresses_reviewed")) & (F.col("_all") == 1)
    d = d.withColumn("pagination_complete", F.coalesce(whole, F.lit(False))).withColumn("observed", F.col("addresses_reviewed").isNotNull())
    age = F.lit(now) - F.col("head_at")
    return d.withColumn("stale", F.col("observed") & ~F.coalesce(age.between(0, max_age), F.lit(False))).drop("_all", "_hit")


def coverage_blockers(coverage: DataFrame) -> DataFrame:
    """One row of overlapping blocker counts over owners."""
    o = F.col("observed")
    good = o & F.col("pagination_complete") & (F.col("pending") == 0) & (F.col("null_ts") == 0) & (F.col("unknown_programs") == 0) & ~F.col("stale")
    return coverage.agg(
        F.count(F.lit(1)).alias("owners_required"), F.count_if(o).alias("owners_observed"), F.count_if(~o).alias("owners_missing"),
        F.coalesce(F.sum("addresses_required"), F.lit(0)).alias("addresses_required"), F.coalesce(F.sum("addresses_reviewed"), F.lit(0)).alias("addresses_observed"),
        F.count_if(good).alias("owners_complete_fresh"), F.count_if(o & (F.col("addresses_reviewed") < F.col("addresses_required"))).alias("owners_missing_addresses"),
        F.count_if(o & ~F.col("pagination_complete")).alias("owners_incomplete_pagination"), F.count_if(F.col("pending") > 0).alias("owners_pending"),
        F.count_if(F.col("null_ts") > 0).alias("owners_null_timestamps"), F.count_if(o & (F.col("unknown_programs") > 0)).alias("owners_unsupported_programs"),
        F.count_if("stale").alias("owners_stale"))
