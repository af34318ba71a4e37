"""Transactions replayed account by account: lifetimes, refunds, supply changes, and what the end balances leave over."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marketlens.session import grouped_once, written

# The names of the native token's wrapper, of the token programs and of the reasons, as the results state them.
WRAPPED = "So11111111111111111111111111111111111111112"
TOKEN, TOKEN_2022 = "TokenkegQfeZyiNwAJbNbGKPFXCWuBvf9Ss623VQ5DA", "TokenzQdBNbLqP5VEhdkAS6EPFLC1PHnBqCXEpPxuEb"
FATAL = ["fee_exceeds_balance", "account_outside_message", "native_underflow", "recreated_token_account_unverified", "native_account_reinitialization", "account_reinitialization",
         "sync_native_identity_unverified", "sync_native_historical_reserve_missing", "sync_native_decrease_unsupported", "missing_transfer_account_state", "transfer_identity_mismatch", "checked_mint_mismatch",
         "token_underflow", "mint_burn_account_missing", "mint_burn_identity_mismatch", "mint_burn_amount_bounds", "missing_close_state", "close_program_mismatch", "nonempty_close",
         "pump_close_roles", "pump_close_permissions", "pump_close_creation_unverified", "pump_close_endpoints", "token_authority_change_unverified"]
HOLDS = ["downstream_program_semantics_unverified", "token2022_extensions_unverified", "new_wsol_reserve_unverified", "pump_close_pda_and_deployed_version_unverified",
         "ata_rent_and_historical_program_semantics_unverified", "mint_burn_authority_and_supply_unverified"]

OPENING, ENDPOINT = -1, (1 << 62)
EFFECT = ["kind", "source", "target", "amount", "mint", "owner", "program", "parent", "space"]
NUMBER = "decimal(38,0)"


def _legs(accounts: DataFrame, effects: DataFrame, tx: str) -> DataFrame:
    """One line a (transaction, account): its opening, a debit leg (0) and a credit leg (1) of every effect, its endpoint.

    An effect on one account only is a credit leg, but for closing legs, which are debits of the account that goes. Steps and accounts are
    dealt out by transaction before the legs are made of them, and no later step deals them out again.
    """
    parents = effects.filter("kind = 'ata_create'").select(tx, F.col("seq").alias("parent"), F.struct("target", "source", "mint", "owner", "program").alias("_parent"))
    # Only a creation asks what wraps it; steps without a parent need not meet one.
    wrapped = F.coalesce((F.col("kind") == "create") & F.col("parent").isNotNull(), F.lit(False))
    asks = effects.filter(wrapped).join(parents, [tx, "parent"], "left")
    e = effects.filter(~wrapped & (F.col("kind") != "ata_create")).unionByName(asks, allowMissingColumns=True)
    e = e.select(tx, "seq", *EFFECT, F.col("_parent").alias("ata"))
    ends = F.struct(F.col("pre").cast(NUMBER).alias("pre"), F.col("post").cast(NUMBER).alias("post"), F.col("fee").cast(NUMBER).alias("fee"), "token_pre", "token_post", F.coalesce("signer", F.lit(False)).alias("signer"), F.coalesce("writable", F.lit(False)).alias("writable"))
    a = accounts.select(tx, F.col("account").alias("_of"), F.lit(True).alias("_ends"), ends.alias("ends"))
    d = e.unionByName(a, allowMissingColumns=True).repartition(tx)
    leg = lambda account, seq, side: F.struct(account.alias("account"), seq.cast("long").alias("seq"), F.lit(side).alias("leg"))
    credit = leg(F.coalesce("target", "source"), F.col("seq"), 1)
    pays = F.col("kind").isin("transfer", "create", "token_transfer", "close", "program_close")
    legs = (F.when(F.col("_ends"), F.array(leg(F.col("_of"), F.lit(OPENING), 0), leg(F.col("_of"), F.lit(ENDPOINT), 0)))
            .when(pays, F.array(leg(F.col("source"), F.col("seq"), 0), credit)).otherwise(F.array(credit)))
    d = d.select(tx, F.explode(legs).alias("_leg"), *EFFECT, "ata", "ends")
    return d.select(tx, "_leg.*", F.struct(*EFFECT, "ata").alias("e"), "ends")


def _states(accounts: DataFrame, effects: DataFrame, tx: str) -> DataFrame:
    """Every leg with the state of its account before it and the balances after it, as ``replay`` states them, without the checks.

    All windows follow one order, (transaction, account, seq, leg), refunds included, so inside ``grouped_once`` legs are made and sorted once; what a
    window needs of no other stands in the first one, since each copies every row.
    """
    w = Window.partitionBy(tx, "account").orderBy("seq", "leg")
    past = w.rowsBetween(Window.unboundedPreceding, -1)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    kind, e = F.col("e.kind"), lambda c: F.col(f"e.{c}")
    opens = (F.col("seq") == OPENING) & F.col("ends.token_pre").isNotNull()
    begins = opens | ((kind == "init") & (F.col("leg") == 1))
    shuts = kind.isin("close", "program_close") & (F.col("leg") == 0)
    creates = (kind == "create") & (F.col("leg") == 1)
    order = F.col("seq")
    as_token = F.when(opens, F.struct(*[F.col(f"ends.token_pre.{c}").alias(c) for c in ("mint", "owner", "program")])).otherwise(F.struct(*[e(c).alias(c) for c in ("mint", "owner", "program")]))
    d = _legs(accounts, effects, tx)
    d = d.withColumns({
        "_known": F.max(F.when(F.col("seq") == OPENING, True)).over(past),
        "_open": F.last(F.when(F.coalesce(begins, F.lit(False)), order), True).over(past), "_shut": F.last(F.when((kind == "close") & (F.col("leg") == 0), order), True).over(past),
        "_vault_shut": F.last(F.when((kind == "program_close") & (F.col("leg") == 0), order), True).over(past),
        "_made": F.last(F.when(creates, order), True).over(past), "_maker": F.last(F.when(creates, e("owner")), True).over(past),
        "_is": F.last(F.when(F.coalesce(begins, F.lit(False)), as_token), True).over(past),
        "generation": F.sum(F.coalesce(begins, F.lit(False)).cast("int")).over(upto) - 1, "_era": F.coalesce(F.sum(F.coalesce(shuts, F.lit(False)).cast("int")).over(past), F.lit(0)),
        "_opened_with": F.first(F.col("ends.pre"), True).over(upto), "_signs": F.last("ends.signer", True).over(upto), "_writes": F.last("ends.writable", True).over(upto), "_post": F.first("ends.post", True).over(upto),
    })
    late = lambda a, b: F.col(a).isNotNull() & (F.col(b).isNull() | (F.col(a) > F.col(b)))
    d = d.withColumns({"_alive": late("_open", "_shut"), "_closed": late("_shut", "_open") & ~F.coalesce(F.col("_made") > F.col("_shut"), F.lit(False))})
    d = d.withColumn("_lives", F.col("_made").isNotNull() & ~F.coalesce(F.greatest("_shut", "_vault_shut") > F.col("_made"), F.lit(False)))

    # Native units, without refunds: openings, transfers, creations, and tokens of the native wrapper.
    wrapped = (kind == "token_transfer") & (F.col("_is.mint") == WRAPPED) & F.col("_alive")
    moves = kind.isin("transfer", "create") | F.coalesce(wrapped, F.lit(False))
    signed = F.when(F.col("seq") == OPENING, F.col("ends.pre") - F.col("ends.fee")).when(moves, F.when(F.col("leg") == 0, -e("amount")).otherwise(e("amount"))).otherwise(0)
    d = d.withColumn("_delta", F.coalesce(signed.cast(NUMBER), F.lit(0)))
    # Sums of an era, here and below: what has run up, less what had at its start, so that one order serves every sum.
    closing = F.coalesce(shuts, F.lit(False))
    zero = F.lit(0).cast(NUMBER)
    d = d.withColumn("_sum", F.sum("_delta").over(upto))
    d = d.withColumn("_base", (F.col("_sum") - F.coalesce(F.last(F.when(closing, F.col("_sum")), True).over(past), zero)).cast(NUMBER))

    # Refunds: a close pays its era's units into the era its target is in; that era's own close passes them on.
    whole = Window.partitionBy(tx).orderBy("account", "seq", "leg")
    pays = F.when(kind.isin("close", "program_close"), F.struct("seq", "leg", F.struct("account", "_era").alias("at"), "_base"))
    d = d.withColumns({"_ends": F.collect_list(pays).over(whole.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), "_row": F.row_number().over(whole)})
    target = lambda c: F.try_element_at(F.filter("_ends", lambda x: (x["leg"] == 1) & (x["seq"] == c["seq"])), F.lit(1))["at"]
    line = F.transform(F.sort_array(F.filter("_ends", lambda c: c["leg"] == 0)), lambda c: F.struct(c["seq"].alias("seq"), c["at"].alias("_from"), target(c).alias("_to"), c["_base"].alias("_base")))
    # The first row of a transaction folds for all of it.
    d = d.withColumn("_c", F.when((F.col("_row") == 1) & (F.size("_ends") > 0), line)).drop("_ends", "_row")
    paid = lambda held, i: F.element_at(held, i + 1) + F.element_at("_c", i + 1)["_base"]
    fold = F.aggregate(F.sequence(F.lit(0), F.size("_c") - 1), F.transform("_c", lambda c: zero), lambda held, i: F.transform(held, lambda x, j: (x + F.when((j > i) & (F.element_at("_c", j + 1)["_from"] == F.element_at("_c", i + 1)["_to"]), paid(held, i)).otherwise(0)).cast(NUMBER)))
    d = d.withColumn("_into", F.when(F.col("_c").isNotNull(), fold))
    d = d.withColumn("_refunds", F.transform("_c", lambda c, i: F.struct(c["seq"].alias("seq"), (F.element_at("_into", i + 1) + c["_base"]).alias("refund")))).drop("_c", "_into")
    d = d.withColumn("_refunds", F.first("_refunds", True).over(whole.rowsBetween(Window.unboundedPreceding, 0)))
    seq = F.col("seq")
    d = d.withColumn("refund", F.when(kind.isin("close", "program_close"), F.try_element_at(F.filter("_refunds", lambda r: r["seq"] == seq), F.lit(1))["refund"])).drop("_refunds")
    paid_in = F.when((F.col("leg") == 1) & F.col("refund").isNotNull(), F.col("refund")).otherwise(zero)
    d = d.withColumn("_paid", (F.col("_delta") + paid_in).cast(NUMBER)).withColumn("_sum", F.sum("_paid").over(upto))
    d = d.withColumn("_held", (F.col("_sum") - F.coalesce(F.last(F.when(closing, F.col("_sum")), True).over(past), zero)).cast(NUMBER))
    d = d.withColumn("_held_before", (F.col("_held") - F.col("_paid")).cast(NUMBER))
    d = d.withColumn("native", F.when(closing, 0).otherwise(F.col("_held")).cast(NUMBER))

    # The reserve of a wrapper account: what its creation paid, if an account step of the same wallet wraps creation and opening.
    ata = e("ata")
    fits = ((ata["target"] == e("target")) & (ata["source"] == e("source")) & (ata["mint"] == WRAPPED) & (ata["program"] == TOKEN) & (e("owner") == TOKEN) & (e("space") == 165)
            & (F.col("_held_before") == 0) & (F.col("_opened_with") == 0) & (e("amount") > 1))
    d = d.withColumn("_fund", F.last(F.when(creates, F.when(fits, F.struct(e("parent").alias("parent"), e("amount").alias("amount"), ata["owner"].alias("owner"))).otherwise(F.struct(F.lit(None).cast("long").alias("parent"), e("amount").alias("amount"), ata["owner"].alias("owner")))), True).over(past))
    wraps = (kind == "init") & (e("mint") == WRAPPED)
    reserved = wraps & (e("program") == TOKEN) & (e("parent") == F.col("_fund.parent")) & (e("owner") == F.col("_fund.owner")) & (F.col("_held_before") == F.col("_fund.amount"))
    d = d.withColumn("_reserve", F.last(F.when(kind == "init", F.struct(F.when(reserved, F.col("_fund.amount")).cast(NUMBER).alias("v"))), True).over(past)["v"])

    # Tokens: an opening, an init and a sync set the amount, all else adds to it.
    sets = F.coalesce(begins, F.lit(False)) | F.coalesce(kind == "sync", F.lit(False)) | F.coalesce((kind == "close") & (F.col("leg") == 0), F.lit(False))
    at = F.when(opens, F.col("ends.token_pre.amount")).when(kind == "sync", F.col("_held") - F.col("_reserve")).otherwise(0).cast(NUMBER)
    change = F.when(kind == "token_transfer", F.when(F.col("leg") == 0, -e("amount")).otherwise(e("amount"))).when(kind == "mint", e("amount")).when(kind == "burn", -e("amount")).otherwise(0).cast(NUMBER)
    d = d.withColumn("_add", F.when(sets, F.coalesce(at, F.lit(0))).otherwise(F.coalesce(change, F.lit(0))).cast(NUMBER))
    d = d.withColumn("_sum", F.sum("_add").over(upto))
    since = lambda frame: F.coalesce(F.last(F.when(sets, F.col("_sum") - F.col("_add")), True).over(frame), zero)
    d = d.withColumns({"tokens": (F.col("_sum") - since(upto)).cast(NUMBER), "_tokens_before": (F.coalesce(F.lag("_sum").over(w), zero) - since(past)).cast(NUMBER),
                       "_moves": F.coalesce(moves, F.lit(False)), "_wraps": F.coalesce(wraps, F.lit(False)), "_reserved": F.coalesce(reserved, F.lit(False))})
    return d


def replay(accounts: DataFrame, effects: DataFrame, tx: str = "tx") -> DataFrame:
    """Every leg of every account with its state before and its balances after: ``generation``, ``native``, ``tokens``, ``refund``, ``fatal``, ``block``.

    ``accounts`` (tx, account, pre, post, fee, token_pre, token_post struct<mint, owner, program, amount>, signer, writable): one row for each account
    of a transaction, the fee on its payer, 0 elsewhere. ``effects`` (tx, seq, kind, source, target, amount, mint, owner, program, parent, space), in
    the order of seq, of kinds ``transfer, create, ata_create`` (the step that wraps a creation), ``init, token_transfer, sync, mint, burn,
    close, program_close, set_authority`` (authority type in owner) and ``system:*, token:*`` (effects that are not understood).

    A token account lives in generations: an opening balance or an ``init`` begins one, a ``close`` ends it, and a ``create`` allows the next. A close moves all
    native units the account holds then, refunds received before included: each close flows into at most one later close, so
    the amounts are summed up along that forest, one fold over the closes of a transaction. All else are running sums over
    (transaction, account); a transaction is small by construction, and run inside ``grouped_once`` its rows are shuffled once.
    """
    d = _states(accounts, effects, tx)
    kind, e = F.col("e.kind"), lambda c: F.col(f"e.{c}")
    alive, debit, same = F.col("_alive"), F.col("leg") == 0, F.col("_is.program") == e("program")
    native_mint, is_, no = F.col("_is.mint") == WRAPPED, lambda k: kind == k, lambda c: ~F.coalesce(c, F.lit(False))
    moved = kind.isin("transfer", "create", "close", "program_close", "token_transfer", "init", "sync", "mint", "burn")
    other = F.lag("_is").over(Window.partitionBy(tx, "seq").orderBy("leg"))
    d = d.withColumn("_other", F.when(F.col("leg") == 1, other))
    # Checks in the order in which a step makes them; the rank breaks ties between the two legs of a step.
    checks = [
        ((F.col("seq") == OPENING) & (F.col("ends.pre") < F.col("ends.fee")), "fee_exceeds_balance", 0), (moved & F.col("_known").isNull(), "account_outside_message", 0),
        (is_("program_close") & debit & (e("source") == e("target")), "pump_close_roles", 1),
        (is_("program_close") & (no(F.col("_writes")) | (~debit & no(F.col("_signs")))), "pump_close_permissions", 2),
        (is_("program_close") & debit & (no(F.col("_lives")) | no(F.col("_maker") == e("program"))), "pump_close_creation_unverified", 3),
        (is_("program_close") & debit & ((F.col("_opened_with") != 0) | (F.col("_post") != 0)), "pump_close_endpoints", 4),
        (is_("create") & ~debit & F.col("_closed") & ((F.col("_held_before") != 0) | no(e("owner") == F.col("_is.program"))), "recreated_token_account_unverified", 1),
        (is_("create") & ~debit & (F.col("_lives") | F.col("_vault_shut").isNotNull()), "native_account_reinitialization", 6),
        (is_("init") & (alive | F.col("_closed")), "account_reinitialization", 1),
        (is_("sync") & (no(alive) | no(native_mint) | no(e("program") == TOKEN) | no(F.col("_is.program") == TOKEN)), "sync_native_identity_unverified", 1),
        (is_("sync") & F.col("_reserve").isNull(), "sync_native_historical_reserve_missing", 2), (is_("sync") & (F.col("tokens") < F.col("_tokens_before")), "sync_native_decrease_unsupported", 3),
        (is_("token_transfer") & no(alive), "missing_transfer_account_state", 1),
        (is_("token_transfer") & (no(same) | (~debit & no(F.col("_other.mint") == F.col("_is.mint")))), "transfer_identity_mismatch", 2),
        (is_("token_transfer") & debit & e("mint").isNotNull() & (e("mint") != F.col("_is.mint")), "checked_mint_mismatch", 3), (is_("token_transfer") & debit & (F.col("tokens") < 0), "token_underflow", 4),
        (kind.isin("mint", "burn") & no(alive), "mint_burn_account_missing", 1), (kind.isin("mint", "burn") & (no(same) | no(e("mint") == F.col("_is.mint")) | native_mint), "mint_burn_identity_mismatch", 2),
        (kind.isin("mint", "burn") & ((F.col("tokens") < 0) | (F.col("tokens") > F.lit("18446744073709551615").cast(NUMBER))), "mint_burn_amount_bounds", 3),
        (is_("close") & debit & no(alive), "missing_close_state", 1), (is_("close") & debit & no(same), "close_program_mismatch", 2),
        (is_("close") & debit & ~F.coalesce(native_mint, F.lit(False)) & (F.col("_tokens_before") != 0), "nonempty_close", 3),
        (is_("set_authority") & no(e("owner") == "closeAccount"), "token_authority_change_unverified", 1),
        (F.col("_moves") & debit & (F.col("seq") >= 0) & (F.col("_held") < 0), "native_underflow", 5),
    ]
    d = d.withColumn("fatal", reduce(lambda rest, c: F.when(c[0], F.struct(F.lit(c[2]).alias("rank"), F.lit(c[1]).alias("reason"))).otherwise(rest), reversed(checks), F.lit(None)))
    closed, post, token = F.col("_closed"), F.col("ends.token_post"), F.col("_is")
    at_end = F.col("seq") == ENDPOINT
    has = alive | closed
    notes = F.array_compact(F.array(
        F.when(at_end & ((no(has) & post.isNotNull()) | (has & post.isNull() & ~closed)), "missing_endpoint_account_state"),
        F.when(at_end & has & post.isNotNull() & (closed | no(post["mint"] == token["mint"]) | no(post["owner"] == token["owner"]) | no(post["program"] == token["program"])), "endpoint_identity_changed"),
        F.when(at_end & (F.col("ends.post") != F.col("native")), "native_balance_residual"), F.when(F.col("_wraps"), "new_wsol_reserve_unverified"), F.when(F.col("_reserved"), "ata_rent_and_historical_program_semantics_unverified"),
        F.when(kind.isin("mint", "burn"), "mint_burn_authority_and_supply_unverified"), F.when(is_("program_close") & debit, "pump_close_pda_and_deployed_version_unverified"),
        F.when((e("program") == TOKEN_2022) & ~kind.isin("create", "transfer", "program_close", "ata_create"), "token2022_extensions_unverified"),
        F.when(kind.startswith("token:"), F.concat(F.lit("unsupported_token_effect:"), F.substring_index(kind, ":", -1))), F.when(kind.startswith("system:"), F.concat(F.lit("unsupported_system_effect:"), F.substring_index(kind, ":", -1)))))
    left = at_end & alive & (post["mint"] == token["mint"]) & (post["owner"] == token["owner"]) & (post["program"] == token["program"])
    return d.withColumns({"block": notes, "token_residual": F.when(left, post["amount"].cast(NUMBER) - F.col("tokens")), "native_residual": F.when(at_end, F.col("ends.post") - F.col("native")), "alive": alive, "closed": closed})


def reconcile_lifecycle(accounts: DataFrame, effects: DataFrame, tx: str = "tx") -> DataFrame:
    """One row a transaction: ``status``, sorted ``blockers``, ``native_residuals`` and ``token_residuals`` (account and amount, non-zero only).

    The first step that contradicts the accounts ends the replay: its reason and the blockers before it stand, and residuals are empty. Otherwise
    the end balances are compared. ENDPOINT_AMOUNTS_MATCH means that nothing but the standing holds on program semantics is open. Transactions without
    an account row are UNKNOWN by ``account_outside_message``.
    """
    d = replay(accounts, effects, tx)
    stop = F.min(F.when(F.col("fatal").isNotNull(), F.struct("seq", F.col("fatal.rank").alias("rank"), "fatal.reason"))).alias("_stop")
    notes = F.collect_set(F.when(F.size("block") > 0, F.struct("seq", "block"))).alias("_notes")
    off = lambda c: F.array_sort(F.collect_list(F.when(F.col(c) != 0, F.struct("account", F.col(c).alias("residual")))))
    g = d.groupBy(tx).agg(stop, notes, off("native_residual").alias("_native"), off("token_residual").alias("_token"))
    before = F.filter("_notes", lambda n: F.col("_stop").isNull() | (n["seq"] < F.col("_stop.seq")))
    said = F.array_union(F.flatten(F.transform(before, lambda n: n["block"])), F.array_compact(F.array(F.col("_stop.reason"))))
    said = F.array_union(said, F.when(F.col("_stop").isNull(), F.array_compact(F.array(F.lit(HOLDS[0]), F.when(F.size("_token") > 0, "token_balance_residual")))).otherwise(F.array().cast("array<string>")))
    g = g.withColumn("blockers", F.array_sort(said))
    none = lambda c: F.when(F.col("_stop").isNull(), F.col(c)).otherwise(F.slice(c, 1, 0))
    good = F.size(F.array_except("blockers", F.array(*[F.lit(h) for h in HOLDS]))) == 0
    g = g.select(tx, F.when(good, "ENDPOINT_AMOUNTS_MATCH").otherwise("UNKNOWN").alias("status"), "blockers", none("_native").alias("native_residuals"), none("_token").alias("token_residuals"))
    with grouped_once(g.sparkSession):
        return written(g)


def account_generations(accounts: DataFrame, effects: DataFrame, tx: str = "tx") -> DataFrame:
    """Lifetimes of token accounts: (tx, account, generation) with the steps that open and close it, the refund, and the tokens moved in it."""
    d = _states(accounts, effects, tx).filter("generation >= 0")
    kind = F.col("e.kind")
    close = (kind == "close") & (F.col("leg") == 0)
    moved = F.when(kind == "token_transfer", F.col("e.amount")).otherwise(0).cast("decimal(38,0)")
    g = d.groupBy(tx, "account", "generation").agg(F.min("seq").alias("opened"), F.max(F.when(close, F.col("seq"))).alias("shut"), F.max(F.when(close, F.col("refund"))).alias("refund"), F.sum(moved).alias("moved"))
    with grouped_once(g.sparkSession):
        return written(g)
