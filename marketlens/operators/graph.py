"""Transfers between wallets: extraction, links, components, traces and balance reconciliation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marketlens.session import written


def over_share(amount: str, supply: str, limit_pct: float) -> Column:
    """Whether a whole amount is more than ``limit_pct`` percent of a whole supply, without rounding."""
    wide = lambda c: F.col(c).cast("decimal(28,0)")
    return wide(amount) * 100 > wide(supply) * F.lit(limit_pct).cast("decimal(9,6)")


def extract_transfers(tx: DataFrame, valid=None) -> DataFrame:
    """Edges of successful transactions from top-level and inner instructions.

    ``tx``: sig, slot, failed, block_time, signers array<string>, balances array<struct<account, owner, mint>> (rows before,
    then after), instructions array<struct<program, kind, source, target, amount, asset>>, inner
    array<struct<index, instructions>>. ``path`` is ``i`` or ``i.j``. Token accounts resolve to the owner of their last balance
    row; ``owner_resolution`` tells whether both did. A transfer that names no mint takes that of its source account, then of its
    target. ``valid`` is a column test on both ends (an address check, say); ends that are null never count.
    """
    base = ["sig", "slot", "block_time", "signers", "balances"]
    ok = tx.filter(~F.coalesce("failed", F.lit(True)))
    # Both kinds of instruction leave one array: the transactions are made and read once.
    top = F.transform("instructions", lambda x, i: F.struct(i.cast("string").alias("path"), x.alias("ins")))
    inner = F.flatten(F.transform("inner", lambda g: F.coalesce(F.transform(g["instructions"], lambda x, j: F.struct(F.concat_ws(".", g["index"].cast("string"), j.cast("string")).alias("path"), x.alias("ins"))), F.array())))
    d = ok.select(*base, F.explode(F.concat(F.coalesce(top, F.array()), F.coalesce(inner, F.array()))).alias("_x")).select(*base, "_x.*")
    kind, program = F.col("ins.kind"), F.col("ins.program")
    relation = (F.when((program == "system") & kind.isin("transfer", "transferWithSeed"), "native_transfer")
                .when((program == "token") & kind.isin("transfer", "transferChecked"), "token_transfer")
                .when((program == "token") & kind.isin("initializeMint", "initializeMint2"), "mint_authority_at_initialization"))
    held = lambda end: F.try_element_at(F.filter("balances", lambda b: (b["account"] == F.col(end)) & b["owner"].isNotNull()), F.lit(-1))
    d = d.withColumn("relation", relation).filter("relation is not null").withColumn("_s", held("ins.source")).withColumn("_t", held("ins.target"))
    token = F.col("relation") == "token_transfer"
    native = F.col("relation") == "native_transfer"
    d = d.select("sig", "slot", "path", "block_time", "relation",
                 F.when(token, F.coalesce("_s.owner", "ins.source")).otherwise(F.col("ins.source")).alias("source"),
                 F.when(token, F.coalesce("_t.owner", "ins.target")).otherwise(F.col("ins.target")).alias("target"),
                 F.when(native, "SOL").when(token, F.coalesce("ins.asset", "_s.mint", "_t.mint")).otherwise(F.col("ins.asset")).alias("asset"),
                 F.col("ins.amount").alias("amount"), F.when(token, F.col("_s.owner").isNotNull() & F.col("_t.owner").isNotNull()).alias("owner_resolution"),
                 F.when(~token & ~native, F.col("signers")).alias("signers"))
    d = d.filter("source is not null and target is not null")
    return d if valid is None else d.filter(valid(F.col("source")) & valid(F.col("target")))


def shared_senders(edges: DataFrame, selected: DataFrame, infrastructure: DataFrame | None = None) -> DataFrame:
    """Native senders reaching more than one selected wallet, with how many; who they reached is a semi
    join on the edges, so no recipient list is ever built for a busy sender."""
    d = edges.filter("relation = 'native_transfer'").join(selected.select(F.col("wallet").alias("target")).distinct(), "target", "left_semi")
    if infrastructure is not None:
        d = d.join(infrastructure.select(F.col("wallet").alias("source")).distinct(), "source", "left_anti")
    pairs = d.groupBy("source", "target").agg(F.count(F.lit(1)).alias("_n"))
    g = pairs.groupBy("source").agg(F.count(F.lit(1)).alias("recipients"), F.sum("_n").alias("transfers"))
    return g.filter("recipients > 1")


def components(edges: DataFrame, nodes: DataFrame, group: str, a: str = "a", b: str = "b", node: str = "node") -> DataFrame:
    """Connected components per group: every node with the smallest node of its component as ``component``.

    Each round hooks every root onto the smallest label a neighbour carries and then jumps pointers,
    so long chains shrink by half per round. Minima are taken in partial aggregates, so a node with
    very many edges is no bottleneck. Every round is written, compressed.
    """
    both = written(edges.select(group, F.col(a).alias("_s"), F.col(b).alias("_t"))
                       .unionByName(edges.select(group, F.col(b).alias("_s"), F.col(a).alias("_t"))).filter("_s <> _t").distinct())
    label = nodes.select(group, F.col(node).alias("_n"), F.col(node).alias("_c")).distinct()
    while True:
        seen = both.join(label.select(group, F.col("_n").alias("_t"), F.col("_c").alias("_low")), [group, "_t"])
        near = seen.groupBy(group, F.col("_s").alias("_n")).agg(F.min("_low").alias("_low"))
        d = label.join(near, [group, "_n"], "left").withColumn("_m", F.least("_c", "_low"))
        # Hook: all nodes of one label learn the smallest label any of them saw.
        hook = d.groupBy(group, "_c").agg(F.min("_m").alias("_to"))
        d = written(d.join(hook, [group, "_c"]).select(group, "_n", "_c", F.least("_m", "_to").alias("_x")))
        # Jump: a label is a node too; take over that node's label.
        up = d.select(group, F.col("_n").alias("_x"), F.col("_x").alias("_xx"))
        new = written(d.join(up, [group, "_x"], "left").select(group, "_n", "_c", F.least("_x", F.coalesce("_xx", "_x")).alias("_new")))
        if new.filter("_new <> _c").isEmpty():
            return new.select(group, F.col("_n").alias(node), F.col("_new").alias("component"))
        label = new.select(group, "_n", F.col("_new").alias("_c"))


def link_edges(holders: DataFrame, tokens: DataFrame, transfers: DataFrame, since: int) -> DataFrame:
    """Links among the selected wallets of a token inside the review window, as ``(token, a, b)``.

    Direct native transfers, token transfers of that token with resolved owners, and a star over the
    recipients of every native sender that reached at least two of them (the pool never links).
    """
    nodes = (holders.select("token", "owner").unionByName(tokens.select("token", F.col("creator").alias("owner"))).distinct()
             .join(tokens.select("token", "pool"), "token").filter("owner <> pool").select("token", "owner", "pool"))
    nodes = written(nodes)  # every kind of link reads them
    # Repeated transfers between the same wallets add nothing: only distinct pairs meet the holders.
    ev = transfers.filter(F.col("block_time") >= since)
    native = ev.filter("relation = 'native_transfer'").select("source", "target").distinct()
    into = native.join(nodes.withColumnRenamed("owner", "target"), "target")
    members = nodes.select("token", F.col("owner").alias("source"))
    own = (ev.filter(F.col("relation") == "token_transfer").filter(F.coalesce("owner_resolution", F.lit(False)))
           .select(F.col("asset").try_cast(nodes.schema["token"].dataType).alias("token"), "asset", "source", "target").distinct())
    own = (own.filter(F.col("token").cast("string") == F.col("asset")).join(nodes.select("token", F.col("owner").alias("target")), ["token", "target"])
           .select("token", "source", "target"))
    direct = (into.select("token", "source", "target").unionByName(own).filter("source <> target")
              .join(members, ["token", "source"], "left_semi").select("token", F.col("source").alias("a"), F.col("target").alias("b")))
    funded = into.filter("source <> pool").select("token", "source", "target")
    hub = funded.groupBy("token", "source").agg(F.min("target").alias("_hub"), F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    star = funded.join(hub, ["token", "source"]).filter("target <> _hub").select("token", F.col("_hub").alias("a"), F.col("target").alias("b"))
    return direct.unionByName(star).distinct()


def linked_exposure(census: DataFrame, tokens: DataFrame, transfers: DataFrame, since: int, max_cluster: float = 10.0, max_creator: float = 2.0) -> DataFrame:
    """Clusters of linked wallets per token with their share and whether it exceeds the policy.

    ``census`` (token, owner, amount), ``tokens`` (token, creator, pool, supply): whole amounts are compared with the
    limits, so the answer does not depend on the order of a sum.
    """
    edges = written(link_edges(census, tokens, transfers, since))
    linked = edges.select("token", F.col("a").alias("owner")).unionByName(edges.select("token", F.col("b").alias("owner"))).distinct()
    comp = components(edges, linked, "token", node="owner")
    d = comp.join(census.select("token", "owner", "amount"), ["token", "owner"], "left").join(tokens.select("token", "creator", "supply"), "token")
    g = d.groupBy("token", "component").agg(F.count(F.lit(1)).alias("wallets"), F.sum(F.coalesce("amount", F.lit(0))).alias("_sum"),
                                            F.max((F.col("owner") == F.col("creator")).cast("int")).alias("_c"), F.max("supply").alias("_supply"))
    bad = over_share("_sum", "_supply", max_cluster) | ((F.col("_c") == 1) & over_share("_sum", "_supply", max_creator))
    share = F.col("_sum") / F.nullif(F.col("_supply"), F.lit(0)) * 100
    return g.select("token", "component", "wallets", share.alias("share_pct"), (F.col("_c") == 1).alias("has_creator"), bad.alias("excessive"))


def cluster_verdict(tokens: DataFrame, clusters: DataFrame, selected: DataFrame, covered: DataFrame) -> DataFrame:
    """Status of the linked-wallet check per token.

    ``clusters`` as ``linked_exposure`` returns them, ``selected`` (token, owner): the wallets whose history must be known,
    ``covered`` (owner, complete): which histories cover the window. Links that were seen can prove a rejection;
    a pass needs every selected history.
    """
    bad = clusters.groupBy("token").agg(F.max("excessive").alias("_bad"), F.count(F.lit(1)).alias("clusters"))
    c = covered.groupBy("owner").agg(F.min(F.coalesce("complete", F.lit(False))).alias("_ok"))
    need = selected.distinct().join(c, "owner", "left").groupBy("token").agg(
        F.count(F.lit(1)).alias("owners_required"), F.count("_ok").alias("owners_observed"), F.count_if(~F.coalesce("_ok", F.lit(False))).alias("_open"))
    d = tokens.select("token").join(bad, "token", "left").join(need, "token", "left").fillna(0, ["clusters", "owners_required", "owners_observed"])
    status = (F.when(F.coalesce("_bad", F.lit(False)), "REJECT").when((F.col("owners_required") > 0) & (F.col("_open") == 0), "PASS").otherwise("UNKNOWN"))
    return d.select("token", "clusters", "owners_required", "owners_observed", status.alias("status"))


def creator_flows(tokens: DataFrame, holders: DataFrame, events: DataFrame) -> DataFrame:
    """Per token: transfers from its creator to its holders, and the creator's withdrawals and sales."""
    t = tokens.select("token", "creator", "pool")
    out = events.filter(F.col("relation").isin("native_transfer", "token_transfer") & (F.col("source") != F.col("target")))
    direct = (out.join(t, out["source"] == t["creator"]).join(holders.select("token", F.col("owner").alias("target")), ["token", "target"], "left_semi")
              .filter((F.col("relation") == "native_transfer") | F.coalesce("owner_resolution", F.lit(False)))
              .groupBy("token").agg(F.count(F.lit(1)).alias("creator_to_holder")))
    acts = events.filter(F.col("relation").isin("withdraw", "sell")).groupBy(F.col("source").alias("creator")).agg(
        F.count_if(F.col("relation") == "withdraw").alias("withdrawals"), F.count_if(F.col("relation") == "sell").alias("sales"))
    return t.join(direct, "token", "left").join(acts, "creator", "left").fillna(0, ["creator_to_holder", "withdrawals", "sales"]).drop("pool")


def associated_entities(creators: DataFrame, events: DataFrame) -> DataFrame:
    """Mints initialised or co-signed by a creator; the pool's own LP mint is infrastructure.

    ``creators`` (creator, pool, lp_mint), ``events`` (source, target, relation, signers array).
    """
    init = events.filter("relation = 'mint_authority_at_initialization'")
    linked = (init.select(F.col("source").alias("creator"), "source", "target", F.lit(True).alias("authority_match"))
              .unionByName(init.select(F.explode("signers").alias("creator"), "source", "target", F.lit(False).alias("authority_match"))))
    d = creators.join(linked, "creator")
    g = d.groupBy("creator", "target").agg(F.max("authority_match").alias("authority_match"),
                                           F.max(F.coalesce((F.col("target") == F.col("lp_mint")) & (F.col("source") == F.col("pool")), F.lit(False))).alias("_lp"))
    return g.select("creator", F.col("target").alias("mint"), "authority_match", F.when(F.col("_lp"), "pool_lp").otherwise("associated").alias("role"))


def parent_paths(trace: DataFrame, tx: str, pos: str, depth: str) -> DataFrame:
    """``parent`` position of every step, rebuilt from its depth, and ``trace_reason``.

    A step may go at most one level deeper than the one before; a bad jump voids its whole transaction. So a step's parent is the last
    step one level up before it. Every step stands on two lines, that of its own level, which it opens, and that of the level above, where it asks for
    the last one that opened; depth has no limit, and a step costs two rows whatever the length of its transaction.
    """
    w = Window.partitionBy(tx).orderBy(pos)
    jump = F.col(depth) > F.coalesce(F.lag(depth).over(w), F.lit(0)) + 1
    d = trace.withColumn("_bad", F.coalesce((F.col(depth) < 1) | jump, F.lit(True)))
    d = d.withColumn("_void", F.max("_bad").over(Window.partitionBy(tx)))
    row, level = F.struct(*trace.columns, "_void"), F.col(depth).cast("long")
    asks = F.struct(F.when(~F.col("_void"), level - 1).alias("_level"), F.lit(None).cast(d.schema[pos].dataType).alias("_open"), row.alias("_row"))
    opens = F.struct(level.alias("_level"), F.col(pos).alias("_open"), F.when(F.lit(False), row).alias("_row"))
    # The two lines of a step leave the same row, so that the transactions are sorted once.
    both = d.select(F.col(tx).alias("_tx"), F.col(pos).alias("_pos"), F.explode(F.when(F.col("_void"), F.array(asks)).otherwise(F.array(asks, opens))).alias("_x")).select("_tx", "_pos", "_x.*")
    line = Window.partitionBy("_tx", "_level").orderBy("_pos").rowsBetween(Window.unboundedPreceding, -1)
    both = both.withColumn("parent", F.max("_open").over(line)).filter("_row IS NOT NULL")
    return both.select("_row.*", F.when(F.col("_level") > 0, F.col("parent")).alias("parent"), F.when(F.col("_row._void"), "invalid_stack_height").alias("trace_reason")).drop("_void")


def two_leg_receipts(paths: DataFrame, tx: str, pos: str, invoked: Column, leg_a: Column, leg_b: Column, amount: str, depth: str = "depth") -> DataFrame:
    """Invocations whose own descendants move both legs: sums of leg A and leg B, both above zero.

    A step's descendants are the steps up to the next one that is no deeper. That step closes all levels from its own to that of the
    step before it, so each step is closed once, and carries the sums up to it: no step is listed under its ancestors.
    """
    w = Window.partitionBy(tx).orderBy(pos)
    leg = lambda c, to: F.coalesce(F.sum(F.when(c, F.col(amount)).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, to)), F.lit(0))
    d = paths.filter(F.col("trace_reason").isNull()).select(
        tx, F.col(pos).alias("_pos"), F.col(depth).cast("long").alias("_depth"), F.coalesce(invoked, F.lit(False)).alias("_call"), leg(leg_a, 0).alias("_a"), leg(leg_b, 0).alias("_b"), leg(leg_a, -1).alias("_a0"), leg(leg_b, -1).alias("_b0"),
        F.coalesce(F.lag(depth).over(w), F.lit(0)).cast("long").alias("_last"), F.lead(pos).over(w).isNull().alias("_end"))
    at = lambda level, a, z, opens, pos="_pos": F.struct(F.col(pos).alias("_pos") if isinstance(pos, str) else pos.alias("_pos"), level.alias("_level"), F.col(a).alias("_a"), F.col(z).alias("_b"), F.lit(opens).alias("_opens"))
    none = F.array()
    # All lines of a step leave its row: it opens its level, shuts those the step before left, and the last one shuts its own and those above.
    shuts = F.when(F.col("_depth") <= F.col("_last"), F.transform(F.sequence("_depth", F.greatest("_depth", "_last")), lambda n: at(n, "_a0", "_b0", 0))).otherwise(none)
    ends = F.when(F.col("_end"), F.transform(F.sequence(F.lit(1).cast("long"), "_depth"), lambda n: at(n, "_a", "_b", 0, F.col("_pos") + 1))).otherwise(none)
    g = d.select(tx, "_call", F.explode(F.concat(F.array(at(F.col("_depth"), "_a", "_b", 1)), shuts, ends)).alias("_x")).select(tx, "_x.*", (F.col("_call") & (F.col("_x._opens") == 1)).alias("_call"))
    line = Window.partitionBy(tx, "_level").orderBy("_pos", "_opens")
    g = g.withColumns({"base_sent": F.lead("_a").over(line) - F.col("_a"), "quote_received": F.lead("_b").over(line) - F.col("_b")})
    return g.filter("_call AND base_sent > 0 AND quote_received > 0").select(tx, F.col("_pos").alias("invocation"), "base_sent", "quote_received")


def reconcile_endpoints(balances: DataFrame, moves: DataFrame, tx: str = "tx", fee: bool = True) -> DataFrame:
    """Account balances at both ends of a transaction against its explicit transfers.

    ``balances`` (tx, account, asset, pre, post, fee), ``moves`` (tx, seq, source, target, asset, amount). A
    transaction matches when every account ends at pre - fee + moves and never runs below zero; else
    it is UNKNOWN with the sorted blockers.
    """
    key = [tx, "account", "asset"]
    signed = (moves.select(tx, F.col("source").alias("account"), "asset", "seq", (-F.col("amount")).alias("delta"))
              .unionByName(moves.select(tx, F.col("target").alias("account"), "asset", "seq", F.col("amount").alias("delta"))))
    start = F.col("pre") - (F.col("fee") if fee else F.lit(0))
    opening = balances.select(*key, F.lit(-1).cast("long").alias("seq"), start.alias("delta"), F.lit(1).alias("_known"))
    line = signed.withColumn("seq", F.col("seq").cast("long")).unionByName(opening, allowMissingColumns=True)
    # A step's debit precedes its credit; the number of steps of one transaction is bounded.
    w = Window.partitionBy(*key).orderBy("seq", "delta").rowsBetween(Window.unboundedPreceding, 0)
    run = line.withColumn("_run", F.sum("delta").over(w))
    acct = run.groupBy(*key).agg(F.sum("delta").alias("end"), F.min("_run").alias("low"), F.max("_known").alias("_known"))
    acct = acct.join(balances.select(*key, "post"), key, "left")
    why = (F.when(F.col("_known").isNull(), "missing_endpoint_account_state").when(F.col("low") < 0, "balance_underflow")
           .when(F.col("end") != F.col("post"), "balance_residual"))
    g = acct.withColumn("_why", why).groupBy(tx).agg(
        F.count(F.lit(1)).alias("accounts"), F.array_sort(F.collect_set("_why")).alias("blockers"),
        F.sum(F.abs(F.when(F.col("_known").isNotNull(), F.col("post") - F.col("end")).otherwise(0))).alias("residual"))
    return g.withColumn("status", F.when(F.size("blockers") == 0, "ENDPOINT_AMOUNTS_MATCH").otherwise("UNKNOWN"))


def paired_replay(base: DataFrame, candidate: DataFrame, tx: str = "tx", good: str = "ENDPOINT_AMOUNTS_MATCH") -> DataFrame:
    """How transactions moved between two decoders: improved, regressed or unchanged."""
    d = base.select(tx, F.col("status").alias("status_base")).join(candidate.select(tx, F.col("status").alias("status_candidate")), tx)
    move = (F.when(F.col("status_base") == F.col("status_candidate"), "unchanged").when(F.col("status_candidate") == good, "improved").otherwise("regressed"))
    return d.groupBy("status_base", "status_candidate", move.alias("change")).agg(F.count(F.lit(1)).alias("n"))
