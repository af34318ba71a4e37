"""Traces against a plain stack, and one of 100,000 steps."""

import random

from pyspark.sql import functions as F

from marketlens.operators import graph as gr

STEP = "tx long, pos long, depth int, call boolean, a boolean, amount long"


def plain(rows):
    """Parents and sums below each call of one transaction, or None if a step jumps."""
    stack, parents, sums = [], {}, {}
    for _, pos, depth, call, a, amount in rows:
        if depth is None or depth < 1 or depth > len(stack) + 1:
            return None
        del stack[depth - 1 :]
        parents[pos] = stack[-1] if stack else None
        for p in stack:
            if p in sums:
                sums[p][0 if a else 1] += amount
        stack.append(pos)
        if call:
            sums[pos] = [0, 0]
    return parents, {p: tuple(s) for p, s in sums.items() if min(s) > 0}


def test_random_traces(spark):
    rng = random.Random(2)
    rows = []
    for tx in range(60):
        depth = 0
        for pos in range(rng.randint(1, 30)):
            depth = None if rng.random() < .003 else rng.randint(1, (depth or 0) + (2 if rng.random() < .01 else 1))
            rows.append((tx, pos * 2, depth, rng.random() < .4, rng.random() < .5, rng.randint(0, 9)))
    df = spark.createDataFrame(rows, STEP).repartition(5)
    p = gr.parent_paths(df, "tx", "pos", "depth")
    assert p.columns == [*df.columns, "parent", "trace_reason"]
    got = {(r["tx"], r["pos"]): (r["parent"], r["trace_reason"]) for r in p.collect()}
    legs = {}
    for r in gr.two_leg_receipts(p, "tx", "pos", F.col("call"), F.col("a"), ~F.col("a"), "amount").collect():
        legs.setdefault(r["tx"], {})[r["invocation"]] = (r["base_sent"], r["quote_received"])
    voids = 0
    for tx in range(60):
        mine = [r for r in rows if r[0] == tx]
        want = plain(mine)
        voids += want is None
        for r in mine:
            assert got[tx, r[1]] == ((None, "invalid_stack_height") if want is None else (want[0][r[1]], None))
        assert legs.get(tx, {}) == (want[1] if want else {})
    assert 0 < voids < 30


def test_long_trace(spark):
    """100,000 steps of one transaction, 1,000 levels deep: two rows a step."""
    n = 100_000
    df = spark.range(n).select(F.lit(1).cast("long").alias("tx"), F.col("id").alias("pos"), (F.col("id") % 1000 + 1).cast("int").alias("depth"), (F.col("id") % 1000 == 0).alias("call"), (F.col("id") % 2 == 0).alias("a"), F.lit(1).cast("long").alias("amount"))
    p = gr.parent_paths(df, "tx", "pos", "depth")
    assert p.filter("trace_reason IS NULL AND (parent = pos - 1 OR depth = 1 AND parent IS NULL)").count() == n
    legs = gr.two_leg_receipts(p, "tx", "pos", F.col("call"), F.col("a"), ~F.col("a"), "amount").collect()
    assert len(legs) == 100 and {(r["base_sent"], r["quote_received"]) for r in legs} == {(499, 500)}


def test_a_trace_is_read_once(spark):
    """The transactions are planned once, not again for each kind of line, and shuffles are cut finer than the session's few partitions."""
    from marketlens.plans import QUERIES
    for name in ("parent_paths", "two_leg_receipts", "extract_transfers"):
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Relation [") == 2, name
    assert int(spark.conf.get("spark.sql.adaptive.coalescePartitions.initialPartitionNum")) > 8


def test_nulls_in_transactions(spark):
    tx = spark.createDataFrame([
        ("a", 1, False, 5, ["s"], [], None, [None, (1, None), (2, [("system", "transfer", "x", "y", 7, None)]), (None, [("system", "transfer", "x", "z", 8, None)])]),
        ("b", 2, False, 5, ["s"], [], [("system", "transfer", "p", "q", 9, None)], None),
        ("c", 3, False, 5, ["s"], [], None, None)],
        "sig string, slot long, failed boolean, block_time long, signers array<string>, balances array<struct<account: string, owner: string, mint: string>>, "
        "instructions array<struct<program: string, kind: string, source: string, target: string, amount: bigint, asset: string>>, "
        "inner array<struct<index: int, instructions: array<struct<program: string, kind: string, source: string, target: string, amount: bigint, asset: string>>>>")
    got = sorted((r["sig"], r["path"], r["target"], r["amount"]) for r in gr.extract_transfers(tx).collect())
    assert got == [("a", "0", "z", 8), ("a", "2.0", "y", 7), ("b", "0", "q", 9)]
