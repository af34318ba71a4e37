"""Cases in which rows were once lost, repeated or judged on absent evidence."""

from pyspark.sql import functions as F

from marketlens.operators import graph as gr
from marketlens.operators import joins as jn
from marketlens.operators import policy as po
from marketlens.operators import timeline as tl
from marketlens.sources import snapshots as sn
from marketlens.streaming import rules
from marketlens.streaming import streams as sm

SNAP = "id long, mint long, ts long, price double"


def test_archive_keeps_the_tail(spark, tmp_path):
    src, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    rows = spark.range(300).select("id", (F.col("id") % 3).alias("mint"), (F.col("id") * 60).alias("ts"), F.lit(1.0).alias("price"))
    for a in (0, 100, 200):
        rows.filter(f"id BETWEEN {a} AND {a + 99}").repartition(1).write.mode("append").parquet(src)
        sm.archive_stream(spark.readStream.schema(rows.schema).parquet(src), out, ck, "ts", 120).awaitTermination()
    got = sorted(r["id"] for r in spark.read.parquet(out).collect())
    assert got == list(range(298))  # all but what is still inside the holdback


def test_ladder_takes_every_row_of_a_second(spark):
    d = spark.createDataFrame([(0, 1, 0, 10.0), (1, 1, 5, 5.0), (2, 1, 5, 12.0), (3, 1, 9, 11.0), (4, 1, 9, 14.0)], SNAP)
    got = sorted((r["ts"], r["price"]) for r in tl.ladder_fires(d, ["mint"], "ts", "price", 1.1, 100, "id").collect())
    s, want = None, []
    for r in d.orderBy("ts", "id").collect():
        s, fired = rules.trailing_reference(1.1)(s, r.asDict())
        want += [(f["ts"], f["price"]) for f in fired]
    assert got == want == [(5, 12.0), (9, 14.0)]


def test_segments_open_once(spark):
    d = spark.createDataFrame([(i, 1, t, 1.0) for i, t in enumerate([1000, 1000, 1060, 9000, 9000])], SNAP)
    assert [r["segment"] for r in tl.segments(d, ["mint"], ["ts", "id"], 90, 500).orderBy("ts", "id").collect()] == [0, 0, 0, 1, 1]


def test_copies_of_the_own_mint_do_not_hide_a_control(spark):
    cases = spark.createDataFrame([(1, "b", "m", 1.0, 1.0, 1.0)], "id long, b string, mint string, x double, y double, z double")
    controls = spark.createDataFrame([(i, "b", m, 1.0, 1.0, 1.0) for i, m in [(1, "m"), (2, "m"), (3, "n"), (4, "n")]], cases.schema)
    got = jn.nearest_controls(cases, controls, ["b"], [("x", 1.0, 1.0), ("y", 1.0, 1.0), ("z", 1.0, 1.0)], "id", "id", 1, F.col("r_mint") != F.col("mint"), [], barred="mint")
    assert [r["r_id"] for r in got.collect()] == [3]


def test_deep_traces_and_bad_jumps(spark):
    d = spark.createDataFrame([("t", i, i) for i in range(1, 8)] + [("t", 8, 3), ("u", 1, 1), ("u", 2, 3), ("u", 3, 1)], "tx string, pos long, depth long")
    got = {(r["tx"], r["pos"]): (r["parent"], r["trace_reason"]) for r in gr.parent_paths(d, "tx", "pos", "depth").collect()}
    assert got["t", 7] == (6, None) and got["t", 8] == (2, None) and got["t", 1] == (None, None)
    assert all(got["u", i] == (None, "invalid_stack_height") for i in (1, 2, 3))


def test_a_batch_inserts_a_key_once(spark):
    d = spark.createDataFrame([(1, 1, 10, 1.0), (2, 1, 10, 2.0), (3, 1, 20, 3.0)], SNAP)
    assert sorted(r["id"] for r in sn.incremental_copy(d, d.limit(0), 10**6).collect()) == [1, 3]


def test_absent_evidence_never_passes(spark):
    dev = spark.createDataFrame([("t", "c", "p", False, True, n) for n in (1, None)] + [("u", "c", "p", False, True, 0)], "token string, creator string, pool string, provider_flag boolean, attributed boolean, associated long")
    ev = spark.createDataFrame([], "source string, relation string, target string, block_time long")
    none = spark.createDataFrame([], "token string, retrieved boolean, flagged boolean")
    assert sorted((r["token"], r["status"]) for r in po.check_developer(dev, ev, none, 0).collect()) == [("t", "UNKNOWN"), ("t", "UNKNOWN"), ("u", "PASS")]
    doc = "struct<program_ok:boolean,executable:boolean,initialized:boolean,mint_authority:string,freeze_authority:string,supply:long,extensions:array<string>>"
    a = spark.createDataFrame([((True, False, True, None, None, 5, None),), ((True, False, True, None, None, 5, []),)], f"account {doc}").select(po.check_token_controls().alias("c"))
    assert [r["c"]["status"] for r in a.collect()] == ["UNKNOWN", "PASS"]
    pools = spark.createDataFrame([("p", 0, "p", None, True)], "pool string, lp_supply long, lp_authority string, freeze string, flags_ok boolean")
    vaults = lambda x: spark.createDataFrame([("p", s, "p", True, "initialized", None, v) for s, v in (("a", 5), ("b", x))], "pool string, side string, owner string, mint_ok boolean, state string, delegate string, amount long")
    assert [po.check_liquidity(pools, vaults(x)).first()["status"] for x in (5, None, 0)] == ["PASS", "UNKNOWN", "REJECT"]
    sales = spark.createDataFrame([("t", f"s{i}", 100, 1, 1) for i in range(4)], "token string, seller string, time long, quote_received long, base_sent long")
    for switch, controls, want in ((True, "PASS", "PASS"), (None, "PASS", "UNKNOWN"), (True, "UNKNOWN", "UNKNOWN"), (True, None, "UNKNOWN")):
        t = spark.createDataFrame([("t", "c", switch, controls)], "token string, creator string, sell_enabled boolean, controls string")
        assert po.check_trading(sales, t, 150).first()["status"] == want


def test_streams_over_many_batches(spark, tmp_path):
    """One file a micro-batch, with state between them; equal seconds in id order."""
    src = str(tmp_path / "in")
    rows = [(i, i % 3, (i // 6) * 40, float((i * 7919) % 23)) for i in range(240)]
    for a in range(0, 240, 48):
        spark.createDataFrame(rows[a : a + 48], SNAP).repartition(1).write.mode("append").parquet(src)
        time_apart()
    stream = spark.readStream.schema(SNAP).option("maxFilesPerTrigger", 1).parquet(src)
    step = rules.level_cross([5.0, 15.0], 10.0, 200, 90)
    got = sorted((r["id"], r["level"]) for r in sm.run_rule(stream, ["mint"], step, "id long, mint long, ts long, level double, price double", "many").collect())
    want = []
    for k in range(3):
        s = None
        for i, m, t, p in rows:
            if m == k:
                s, fired = step(s, {"id": i, "ts": t, "price": p})
                want += [(f["id"], f["level"]) for f in fired]
    assert got == sorted(want) and want


def time_apart():
    """Files are read in the order of their modification time."""
    import time

    time.sleep(1.1)
