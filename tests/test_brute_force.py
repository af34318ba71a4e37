"""Parallel forms against sequential brute force on random data with a hot key."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketlens.operators import alarms as al
from marketlens.operators import graph as gr
from marketlens.operators import joins as jn
from marketlens.operators import stats as st
from marketlens.operators import timeline as tl
from marketlens.streaming import rules


def series(seed, keys=4, n=900, span=40_000):
    """A third of all rows belong to key 0."""
    rng = random.Random(seed)
    seen, rows = set(), []
    while len(rows) < n:
        k = 0 if rng.random() < 1 / 3 else rng.randrange(1, keys + 1)
        t = rng.randrange(span)
        if (k, t) not in seen:
            seen.add((k, t))
            rows.append((len(rows), k, t, round(rng.lognormvariate(0, 1), 3)))
    return rows


def drive(rows, step, make):
    out = []
    for key in sorted({r[1] for r in rows}):
        s = None
        for i, k, t, p in sorted((r for r in rows if r[1] == key), key=lambda r: r[2]):
            s, fired = step(s, make(i, t, p))
            out += [(key, f) for f in fired]
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, mint long, ts long, price double")


@pytest.mark.parametrize("seed, sep, width", [(1, 50, 64), (2, 300, 301), (3, 1000, 1000), (4, 77, 5000)])
def test_spaced_picks(spark, seed, sep, width):
    rows = series(seed)
    want = sorted((k, f["ts"]) for k, f in drive(rows, rules.spaced(sep), lambda i, t, p: {"ts": t}))
    got = sorted((r["mint"], r["ts"]) for r in tl.spaced_picks(frame(spark, rows), ["mint"], "ts", sep, width).collect())
    assert got == want


@pytest.mark.parametrize("seed, width", [(5, 100), (6, 7000)])
def test_ladder(spark, seed, width):
    rows = series(seed)
    want = sorted((k, f["ts"]) for k, f in drive(rows, rules.trailing_reference(1.1), lambda i, t, p: {"ts": t, "price": p}))
    got = sorted((r["mint"], r["ts"]) for r in tl.ladder_fires(frame(spark, rows), ["mint"], "ts", "price", 1.1, width).collect())
    assert got == want


def test_level_cross(spark):
    rows = series(7)
    rule = rules.level_cross([0.8, 1.5], 10.0, 400, 200)
    want = sorted((k, f["ts"], f["level"]) for k, f in drive(rows, rule, lambda i, t, p: {"id": i, "ts": t, "price": p}))
    got = sorted((r["mint"], r["ts"], r["level"]) for r in al.level_cross(frame(spark, rows), [0.8, 1.5], 10.0, 400, 200, 500).collect())
    assert got == want and want


@pytest.mark.parametrize("retry, width", [(200, 300), (3000, 500)])
def test_incidents(spark, retry, width):
    rows = series(8)
    name = lambda p: "collecting" if p < 1 else "stalled" if p < 2 else "paused" if p < 3 else "stopped"
    want = sorted((f["id"], f["delivery"]) for _, f in drive(rows, rules.incident_transitions(retry), lambda i, t, p: {"id": i, "ts": t, "status": name(p)}))
    d = frame(spark, rows).withColumn("status", F.expr("CASE WHEN price < 1 THEN 'collecting' WHEN price < 2 THEN 'stalled' WHEN price < 3 THEN 'paused' ELSE 'stopped' END"))
    got = sorted((r["id"], r["delivery"]) for r in al.incident_transitions(d, retry, width).collect())
    assert got == want


def test_running_and_segments_cross_chunks(spark):
    rows = series(9)
    got = {r["id"]: (r["gap"], r["segment"]) for r in tl.segments(frame(spark, rows), ["mint"], ["ts", "id"], 150, 333).collect()}
    for key in {r[1] for r in rows}:
        prev, seg = None, 0
        for i, _, t, _ in sorted((r for r in rows if r[1] == key), key=lambda r: r[2]):
            gap = None if prev is None else t - prev
            seg += gap is not None and gap > 150
            assert got[i] == (gap, seg)
            prev = t


def test_sliding_is_independent_of_the_chunk_width(spark):
    d = frame(spark, series(10))
    build = lambda x, w: x.withColumn("v", F.sum("price").over(w.rangeBetween(-500, 200)))
    a = {r["id"]: round(r["v"], 6) for r in tl.sliding(d, ["mint"], "ts", 500, 200, build, 100).collect()}
    z = {r["id"]: round(r["v"], 6) for r in tl.sliding(d, ["mint"], "ts", 500, 200, build, 10**6).collect()}
    assert a == z


@pytest.mark.parametrize("seed, k", [(11, 1), (12, 3)])
def test_nearest_controls(spark, seed, k):
    rng = random.Random(seed)
    # A third of the controls are copies of one point.
    rows = [(i, "b", 1.0 if i % 3 == 0 else round(rng.uniform(0, 3), 2), 1.0 if i % 3 == 0 else round(rng.uniform(0, 3), 2), 0.0) for i in range(300)]
    d = spark.createDataFrame(rows, "id long, b string, x double, y double, z double")
    coords = [("x", 0.5, 1.0), ("y", 0.8, 2.0), ("z", 1.0, 1.0)]
    got = sorted((r["id"], r["r_id"]) for r in jn.nearest_controls(d.filter("id < 60"), d.filter("id >= 60"), ["b"], coords, "id", "id", k, None, []).collect())
    want = []
    for c in rows[:60]:
        near = sorted((abs(c[2] - o[2]) + abs(c[3] - o[3]) / 2, o[0]) for o in rows[60:] if abs(c[2] - o[2]) <= 0.5 and abs(c[3] - o[3]) <= 0.8)
        want += [(c[0], i) for _, i in near[:k]]
    assert got == sorted(want)


@pytest.mark.parametrize("seed", [13, 14])
def test_greedy_pairs(spark, seed):
    rng = random.Random(seed)
    rows = [(i, "b", rng.randrange(1000), round(rng.uniform(0, 2), 3), round(rng.uniform(0, 2), 3)) for i in range(120)]
    d = spark.createDataFrame(rows, "id long, b string, t long, x double, y double")
    coords = [("x", 0.6, 1.0), ("y", 0.6, 1.0), ("t", 400, None)]
    got = sorted((r["id"], r["r_id"]) for r in jn.greedy_pairs(d.filter("id < 60"), d.filter("id >= 60"), ["b"], coords, ["t", "id"], "id", k=2).collect())
    used, want = set(), []
    for c in sorted(rows[:60], key=lambda r: (r[2], r[0])):
        near = [(abs(c[3] - o[3]) + abs(c[4] - o[4]), o[0]) for o in rows[60:]
                if o[0] not in used and abs(c[3] - o[3]) <= 0.6 and abs(c[4] - o[4]) <= 0.6 and abs(c[2] - o[2]) <= 400]
        if near:
            used.add(min(near)[1])
            want.append((c[0], min(near)[1]))
    assert got == sorted(want)


def test_greedy_pairs_of_copies_in_few_rounds(spark, monkeypatch):
    """Forty cases and forty controls at each of three points: taking turns must not cost a round for each copy. Rows with a null or NaN match nothing."""
    rows = [(i, "b", i % 7, float(i % 3) / 4, 1.0) for i in range(240)] + [(240, "b", 0, None, 1.0), (241, None, 0, 0.5, 1.0), (242, "b", 0, math.nan, 1.0)]
    d = spark.createDataFrame(rows, "id long, b string, t long, x double, y double")
    coords = [("x", 0.3, 1.0), ("y", 0.6, 1.0), ("t", 4, None)]
    passes = []
    for name in ("cut_lineage", "written"):
        monkeypatch.setattr(jn, name, lambda df, f=getattr(jn, name): passes.append(1) or f(df))
    cases, controls = d.filter("id % 2 = 0"), d.filter("id % 2 = 1")
    got = sorted((r["id"], r["r_id"], r["distance"]) for r in jn.greedy_pairs(cases, controls, ["b"], coords, ["t", "id"], "id").collect())
    used, want = set(), []
    for c in sorted((r for r in rows[:240] if r[0] % 2 == 0), key=lambda r: (r[2], r[0])):
        near = [(abs(c[3] - o[3]), o[0]) for o in rows[:240] if o[0] % 2 and o[0] not in used and abs(c[3] - o[3]) <= 0.3 and abs(c[2] - o[2]) <= 4]
        if near:
            used.add(min(near)[1])
            want.append((c[0], min(near)[1], min(near)[0]))
    assert got == sorted(want) and len(passes) < 20


def test_greedy_pairs_settle_a_crowd_at_a_border(spark, monkeypatch):
    """A crowd on both sides of a border of tiles, each case displacing others back and forth: not a round for each crossing."""
    rng = random.Random(16)
    rows = [(i, "b", rng.randrange(10**6), rng.uniform(2.6, 3.4)) for i in range(400)]
    d = spark.createDataFrame(rows, "id long, b string, t long, x double")
    passes = []
    for name in ("cut_lineage", "written"):
        monkeypatch.setattr(jn, name, lambda df, f=getattr(jn, name): passes.append(1) or f(df))
    got = sorted((r["id"], r["r_id"]) for r in jn.greedy_pairs(d.filter("id % 2 = 0"), d.filter("id % 2 = 1"), ["b"], [("x", 1.0, 1.0)], ["t", "id"], "id").collect())
    used, want = set(), []
    for c in sorted((r for r in rows if r[0] % 2 == 0), key=lambda r: (r[2], r[0])):
        near = [(abs(c[3] - o[3]), o[0]) for o in rows if o[0] % 2 and o[0] not in used]
        used.add(min(near)[1])
        want.append((c[0], min(near)[1]))
    assert got == sorted(want) and len(passes) <= 14


def test_components(spark):
    rng = random.Random(15)
    edges = [(g, rng.randrange(80), rng.randrange(80)) for g in (1, 2) for _ in range(55)]
    edges += [(3, i, i + 1) for i in range(60)] + [(4, 0, i) for i in range(1, 50)]
    nodes = sorted({(g, x) for g, a, z in edges for x in (a, z)})
    root = {n: n[1] for n in nodes}
    changed = True
    while changed:
        changed = False
        for g, a, z in edges:
            m = min(root[g, a], root[g, z])
            for n in ((g, a), (g, z)):
                if root[n] != m:
                    root[n], changed = m, True
    d = gr.components(spark.createDataFrame(edges, "g int, a int, b int"), spark.createDataFrame(nodes, "g int, node int"), "g")
    assert {(r["g"], r["node"]): r["component"] for r in d.collect()} == root


def test_exact_quantiles(spark):
    rng = np.random.default_rng(16)
    rows = [(int(g), float(v)) for g in (0, 1) for v in np.r_[rng.normal(0, 50, 300), np.full(200, 7.5)]] + [(0, None), (1, float("nan"))]
    got = {r["g"]: r for r in st.distribution(spark.createDataFrame(rows, "g int, v double"), ["g"], "v").collect()}
    for g in (0, 1):
        v = [x for k, x in rows if k == g and x is not None and not math.isnan(x)]
        assert got[g]["missing"] == 1
        for name, q in st.QUARTILES.items():
            assert got[g][name] == pytest.approx(float(np.quantile(v, q)))


def test_logistic_optimum(spark):
    rng = np.random.default_rng(17)
    x = rng.normal(size=(200, 2)) * [3, 0.5] + [1, -2]
    y = (rng.random(200) < 1 / (1 + np.exp(-(x[:, 0] - 1)))).astype(int)
    d = spark.createDataFrame([(float(a), float(c), int(t)) for (a, c), t in zip(x, y)], "a double, c double, y int")
    m = st.fit_logistic(d, ["a", "c"], "y")
    z = np.c_[np.ones(200), (x - x.mean(0)) / x.std(0)]
    w = np.zeros(3)
    for _ in range(20000):
        g = z.T @ (1 / (1 + np.exp(-z @ w)) - y) / 200
        g[1:] += w[1:] / 200
        w -= 0.5 * g
    assert m["coefficients"] == pytest.approx(list(w), abs=1e-3)


def test_archive_stream_never_repeats_a_key(spark, tmp_path):
    from marketlens.streaming import streams as sm

    src = str(tmp_path / "in")
    rows = frame(spark, [(i, i % 3, i * 1000, 1.0) for i in range(200)])
    rows.filter("id < 120").write.parquet(src)
    read = lambda: spark.readStream.schema(rows.schema).parquet(src)
    out, ck = str(tmp_path / "out"), str(tmp_path / "ck")
    sm.archive_stream(read(), out, ck, "ts", 120, 10**6).awaitTermination()
    rows.filter("id >= 100").write.mode("append").parquet(src)
    sm.archive_stream(read(), out, ck, "ts", 120, 10**6).awaitTermination()
    assert spark.read.parquet(out).count() == 200


@pytest.mark.parametrize("rows_a_chunk, most", [(1000, 3), (4, 99)])
def test_sequence_guard_of_thin_keys(spark, monkeypatch, rows_a_chunk, most):
    """Arrivals so far apart that each has a cell of its own: keys of few rows take one round, cut ones as many as agree, with the same rows."""
    from marketlens.operators import features as ft

    rng = random.Random(12)
    rows = [(i * 100, i % 5, 1000 + i * 3 - rng.choice([0, 0, 60]), 1000 + i * 3 - rng.choice([0, 0, 0, 400])) for i in range(150)]
    passes, cut = [], tl.cut_lineage
    monkeypatch.setattr(tl, "cut_lineage", lambda df: passes.append(1) or cut(df))
    monkeypatch.setattr(tl, "CHUNK_ROWS", rows_a_chunk)
    got = sorted(map(tuple, ft.sequence_guard(spark.createDataFrame(rows, "id long, mint long, ts long, source_ts long"), 50).select("id", "sequence_reason").collect()))
    step, state, want = rules.sequence_guard("id"), {}, []
    for i, m, t, s in rows:
        state[m], out = step(state.get(m), {"id": i, "_ts": t, "_source": s})
        want += [(o["id"], o["sequence_reason"]) for o in out]
    assert got == sorted(want) and len({w for _, w in want}) == 3 and len(passes) <= most
