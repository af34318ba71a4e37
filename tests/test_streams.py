"""Keyed streams by event time: any cut of the source gives the same output, late rows come out as late, timers end what is over."""

import random

import pytest

from marketlens.streaming import rules
from marketlens.streaming import streams as sm

SNAP = "id long, mint long, ts long, price double"


def files(spark, path, schema, parts):
    """One file for each part, in that order of time; a stream reads one a micro-batch."""
    import os
    import time
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{path}/{i:03}")
        for f in os.listdir(f"{path}/{i:03}"):
            os.utime(f"{path}/{i:03}/{f}", (time.time() - 10_000 + i * 10,) * 2)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(path))


def sample(seed=4, n=240):
    rng = random.Random(seed)
    return [(i, i % 3, 1000 + i * 20, round(100 * (1 + rng.random() * (3 if i % 17 == 0 else .2)), 2)) for i in range(n)]


def cut(rows, k, shuffle=0, seed=1):
    """``k`` parts in order; rows move by at most ``shuffle`` places before the cut."""
    rng = random.Random(seed)
    rows = [r for _, r in sorted((i + rng.uniform(0, shuffle), r) for i, r in enumerate(rows))]
    size = -(-len(rows) // k)
    return [rows[i : i + size] for i in range(0, len(rows), size)]


def fired(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("parts,shuffle", [(5, 8), (24, 8), (24, 0)])
def test_any_cut_gives_the_same(spark, tmp_path, parts, shuffle):
    rule = rules.movement_alarm(lambda r: 30.0, 300, 200, 500, 600)
    state, want = {}, []
    for r in sample():
        state[r[1]], out = rule(state.get(r[1]), dict(zip(("id", "mint", "ts", "price"), r)))
        want += [(o["id"], r[1], o["ts"], o["move_pct"], None) for o in out]
    stream = files(spark, tmp_path, SNAP, cut(sample(), parts, shuffle))
    got = fired(sm.run_rule(stream, ["mint"], rule, "id long, mint long, ts long, move_pct double", f"cut{parts}-{shuffle}", delay=20 * 2 * (shuffle + 1)))
    assert len(want) > 3 and got == sorted(want, key=repr)


def test_late_rows_come_out(spark, tmp_path):
    rows = sample()
    parts = cut(rows, 4)
    late = (999, 0, 1001, 5.0)
    parts[3] = [late, *parts[3]]
    rule = rules.movement_alarm(lambda r: 30.0, 300, 200, 500, 600)
    got = sm.run_rule(files(spark, tmp_path, SNAP, parts), ["mint"], rule, "id long, mint long, ts long, move_pct double", "late", delay=40).collect()
    assert [(r["id"], r["mint"], r["ts"], r["reason"]) for r in got if r["reason"]] == [(999, 0, 1001, "late")]


def test_failed_delivery_waits_for_the_retry(spark, tmp_path):
    """Four micro-batches; the message of 300 fails, that of 360 arrives: 330 waits, 420 is silenced."""
    schema = "id long, mint long, ts long, price double, attempt long, ok boolean"
    prices = [(1, 0, 100.0), (2, 300, 200.0), (3, 330, 210.0), (4, 360, 220.0), (5, 420, 230.0), (6, 800, 900.0)]
    told = {2: False, 3: True, 4: True, 5: True, 6: True}
    parts = [[(i, 7, t, p, None, None)] + ([(i, 7, t + 10, None, i, told[i])] if i in told else []) for i, t, p in prices]
    rule = rules.movement_alarm_with_delivery(lambda r: 30.0, 300, 200, 500, 400, 60)
    got = sm.run_rule(files(spark, tmp_path, schema, [parts[0] + parts[1], parts[2], parts[3] + parts[4], parts[5]]), ["mint"], rule, "id long, mint long, ts long, move_pct double", "delivery", delay=20)
    assert sorted(r["id"] for r in got.collect()) == [2, 4, 6]


@pytest.mark.parametrize("parts", [1, 5])
def test_every_case_has_one_row_a_horizon(spark, tmp_path, parts):
    schema = "id long, mint long, ts long, entry double, mc double"
    rng = random.Random(9)
    rows = sorted([(i, rng.randrange(4), rng.randrange(5000), 10.0, None) for i in range(40)] + [(100 + i, rng.randrange(5), rng.randrange(9000), None, rng.choice([5.0, 20.0, None])) for i in range(60)], key=lambda r: r[2])
    want = []
    for i, m, t, e, mc in rows:
        for h in (600, 2000) if e is not None else ():
            seen = sorted((r[2], r[0], r[4]) for r in rows if r[1] == m and r[4] is not None and t + h <= r[2] <= t + h + 150)
            want.append((i, m, h, "OBSERVED", seen[0][0], seen[0][2] / e) if seen else (i, m, h, "EXPIRED", None, None))
    d = sm.run_rule(files(spark, tmp_path, schema, cut(rows, parts)), ["mint"], sm.track_outcomes([600, 2000], 150), "id long, mint long, horizon long, status string, seen long, multiple double", f"outcomes{parts}", delay=10)
    assert fired(d.drop("reason")) == sorted(want, key=repr)
    assert {r[3] for r in want} == {"OBSERVED", "EXPIRED"}


def test_idle_state_goes(spark, tmp_path):
    """A counter that starts anew once its key has been silent for long."""
    count = lambda s, r: ((s or 0) + 1, [{"id": r["id"], "n": (s or 0) + 1}])
    rows = [[(1, 1, 100, 0.0), (2, 1, 110, 0.0)], [(3, 2, 5000, 0.0)], [(4, 2, 5001, 0.0)], [(5, 1, 6000, 0.0)]]
    d = files(spark, tmp_path, SNAP, rows)
    closing = sm.clock(spark)
    out = sm.run_available(sm.keyed_rule(d, ["mint"], count, "id long, mint long, n long", closing=closing, idle=1000), "idle", closing=closing)
    assert sorted((r["id"], r["n"]) for r in out.collect()) == [(1, 1), (2, 2), (3, 1), (4, 2), (5, 1)]


@pytest.mark.parametrize("slots", [1, 4])
def test_keys_share_records_of_state(spark, tmp_path, monkeypatch, slots):
    """Sixty keys in a few records: the rows of one record a key, whatever the cut, late rows and missing prices included; no call and no record for each key."""
    rng = random.Random(3)
    rows = [(i, i % 60, 1000 + i * 5, None if i % 50 == 0 else round(100 * rng.uniform(0.5, 3), 2)) for i in range(600)]
    parts = cut(rows, 6, 4)
    parts[5] = [(9999, 7, 1001, 5.0), *parts[5]]
    rule = lambda s, r: ((r["price"] if r["price"] is not None else s), [{"id": r["id"], "ts": r["ts"], "was": s}] if r["id"] % 3 else [])
    output, state, want = "id long, mint long, ts long, was double", {}, [(9999, 7, 1001, None, "late")]
    for i, m, t, p in rows:
        if i % 3:
            want.append((i, m, t, state.get(m), None))
        state[m] = p if p is not None else state.get(m)
    monkeypatch.setattr(sm, "SLOTS", slots)
    monkeypatch.setattr(sm, "work_path", lambda spark, name: str(tmp_path / "work" / name))
    got = fired(sm.run_rule(files(spark, tmp_path / "in", SNAP, parts), ["mint"], rule, output, "slots", delay=40))
    assert got == sorted(want, key=repr)
    assert 0 < spark.read.format("statestore").load(str(tmp_path / "work" / "slots" / "state")).count() <= slots
