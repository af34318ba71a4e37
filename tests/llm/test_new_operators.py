"""Conversation repair, whitening and benchmark passages against brute force, and on awkward rows."""

import hashlib
import itertools
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketlens.llm import decontamination, queries, repair, whitening
from marketlens.llm.fmindex import Cutter, Index, Phrases, build, codes, suffix_order
from tests.llm.test_digests import ODD, SCHEMA, SF

SPACE = "\t\n\x0b\x0c\r "
TURNS = "conv_id long, turn long, role string, text string, part string"


def plain_repair(rows):
    """Every string of edits by plain search over (row, ending), whole strings compared. ``rows`` are (role, text) in order."""
    seen, faults = set(), []
    for r in rows:
        core = r[1].strip(SPACE)
        faults.append("blank" if not core else "duplicate" if r in seen else "truncated" if core[-1] not in ".!?" else "")
        seen.add(r)
    after = {"": "u", "s": "u", "u": "a", "a": "u"}
    best = {"": (0, "", ())}

    def inserted(cells):
        for q in ("", "s", "a", "u"):  # two insertions at most pay
            if q in cells:
                c, a, out = cells[q]
                new = (c + 2, a + "I", (*out, ("user" if after[q] == "u" else "assistant", "")))
                cells[after[q]] = min(cells.get(after[q], new), new)
        if "u" in cells:
            c, a, out = cells["u"]
            new = (c + 2, a + "I", (*out, ("assistant", "")))
            cells["a"] = min(cells.get("a", new), new)
        return cells

    best = inserted(best)
    for (role, text), bad in zip(rows, faults):
        new = {}

        def offer(q, cell):
            new[q] = min(new.get(q, cell), cell)

        for q, (c, a, out) in best.items():
            offer(q, (c + 3, a + "D", out))
            if bad in ("blank", "duplicate"):
                continue
            late = bad == "truncated"
            offer(after[q], (c + 2 + late, a + "R", (*out, ("user" if after[q] == "u" else "assistant", text))))
            if role[:1] == after[q] or (q == "" and role[:1] == "s"):
                offer(role[:1], (c + late, a + "K", (*out, (role, text))))
        best = inserted(new)
    cost, audit, out = min(best[q] for q in ("", "a") if q in best)
    letters = [r[0][:1] for r in rows]
    return {"blank": faults.count("blank"), "duplicate": faults.count("duplicate"), "truncated": faults.count("truncated"), "illegal": sum(x + y not in ("su", "ua", "au") for x, y in zip(letters, letters[1:])),
            "cost": cost, "audit": audit, "repaired_sha256": hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()}


def summaries(frames):
    whole, cut = frames
    return {r["_conv"]: r.asDict() for r in repair.summary(whole, True).unionByName(repair.summary(cut, False)).collect()}


def in_order(rows):
    return [(r or " ", t or " ") for _, r, t in sorted(((-1 if n is None else n, r or " ", t or " ") for n, r, t in rows), key=lambda x: x)]


def test_audit_order():
    rng = np.random.default_rng(3)
    root = repair.Audit(None, "")
    chains = [root]
    for _ in range(400):
        chains.append(repair.Audit(chains[rng.integers(len(chains))], "DIKR"[rng.integers(2)] * int(rng.integers(1, 4))))
    chains.append(repair.Audit(None, chains[-1].text() + "K"))
    for a, b in itertools.islice(itertools.permutations(chains[::7], 2), 3000):
        assert repair.before(a, b) == (a.text() < b.text())
        assert all(a.prefix(n) == repair.roll(0, a.text()[:n]) for n in (0, a.length // 2, a.length))


def test_audit_collisions(monkeypatch):
    """With a hash that always collides the letters still decide."""
    monkeypatch.setattr(repair, "roll", lambda h, piece: 0)
    a, b = repair.Audit(repair.Audit(None, "KD"), "K"), repair.Audit(repair.Audit(None, "KK"), "D")
    assert repair.before(a, b) and not repair.before(b, a)


@pytest.mark.parametrize("most", [3, 4096])
def test_repair_brute(spark, most):
    rng = np.random.default_rng(most)
    texts, roles = ["Hi.", "Hi", "", " \n", "Yes!", "No?", "é", "a.\t"], ["system", "user", "assistant", "tool", None]
    rows = [(int(c), int(t), roles[rng.choice(5, p=[.1, .4, .35, .1, .05])], texts[rng.integers(8)] + ("" if rng.random() < .4 else f"{rng.integers(99)}."), "x") for c in range(60) for t in range(rng.integers(1, 14))]
    rows += [(99, t, "user" if t % 3 else "assistant", f"line {t % 200}.", "x") for t in range(500)]
    got = summaries(repair.repair(spark.createDataFrame(rows, TURNS).repartition(5), most_rows=most))
    for c in {r[0] for r in rows}:
        want = plain_repair(in_order([r[1:4] for r in rows if r[0] == c]))
        assert {k: got[c][k] for k in want} == want, c
        assert got[c]["gaps"] == 0


def test_repair_odd(spark):
    long = "word " * 250_000 + "end."
    rows = [(None, None, None, None, None), (None, 1, "user", "Q.", None), (1, 3, "user", "Q.", "p"), (1, 3, "user", "Q.", "p"), (1, None, "system", "S.", "p"), (1, 9, "assistant", long, "p"), (2, 1, "user", " ", "p")]
    got = summaries(repair.repair(spark.createDataFrame(rows, TURNS)))
    assert got[1]["audit"] == "KKDK" and got[1]["cost"] == 3 and got[1]["gaps"] == 5 and got[1]["duplicate"] == 1
    assert got[1]["repaired_sha256"] == hashlib.sha256(f"system:S.\nuser:Q.\nassistant:{long}".encode()).hexdigest()
    assert got[None]["audit"] == "DKI" and got[None]["gaps"] == 0 and got[2]["audit"] == "D" and got[2]["repaired_sha256"] == hashlib.sha256(b"").hexdigest()
    assert summaries(repair.repair(spark.createDataFrame([], TURNS))) == {}
    real = repair.repair(spark.createDataFrame(rows, TURNS))
    assert ("user", "Q.") in [(x["role"], x["text"]) for f in real for r in f.collect() for x in r["repaired"]]


def test_repair_query(spark):
    """Every conversation of the whole table, dropped ones too; its damage by the CRC rule."""
    table = spark.read.parquet(f"{SF}/conversations.parquet").collect()
    damaged = {}
    for r in table:
        held = damaged.setdefault(r["conv_id"], [])
        k, role, text = zlib.crc32(f"{r['conv_id']}:{r['turn']}".encode()) % 20, r["role"] or " ", r["text"] or " "
        role, text = ("user" if k == 4 else role), ("" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text)
        held += [(r["turn"], role, text)] * (0 if k == 0 else 2 if k == 3 else 1)
    got = {r["conv_id"]: r.asDict() for r in queries.QUERIES["op11_conversation_repair"](spark, SF).collect()}
    assert set(got) == set(damaged)
    for c, rows in damaged.items():
        want = plain_repair(in_order(rows))
        assert {k: got[c][k] for k in want} == want


def test_whitening_brute(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    x = np.floor(1024 * np.array([r["embedding"] for r in table], float)).astype(np.int64) + 100_000
    n, s = len(x), x.sum(0)
    c = x - s / n
    values, vectors = np.linalg.eigh(c.T @ c / n)
    at = {r["vec_id"]: i for i, r in enumerate(table)}
    rows = queries.QUERIES["op12_whitened_embeddings"](spark, SF).collect()
    assert len(rows) == 8 * n
    z = np.zeros((n, 8))
    for r in rows:
        z[at[r["vec_id"]], r["component"] - 1] = r["whitened"]
        assert r["n"] == n and r["deviation"] == int(((n * x[at[r["vec_id"]]] - s) ** 2).sum())
        assert abs(r["explained"] / (values[-r["component"]] / values.sum()) - 1) < 1e-9 and r["identity_error"] < 1e-9
    want = c @ vectors[:, ::-1][:, :8] / np.sqrt(values[::-1][:8])
    assert np.abs(z * np.sign((z * want).sum(0)) - want).max() < 1e-9


def test_whitening_odd(spark):
    kind = "vec_id long, embedding array<double>, component int, n string"
    rows = [(1, [1.0, None]), (2, None), (3, [float("nan"), 1.0]), (4, [1.0, 2.0]), (None, [2.0, 1.0]), (4, [1.0, 2.0]), (7, []), (8, [1.0, float("inf")]), (9, [1.0, 2.0, 3.0])]
    df = spark.createDataFrame([(*r, 5, "x") for r in rows], kind)
    got = whitening.whitened(df).collect()
    assert sorted((r["_id"] or 0, r["component"], round(abs(r["whitened"]), 9)) for r in got) == [(0, 1, round(2**0.5, 9)), (4, 1, round(0.5**0.5, 9)), (4, 1, round(0.5**0.5, 9))]
    assert whitening.whitened(df.filter("vec_id = 4")).collect() == [] and whitening.whitened(df.filter("false")).collect() == []
    far = spark.createDataFrame([(i, [float(2**40 + i), float(i % 3)]) for i in range(9)], "vec_id long, embedding array<double>")
    assert {r["component"] for r in whitening.whitened(far).collect()} == {1, 2}


def test_factor():
    rng = np.random.default_rng(5)
    for d, r in ((1, 1), (6, 6), (9, 4), (5, 0)):
        a = rng.normal(size=(d, r)) @ np.diag(10.0 ** -np.arange(r))
        lower, _ = whitening.factor(a @ a.T)
        values, vectors = whitening.rotate(lower)
        assert np.allclose(vectors @ np.diag(values) @ vectors.T, a @ a.T, atol=1e-12) and np.allclose(vectors.T @ vectors, np.eye(len(values)), atol=1e-6)


def words_of(text):
    return [w.encode() for w in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))]


def plain_passages(docs, items, length):
    phrases = {}
    for i, t in items:
        w = words_of(t)
        for k in range(max(1, len(w) - length + 1) if w else 0):
            phrases.setdefault(tuple(w[k : k + length]), set()).add("" if i is None else str(i))
    out = []
    for i, t in docs:
        w, hit, found = words_of(t), set(), set()
        for n in {len(p) for p in phrases}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in phrases:
                    hit |= set(range(k, k + n))
                    found |= phrases[tuple(w[k : k + n])]
        out.append((i, len(w), len(hit), tuple(sorted(found))))
    return sorted(out, key=repr)


def told(df):
    return sorted(((r["doc"]["doc_id"], r["n_words"], sum(x["last"] - x["first"] for x in r["runs"]), tuple(sorted(r["items"]))) for r in df.collect()), key=repr)


def test_suffix_order_and_index():
    rng = np.random.default_rng(2)
    for n, k in ((1, 1), (2, 1), (50, 2), (300, 3)):
        t = np.concatenate([x := rng.integers(0, k, n), x])
        assert suffix_order(t).tolist() == sorted(range(len(t)), key=lambda i: t[i:].tolist())
    vocabulary = ["a", "b", "ab", "É", "é", "x1"]
    texts = [" ".join(vocabulary[i] for i in rng.integers(0, 6, m)) + "." for m in rng.integers(0, 60, 30)]
    raw = [t.encode() for t in texts]
    index = Index(build(raw, Cutter()))
    phrases = sorted({b" ".join(words_of(t)[k : k + n]) for t in texts for n in (1, 2, 5) for k in range(len(words_of(t)) - n + 1)}) + [b"b b b b b b b b", b"zz"]
    p, at, size = Phrases(phrases).hits(index)
    got = sorted(zip(p.tolist(), at.tolist()))
    line = [w for t in texts for w in [*words_of(t), None]]
    assert got == sorted((k, i) for k, q in enumerate(phrases) for i in range(len(line)) if line[i : i + q.count(b" ") + 1] == q.split(b" "))


def test_codes_with_colliding_hashes():
    low = np.frombuffer(b"aa\0bb\0aa\0c", np.uint8)
    start, end = np.array([0, 3, 6, 9]), np.array([2, 5, 8, 10])
    _, first, code = codes(low, start, end, np.full(4, 7, np.uint64))
    assert code[0] == code[2] and len(set(code.tolist())) == 3 and len(first) == 3


@pytest.mark.parametrize("block", [1 << 16, 5])
def test_passages_brute(spark, block):
    docs = [(i, t) for i, t in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    if block == 5:
        docs, items = docs[:40], [(1, "one two"), (2, "two"), (3, "one two")]
        docs.append((77, "One two, THREE two"))
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    found = decontamination.find(d, spark.createDataFrame(items, "item_id long, text string"), block=2 if block == 5 else block, shard_bytes=1 << 16, carry=["doc_id"])
    assert told(found) == plain_passages(docs, items, 10)


def test_passages_odd(spark):
    extra = [(50, "x " * 400_000 + "one two three four five six SEVEN", "en", "s", 1, "k"), (51, "alpha; Beta\ngamma", "en", "s", 1, "k")]
    df = spark.createDataFrame([*ODD, *extra], SCHEMA).withColumn("n_words", F.lit(1)).withColumn("doc", F.lit(2))
    items = [(1, "one two three four five six one two three four five"), (None, "beta gamma"), (None, "12"), (3, None), (4, "--"), (5, "Beta gamma"), (5, "é")]
    bench = spark.createDataFrame([(*i, "x") for i in items], "item_id long, text string, phrase string")
    got = decontamination.find(df, bench)
    assert told(got) == plain_passages([(r[0], r[1]) for r in [*ODD, *extra]], items, 10)
    row = got.filter("doc.doc_id = 51").first()
    assert [(x["start"], x["end"]) for x in row["runs"]] == [(7, 17)] and row["doc"]["n_words"] == 1 and row["doc"]["text"] == "alpha; Beta\ngamma"
    assert told(decontamination.find(df, bench.filter("false"))) == plain_passages([(r[0], r[1]) for r in [*ODD, *extra]], [], 10)
    assert decontamination.find(df.filter("false"), bench).collect() == []
