"""Paragraphs, substrings and vector search against brute force, on whole small tables and awkward rows."""

import hashlib
import math
import re
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketlens.llm import queries
from marketlens.llm.paragraphs import MIX, Words, borders, repeated
from marketlens.llm.substrings import Anchors, Meetings, covered, repeats
from marketlens.llm.topk import Search, quantised, top_k
from tests.llm.test_digests import ODD, SCHEMA, SF


@pytest.fixture(scope="module")
def docs(spark):
    return [r.asDict() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


def strip_repeats(rows, length=50):
    """Every string of ``length`` bytes with the smallest id it occurs under."""
    first = {}
    late = math.inf
    for i, t in rows:
        raw, o = (t or "").encode(), late if i is None else i
        for p in range(len(raw) - length + 1):
            s = raw[p : p + length]
            first[s] = min(first.get(s, late), o)
    out = []
    for i, t in rows:
        raw, o = (t or "").encode(), late if i is None else i
        gone = bytearray(len(raw))
        for p in range(len(raw) - length + 1):
            if first[raw[p : p + length]] < o:
                gone[p : p + length] = b"\1" * length
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        out.append((i, len(raw), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return out


def order(rows):
    return sorted(rows, key=repr)


def digest(df):
    return order((r["_id"], r["n_bytes"], sum(b - a for a, b in r["spans"]), len(r["spans"]), r["kept_sha256"]) for r in df.collect())


def test_substrings(spark, docs):
    got = queries.QUERIES["op8_repeated_substrings"](spark, SF).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert order(map(tuple, got)) == order(strip_repeats([(r["doc_id"], r["text"]) for r in docs]))


def test_substrings_odd(spark):
    df = spark.createDataFrame(ODD, SCHEMA)
    assert digest(repeats(df)) == order(strip_repeats([o[:2] for o in ODD]))
    assert repeats(df.limit(0)).count() == 0


@pytest.mark.parametrize("crowd", [20_000, 2])
def test_substrings_random(spark, crowd):
    """Passages pasted into random texts, cut short of the length, over text ends, in runs and inside each other; with and without crowds."""
    rng = np.random.default_rng(8)
    letters = np.array(list("abcd é\n"))
    word = lambda n: "".join(rng.choice(letters, n))
    passages = [word(int(n)) for n in rng.integers(30, 140, 12)] + ["x" * 200, "ab" * 60]
    rows = []
    for i in range(160):
        t = "".join(word(int(rng.integers(0, 40))) + passages[rng.integers(0, len(passages))][: int(rng.integers(20, 200))] for _ in range(int(rng.integers(0, 4))))
        rows.append((int(i // 2 * 2) if i % 7 == 0 else i, t))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert digest(repeats(df, crowd=crowd, chunk=64)) == order(strip_repeats(rows))


def test_anchors_depend_on_bytes_alone():
    a, rng = Anchors(50), np.random.default_rng(1)
    s = rng.integers(0, 4, 50).astype(np.uint8)
    seen = set()
    for _ in range(50):
        before, after = (rng.integers(0, 4, rng.integers(0, 90)).astype(np.uint8) for _ in range(2))
        t = np.concatenate([before, s, after])
        p, h = a.pick(t, np.array([len(t)]))
        inside = (p >= len(before)) & (p <= len(before) + 30)
        assert inside.any()
        seen.add(frozenset(zip((p[inside] - len(before)).tolist(), h[inside].tolist())))
    assert frozenset.intersection(*seen)


def test_covered():
    assert covered(200, 50, 31, np.array([0, 100]), np.array([1, 1])).tolist() == [[0, 50], [100, 150]]
    assert covered(200, 50, 31, np.array([-5, 45]), np.array([1 << 5, 1 << 5])).tolist() == [[0, 100]]


def plain_units(text, least=8, reach=8):
    """The units of a text, word by word: place and words."""
    w = (text or "").lower().split()
    if not w:
        return []
    known, mask = Words(), (1 << 64) - 1
    gap = []
    for a, b in zip(w, w[1:]):
        x = (known[a] * int(MIX) + known[b]) & mask
        x = ((x ^ x >> 31) * int(MIX)) & mask
        gap.append(x ^ x >> 29)
    edges, last = [], 0
    for i, x in enumerate(w, 1):
        if re.search(r"[.!?\u3002\uff01\uff1f][^\w]*$", x):
            if i - last >= least:
                edges.append(i)
            last = i
    while edges and len(w) - edges[-1] < least:
        edges.pop()
    cuts = [0]
    for e in [*edges, len(w)]:
        start = cuts[-1]
        for i in range(start + reach + 1, e - reach):
            around = gap[i - 1 - reach : i + reach]
            if min(around) == gap[i - 1] and around.index(gap[i - 1]) == reach:
                cuts.append(i)
        cuts.append(e)
    return [(i, w[i:j]) for i, j in zip(cuts, cuts[1:])]


def plain_classes(rows):
    """Class (first occurrence and size) of every unit, by comparing all pairs that share a shingle."""
    paras = [(d, n, i, w) for d, t in rows for n, (i, w) in enumerate(plain_units(t))]
    root = list(range(len(paras)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    grams = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for *_, w in paras]
    where = {}
    for i, g in enumerate(grams):
        for s in g:
            where.setdefault(s, []).append(i)
    for i, g in enumerate(grams):
        for j in {j for s in g for j in where[s] if j < i}:
            if len(g & grams[j]) >= 0.8 * len(g | grams[j]):
                root[find(i)] = find(j)
    classes = {}
    for i, (d, n, at, w) in enumerate(paras):
        classes.setdefault(find(i), []).append((d, n, at, len(w)))
    return {x: (min(c)[:2], len(c)) for c in classes.values() if len(c) > 1 for x in c}


def found_classes(df):
    return {(r["doc_id"], r["paragraph"], r["word"], r["n_words"]): ((r["class_doc_id"], r["class_paragraph"]), r["class_size"]) for r in df.collect()}


def test_paragraphs(spark, docs):
    """Every pair of units of similarity 0.8 or more is found: same classes as comparing all pairs, over whole texts."""
    want = plain_classes([(r["doc_id"], r["text"]) for r in docs])
    got = found_classes(queries.QUERIES["op1_paragraph_dedup"](spark, SF))
    assert want and len(set(want) ^ set(got)) <= 0.01 * len(want)
    assert sum(got.get(k) == v for k, v in want.items()) >= 0.99 * len(want)


def test_paragraphs_odd(spark):
    df = spark.createDataFrame(ODD, SCHEMA)
    rows = repeated(df).collect()
    assert {(r["doc_id"], r["class_doc_id"], r["class_size"], r["removed"]) for r in rows} == {(1, 1, 3, False), (3, 1, 3, True), (4, 4, 2, False), (5, 4, 2, True)}
    assert repeated(df.limit(0)).count() == 0


def random_words(rng, n):
    return [f"w{x}" for x in rng.integers(0, 5000, n)]


def test_near_units(spark):
    """Long sentences with a word changed are near copies; many variants of one sentence are one class."""
    rng = np.random.default_rng(17)
    end = lambda w: " ".join(w) + ". "
    base = random_words(rng, 16)
    rows = [(0, end(random_words(rng, 20)) + end(base) + end(random_words(rng, 20)))]
    for i in range(1, 60):
        rows.append((i, end(random_words(rng, 15)) + end([*base[:-1], f"x{i}"] if i % 2 else base) + end(random_words(rng, 18))))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = plain_classes(rows)
    assert found_classes(df := repeated(df)) == want and max(n for _, n in want.values()) >= 30


def test_passage_inside_long_lines(spark):
    """A passage in the middle of long lines, or wrapped into short ones, is found at its place, also with a word changed."""
    rng = np.random.default_rng(11)
    planted = random_words(rng, 90)
    changed = [*planted[:30], "other", *planted[31:]]
    texts = [" ".join([*random_words(rng, 700), *p, *random_words(rng, 900 + i)]) for i, p in enumerate((planted, planted, changed))]
    texts += ["\n".join(" ".join(planted[i : i + 7]) for i in range(0, 90, 7)), " ".join(random_words(rng, 500)), " ".join(random_words(rng, 20_000))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = repeated(df).collect()
    assert {r["doc_id"] for r in rows} == {0, 1, 2, 3}
    assert all(r["word"] < 790 and r["word"] + r["n_words"] > 700 for r in rows if r["doc_id"] < 3)
    assert {r["doc_id"] for r in rows if r["removed"]} == {1, 2, 3}
    assert found_classes(repeated(df)) == plain_classes(list(enumerate(texts)))


def test_passages_of_over_fifty_words_share_a_unit():
    """Of passages of 60 words between other words, nine in ten at least share a whole unit; those of 100 words nearly all."""
    rng = np.random.default_rng(12)
    known = Words()
    for length, least in ((60, 0.9), (100, 0.99)):
        met = 0
        for _ in range(400):
            shared = random_words(rng, length)
            seen = []
            for _ in "ab":
                w = [*random_words(rng, rng.integers(0, 90)), *shared, *random_words(rng, rng.integers(0, 90))]
                e = borders(known.of(w), 8, 8)
                seen.append({tuple(w[i:j]) for i, j in zip(e, e[1:])})
            met += bool(seen[0] & seen[1])
        assert met >= least * 400


def nearest(vectors, asked, k):
    out = []
    for q, v in vectors.items():
        if asked(q):
            s = sorted(((-sum(a * b for a, b in zip(v, w)), i) for i, w in vectors.items() if i != q and len(w) == len(v)))[:k]
            out += [(q, n + 1, i, -x) for n, (x, i) in enumerate(s)]
    return order(out)


def test_search_odd(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(size=6) * rng.choice([0.1, 1, 5])], "x") for i in range(150)]
    rows += [(200 + i, [1.0, 0.5, -0.25, 0.0, 2.0, 1.0], "hot") for i in range(60)]
    rows += [(300, None, "n"), (301, [1.0, None, 0.0, 0.0, 0.0, 0.0], "n"), (302, [float("nan")] * 6, "n"), (303, [float("inf")] + [0.0] * 5, "n"), (None, [1.0] * 6, "n"), (304, [0.0] * 6, "z"), (305, [1.0, 2.0], "d"), (306, [1.0, 3.0], "d"), (307, [], "d"), (200, [1.0, 0.5, -0.25, 0.0, 2.0, 1.0], "again")]
    df = spark.createDataFrame(rows, T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.DoubleType())), T.StructField("query_id", T.StringType())]))
    vectors = {i: [math.floor(64 * x) for x in v] for i, v, _ in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    for k in (3, 20):
        got = top_k(quantised(df), F.col("_id") % 5 == 0, k, block=16, bucket=8).collect()
        assert order(map(tuple, got)) == nearest(vectors, lambda i: i % 5 == 0, k)
    assert top_k(quantised(df.limit(0)), F.col("_id") % 5 == 0).count() == 0


def test_search_keeps_every_vector_of_an_id(spark):
    """Rows that share an id but not the vector all count, as in the SQL: no row meets its own id, ranks are per id."""
    rng = np.random.default_rng(5)
    rows = [(int(i), [float(x) for x in rng.integers(-9, 9, 4) * 5.0]) for i in np.repeat(np.arange(40), 3)]
    rows += [(5, [50.0 + i, 40.0, 30.0, 20.0]) for i in range(12)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    vectors = sorted({(i, tuple(math.floor(64 * x) for x in v)) for i, v in rows})
    want = []
    for q in range(0, 40, 5):
        s = sorted((-sum(a * b for a, b in zip(v, w)), i) for j, v in vectors if j == q for i, w in vectors if i != q)[:6]
        want += [(q, n + 1, i, -x) for n, (x, i) in enumerate(s)]
    got = top_k(quantised(df), F.col("_id") % 5 == 0, 6, block=16, bucket=16, spread=0.5).collect()
    assert order(map(tuple, got)) == order(want)


def test_search_prunes_exactly():
    """Both prunings, on clustered vectors where high cosines make coordinates select."""
    rng = np.random.default_rng(4)
    base = rng.normal(size=(20, 16)) * 60
    v = np.concatenate([np.round(b + rng.normal(size=(40, 16)) * 3) for b in base]).astype(np.int64)
    v = v[np.argsort(-(v ** 2).sum(1), kind="stable")]
    s = Search(np.arange(0, 800, 5), v[::5], 10)
    for i in range(0, 800, 50):
        s.feed(np.arange(i, i + 50), v[i : i + 50])
    score = v[::5] @ v.T
    for n, q in enumerate(range(0, 800, 5)):
        want = sorted((-int(x), i) for i, x in enumerate(score[n]) if i != q)[:10]
        mine = s.best[0] == n
        assert [(-int(a), int(b)) for a, b in zip(s.best[2][mine], s.best[1][mine])] == want


def test_substring_tables_are_thin(spark, monkeypatch):
    """Bytes of all tables a run writes, by bytes of text: 1.43 when every place of a shared anchor carried its bytes, 0.77 so."""
    monkeypatch.setattr("marketlens.llm.substrings.finished", lambda *_: None)
    df = spark.read.parquet(f"{SF}/documents.parquet")
    folder = Path(spark.conf.get("spark.checkpoint.dir"))
    known = set(folder.glob("substring-*"))
    repeats(df).count()
    written = sum(p.stat().st_size for d in set(folder.glob("substring-*")) - known for p in d.rglob("*.parquet"))
    assert written < 1.1 * df.agg(F.sum(F.octet_length("text"))).first()[0]


@pytest.mark.parametrize("hold", [1, 7, 10_000])
def test_meetings_in_pieces(hold):
    """Places that an earlier text has in their whole context, and anchors that need comparing, however the rows are cut."""
    rng = np.random.default_rng(3)
    n = 600
    a, k, o = rng.integers(-40, 40, n) ** 3 // 900, rng.integers(0, 4, n), rng.integers(0, 6, n)
    a[:80] = 5
    at = np.lexsort((o, k, a))
    rows = [a[at], k[at], o[at], np.arange(n), np.arange(n, dtype=np.int32)]
    m, out = Meetings(hold), []
    for i in range(0, n, 11):
        out += m.add([x[i : i + 11] for x in rows])
    out += m.rest()
    got = {d: (x, late) for b in out for x, d, late in zip(*(b.column(c).to_pylist() for c in ("_a", "_d", "_later")))}
    for i, (x, c, age) in enumerate(zip(*rows[:3])):
        same = rows[0] == x
        if age > rows[2][same & (rows[1] == c)].min():
            assert got[i] == (0, True)
        elif len(set(rows[1][same])) > 1 and len(set(rows[2][same])) > 1:
            assert got[i] == (x, False)
        else:  # a long anchor is compared in any case
            assert i not in got or (same.sum() > hold and got[i] == (x, False))


def test_words_in_use_are_hashed_once():
    """A full memory gives up what is not asked for, so words of every text are not hashed anew."""
    known, often = Words(50), ["to", "be", "or", "not."]
    for i in range(200):
        known.of([*often, *(f"{i}x{k}" for k in range(10))])
        assert all(w in known or w in known.old for w in often)
    assert len(known) + len(known.old) <= 100


def test_borders_are_those_of_windows():
    """The gap that hashes lowest among ``reach`` on both sides, in stretches of any length, ties to the first."""
    rng = np.random.default_rng(4)
    for i in range(300):
        h = rng.integers(0, 1 << int(rng.choice([2, 6, 60])), int(rng.integers(1, 90))).astype(np.uint64) & ~np.uint64(1) | (rng.random(1) < 0).astype(np.uint64)
        h[rng.random(len(h)) < 0.05] |= np.uint64(1)
        edges = [e + 1 for e in np.flatnonzero(h & np.uint64(1)).tolist()]
        kept = [e for e, before in zip(edges, [0, *edges]) if e - before >= 4]
        while kept and len(h) - kept[-1] < 4:
            kept.pop()
        want = {0, *kept, len(h)}
        for a, b in zip([0, *kept], [*kept, len(h)]):
            gap = [int((x ^ (x >> 31)) * int(MIX) % 2**64) for x in ((int(u) * int(MIX) + int(v)) % 2**64 for u, v in zip(h[a : b - 1], h[a + 1 : b]))]
            gap = [x ^ (x >> 29) for x in gap]
            want |= {a + c + 1 for c in range(3, len(gap) - 3) if min(range(c - 3, c + 4), key=gap.__getitem__) == c}
        assert borders(h, 4, 3) == sorted(want)
