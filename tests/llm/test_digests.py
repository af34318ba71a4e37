"""Brute-force versions of the queries over whole tables, and small frames with every awkward row."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tokenizers
import xxhash
from pyspark.sql import types as T

from marketlens.llm import bpe, language, queries, tokenfile
from marketlens.llm.exact_dedup import refine
from marketlens.llm.mixing import mix
from marketlens.llm.sharding import shard
from marketlens.llm.simhash import near_duplicates

SF = "/root/testdata/sf0.001"
SPACE = re.compile(r"[\x20\x09-\x0D]+")
ODD = [(1, "a b", "en", "s1", 5, "x"), (1, "a b", "en", "s1", 5, "x"), (2, None, None, None, None, None), (None, "", None, "s2", 0, "k"), (None, None, None, None, None, "k"),
       (3, "a \n\tb", "en", "s1", 5, "x"), (4, "one two three four five six " * 3000, "fr", "s2", 1, "x"), (5, "one two three four five six " * 3000, "fr", "s2", 1, "x"),
       (6, " \t ", "de", "s3", 1, ""), (7, "12 34 <|endoftext|> é", "de", "s3", 1, ""), (8, "日本 العربية \U0001f600 x\x85y", None, "", 3, "z"), (9, "a", "en", "s1", 1, "x"), (9, "b", "en", "s1", 1, "x")]
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                       T.StructField("n_chars", T.LongType()), T.StructField("keep_id", T.StringType())])


@pytest.fixture(scope="module")
def table(spark):
    return [r.asDict() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df):
    return {r["doc_id"]: r.asDict() for r in df.collect()}


def check_shards(rows, texts, k=8):
    total, sums, groups = 0, Counter(), defaultdict(set)
    sizes = Counter()
    for r in rows:
        t = texts[r["doc_id"]] or ""
        assert r["size"] == len(t.encode()) + 1 and r["text_crc32"] == zlib.crc32(t.encode())
        sums[r["shard"]] += r["size"]
        groups[t].add(r["shard"])
        sizes[t] += r["size"]
        total += r["size"]
    assert all(len(g) == 1 for g in groups.values()) and set(sums) <= set(range(k))
    order = sorted(sizes, key=lambda t: hashlib.sha256(t.encode()).digest())
    low, high = max(-(-total // k), max(sizes.values())), total
    while low < high:  # plain bisection with a greedy walk
        mid, used, held = (low + high) // 2, 1, 0
        for t in order:
            used, held = (used + 1, sizes[t]) if held + sizes[t] > mid else (used, held + sizes[t])
        low, high = (low, mid) if used <= k else (mid + 1, high)
    assert max(sums.values()) == low
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_shards(spark, table, odd, empty):
    check_shards(queries.QUERIES["op2_minimax_shards"](spark, SF).collect(), {r["doc_id"]: r["text"] for r in table})
    rows = shard(odd, 3).collect()
    assert len(rows) == len(ODD) and sum(r["size"] for r in rows) == sum(len((o[1] or "").encode()) + 1 for o in ODD)
    assert shard(empty).count() == 0


def test_mix_odd(odd, empty):
    rows = mix(odd, carry=["doc_id", "source", "text"]).collect()
    assert len(rows) == len(ODD)
    per = defaultdict(lambda: [0, 0, 0.0])
    for r in rows:
        assert r["size"] == len([w for w in SPACE.split(r["doc"]["text"] or "") if w]) and 0 <= r["taken"] <= 3 * r["size"]
        p = per[r["doc"]["source"]]
        p[0], p[1], p[2] = p[0] + r["size"], p[1] + r["taken"], r["target"]
    total = sum(p[0] for p in per.values())
    assert abs(sum(p[2] for p in per.values()) - total) < 1e-6 * total
    assert all(p[2] <= 3 * p[0] + 1e-9 for p in per.values())
    assert mix(empty).count() == 0


def test_mix_level():
    """Targets of the reshared excess, by hand: weights 5, 2, 1 over sizes 10, 100, 100."""
    caps, w, total = [30, 300, 300], [5, 2, 1], 210
    targets = [30, (210 - 30) * 2 / 3, (210 - 30) / 3]
    assert sum(targets) == total and all(t <= c for t, c in zip(targets, caps))


def test_exact(odd, empty):
    rows = refine(odd, digest=True).collect()
    norm = [SPACE.sub(" ", o[1] or "") for o in ODD]
    groups = defaultdict(list)
    for o, n in zip(ODD, norm):
        groups[n].append(o[0])
    assert len(rows) == len(ODD)
    assert sum(r["kept"] for r in rows) == len(groups)
    for r in rows:
        text = SPACE.sub(" ", r["doc"]["text"] or "")
        ids = groups[text]
        assert r["group_size"] == len(ids) and r["text_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert r["keep_id"] == min((i for i in ids if i is not None), default=None)
    assert refine(empty).count() == 0


def simhash(text):
    words = [w for w in SPACE.split("".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h)) if h else 0


def near(ids, prints):
    """Components by comparing all pairs."""
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                root[find(i)] = find(j)
    low = {}
    for i, d in enumerate(ids):
        low[find(i)] = min((x for x in (d, low.get(find(i))) if x is not None), default=None)
    return [low[find(i)] for i in range(len(ids))]


def test_simhash(spark, table, odd, empty):
    got = by_id(queries.QUERIES["op7_simhash_near_dedup"](spark, SF))
    prints = [simhash(r["text"]) for r in table]
    assert len(got) == len(table)
    for r, p, c in zip(table, prints, near([r["doc_id"] for r in table], prints)):
        assert got[r["doc_id"]]["fingerprint"] == f"{p:016x}" and got[r["doc_id"]]["component_id"] == c
    rows = near_duplicates(odd).collect()
    want = near([o[0] for o in ODD], [simhash(o[1]) for o in ODD])
    assert Counter(r["component_id"] for r in rows) == Counter(want) and sum(r["kept"] for r in rows) == len(set(simhash(o[1]) for o in ODD))
    assert near_duplicates(empty).count() == 0


def test_simhash_crowds(spark):
    """Random clusters of fingerprints, with keys above and below the crowd."""
    from pyspark.sql import functions as F

    from marketlens.llm.simhash import links
    from marketlens.operators.graph import components

    rng = np.random.default_rng(3)
    prints = set()
    for _ in range(12):
        base = int(rng.integers(0, 1 << 62))
        for _ in range(40):
            x = base
            for b in rng.choice(64 if rng.random() < 0.3 else 9, rng.integers(0, 5), replace=False):
                x ^= 1 << int(b)
            prints.add(x)
    signed = [x - (1 << 64) if x >> 63 else x for x in sorted(prints)]
    want = {p: c for p, c in zip(signed, near(signed, sorted(prints)))}
    df = spark.createDataFrame([(x,) for x in signed], "_f long")
    for crowd in (4, 1000):
        e = links(df, crowd)[0].distinct().withColumn("_g", F.lit(0))
        nodes = e.select("_g", F.col("a").alias("_f")).union(e.select("_g", F.col("b").alias("_f"))).distinct()
        got = {r["_f"]: r["component"] for r in components(e, nodes, "_g", node="_f").collect()}
        assert all(got.get(p, p) == c for p, c in want.items())


def test_language(spark, table, odd, empty):
    rows = queries.QUERIES["op5_language_codes"](spark, SF).collect()
    assert len(rows) == len(table)
    truth = {r["doc_id"]: r["lang"] for r in table}
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1 for r in rows)
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) >= 0.97 * len(held)
    model = language.train(odd.select("text", "lang"))
    got = {(r["doc"]["doc_id"], r["doc"]["text"]): r["guess"] for r in language.identify(odd, model).collect()}
    assert got[2, None]["lang"] == "und" and got[6, " \t "]["lang"] == "und" and got[9, "a"]["lang"] == "en"
    none = language.train(empty.select("text", "lang"))
    assert language.identify(odd, none).filter("guess.lang <> 'und'").count() == 0 and language.identify(empty, model).count() == 0


def test_gram_counts_pieces(monkeypatch):
    text = "une phrase assez longue pour plusieurs morceaux, é à ç " * 40
    whole = language.gram_counts(text, 256)
    monkeypatch.setattr(language, "PIECE", 64)
    assert (language.gram_counts(text, 256) == whole).all()


def test_code_words():
    for n in (2, 3, 4, 7, 20):
        c = language.code_words(n)
        apart = [(c[i] != c[j]).sum() for i in range(n) for j in range(i)]
        assert min(apart) >= c.shape[1] // 2 - 1 and (abs(c.sum(0)) < n).all()


def reference(name):
    return tokenizers.Tokenizer.from_file(public_tokenizers.path(name))


def test_bpe(spark, table, odd, empty):
    lib = reference("byte_bpe_50k.json")
    got = by_id(queries.QUERIES["op10_bpe_round_trip"](spark, SF))
    for r in table:
        ids = lib.encode(r["text"] or "", add_special_tokens=False).ids
        g = got[r["doc_id"]]
        assert g["n_tokens"] == len(ids) and g["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert g["decoded_sha256"] == hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    rows = bpe.encode(odd, queries.vocabulary("byte_bpe_50k.json")).collect()
    assert len(rows) == len(ODD) and all(r["ids"] == lib.encode(r["doc"]["text"] or "", add_special_tokens=False).ids for r in rows)
    assert bpe.encode(empty, queries.vocabulary("byte_bpe_50k.json")).count() == 0


def test_bpe_words():
    """Random text over awkward letters, with forgetting after every batch."""
    lib, own = reference("byte_bpe_50k.json"), bpe.Bpe(queries.vocabulary("byte_bpe_50k.json"), remember=50)
    rng = np.random.default_rng(5)
    letters = list("aaeth  \n\t\r\x0b\x1c\x85\xa0　​'s0159²ßéçΣ漢🙂́_-!.") + ["<|endoftext|>"]
    for _ in range(20):
        texts = ["".join(rng.choice(letters, rng.integers(0, 50))) for _ in range(100)] + ["a" * 300, " the" * 40, "\n" * 30]
        for t, c in zip(texts, own.encode(texts)):
            e = lib.encode(t, add_special_tokens=False).ids
            assert np.frombuffer(c, "<u4").tolist() == e and own.decode(c) == lib.decode(e, skip_special_tokens=False)


def test_token_files(spark, table, odd, empty, tmp_path):
    lib = reference("word_bpe_49k.json")
    lib.no_truncation()
    lib.no_padding()
    got, start = by_id(queries.QUERIES["op6_token_files"](spark, SF)), 0
    for r in sorted(table, key=lambda r: r["doc_id"]):
        ids = [*lib.encode(r["text"] or "", add_special_tokens=False).ids, 2]
        g = got[r["doc_id"]]
        assert (g["start"], g["n_tokens"], g["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    path = str(tmp_path / "odd")
    tokenfile.write(odd, queries.vocabulary("word_bpe_49k.json"), 2, path)
    rows = tokenfile.read(spark, path).collect()
    assert sorted(map(tuple, (r["ids"] for r in rows))) == sorted((*lib.encode(o[1] or "", add_special_tokens=False).ids, 2) for o in ODD)
    starts = sorted((r["start"], r["n_tokens"]) for r in tokenfile.places(spark, path).collect())
    assert all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:]))
    assert tokenfile.read(spark, path, 4, 5).count() == 2
    tokenfile.write(empty, queries.vocabulary("word_bpe_49k.json"), 2, str(tmp_path / "none"))
    assert tokenfile.check_sums(spark, str(tmp_path / "none")).count() == 0


def test_chunks():
    lib, own = reference("word_bpe_49k.json"), tokenfile.Chunks(queries.vocabulary("word_bpe_49k.json"), remember=50)
    lib.no_truncation()
    lib.no_padding()
    rng = np.random.default_rng(6)
    letters = list("aaETh  \n\t\r\x0b\x1c\x85\xa0　​'s0159²ßÉçΣ漢🙂́̈İ_-!.") + ["<|endoftext|>", "<|startoftext|>"]
    for _ in range(20):
        texts = ["".join(rng.choice(letters, rng.integers(0, 50))) for _ in range(100)]
        for t, c in zip(texts, own.encode(texts)):
            assert c.tolist() == lib.encode(t, add_special_tokens=False).ids, repr(t)


def test_chunks_in_use_are_made_once(monkeypatch):
    """A full memory gives up what is not asked for; words of every text are not made anew, which was most of the time."""
    made, of = [], tokenfile.Chunks.made
    monkeypatch.setattr(tokenfile.Chunks, "made", lambda self, c: made.append(c) or of(self, c))
    own = tokenfile.Chunks(queries.vocabulary("word_bpe_49k.json"), remember=200)
    often = [f"w{c}," for c in "abcdefghij"]
    for i in range(50):
        own.encode([" ".join(often + [f"x{'abcdefghij'[i % 10]}{'klmnop'[i // 10]}{c}" for c in "qrstuvwxyz"])])
    assert len(made) == 10 + 50 * 10 and len(own) + len(own.old) < 260
