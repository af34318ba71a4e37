"""Every stage of the pipeline against brute force on what the stage before kept."""

import hashlib
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
import tokenizers
from pyspark.sql import functions as F

from tests.llm.test_digests import ODD, SCHEMA, SF, SPACE, near, simhash

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def rows(df):
    return [r.asDict() for r in df.collect()]


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    out.append(rows(docs))
    for _, stage in corpus_pipeline.STAGES:
        docs = spark.createDataFrame(stage(spark, docs, SF).collect(), docs.schema) if stage is not corpus_pipeline.STAGES[-1][1] else stage(spark, docs, SF)
        out.append(rows(docs))
    return out


def test_order_and_columns(spark, stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "exact dedup", "SimHash near-dedup", "source mix", "BPE"]
    assert all(set(s[0]) == set(COLUMNS) for s in stages[:-1])


def test_language_keeps_clean_documents(stages):
    kept = {r["doc_id"] for r in stages[1]}
    assert len(kept) >= 0.99 * len(stages[0]) and all(any(c.isalpha() for c in r["text"] or "") for r in stages[1])


def test_exact(stages):
    first = {}
    for r in sorted(stages[1], key=lambda r: r["doc_id"]):
        first.setdefault(SPACE.sub(" ", r["text"] or ""), r["doc_id"])
    assert sorted(first.values()) == sorted(r["doc_id"] for r in stages[2])


def test_near(stages):
    ids, prints = [r["doc_id"] for r in stages[2]], [simhash(r["text"]) for r in stages[2]]
    assert sorted(set(near(ids, prints))) == sorted(r["doc_id"] for r in stages[3])


def test_similar(spark, stages):
    """All pairs of similarity 0.8 on five words, which SimHash leaves on this table."""
    grams = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for w in ((r["text"] or "").lower().split() for r in stages[2])]
    ids, low = [r["doc_id"] for r in stages[2]], list(range(len(grams)))
    pairs = [(i, j) for i in range(len(grams)) for j in range(i) if len(grams[i] & grams[j]) >= 0.8 * len(grams[i] | grams[j])]
    for _ in ids:
        for i, j in pairs:
            low[i] = low[j] = min(low[i], low[j], key=lambda x: ids[x])
    kept = sorted({ids[x] for x in low})
    docs = spark.createDataFrame(stages[2], spark.read.parquet(f"{SF}/documents.parquet").schema)
    assert pairs and len(kept) < len(stages[3])
    assert sorted(r["doc_id"] for r in corpus_pipeline.drop_similar(spark, docs, SF).collect()) == kept
    odd = spark.createDataFrame(ODD, SCHEMA)
    assert sum(r["doc_id"] in (4, 5) for r in corpus_pipeline.drop_similar(spark, odd, SF).collect()) == 1
    assert corpus_pipeline.drop_similar(spark, odd.limit(0), SF).count() == 0


def test_mix(stages):
    size = {r["doc_id"]: len([w for w in SPACE.split(r["text"] or "") if w]) for r in stages[3]}
    source, total = defaultdict(int), sum(size.values())
    for r in stages[3]:
        source[r["source"]] += size[r["doc_id"]]
    names = sorted(source)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, left, free = {}, total, set(names)
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] >= 3 * source[s]}
        target.update(share)
        if not over:
            break
        for s in over:
            target[s], left = 3 * source[s], left - 3 * source[s]
        free -= over
    taken, times = defaultdict(int), Counter(r["doc_id"] for r in stages[4])
    for r in stages[3]:
        taken[r["source"]] += size[r["doc_id"]] * times[r["doc_id"]]
    assert max(times.values()) <= 3
    for s in names:
        assert abs(taken[s] - target[s]) <= max(size[r["doc_id"]] for r in stages[3] if r["source"] == s)


def test_tokens(stages):
    lib = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    text = {r["doc_id"]: r["text"] for r in stages[4]}
    assert Counter(r["doc_id"] for r in stages[5]) == Counter(r["doc_id"] for r in stages[4])
    for r in stages[5]:
        ids = lib.encode(text[r["doc_id"]], add_special_tokens=False).ids
        assert r["ids"] == ids and r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()


def test_run_agrees_with_the_stages(spark, stages):
    got = Counter((r["doc_id"], r["ids_sha256"]) for r in corpus_pipeline.run(spark, SF).select("doc_id", "ids_sha256").collect())
    assert got == Counter((r["doc_id"], r["ids_sha256"]) for r in stages[5])


def test_odd_rows(spark):
    docs = spark.createDataFrame(ODD, SCHEMA).withColumn("_d", F.lit("extra")).withColumn("kept", F.lit("extra"))
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert out.count() <= 3 * len(ODD)
        if stage is not corpus_pipeline.STAGES[-1][1]:
            assert out.columns == docs.columns
            docs = spark.createDataFrame(out.collect(), docs.schema)
    assert corpus_pipeline.tokenise(spark, docs.limit(0), SF).count() == 0
