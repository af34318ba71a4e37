"""The registered queries of the package and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlens.llm import bpe, decontamination, language, repair, tokenfile, whitening
from marketlens.llm.common import documents
from marketlens.llm.exact_dedup import refine
from marketlens.llm.mixing import mix
from marketlens.llm.simhash import near_duplicates
from marketlens.llm.substrings import repeats
from marketlens.llm.topk import quantised, top_k
from marketlens.llm.paragraphs import repeated
from marketlens.llm.sharding import shard
from marketlens.session import work_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def vocabulary(name: str) -> str:
    """A public tokenizer's file; its text goes to the executors, which need not have it."""
    return Path(public_tokenizers.path(name)).read_text("utf-8")


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return register


@query()
def op1_paragraph_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every occurrence of a paragraph that repeats exactly or nearly, with its class."""
    return repeated(documents(spark, sf_dir))


@query()
def op2_minimax_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in eight shards of near equal bytes; equal texts stay together."""
    return shard(documents(spark, sf_dir), 8).withColumns({"law": F.lit("bytes"), "grown_shard": F.lit(None).cast("int")})


TOP = """
WITH v AS (SELECT vec_id, [CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT) for x in embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
q AS (SELECT vec_id AS query_id, v AS q FROM v WHERE vec_id % 20 = 0),
s AS (SELECT query_id, vec_id, CAST(list_dot_product(CAST(q AS DOUBLE[]), CAST(v AS DOUBLE[])) AS BIGINT) AS score FROM q JOIN v ON vec_id <> query_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20"""


@query(TOP)
def op3_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 highest integer products of every twentieth vector with all others."""
    return top_k(quantised(spark.read.parquet(f"{sf_dir}/embeddings.parquet")), F.col("_id") % 20 == 0, 20)


@query()
def op5_language_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from two of three folds."""
    docs = documents(spark, sf_dir)
    fold = language.remainder("doc_id")
    model = language.train(docs.filter(fold != 1).select("text", "lang"))
    d = language.identify(docs.select("doc_id", "text"), model)
    return d.select("doc.doc_id", (language.remainder("doc.doc_id") == 1).alias("held_out"), F.col("guess.lang").alias("lang_pred"), F.col("guess.score").alias("score"), F.col("guess.ambiguous").alias("ambiguous"))


@query()
def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text as token ids in Parquet files, read back."""
    path = work_path(spark, "token-files")
    tokenfile.write(documents(spark, sf_dir), vocabulary("word_bpe_49k.json"), 2, path)
    return tokenfile.check_sums(spark, path)


@query()
def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its fingerprint and near-duplicate component."""
    return near_duplicates(documents(spark, sf_dir), carry=["doc_id"]).select("doc.*", "fingerprint", "component_id")


@query()
def op8_repeated_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every text without the 50-byte strings that earlier documents hold."""
    d = repeats(documents(spark, sf_dir))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s[1] - s[0])
    return d.select(F.col("_id").alias("doc_id"), "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


@query()
def op10_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every text's token ids and of what they decode to."""
    d = bpe.encode(documents(spark, sf_dir), vocabulary("byte_bpe_50k.json"), carry=["doc_id"], ids=False)
    return d.select("doc.*", "n_tokens", "ids_sha256", "decoded_sha256")


MIX = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
  md5('17:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS ss, row_number() OVER (ORDER BY source IS NULL, source) AS rn FROM d GROUP BY source),
w AS (SELECT source, ss, 3 * ss AS cap, CASE (rn - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w FROM s),
o AS (SELECT *, row_number() OVER (ORDER BY cap / w, source) AS k FROM w),
v AS (SELECT *, (CAST(sum(ss) OVER () AS DOUBLE) - CAST(coalesce(sum(cap) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE))
  / CAST(sum(w) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level FROM o),
l AS (SELECT coalesce((SELECT level FROM v WHERE cap > level * w ORDER BY k LIMIT 1), 0) AS level),
t AS (SELECT source, ss, least(CAST(cap AS DOUBLE), level * w) AS target FROM w, l),
u AS (SELECT *, CASE WHEN ss > 0 THEN CAST(floor(target / ss) AS BIGINT) ELSE 0 END AS whole FROM t),
r AS (SELECT doc_id, size, ss, target, whole, target - whole * ss AS need,
  sum(size) OVER (PARTITION BY d.source ORDER BY h, size ROWS UNBOUNDED PRECEDING) - size AS run FROM d JOIN u ON d.source IS NOT DISTINCT FROM u.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, ss AS source_size, round(target, 6) AS target,
  CAST(size * (whole + CASE WHEN CAST(run * 2 + size AS DOUBLE) <= need * 2 THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM r"""


@query(MIX)
def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words the mix takes of every document, with its source's size and target."""
    d = mix(documents(spark, sf_dir), carry=["doc_id"])
    return d.select("doc.doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken")


@query(r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
  doc_id = min(doc_id) OVER (PARTITION BY text_sha256) AS kept, text_sha256 FROM d""")
def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the one of its equals that stays."""
    return refine(documents(spark, sf_dir), carry=["doc_id"], digest=True).select("doc.*", "keep_id", "group_size", "kept", "text_sha256")


LEAKS = r"""
WITH t AS (SELECT 0 AS kind, row_number() OVER () AS row, CAST(doc_id AS VARCHAR) AS name, doc_id, text FROM documents
  UNION ALL SELECT 1, row_number() OVER (), coalesce(CAST(item_id AS VARCHAR), ''), NULL, text FROM benchmark),
w AS (SELECT kind, row, name, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM t),
p AS (SELECT DISTINCT name AS item, array_to_string(list_slice(w, i, i + 9), ' ') AS phrase, least(len(w), 10) AS size
  FROM (SELECT *, unnest(range(1, greatest(2, len(w) - 8))) AS i FROM w WHERE kind = 1 AND len(w) > 0)),
s AS (SELECT DISTINCT size FROM p),
o AS (SELECT row, i, size, array_to_string(list_slice(w, i, i + size - 1), ' ') AS phrase
  FROM (SELECT row, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM w, s WHERE kind = 0 AND len(w) >= size)),
h AS (SELECT row, i, size, item FROM o JOIN p USING (phrase, size)),
n AS (SELECT row, count(*) AS n_hit FROM (SELECT DISTINCT row, unnest(range(i, i + size)) AS at FROM h) GROUP BY row),
m AS (SELECT row, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT row, item FROM h) GROUP BY row)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM w LEFT JOIN n USING (row) LEFT JOIN m USING (row) WHERE kind = 0"""


@query(LEAKS)
def op13_benchmark_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which words of every document stand in passages of the benchmark, and of which items."""
    d = decontamination.find(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), carry=["doc_id"])
    hit = F.aggregate("runs", F.lit(0).cast("long"), lambda a, r: a + r["last"] - r["first"])
    return d.select("doc.doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                    F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), (F.size("runs") > 0).alias("contaminated"))


@query()
def op12_whitened_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector on the eight leading principal components, scaled to variance 1."""
    d = whitening.whitened(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return d.select(F.col("_id").alias("vec_id"), "component", "n", "deviation", "whitened", "explained", "identity_error")


REPAIR = r"""
WITH RECURSIVE d AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  crc FROM (SELECT *, list_reduce(list_prepend(4294967295::BIGINT, [CAST(x AS BIGINT) for x in [ord(c) for c in string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), '')]]),
  lambda a, b: list_reduce(list_prepend(xor(a, b), [CAST(i AS BIGINT) for i in range(8)]), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))) AS crc FROM conversations)),
k AS (SELECT conv_id, turn, role, text, xor(crc, 4294967295) % 20 AS k FROM d),
e AS (SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role, CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
  unnest(CASE WHEN k = 3 THEN [1, 2] ELSE [1] END) AS copy FROM k WHERE k <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS tail FROM e),
f AS (SELECT *, CASE WHEN tail = '' THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd' WHEN tail NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault,
  role[1] AS r, lag(role[1]) OVER (PARTITION BY conv_id ORDER BY i) AS p FROM o),
a AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
  count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (i > 1 AND p || r NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id),
c AS (SELECT DISTINCT conv_id FROM conversations),
s AS (SELECT conv_id, 0::BIGINT AS i, {c: 0, a: '', t: ''} AS e, NULL::STRUCT(c INTEGER, a VARCHAR, t VARCHAR) AS s, {c: 2, a: 'I', t: E'\nuser:'} AS u, {c: 4, a: 'II', t: E'\nuser:\nassistant:'} AS v FROM c
  UNION ALL
  SELECT conv_id, i, e, s, u, CASE WHEN u IS NULL THEN v WHEN v IS NULL THEN {c: u.c + 2, a: u.a || 'I', t: u.t || E'\nassistant:'} ELSE least(v, {c: u.c + 2, a: u.a || 'I', t: u.t || E'\nassistant:'}) END FROM (
  SELECT conv_id, i, e, s, v, list_min([x for x in [u, {c: e.c + 2, a: e.a || 'I', t: e.t || E'\nuser:'}, CASE WHEN s IS NOT NULL THEN {c: s.c + 2, a: s.a || 'I', t: s.t || E'\nuser:'} END,
    CASE WHEN v IS NOT NULL THEN {c: v.c + 2, a: v.a || 'I', t: v.t || E'\nuser:'} END] if x IS NOT NULL]) AS u FROM (
  SELECT s.conv_id, f.i, {c: e.c + 3, a: e.a || 'D', t: e.t} AS e,
    list_min([x for x in [CASE WHEN s.s IS NOT NULL THEN {c: s.s.c + 3, a: s.s.a || 'D', t: s.s.t} END, CASE WHEN r = 's' AND fault NOT IN ('b', 'd') THEN {c: e.c + m, a: e.a || 'K', t: e.t || w} END] if x IS NOT NULL]) AS s,
    list_min([x for x in [CASE WHEN u IS NOT NULL THEN {c: u.c + 3, a: u.a || 'D', t: u.t} END, CASE WHEN fault NOT IN ('b', 'd') THEN {c: e.c + 2 + m, a: e.a || 'R', t: e.t || E'\nuser:' || text} END,
      CASE WHEN s.s IS NOT NULL AND fault NOT IN ('b', 'd') THEN {c: s.s.c + 2 + m, a: s.s.a || 'R', t: s.s.t || E'\nuser:' || text} END, CASE WHEN v IS NOT NULL AND fault NOT IN ('b', 'd') THEN {c: v.c + 2 + m, a: v.a || 'R', t: v.t || E'\nuser:' || text} END,
      CASE WHEN r = 'u' AND fault NOT IN ('b', 'd') THEN {c: e.c + m, a: e.a || 'K', t: e.t || w} END, CASE WHEN s.s IS NOT NULL AND r = 'u' AND fault NOT IN ('b', 'd') THEN {c: s.s.c + m, a: s.s.a || 'K', t: s.s.t || w} END,
      CASE WHEN v IS NOT NULL AND r = 'u' AND fault NOT IN ('b', 'd') THEN {c: v.c + m, a: v.a || 'K', t: v.t || w} END] if x IS NOT NULL]) AS u,
    list_min([x for x in [CASE WHEN v IS NOT NULL THEN {c: v.c + 3, a: v.a || 'D', t: v.t} END, CASE WHEN u IS NOT NULL AND fault NOT IN ('b', 'd') THEN {c: u.c + 2 + m, a: u.a || 'R', t: u.t || E'\nassistant:' || text} END,
      CASE WHEN u IS NOT NULL AND r = 'a' AND fault NOT IN ('b', 'd') THEN {c: u.c + m, a: u.a || 'K', t: u.t || w} END] if x IS NOT NULL]) AS v
  FROM s JOIN (SELECT *, CASE WHEN fault = 't' THEN 1 ELSE 0 END AS m, E'\n' || role || ':' || text AS w FROM f) AS f ON f.conv_id IS NOT DISTINCT FROM s.conv_id AND f.i = s.i + 1))),
l AS (SELECT conv_id, max_by(CASE WHEN v IS NULL THEN e ELSE least(e, v) END, i) AS x FROM s GROUP BY conv_id)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  CAST(x.c AS BIGINT) AS cost, x.a AS audit, sha256(x.t[2:]) AS repaired_sha256
FROM c JOIN l ON l.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN a ON a.conv_id IS NOT DISTINCT FROM c.conv_id"""


@query(REPAIR)
def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults of every damaged conversation, the cheapest edits that repair it and a digest of the result."""
    whole, cut = repair.repair(repair.damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet")), gone="gone")
    d = repair.summary(whole, True).unionByName(repair.summary(cut, False))
    return d.withColumnRenamed("_conv", "conv_id")
