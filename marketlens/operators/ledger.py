"""Append-only ledgers: hash chains, idempotent appends and set digests."""

from __future__ import annotations

import hashlib
import json
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlens.operators.timeline import previous
from marketlens.session import cut_lineage


def canonical(*cols: str) -> Column:
    """Compact JSON object of the columns in sorted order: the text that is hashed. Null fields are left out."""
    return F.to_json(F.struct(*sorted(cols)))


def link_hash(cols: list[str], previous_hash: Column) -> Column:
    """SHA-256 over the joined columns and the previous hash."""
    return F.sha2(F.concat_ws("|", *[F.col(c).cast("string") for c in cols], previous_hash), 256)


def build_chain(df: DataFrame, chain: str, seq: str, cols: list[str], seed: str) -> DataFrame:
    """``previous_hash`` and ``hash`` along each chain in ``seq`` order, starting from ``seed``.

    Every hash needs the one before it, so one chain is one sequence by definition. Its rows are
    sorted by Spark and streamed in Arrow batches; nothing but the last hash is kept. A writer's
    new rows continue a chain with its last hash as ``seed``. Verification is fully parallel.
    """
    text = F.concat_ws("|", *[F.col(c).cast("string") for c in cols])
    rows = df.withColumn("_text", text).withColumn("_key", F.col(chain).cast("string"))
    rows = rows.repartition(chain).sortWithinPartitions(chain, seq)
    schema = df.withColumns({"previous_hash": F.lit(""), "hash": F.lit("")}).schema

    def fold(batches):
        key, last = None, seed
        for pdf in batches:
            before, after = [], []
            for k, t in zip(pdf["_key"], pdf["_text"]):
                if k != key:
                    key, last = k, seed
                before.append(last)
                last = hashlib.sha256(f"{t}|{last}".encode()).hexdigest()
                after.append(last)
            yield pdf.drop(columns=["_key", "_text"]).assign(previous_hash=before, hash=after)

    return rows.mapInPandas(fold, schema)


def verify_chain(df: DataFrame, chain: str, seq: str, cols: list[str], seed: str, width: int = 4096,
                 anchor: tuple[Column, Column] | None = None) -> DataFrame:
    """``fault`` of every row: broken sequence, previous hash or own hash; null when sound.

    ``anchor`` (sequence, hash) is a trusted row: only rows after it are checked.
    """
    first_seq, first_hash = (F.lit(1), F.lit(seed)) if anchor is None else (anchor[0] + 1, anchor[1])
    d = df if anchor is None else df.filter(F.col(seq) > anchor[0])
    d = previous(d, [chain], [seq], width, {"_pseq": seq, "_phash": "hash"})
    gap = F.col(seq) != F.coalesce(F.col("_pseq") + 1, first_seq)
    bent = F.col("previous_hash") != F.coalesce(F.col("_phash"), first_hash)
    own = F.col("hash") != link_hash(cols, F.col("previous_hash"))
    return d.withColumn("fault", F.when(gap, "sequence").when(bent, "previous_hash").when(own, "hash")).drop("_pseq", "_phash")


def first_fault(verified: DataFrame, chain: str, seq: str) -> DataFrame:
    bad = F.min(F.when(F.col("fault").isNotNull(), F.struct(seq, "fault")))
    return verified.groupBy(chain).agg(F.count(F.lit(1)).alias("checked"), bad.alias("_b")).select(
        chain, "checked", F.col(f"_b.{seq}").alias("first_bad"), F.col("_b.fault").alias("fault"))


def append_idempotent(existing: DataFrame, incoming: DataFrame, key: list[str], body: str, order: list[str]) -> DataFrame:
    """``outcome`` of every incoming row: append, duplicate (equal body) or conflict.

    Within the batch the first row of a key decides.
    """
    first = incoming.groupBy(*key).agg(F.min_by(body, F.struct(*order)).alias("_b0"), F.min(F.struct(*order)).alias("_o0"))
    old = existing.groupBy(*key).agg(F.min(body).alias("_old"))
    d = incoming.join(first, key).join(old, key, "left")
    ref = F.coalesce("_old", "_b0")
    fresh = F.col("_old").isNull() & (F.struct(*order) == F.col("_o0"))
    return d.withColumn("outcome", F.when(fresh, "append").when(F.col(body) == ref, "duplicate").otherwise("conflict")).drop("_b0", "_o0", "_old")


def set_tree(df: DataFrame, by: list[str], member: str, leaf: int = 4096) -> DataFrame:
    """Hash tree over the distinct members of every group: ``(*by, prefix, digest, members)``, the root under the empty prefix.

    Members are dealt by the first hex digits of their SHA-256, as many digits as leave about ``leaf`` members in a leaf of that
    group. A leaf's digest is that of the JSON list of its sorted members; so the root of a group of ``leaf`` members or fewer is the
    plain digest of its list, which a bound value can be held against. A node above digests its 16 children at most, in order. No task
    sees more than a leaf or the children of a node.
    """
    if not by:
        return set_tree(df.withColumn("_all", F.lit(0)), ["_all"], member, leaf).drop("_all")
    text = F.col(member).cast("string")
    m = df.select(*by, text.alias("_m")).filter("_m IS NOT NULL").distinct()
    sizes = m.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    digits = F.size(F.filter(F.sequence(F.lit(0), F.lit(14)), lambda d: F.lit(float(leaf)) * F.pow(F.lit(16.0), d) < F.col("_n")))
    level = sizes.select(*[F.col(c).alias(f"_{c}") for c in by], digits.alias("_d"))
    same = reduce(lambda a, c: a & F.col(c).eqNullSafe(F.col(f"_{c}")), by, F.lit(True))
    m = m.join(level, same)
    m = m.withColumn("prefix", F.expr("substring(sha2(_m, 256), 1, _d)"))
    nodes = cut_lineage(m.groupBy(*by, "prefix").agg(F.sha2(F.to_json(F.sort_array(F.collect_list("_m"))), 256).alias("digest"), F.count(F.lit(1)).alias("members")))
    deepest, out = nodes.agg(F.max(F.length("prefix"))).first()[0] or 0, nodes
    for depth in range(deepest, 0, -1):
        kids = F.sort_array(F.collect_list(F.struct("prefix", "digest")))
        up = nodes.filter(F.length("prefix") == depth).groupBy(*by, F.expr(f"substring(prefix, 1, {depth - 1})").alias("_up")).agg(F.sha2(F.concat_ws("|", F.transform(kids, lambda k: k["digest"])), 256).alias("digest"), F.sum("members").alias("members"))
        up = cut_lineage(up.withColumnRenamed("_up", "prefix"))
        nodes = up.unionByName(nodes.filter(F.length("prefix") < depth))
        out = out.unionByName(up)
    return out


def set_digest(df: DataFrame, by: list[str], member: str, leaf: int = 4096) -> DataFrame:
    """Order-free digest of the distinct members of a group, with their count: the root of its ``set_tree``."""
    return set_tree(df, by, member, leaf).filter("prefix = ''").select(*by, "members", "digest")


def compare_bound(digests: DataFrame, bound: DataFrame, by: list[str]) -> DataFrame:
    """``binding`` of every bound digest (``members, digest``): ok, count, digest, or missing where the group has no member."""
    b = bound.select(*by, F.col("members").alias("_n"), F.col("digest").alias("_b"))
    why = F.when(F.col("digest").isNull(), "missing").when(F.col("members") != F.col("_n"), "count").when(F.col("digest") != F.col("_b"), "digest").otherwise("ok")
    return b.join(digests, by, "left").select(*by, why.alias("binding"))


def proof(tree: DataFrame, df: DataFrame, by: dict, member: str, value: str) -> tuple[list[str], list[tuple[str, str]]]:
    """What shows that ``value`` is in the group ``by`` (column to value): its leaf's members, and the digests of all nodes beside its path, 16 a level."""
    mine = lambda d: d.filter(reduce(lambda a, c: a & F.col(c).eqNullSafe(F.lit(by[c])), by, F.lit(True)))
    h = hashlib.sha256(value.encode()).hexdigest()
    beside = mine(tree).filter(F.lit(h).startswith(F.expr("substring(prefix, 1, length(prefix) - 1)")) & (F.length("prefix") > 0)).select("prefix", "digest").collect()
    depth = max((len(r["prefix"]) for r in beside), default=0)
    leaf = mine(df).select(F.col(member).cast("string").alias("_m")).filter(F.expr(f"substring(sha2(_m, 256), 1, {depth})") == h[:depth]).distinct().orderBy("_m").collect()
    return [r["_m"] for r in leaf], sorted((r["prefix"], r["digest"]) for r in beside)


def proof_holds(root: str, value: str, leaf: list[str], beside: list[tuple[str, str]]) -> bool:
    """Does the proof lead from ``value`` to ``root``?"""
    h = hashlib.sha256(value.encode()).hexdigest()
    digest = hashlib.sha256(json.dumps(sorted(leaf), separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()
    for depth in range(max((len(p) for p, _ in beside), default=0), 0, -1):
        kids = {p: d for p, d in beside if len(p) == depth}
        if kids.get(h[:depth]) != digest:
            return False
        digest = hashlib.sha256("|".join(kids[p] for p in sorted(kids)).encode()).hexdigest()
    return value in leaf and digest == root
