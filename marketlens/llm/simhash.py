"""Near duplicates by SimHash, found through one-wildcard variants of half fingerprints."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlens.llm.common import finished, stored
from marketlens.operators.graph import components

BITS = 64


def fingerprint(text: str | None, words: int, seed: int, piece: int = 1 << 16) -> int:
    """SimHash over the hashes of all word shingles, as an unsigned integer; 0 without a word.

    White space and A-Z are ASCII in UTF-8 bytes too. Bit counts are added up in pieces of 65,536 shingles.
    """
    tokens = (text or "").encode("utf-8", "replace").lower().split()
    if not tokens:
        return 0
    line = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.append(0, ends[:-1] + 1)
    if len(tokens) > words:
        starts, ends = starts[: len(tokens) - words + 1], ends[words - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    ones = np.zeros(BITS, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(starts), piece):
        span = zip(starts[at : at + piece].tolist(), ends[at : at + piece].tolist())
        hashes = np.fromiter((digest(line[a:b], seed) for a, b in span), "<u8")
        ones += np.unpackbits(hashes.view(np.uint8), bitorder="little").reshape(-1, BITS).sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(starts), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None, words: int = 3, seed: int = 42) -> DataFrame:
    """``carry`` columns in ``_d``, the id in ``_id``, the fingerprint in ``_f`` (a long with the same bits) and a row number in ``_row``."""
    carry = docs.columns if carry is None else carry
    src = docs.select(F.struct(*[F.col(f"`{c}`") for c in carry]).alias("_d"), F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("_t"))

    @F.arrow_udf("long")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array(np.fromiter((fingerprint(t.as_py(), words, seed) for t in texts), np.uint64, len(texts)).view(np.int64))

    return src.select("_d", "_id", run("_t").alias("_f"), F.monotonically_increasing_id().alias("_row"))


def _half(h: int) -> Column:
    return F.shiftrightunsigned(F.col("_f"), 32 * h).bitwiseAND(F.lit(0xFFFFFFFF))


def keys(prints: DataFrame) -> DataFrame:
    """``_f, _k, _b``: each half of a fingerprint as it is and with each of its bits taken out.

    A key holds its kind (33 to a half: 0 exact, else 1 + the place of the missing bit) above the 32 bits of
    the variant. ``_b`` is the value of the missing bit.
    """
    made = []
    for h in (0, 1):
        x = _half(h)
        made.append(F.struct((F.lit(33 * h << 32) + x).alias("k"), F.lit(0).alias("b")))
        made += [F.struct((F.lit(33 * h + 1 + i << 32) + x.bitwiseAND(F.lit(0xFFFFFFFF ^ 1 << i))).alias("k"), F.shiftright(x, i).bitwiseAND(F.lit(1)).cast("int").alias("b")) for i in range(32)]
    return prints.select("_f", F.explode(F.array(*made)).alias("_x")).select("_f", F.col("_x.k").alias("_k"), F.col("_x.b").alias("_b"))


EXACT = "shiftright(_k, 32) % 33 = 0"


def links(prints: DataFrame, crowd: int = 32) -> tuple[DataFrame, list[DataFrame]]:
    """Pairs ``(a, b)`` whose closure joins exactly the fingerprints that a path of links (2 differing bits or fewer) joins.

    ``prints`` holds distinct fingerprints ``_f``. Two that differ in at most two bits differ in at most one
    within one of their halves, so they share that half or one of its variants with a bit taken out. Equal
    keys meet and whole fingerprints are compared. Under a variant only the two values of the missing bit
    meet, so no pair comes twice from one half.

    A crowded key (more than ``crowd`` fingerprints) makes no pairs; ``stars`` serves it exactly. The written tables that the
    pairs are read from come second, to be deleted once the pairs are written.
    """
    d = stored(keys(prints), "simhash-keys")
    sizes = d.groupBy("_k").agg(F.count(F.lit(1)).alias("_n"), F.sum("_b").alias("_ones"))
    # A key serves where two can meet: any two under an exact key, the two values of a missing bit else.
    sizes = stored(sizes.filter(f"_n > 1 AND ({EXACT} OR (_ones > 0 AND _ones < _n))").select("_k", "_n"), "simhash-sizes")
    met = stored(d.join(sizes, "_k"), "simhash-met")
    few = met.filter(F.col("_n") <= crowd)
    pairs = few.withColumnsRenamed({"_f": "a", "_b": "_ba"}).join(few.select("_k", F.col("_f").alias("b"), F.col("_b").alias("_bb")), "_k")
    pairs = pairs.filter(f"CASE WHEN {EXACT} THEN a < b ELSE _ba < _bb END").filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2)
    return pairs.select("a", "b").unionByName(stars(met.filter(F.col("_n") > crowd))), [d, sizes, met]


def stars(rows: DataFrame) -> DataFrame:
    """Links in crowded keys without pairing their rows.

    Rows of a key agree in one half but for the missing bit. Those that also share the other half with any two
    bits taken out (exact keys) or any one (variants) are all within two bits of each other, and every
    such pair shares one of these finer keys. A link of each to the smallest joins them as all pairs would.
    """
    other = F.when(F.shiftright("_k", 32) < 33, _half(1)).otherwise(_half(0))
    one = [1 << i for i in range(32)]
    two = [a | b for i, a in enumerate(one) for b in one[:i]]
    masks = F.when(F.expr(EXACT), F.array(*[F.lit(m).cast("long") for m in [0, *one, *two]])).otherwise(F.array(*[F.lit(m).cast("long") for m in [0, *one]]))
    d = rows.select("_f", "_k", other.alias("_o"), F.explode(masks).alias("_m")).withColumn("_o", F.col("_o").bitwiseAND(F.bitwise_not("_m")))
    fine = ["_k", "_m", "_o"]
    low = d.groupBy(*fine).agg(F.min("_f").alias("a"), F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    return d.join(low, fine).select("a", F.col("_f").alias("b")).filter("a <> b")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None, words: int = 3, seed: int = 42) -> DataFrame:
    """The ``carry`` columns in ``doc``, with ``fingerprint`` (16 hexadecimal digits), ``component_id`` and ``kept``.

    Documents link if their fingerprints differ in two bits or fewer; ``component_id`` is the smallest id that
    links reach. Equal fingerprints are one node, so groups of copies cost one row. Exactly one row of each
    component is kept: the one with the smallest id, or any one of its repeats.

    Null and wordless texts have fingerprint 0 and link like any other. Null ids sort after every id; a component
    without an id has none. Fewer words than a shingle make one shingle. An empty table gives no rows.
    """
    rows = stored(fingerprints(docs, id_col, text_col, carry, words, seed), "simhash-rows")
    first = F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("id"), F.col("_row").alias("row"))
    nodes = stored(rows.groupBy("_f").agg(F.min(first).alias("_first")), "simhash-nodes")
    pairs, used = links(nodes.select("_f"))
    edges = stored(pairs.distinct().withColumn("_g", F.lit(0)), "simhash-links")
    finished(docs.sparkSession, *used)
    ends = edges.select("_g", F.col("a").alias("_f")).union(edges.select("_g", F.col("b").alias("_f"))).distinct()
    joined = components(edges, ends, "_g", node="_f").select("_f", "component")
    classes = stored(nodes.join(joined, "_f", "left").select("_f", "_first", F.coalesce("component", "_f").alias("_c")), "simhash-joined")
    best = stored(classes.groupBy("_c").agg(F.min("_first").alias("_best")), "simhash-best")
    labels = stored(classes.join(best, "_c").select("_f", "_best"), "simhash-labels")
    finished(docs.sparkSession, nodes, edges, classes, best)
    d = rows.join(labels.hint("merge"), "_f")
    return d.select(F.col("_d").alias("doc"), F.lower(F.lpad(F.hex("_f"), 16, "0")).alias("fingerprint"), F.col("_best.id").alias("component_id"), (F.col("_row") == F.col("_best.row")).alias("kept"))
