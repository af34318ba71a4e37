"""Repeated paragraphs by MinHash bands, exact verification and components."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketlens.llm.bpe import slices
from marketlens.llm.common import BLANKS, finished, stored, worker_memory
from marketlens.llm.substrings import Anchors
from marketlens.operators.graph import components


#: Characters that end a sentence, when nothing but signs follows them in the word.
STOPS = ".!?\u3002\uff01\uff1f"
MIX = np.uint64(0x9E3779B97F4A7C15)
#: How many parts the texts of the units are dealt out in, one after the other.
TURNS = 3


def stirred(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * MIX
    return x ^ (x >> np.uint64(29))


def shingles(text: str, words: int) -> np.ndarray:
    """Hashes of the distinct word shingles; fewer words make one."""
    w = text.encode("utf-8", "replace").split(b" ")
    n = max(1, len(w) - words + 1)
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(b" ".join(w[i : i + words])) for i in range(n)), np.uint64, n))


class Bands:
    """``bands`` keys of ``rows`` minima each; a pair of similarity s shares a key with probability 1 - (1 - s^rows)^bands."""

    def __init__(self, bands: int, rows: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.bands, self.rows = bands, rows
        self.a = rng.integers(1, 1 << 63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = rng.integers(0, 1 << 63, bands * rows, dtype=np.uint64)

    def keys(self, hashes: np.ndarray) -> list[int]:
        low = np.full(len(self.a), np.iinfo(np.uint64).max, np.uint64)
        for at in range(0, len(hashes), 2048):
            x = hashes[at : at + 2048, None] * self.a + self.b
            low = np.minimum(low, (x ^ (x >> np.uint64(29))).min(0))
        return [xxhash.xxh64_intdigest(low[i * self.rows : (i + 1) * self.rows].tobytes(), i) - (1 << 63) for i in range(self.bands)]

    def together(self, hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Keys of many sets that lie one behind the other, each from its place in ``first``."""
        out = np.zeros((len(first), self.bands), np.uint64)
        for i in range(self.bands * self.rows):
            x = hashes * self.a[i] + self.b[i]
            low = np.minimum.reduceat(x ^ (x >> np.uint64(29)), first)
            band = i // self.rows
            out[:, band] = stirred(out[:, band] * MIX + low + np.uint64(band))
        return out.view(np.int64)


class Words(dict):
    """64-bit hash of a word, its lowest bit set if the word ends a sentence; ``remember`` bounds each of two generations."""

    def __init__(self, remember: int = 200_000):
        super().__init__()
        self.remember, self.old = remember, {}

    def __missing__(self, word: str) -> int:
        value = self.old.get(word)
        if value is None:
            ends = False
            if not word[-1].isalnum():
                ends = word[-1] in STOPS
                if not ends:
                    at = max(word.rfind(c) for c in STOPS)
                    ends = at >= 0 and not any(map(str.isalnum, word[at:]))
            value = xxhash.xxh64_intdigest(word.encode("utf-8", "replace")) & ~1 | ends
        if len(self) >= self.remember:
            self.old = dict(self)
            self.clear()
        self[word] = value
        return value

    def of(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def borders(hashes: np.ndarray, least: int, reach: int) -> list[int]:
    """Where the units of a text of these words begin, and its end.

    A unit ends with a sentence of ``least`` words or more; shorter ones join what follows (the last joins what is before it).
    Within a unit, the gap whose two words hash lowest among the ``reach`` gaps on both sides is a border too, so text without
    sentences is cut as well. Line breaks play no part. A border depends only on words near it: a passage is cut
    alike wherever it stands.
    """
    n = len(hashes)
    if not n:
        return [0]
    ends = np.flatnonzero(hashes & np.uint64(1)) + 1
    edges = ends[np.diff(ends, prepend=0) >= least].tolist()
    while edges and n - edges[-1] < least:
        edges.pop()
    bounds = np.array([0, *edges, n])
    gap = stirred(hashes[:-1] * MIX + hashes[1:])
    m = len(gap)
    if m <= 2 * reach:
        return bounds.tolist()
    low = Anchors._slide(gap, reach, np.minimum)
    middle = gap[reach : m - reach]
    at = np.flatnonzero((middle < low[: m - 2 * reach]) & (middle <= low[reach + 1 :])) + reach
    unit = np.searchsorted(bounds, at, side="right")
    at = at[(at - reach >= bounds[unit - 1]) & (at + reach <= bounds[unit] - 2)]
    return np.sort(np.concatenate([bounds, at + 1])).tolist()


def unit_keys(hashes: np.ndarray, starts: np.ndarray, sizes: np.ndarray, words: int, maker: Bands) -> np.ndarray:
    """The band keys of units that lie in one array of word hashes, a row each; all shingles by rolling sums at once."""
    count = np.maximum(1, sizes - words + 1)
    first = np.cumsum(count) - count
    at = np.arange(int(count.sum())) + np.repeat(starts - first, count)
    end = np.repeat(starts + sizes, count)
    x = np.zeros(len(at), np.uint64)
    for i in range(words):
        x = x * MIX + np.where(at + i < end, hashes[np.minimum(at + i, len(hashes) - 1)], np.uint64(0))
    return maker.together(stirred(x), first)


def units(docs: DataFrame, id_col: str, text_col: str, words: int, maker: Bands, least: int = 8, reach: int = 8) -> DataFrame:
    """``_id, _no, _word, _n, _h, _text, _keys`` of every unit: number, place and count of its words, digest, text and band keys.

    One pass over the texts, a few MB at a time; words are lower-cased and stand between white space.
    """
    src = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("_t"))
    schema = T.StructType([src.schema["_id"], T.StructField("_no", T.IntegerType()), T.StructField("_word", T.IntegerType()), T.StructField("_n", T.IntegerType()),
                           T.StructField("_h", T.BinaryType()), T.StructField("_text", T.StringType()), T.StructField("_keys", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = worker_memory().setdefault("paragraph words", Words())
        for batch in batches:
            ids, done = batch.column("_id"), 0
            for texts in slices(batch.column("_t"), 2 << 20):
                row, no, word, size, digests, shown, hashes, starts, before = [], [], [], [], [], [], [], [], 0
                for i, text in enumerate(texts):
                    w = (text or "").lower().split()
                    h = known.of(w)
                    edges = borders(h, least, reach)
                    for k, (a, b) in enumerate(zip(edges, edges[1:])):
                        t = " ".join(w[a:b])
                        digests.append(xxhash.xxh3_128_digest(t.encode("utf-8", "replace")))
                        shown.append(t)
                        row.append(done + i), no.append(k), word.append(a), size.append(b - a), starts.append(before + a)
                    hashes.append(h)
                    before += len(w)
                done += len(texts)
                if row:
                    keys = unit_keys(np.concatenate(hashes), np.array(starts), np.array(size), words, maker)
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(row) + 1, dtype=np.int32) * keys.shape[1]), pa.array(keys.ravel()))
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(row)), pa.array(no, pa.int32()), pa.array(word, pa.int32()), pa.array(size, pa.int32()), pa.array(digests, pa.binary()),
                                                      pa.array(shown, pa.string()), lists], schema.names)

    return src.mapInArrow(run, schema)


def verify(pairs: DataFrame, texts: DataFrame, words: int, similarity: float) -> DataFrame:
    """The pairs whose exact Jaccard similarity of word shingles reaches ``similarity``."""

    @F.arrow_udf("double")
    def jaccard(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for left, right in batches:
            out, last, seen = [], None, None
            for x, y in zip(left.to_pylist(), right.to_pylist(), strict=True):
                if x != last:
                    last, seen = x, shingles(x, words)
                other = shingles(y, words)
                both = len(np.intersect1d(seen, other, assume_unique=True))
                out.append(both / (len(seen) + len(other) - both))
            yield pa.array(out, pa.float64())

    d = pairs.join(texts.select(F.col("_p").alias("a"), F.col("_text").alias("_ta")), "a").join(texts.select(F.col("_p").alias("b"), F.col("_text").alias("_tb")), "b")
    return d.filter(jaccard("_ta", "_tb") >= similarity).select("a", "b")


def prefix_pairs(members: DataFrame, texts: DataFrame, words: int, similarity: float) -> tuple[DataFrame, DataFrame]:
    """Every pair of ``members`` (``_p, _c``) of different components ``_c`` that can reach ``similarity``, and few others; and the table they are read from.

    Sets of a and b shingles are that similar only if they share s / (1 + s) (a + b) of them. So, with the shingles of
    both in one order, the first they share lies among the a (or b) less that many first ones. Rare shingles come
    first: variants of one text that differ in several words are led by shingles of their own and never meet, however
    many they are, and a shingle whose members are joined already is left out.
    """
    @F.arrow_udf("array<long>")
    def cut(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([shingles(t.as_py(), words).view(np.int64) for t in batch], pa.list_(pa.int64()))

    d = members.join(texts.select("_p", "_text"), "_p").select("_p", "_c", cut("_text").alias("_s"))
    d = stored(d.select("_p", "_c", F.size("_s").alias("_n"), F.explode("_s").alias("_t")), "paragraph-shingles")
    often = stored(d.groupBy("_t").agg(F.count(F.lit(1)).alias("_f")), "paragraph-often")
    # A list per paragraph, as long as the paragraph; only its head is kept.
    order = d.join(often, "_t").groupBy("_p", "_c", "_n").agg(F.sort_array(F.collect_list(F.struct("_f", "_t"))).alias("_s"))
    head = F.slice("_s", F.lit(1), (F.col("_n") - F.ceil(F.col("_n") * similarity - 1e-9) + 1).cast("int"))
    heads = stored(order.select("_p", "_c", "_n", F.posexplode(head).alias("_at", "_x")).select("_p", "_c", "_n", "_at", F.col("_x._t").alias("_t")), "paragraph-heads")
    del order
    finished(texts.sparkSession, d, often)
    open_ = stored(heads.groupBy("_t").agg(F.min("_c").alias("_lo"), F.max("_c").alias("_hi")).filter("_lo <> _hi").select("_t"), "paragraph-open")
    d = stored(heads.join(open_, "_t"), "paragraph-meet")
    finished(texts.sparkSession, heads, open_)
    a, b = (d.select("_t", F.col("_p").alias(x), F.col("_c").alias(f"_c{x}"), F.col("_n").alias(f"_n{x}"), F.col("_at").alias(f"_at{x}")) for x in "ab")
    need = F.ceil((F.col("_na") + F.col("_nb")) * (similarity / (1 + similarity)) - 1e-9)
    reach = F.least(F.col("_na") - F.col("_ata"), F.col("_nb") - F.col("_atb"))
    return a.join(b, (a["_t"] == b["_t"]) & (F.col("_ca") < F.col("_cb")) & (reach >= need)).select("a", "b").distinct(), d


def connect(links: DataFrame) -> DataFrame:
    """``_p, component`` of every paragraph with a link."""
    e = links.withColumn("_g", F.lit(0))
    ends = e.select("_g", F.col("a").alias("_p")).union(e.select("_g", F.col("b").alias("_p"))).distinct()
    return components(e, ends, "_g", node="_p").select("_p", "component")


def similar(nodes: DataFrame, words: int, similarity: float, bands: int, rows: int) -> tuple[DataFrame, list[DataFrame]]:
    """``_p, component`` of the distinct texts (``_p, _text``) that pairs of that similarity join, and the tables written for it."""
    maker = Bands(bands, rows)

    @F.arrow_udf("array<long>")
    def keys(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array([maker.keys(shingles(t.as_py(), words)) for t in texts], pa.list_(pa.int64()))

    d = stored(nodes.select("_p", F.explode(keys("_text")).alias("_k")), "paragraph-bands")
    crowd = stored(d.groupBy("_k").agg(F.min("_p").alias("_low"), F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("_k", "_low"), "paragraph-keys")
    met = stored(d.join(crowd, "_k"), "paragraph-met")
    joined, used = settle(met, nodes, words, similarity)
    return joined, [d, crowd, met, *used]


def settle(met: DataFrame, nodes: DataFrame, words: int, similarity: float) -> tuple[DataFrame, list[DataFrame]]:
    """``_p, component`` of the texts that meet under a key (``_p, _k`` and the first of the key, ``_low``), verified in two rounds."""
    spark = met.sparkSession
    links = stored(verify(met.filter("_p <> _low").select(F.col("_low").alias("a"), F.col("_p").alias("b")).distinct(), nodes, words, similarity), "paragraph-links")
    finished(spark)

    label = F.coalesce("component", "_p").alias("_c")
    labels = stored(met.join(connect(links), "_p", "left").select("_k", "_p", label), "paragraph-labels")
    finished(spark)
    mixed = stored(labels.groupBy("_k").agg(F.min("_c").alias("_a"), F.max("_c").alias("_b")).filter("_a <> _b").select("_k"), "paragraph-mixed")
    members = stored(labels.join(mixed, "_k", "left_semi").select("_p", "_c").distinct(), "paragraph-members")
    finished(spark, labels, mixed)
    pairs, table = prefix_pairs(members, nodes, words, similarity)
    more = stored(verify(pairs, nodes, words, similarity), "paragraph-more")
    del pairs
    finished(spark, members, table)
    return connect(links.unionByName(more)), [links, more]


def repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8, bands: int = 6, rows: int = 2) -> DataFrame:
    """Paragraphs that occur again, exactly or nearly: one row for each occurrence.

    Paragraphs are the units of ``borders``: they cover the whole text, whatever its lines, and a passage that stands
    in two texts is cut alike in both. Returns ``doc_id, paragraph, word, n_words, class_doc_id, class_paragraph, class_size,
    removed``: the number of the unit, the place of its first word (from 0) and how many it has. The first occurrence of a class (smallest id,
    then place) is its name and stays, the others are removed.

    Equal units are one node. Band keys (6 of 2 minima find a pair of similarity 0.8 with a
    probability of 0.998) bring colliding units together in two rounds: each is verified against the first of its key;
    then the units of keys that those links have not joined into one are paired with each other as
    ``prefix_pairs`` says and verified. So a large group of near copies costs in proportion to its rows, and no
    colliding pair that can be similar goes unchecked. Units of fewer than ``words`` words are one shingle: they meet their equals only.

    Null, empty and blank texts have no units; null ids sort last; repeated rows are occurrences of their own (repeats of
    the first stay with it); an empty table gives no rows; other columns are not read. Texts of any length are taken whole; a unit
    without borders (one word over and over) is as long as that stretch.
    """
    spark = docs.sparkSession
    cut = stored(units(docs, id_col, text_col, words, Bands(bands, rows)), "paragraph-units", "zstd")
    short = F.xxhash64("_h")  # tells the digests of one key apart
    same_key = Window.partitionBy("_k")
    found = []
    for band in range(bands):  # one at a time, so that disk follows the units and not units x bands
        keys = cut.select("_h", F.col("_keys")[band].alias("_k")).withColumns({"_a": F.min(short).over(same_key), "_b": F.max(short).over(same_key)})
        found.append(stored(keys.filter("_a <> _b").select("_h", "_k").distinct(), "paragraph-meeting"))
        del keys
        finished(spark)
    meet = reduce(DataFrame.unionByName, found)
    wanted = stored(meet.select("_h").distinct(), "paragraph-wanted")
    parts = []
    for turn in range(TURNS):  # a part of the digests each, so that one part of the texts is dealt out at a time
        texts = cut.filter(F.pmod(short, F.lit(TURNS)) == turn).groupBy("_h").agg(F.first("_text").alias("_text"))
        number = F.monotonically_increasing_id() + F.lit(turn << 58)
        parts.append(stored(texts.join(wanted.hint("merge"), "_h", "left_semi").withColumn("_p", number), "paragraph-texts"))
        del texts
        finished(spark)
    nodes = reduce(DataFrame.unionByName, parts)
    places = stored(cut.select("_id", "_no", "_word", "_n", "_h"), "paragraph-places", "zstd")
    finished(spark, cut, wanted)
    plain = stored(meet.join(nodes.select("_h", "_p"), "_h").select("_k", "_p"), "paragraph-nodes")
    met = stored(plain.join(plain.groupBy("_k").agg(F.min("_p").alias("_low")), "_k"), "paragraph-met")
    del meet
    finished(spark, *found, plain)
    joined, used = settle(met, nodes, words, similarity)

    named = stored(nodes.select("_h", "_p").join(joined, "_p").select("_h", F.concat(F.lit("component "), F.col("component").cast("string")).cast("binary").alias("_c")), "paragraph-classes")
    told = places.join(named.hint("merge"), "_h", "left")
    told = stored(told.select("_id", "_no", "_word", "_n", F.coalesce("_c", "_h").alias("_c")), "paragraph-told")
    place = F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("id"), F.col("_no").alias("no"))
    best = stored(told.groupBy("_c").agg(F.min(place).alias("_first"), F.count(F.lit(1)).alias("_size")).filter("_size > 1"), "paragraph-first")
    finished(spark, places, *parts, met, named, *used)
    out = told.join(best.hint("merge"), "_c")
    return out.select(F.col("_id").alias("doc_id"), F.col("_no").alias("paragraph"), F.col("_word").alias("word"), F.col("_n").alias("n_words"), F.col("_first.id").alias("class_doc_id"),
                      F.col("_first.no").alias("class_paragraph"), F.col("_size").alias("class_size"), (~(F.col("_id").eqNullSafe(F.col("_first.id")) & (F.col("_no") == F.col("_first.no")))).alias("removed"))


def near_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None, words: int = 5, similarity: float = 0.8, bands: int = 16, rows: int = 4) -> DataFrame:
    """The ``carry`` columns in ``doc``, with ``component_id`` and ``kept``: whole texts joined by pairs of that exact Jaccard similarity.

    Found as ``repeated`` finds paragraphs. One row of each component is kept: the smallest id (null ids last), or any one of its repeats.
    Null and wordless texts are equal; an empty table gives no rows.
    """
    carry = docs.columns if carry is None else carry
    text = F.trim(F.regexp_replace(F.lower(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))), BLANKS, " "))
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in carry]).alias("_d"), F.col(f"`{id_col}`").alias("_id"), text.alias("_text"))
    d = stored(d.withColumn("_h", F.unhex(F.sha2("_text", 256))).withColumn("_row", F.monotonically_increasing_id()), "near-rows")
    nodes = stored(d.groupBy("_h").agg(F.first("_text").alias("_text")).withColumn("_p", F.monotonically_increasing_id()), "near-texts")
    joined, used = similar(nodes, words, similarity, bands, rows)
    named = stored(nodes.select("_h", "_p").join(joined, "_p", "left").select("_h", F.coalesce("component", "_p").alias("_c")), "near-classes")
    first = F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("id"), F.col("_row").alias("row"))
    told = d.select("_h", "_id", "_row").join(named, "_h")
    best = stored(told.groupBy("_c").agg(F.min(first).alias("_best")), "near-best")
    labels = stored(told.join(best, "_c").select("_row", "_best"), "near-labels")
    finished(docs.sparkSession, nodes, named, best, *used)
    return d.join(labels, "_row").select(F.col("_d").alias("doc"), F.col("_best.id").alias("component_id"), (F.col("_row") == F.col("_best.row")).alias("kept"))
