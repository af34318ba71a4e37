"""Repeated substrings through a column-wise collection of aligned contexts."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens.llm.bpe import slices
from marketlens.llm.common import finished, stored

LATE = (1 << 63) - 1


class Anchors:
    """Picks byte positions so that equal strings of ``length`` bytes hold the same picks at the same places.

    Of every ``length`` bytes the ``grain``-byte grams with the smallest hash are picked (all that tie), a function of
    those bytes alone. So two equal strings share a pick, and only grams picked in two texts can lie in one.
    """

    def __init__(self, length: int, grain: int = 20, seed: int = 11):
        self.length, self.grain, self.width = length, grain, length - grain + 1
        rng = np.random.default_rng(seed)
        self.table = rng.integers(0, 1 << 63, 256, dtype=np.uint64)
        base = int(rng.integers(0, 1 << 62)) * 2 + 1
        self.step = (np.uint64(base), np.uint64(pow(base, -1, 1 << 64)))
        self.other = rng.integers(0, 1 << 63, 256, dtype=np.uint64)
        self.power = (np.ones(1, np.uint64), np.ones(1, np.uint64))

    def _powers(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The first ``n`` powers of the base and of its inverse, modulo 2^64."""
        while len(self.power[0]) < n:
            self.power = tuple(np.concatenate([p, p * (p[-1:] * s)]) for p, s in zip(self.power, self.step))
        return self.power[0][:n], self.power[1][:n]

    @staticmethod
    def _slide(x: np.ndarray, width: int, best: np.ufunc) -> np.ndarray:
        """The best of every ``width`` neighbours from a place on."""
        reach = 1
        while reach * 2 <= width:
            x = best(x[: len(x) - reach], x[reach:])
            reach *= 2
        extra = width - reach
        return best(x[: len(x) - extra], x[extra:]) if extra else x

    def pick(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places and hashes of the picks in ``data``, texts laid end to end that stop at ``ends``."""
        n, k, w = len(data), self.grain, self.width
        if n < self.length:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        power, inverse = self._powers(n)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(self.table[data] * power, out=total[1:])
        h = (total[k:] - total[:-k]) * inverse[: n - k + 1]
        h ^= h >> np.uint64(31)
        h *= np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        np.maximum(h, 1, out=h)
        low = self._slide(h, w, np.minimum)
        # Strings that reach into the next text pick nothing.
        start = np.append(0, ends[:-1])
        for a, b in zip(start.tolist(), ends.tolist()):
            low[max(a, b - self.length + 1) : b] = 0
        padded = np.concatenate([np.zeros(w - 1, np.uint64), low, np.zeros(len(h) - len(low), np.uint64)])
        high = self._slide(padded, w, np.maximum)
        at = np.flatnonzero(high[: len(h)] == h)
        return at, h[at]

    def context_keys(self, data: np.ndarray, place: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Keys of the contexts of the picks at ``place``: all bytes of the strings that hold a pick, as far as its text, ``start`` to ``end``, goes.

        Their hash is of another table than the picks', so picks of one hash and contexts of one key are unlike only if two hashes fail at once.
        """
        left = self.length - self.grain
        low, high = np.maximum(start, place - left), np.minimum(end, place + self.length)
        power, inverse = self._powers(len(data))
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.other[data] * power, out=total[1:])
        x = (total[high] - total[low]) * inverse[low]
        x ^= x >> np.uint64(31)
        x = x * np.uint64(0x9E3779B97F4A7C15) + ((low - place + left) * 4 * self.length + (high - low)).astype(np.uint64)
        x ^= x >> np.uint64(29)
        return x * np.uint64(0xBF58476D1CE4E5B9)


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(texts), np.uint8), np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))


class Columns:
    """Column-wise construction over contexts aligned at their anchor.

    ``table`` holds one context a row, the anchor at the same place in each. Round by round, from the last
    column to the first, one symbol of every context is put in front of its suffix: the suffixes stay sorted by
    a stable sort of that column (the new column of the collection's transform, read in the order so far),
    and the prefix that neighbours share follows from the smallest shared prefix between their old places.
    Contexts are aligned, so suffixes of different rounds never need comparing and each round needs only the
    order and prefixes of the one before, read once from end to end.
    """

    def __init__(self, table: np.ndarray):
        self.table = table
        self.order = np.arange(len(table))
        self.shared = np.zeros(len(table), np.int32)  # with the row before; 0 for the first

    def insert(self, column: int) -> None:
        symbols = self.table[self.order, column]
        turn = np.argsort(symbols, kind="stable")
        n = len(turn)
        if n > 1:
            least = [self.shared]
            reach = 1
            while reach * 2 < n:
                x = least[-1]
                least.append(np.minimum(x[: len(x) - reach], x[reach:]))
                reach *= 2
            sorted_symbols = symbols[turn]
            same = sorted_symbols[1:] == sorted_symbols[:-1]
            low, high = turn[:-1][same] + 1, turn[1:][same] + 1  # old places after the former up to the latter
            level = np.frexp(high - low)[1] - 1
            between = np.empty(len(low), np.int32)
            for v in np.unique(level):
                pick = level == v
                between[pick] = np.minimum(least[v][low[pick]], least[v][high[pick] - (1 << v)])
            fresh = np.zeros(n, np.int32)
            fresh[1:][same] = between + 1
            self.shared = fresh
        self.order = self.order[turn]

    def earliest(self, length: int, valid: np.ndarray, age: np.ndarray) -> np.ndarray:
        """For every context the least ``age`` among those with the same next ``length`` bytes; only ``valid`` ones count."""
        run = np.cumsum(self.shared < length) - 1
        out = np.full(len(age), LATE)
        seen = np.full(run[-1] + 1, LATE)
        ok = valid[self.order]
        np.minimum.at(seen, run[ok], age[self.order][ok])
        out[self.order] = seen[run]
        out[~valid] = LATE
        return out


def masks(contexts: np.ndarray, low: np.ndarray, high: np.ndarray, age: np.ndarray, length: int, width: int) -> np.ndarray:
    """A bit for each of the ``width`` places a string can start at in a context: whether an earlier text has the string."""
    columns, out = Columns(contexts), np.zeros(len(contexts), np.int64)
    for c in range(contexts.shape[1] - 1, -1, -1):
        columns.insert(c)
        if c < width:
            first = columns.earliest(length, (low <= c) & (high >= c + length), age)
            out |= (first < age).astype(np.int64) << c
    return out


def covered(size: int, length: int, width: int, places: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Starts and ends of the maximal runs of removed bytes; ``places`` are where contexts begin, maybe before the text."""
    starts = np.unique(np.concatenate([places[(bits >> c & 1) == 1] + c for c in range(width)]) if len(places) else places)
    starts = starts[(starts >= 0) & (starts + length <= size)]
    if not len(starts):
        return np.zeros((0, 2), np.int64)
    gap = np.flatnonzero(starts[1:] > starts[:-1] + length)
    return np.stack([starts[np.append(0, gap + 1)], starts[np.append(gap, len(starts) - 1)] + length], 1)


class Meetings:
    """Says of every place of an anchor, one anchor after the other, what it has to do with earlier texts.

    Rows come by anchor, context and age. A place whose context an earlier text has is ``later``: all its strings are
    repeated. The others of an anchor are compared byte by byte if it has several contexts and ages, and are left out
    if it has not. An anchor of more than ``hold`` places is told in pieces and compared in any case.
    """

    FIELDS = ["_a", "_k", "_o", "_d", "_s"]

    def __init__(self, hold: int):
        self.hold, self.held, self.open = hold, [], None

    def add(self, rows: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        self.held.append(rows)
        if sum(len(x[0]) for x in self.held) >= self.hold:
            rows = [np.concatenate(x) for x in zip(*self.held)]
            cut = int(np.searchsorted(rows[0], rows[0][-1]))  # the last anchor may go on
            self.held = [[x[cut:] for x in rows]] if cut else []
            yield self.tell([x[:cut] for x in rows] if cut else rows, not cut)

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.held and sum(len(x[0]) for x in self.held):
            yield self.tell([np.concatenate(x) for x in zip(*self.held)], False)

    def tell(self, rows: list[np.ndarray], goes_on: bool) -> pa.RecordBatch:
        a, k, o, d, s = rows
        fresh = np.append(True, a[1:] != a[:-1])
        context = fresh | np.append(True, k[1:] != k[:-1])
        at, anchor = np.flatnonzero(fresh), np.cumsum(fresh) - 1
        first = o[context]
        compare = (np.minimum.reduceat(o, at) < np.maximum.reduceat(o, at)) & (np.bincount(anchor[context]) > 1)
        if self.open is not None and self.open[0] == a[0]:
            compare[0] = True
            if self.open[1] == k[0]:
                first[0] = self.open[2]
        compare[-1] |= goes_on
        self.open = (a[-1], k[-1], first[-1]) if goes_on else None
        later = o > first[np.cumsum(context) - 1]
        keep = np.flatnonzero(later | compare[anchor])
        later = later[keep]
        return pa.RecordBatch.from_arrays([pa.array(np.where(later, 0, a[keep])), pa.array(d[keep]), pa.array(s[keep]), pa.array(later)], ["_a", "_d", "_s", "_later"])


def repeats(docs: DataFrame, length: int = 50, id_col: str = "doc_id", text_col: str = "text", grain: int = 20, crowd: int = 20_000, chunk: int = 50_000, rounds: int = 3) -> DataFrame:
    """Bytes of each text that lie in a string of ``length`` bytes found in a text of a smaller id.

    Returns ``_id, n_bytes, spans, kept_sha256``: ``spans`` are the maximal removed runs as [start, end). Every row of
    ``docs`` gets a row.

    1. Equal texts become one, with their smallest id; later copies are removed whole.
    2. Anchors (see ``Anchors``) found in texts of two ids or more mark the only places where strings can repeat. Anchors are
       met in ``rounds``, a part of the hashes each, so that one part lies on disk at a time; only numbers travel.
    3. A place has a context: all bytes of the strings that hold the anchor. Where an earlier text has the whole context,
       each of its strings is repeated; where an anchor has one context only, the first text repeats nothing.
    4. The contexts that are left are dealt out by anchor and a column-wise collection is built over each chunk of whole anchors;
       neighbours that share ``length`` bytes and an earlier id mark the repeated strings.
    5. The marks go back to the texts by place.

    An anchor with more than ``crowd`` contexts is too much for a chunk: its strings are grouped one by one
    instead, with the same result. Null texts are empty; a null id counts as later than all others; rows of one id
    do not remove from each other; an empty table gives no rows.
    """
    anchors, width, reach = Anchors(length, grain), length - grain + 1, 2 * length - grain
    left = length - grain  # columns before the anchor
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").alias("_id"), F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(LATE)).alias("_o"), text.cast("binary").alias("_t")).withColumn("_h", F.unhex(F.sha2("_t", 256)))
    texts = rows.groupBy("_h").agg(F.min("_o").alias("_o"), F.first("_t").alias("_t"))
    spark = docs.sparkSession
    texts = stored(texts.withColumn("_d", F.monotonically_increasing_id()), "substring-texts")
    finished(spark)

    def picks(turn: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at = 0
                for texts in slices(batch.column("_t"), 1 << 20):
                    data, ends = joined(texts)
                    place, h = anchors.pick(data, ends)
                    mine = (h >> np.uint64(40)) % np.uint64(rounds) == turn
                    place, h = place[mine], h[mine]
                    owner = np.searchsorted(ends, place, side="right")
                    start = np.append(0, ends[:-1])[owner]
                    k = anchors.context_keys(data, place, start, ends[owner])
                    ids, ages = (batch.column(c).slice(at, len(texts)).to_numpy()[owner] for c in ("_d", "_o"))
                    at += len(texts)
                    yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(k.view(np.int64)), pa.array(ages), pa.array(ids), pa.array((place - start - left).astype(np.int32))], Meetings.FIELDS)

        return run

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        meetings = Meetings(chunk)
        for batch in batches:
            if len(batch):
                yield from meetings.add([batch.column(c).to_numpy() for c in Meetings.FIELDS])
        yield from meetings.rest()

    told = []
    for turn in range(rounds):
        found = texts.filter(F.length("_t") >= length).select("_d", "_o", "_t").mapInArrow(picks(turn), "_a long, _k long, _o long, _d long, _s int")
        found = found.repartition("_a").sortWithinPartitions("_a", "_k", "_o").mapInArrow(meet, "_a long, _d long, _s int, _later boolean")
        told.append(stored(found, "substring-places"))
        del found
        finished(spark)
    places = reduce(DataFrame.unionByName, told)

    # Contexts, padded to one width; _lo and _hi bound the bytes that are the text's own.
    per = places.filter("NOT _later").groupBy("_d").agg(F.collect_list(F.struct("_s", "_a")).alias("_x"))  # bounded by the text's length

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, o, t, x in zip(batch.column("_d"), batch.column("_o"), batch.column("_t"), batch.column("_x"), strict=True):
                raw, x = t.as_py(), x.values
                place, a = x.field("_s"), x.field("_a")
                start = place.to_numpy().astype(np.int64)
                low, high = np.maximum(0, -start), np.minimum(reach, len(raw) - start)
                padded = np.zeros(len(raw) + 2 * reach, np.uint8)
                padded[reach : reach + len(raw)] = np.frombuffer(raw, np.uint8)
                for i in range(0, len(start), 50_000):
                    s = slice(i, i + 50_000)
                    table = np.lib.stride_tricks.sliding_window_view(padded, reach)[start[s] + reach]
                    n = len(table)
                    yield pa.RecordBatch.from_arrays([a.slice(i, n), pa.array(np.full(n, d.as_py())), pa.array(np.full(n, o.as_py())), place.slice(i, n), pa.array(low[s].astype(np.int16)), pa.array(high[s].astype(np.int16)),
                                                      pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((np.arange(n + 1) * reach).astype(np.int32)), pa.py_buffer(table.tobytes())])], ["_a", "_d", "_o", "_s", "_lo", "_hi", "_c"])

    near = texts.select("_d", "_o", "_t").join(per.hint("merge"), "_d").select("_d", "_o", "_t", "_x")
    near = stored(near.mapInArrow(contexts, "_a long, _d long, _o long, _s int, _lo short, _hi short, _c binary"), "substring-contexts", "zstd")
    del per
    finished(spark)
    sizes = stored(near.groupBy("_a").count().filter(F.col("count") > crowd).select("_a"), "substring-crowds")

    def marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def build(t: pa.Table) -> pa.RecordBatch:
            table = np.frombuffer(b"".join(t.column("_c").to_pylist()), np.uint8).reshape(-1, reach)
            bits = masks(table, t.column("_lo").to_numpy(), t.column("_hi").to_numpy(), t.column("_o").to_numpy(), length, width)
            hit = np.flatnonzero(bits)
            return pa.RecordBatch.from_arrays([t.column("_d").combine_chunks().take(pa.array(hit)), t.column("_s").combine_chunks().take(pa.array(hit)), pa.array(bits[hit])], ["_d", "_s", "_bits"])

        for batch in batches:
            held.append(batch)
            if sum(map(len, held)) >= chunk:
                t = pa.Table.from_batches(held)
                a = t.column("_a").to_numpy()
                cut = int(np.searchsorted(a, a[-1]))  # the last anchor may go on
                if cut:
                    yield build(t.slice(0, cut))
                    held = t.slice(cut).to_batches()
        if held and sum(map(len, held)):
            yield build(pa.Table.from_batches(held))

    calm = near.join(sizes, "_a", "left_anti").repartition("_a").sortWithinPartitions("_a")
    calm = calm.select("_a", "_d", "_o", "_s", "_lo", "_hi", "_c").mapInArrow(marks, "_d long, _s int, _bits long")
    busy = near.join(sizes, "_a").select("_a", "_d", "_o", "_s", "_lo", "_hi", "_c", F.explode(F.array(*map(F.lit, range(width)))).alias("_w"))
    busy = busy.filter((F.col("_lo") <= F.col("_w")) & (F.col("_hi") >= F.col("_w") + length)).select("_a", "_d", "_o", "_s", "_w", F.sha2(F.substring("_c", F.col("_w") + 1, F.lit(length)), 256).alias("_h"))
    least = busy.groupBy("_a", "_w", "_h").agg(F.min("_o").alias("_least"))
    busy = busy.join(least, ["_a", "_w", "_h"]).filter("_least < _o").groupBy("_d", "_s").agg(F.bit_or(F.expr("shiftleft(1L, _w)")).alias("_bits"))
    marked = stored(calm.unionByName(busy), "substring-marks")
    del calm, busy, least
    finished(spark, near, sizes)

    every = F.lit((1 << width) - 1)  # an earlier text has the whole context: each string of it is repeated
    hits = places.filter("_later").select("_d", "_s", every.alias("_bits")).unionByName(marked)
    hits = hits.groupBy("_d").agg(F.collect_list(F.struct("_s", "_bits")).alias("_x"))

    @F.pandas_udf("spans array<array<long>>, kept_sha256 string")
    def rest(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for raws, lists in batches:
            out = []
            for raw, x in zip(raws, lists, strict=True):
                if x is None:
                    out.append(([], hashlib.sha256(raw).hexdigest()))
                    continue
                place, bits = (np.fromiter((r[f] for r in x), np.int64, len(x)) for f in ("_s", "_bits"))
                spans = covered(len(raw), length, width, place, bits)
                digest, at = hashlib.sha256(), 0
                for a, b in spans.tolist():
                    digest.update(raw[at:a])
                    at = b
                digest.update(raw[at:])
                out.append((spans.tolist(), digest.hexdigest()))
            yield pd.DataFrame(out, columns=["spans", "kept_sha256"])

    done = texts.join(hits.hint("merge"), "_d", "left").select("_h", "_o", rest("_t", "_x").alias("_r"))
    done = stored(done.select("_h", F.col("_o").alias("_first"), "_r"), "substring-done")
    finished(spark, texts, *told, marked)
    d = rows.select("_id", "_o", "_h", F.length("_t").cast("long").alias("n_bytes")).join(done.hint("merge"), "_h")
    copy = (F.col("_o") > F.col("_first")) & (F.col("n_bytes") >= length)
    return d.select("_id", "n_bytes", F.when(copy, F.array(F.array(F.lit(0).cast("long"), F.col("n_bytes")))).otherwise(F.col("_r.spans")).alias("spans"),
                    F.when(copy, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.col("_r.kept_sha256")).alias("kept_sha256"))
