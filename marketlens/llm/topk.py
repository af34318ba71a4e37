"""Exact top-k inner products over vectors bucketed by length."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketlens.llm.common import parts, stored


def quantised(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 64) -> DataFrame:
    """``_id, _v``: floor(scale * x) of every component; rows with a null or non-finite component, vector or id are left out.

    An id that occurs with several vectors keeps each of them, as query and as candidate; equal rows count once.
    """
    x = F.col(f"`{vec_col}`")
    bad = F.exists(x, lambda e: e.isNull() | F.isnan(e.cast("double")) | (F.abs(e.cast("double")) == float("inf")))
    d = vectors.filter(x.isNotNull() & F.col(f"`{id_col}`").isNotNull()).filter(~bad)
    d = d.select(F.col(f"`{id_col}`").cast("long").alias("_id"), F.transform(x, lambda e: F.floor(e.cast("double") * scale)).alias("_v"))
    return d.distinct()


class Search:
    """The best ``k`` so far for a block of queries of one dimension, fed with buckets of falling length."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int, steep: float = 0.8, coordinates: int = 3):
        self.ids, self.k, self.steep, self.coordinates = ids, k, steep, coordinates
        self.whole, self.vectors = vectors, vectors.astype(np.float64)
        self.length = np.sqrt((self.vectors ** 2).sum(1))
        self.floor = np.full(len(ids), -np.inf)  # the k-th best score so far
        self.best = (np.zeros(0, np.int64),) * 3  # query, vector id, score
        with np.errstate(invalid="ignore", divide="ignore"):
            self.unit = np.nan_to_num(self.vectors / self.length[:, None])
        self.order = np.argsort(-np.abs(self.unit), axis=1, kind="stable")[:, :coordinates]

    def feed(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        """One bucket; rows in order of falling length."""
        data = vectors.astype(np.float64)
        length = np.sqrt((data ** 2).sum(1))
        top = length[0]
        with np.errstate(invalid="ignore", divide="ignore"):
            local = np.nan_to_num(self.floor / (self.length * top), nan=-np.inf, neginf=-np.inf, posinf=np.inf)
        # A cosine no vector of the bucket can reach: the bucket is out for the query.
        live = np.flatnonzero((local <= 1 + 1e-9) | (self.length * top == 0) & (self.floor <= 0))
        by_coordinate = live[local[live] >= self.steep]
        by_length = live[local[live] < self.steep]
        found = []
        if len(by_length):
            # Only vectors long enough for some query of the group; the others are shorter than all need.
            need = np.where(self.floor[by_length] > 0, self.floor[by_length] / np.maximum(self.length[by_length], 1e-300), 0).min()
            n = int(np.searchsorted(-length, -need * (1 - 1e-9), side="right"))
            if n:
                scores = self.product(by_length, vectors[:n], data[:n])
                least = self.floor[by_length]
                if n > self.k:  # more than k of this bucket alone, the query's own rows aside
                    others = np.where(ids[:n] == self.ids[by_length][:, None], np.iinfo(np.int64).min, scores)
                    least = np.maximum(least, np.partition(others, n - self.k, axis=1)[:, n - self.k])
                q, c = np.nonzero(scores >= least[:, None])
                found.append((by_length[q], ids[c], scores[q, c]))
        if len(by_coordinate):
            with np.errstate(invalid="ignore", divide="ignore"):
                unit = np.nan_to_num(data / length[:, None])
            for q in by_coordinate:
                t = min(1.0, local[q])
                mask = np.ones(len(ids), bool)
                for f in self.order[q]:
                    a = self.unit[q, f]
                    slack = np.sqrt(max(0.0, 1 - a * a)) * np.sqrt(max(0.0, 1 - t * t)) + 1e-9
                    if a > -t:
                        mask &= unit[:, f] >= a * t - slack
                    if a < t:
                        mask &= unit[:, f] <= a * t + slack
                c = np.flatnonzero(mask)
                if len(c):
                    scores = self.product(np.array([q]), vectors[c], data[c])[0]
                    keep = scores >= self.floor[q]
                    found.append((np.full(keep.sum(), q), ids[c[keep]], scores[keep]))
        if found:
            self.merge(*map(np.concatenate, zip(*found)))

    def product(self, queries: np.ndarray, whole: np.ndarray, data: np.ndarray) -> np.ndarray:
        """Integer products; doubles hold them exactly unless lengths are extreme."""
        if self.length[queries].max() * np.sqrt((data ** 2).sum(1).max()) < 2.0 ** 52:
            return (self.vectors[queries] @ data.T).astype(np.int64)
        return self.whole[queries] @ whole.T

    def merge(self, query: np.ndarray, vector: np.ndarray, score: np.ndarray) -> None:
        other = vector != self.ids[query]
        query, vector, score = (np.concatenate(p) for p in zip(self.best, (query[other], vector[other], score[other])))
        order = np.lexsort((vector, -score, query))
        query, vector, score = query[order], vector[order], score[order]
        first = np.searchsorted(query, query, side="left")
        keep = np.arange(len(query)) - first < self.k
        self.best = (query[keep], vector[keep], score[keep])
        counts = np.bincount(query[keep], minlength=len(self.ids))
        ends = np.cumsum(counts) - 1
        full = counts == self.k
        self.floor[full] = self.best[2][ends[full]]


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, block: int = 4096, bucket: int = 1024, spread: float = 0.95) -> DataFrame:
    """The ``k`` highest integer inner products of each query with every other vector: ``query_id, rank, vec_id, score``.

    ``vectors`` comes from ``quantised``; ``is_query`` is a condition on ``_id``. Queries are dealt into blocks of about
    ``block`` and candidates into groups, so that block times group fills the partitions; every block meets every
    group once, as rows that stream by falling length. A task cuts the stream into buckets (at most ``bucket``
    rows whose lengths differ by less than ``spread``) and knows the k-th best score of each query so far. The
    cosine this asks for in a bucket decides: none can reach it (skip), a low one (only vectors long enough,
    as one matrix product), a high one (only vectors whose largest query coordinates lie in the range
    that the cosine allows, then products). Last, the groups' best are ranked, at most k of each.

    Of equal vectors the k + 1 smallest ids are enough for any query, so a hot vector is cut before the search.
    Ties go to the smaller id. Vectors of another dimension are no candidates. With fewer candidates all are
    returned; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    d = vectors.withColumn("_copy", F.row_number().over(Window.partitionBy("_v").orderBy("_id")))
    # Copies beyond k + 1 are cut on every task before the shuffle (a group limit); they can still be queries.
    rows = stored(d.filter(F.col("_copy") <= k + 1).select("_id", "_v"), "search-vectors")
    asked = stored(vectors.filter(is_query).select("_id", "_v"), "search-queries")
    n = asked.count()
    blocks = max(1, -(-n // block))
    groups = max(1, -(-parts(spark) // blocks))
    square = F.aggregate("_v", F.lit(0.0), lambda a, e: a + e.cast("double") * e.cast("double"))
    size = F.size("_v")
    all_groups, all_blocks = F.array(*map(F.lit, range(groups))), F.sequence(F.lit(0), F.lit(blocks - 1))
    left = asked.select(F.pmod(F.xxhash64("_id"), F.lit(blocks)).cast("int").alias("_b"), F.explode(all_groups).alias("_g"), size.alias("_dim"), F.lit(0).alias("_kind"), F.lit(0.0).alias("_square"), "_id", "_v")
    right = rows.select(F.explode(all_blocks).alias("_b"), F.pmod(F.xxhash64("_id", F.lit(1)), F.lit(groups)).cast("int").alias("_g"), size.alias("_dim"), F.lit(1).alias("_kind"), square.alias("_square"), "_id", "_v")
    stream = left.unionByName(right).repartition(parts(spark), "_b", "_g").sortWithinPartitions("_b", "_g", "_dim", "_kind", F.desc("_square"), "_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, search, pending = None, None, []

        def result() -> Iterator[pa.RecordBatch]:
            if search is not None:
                q, v, s = search.best
                yield pa.RecordBatch.from_arrays([pa.array(search.ids[q]), pa.array(v), pa.array(s)], ["query_id", "vec_id", "score"])

        for batch in batches:
            cell = np.stack([batch.column(c).to_numpy() for c in ("_b", "_g", "_dim", "_kind")], 1)
            ids, squares, lists = batch.column("_id").to_numpy(), batch.column("_square").to_numpy(), batch.column("_v")
            cuts = np.flatnonzero((cell[1:] != cell[:-1]).any(1)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(cell)]):
                *key, kind = cell[a].tolist()
                if key != at:
                    yield from result()
                    at, search, pending = key, None, []
                matrix = lists.slice(a, b - a).flatten().to_numpy().reshape(b - a, key[2])
                if kind == 0:
                    pending.append((ids[a:b], matrix))
                    continue
                if pending:
                    search, pending = Search(*(np.concatenate(x) for x in zip(*pending)), k), []
                if search is None:
                    continue
                lo = a
                while lo < b:
                    hi = min(b, lo + bucket)
                    hi = max(lo + 1, lo + int(np.searchsorted(-squares[lo:hi], -squares[lo] * spread ** 2, side="right")))
                    search.feed(ids[lo:hi], matrix[lo - a : hi - a])
                    lo = hi
        yield from result()

    best = stream.mapInArrow(run, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
