"""Whitened embeddings: pivoted Cholesky of the centred scatter, one-sided Jacobi on the triangular factor."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vector: Column) -> Column:
    """No null vector, no null, NaN or infinite entry, one entry at least."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vector) > 0) & fine, F.lit(False))


def factor(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cholesky with the largest remaining diagonal entry as pivot: rows in their own order, one column a pivot, up to the numeric rank."""
    a, d = a.astype(float), len(a)
    left, out = np.diag(a).copy(), []
    stop = d * np.finfo(float).eps * max(left.max(initial=0.0), 0.0)
    chosen = np.zeros(d, bool)
    for _ in range(d):
        p = int(np.argmax(np.where(chosen, -np.inf, left)))
        if left[p] <= stop:
            break
        column = a[:, p].copy()
        for c in out:
            column -= c * c[p]
        column[chosen] = 0.0
        column /= np.sqrt(left[p])
        column[p] = np.sqrt(left[p])
        chosen[p] = True
        left -= column ** 2
        out.append(column)
    return (np.array(out).T if out else np.zeros((d, 0))), chosen


def rotate(lower: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Squared lengths, falling, and directions of the columns of ``lower`` once plane rotations have made all pairs orthogonal."""
    u = lower.copy()
    r = u.shape[1]
    for _ in range(sweeps):
        worst = 0.0
        for i in range(r - 1):
            for j in range(i + 1, r):
                x, y = u[:, i], u[:, j]
                a, b, g = x @ x, y @ y, x @ y
                if a == 0 or b == 0 or abs(g) <= 1e-15 * np.sqrt(a * b):
                    continue
                worst = max(worst, abs(g) / np.sqrt(a * b))
                z = (b - a) / (2 * g)
                t = (1.0 if z >= 0 else -1.0) / (abs(z) + np.hypot(1.0, z))
                c = 1 / np.hypot(1.0, t)
                u[:, i], u[:, j] = c * (x - t * y), c * (t * x + y)
        if worst < 1e-14:
            break
    values = (u * u).sum(0)
    by = np.argsort(-values, kind="stable")
    return values[by], u[:, by] / np.sqrt(values[by])


@dataclass
class Whitener:
    """What the fit list determines: its size, sums, centred scatter's eigenvalues over n (falling) and unit eigenvectors as columns."""

    n: int
    sums: list[int]
    trace: float
    values: np.ndarray
    vectors: np.ndarray


def matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one length as rows."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def products(y: np.ndarray) -> np.ndarray:
    """Exact sum of the outer products of integer rows: as floats while every sum stays below 2^53, else as Python integers."""
    top = float(np.abs(y).max(initial=0)) ** 2
    step = int(2**53 // max(1.0, top))
    total = np.zeros((y.shape[1],) * 2, object)
    for at in range(0, len(y), max(1, step)):
        x = y[at : at + max(1, step)]
        total += (x.astype(float).T @ x.astype(float)).astype(np.int64).astype(object) if step else x.astype(object).T @ x.astype(object)
    return total


def integers(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 1024, shift: int = 100_000) -> DataFrame:
    """``_id, _v``: floor(scale * c) + shift of every entry c as long, for every usable vector of the commonest length."""
    v = F.col(f"`{vector_col}`").cast("array<double>")
    d = vectors.select(F.col(f"`{id_col}`").alias("_id"), v.alias("_c")).filter(usable(F.col("_c")))
    # The lengths that occur are few; ties go to the longer one.
    size = d.groupBy(F.size("_c").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    d = d.filter(F.size("_c") == (size["size"] if size else 0))
    return d.select("_id", F.transform("_c", lambda c: F.floor(c * scale) + shift).alias("_v"))


def fit(xs: DataFrame) -> Whitener | None:
    """The whitener of all vectors ``_v``; None without a vector.

    The scatter is summed in exact integers about the rounded mean, centred before multiplying; what the rounding leaves is taken off exactly, so
    the result does not depend on how rows are dealt. The driver gets one d x d matrix, which grows with the vectors' length only.
    """
    d = xs.select(F.size("_v").alias("d")).first()
    if d is None:
        return None
    dims = d["d"]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(dims, object)
        for batch in batches:
            if batch.num_rows:
                y = matrix(batch.column(0))
                n += len(y)
                total += y.sum(0) if float(np.abs(y).max()) * len(y) < 2**62 else y.astype(object).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(range(dims), pa.int32()), pa.array([n] * dims, pa.int64()), pa.array([Decimal(int(x)) for x in total], pa.decimal128(38, 0))], ["i", "n", "s"])

    rows = xs.select("_v").mapInArrow(add, "i int, n long, s decimal(38,0)").groupBy("i").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).orderBy("i").collect()
    n, s = rows[0]["n"], [int(r["s"]) for r in rows]
    middle = np.array([x // n for x in s], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dims, dims), object)
        for batch in batches:
            if batch.num_rows:
                total += products(matrix(batch.column(0)) - middle)
        for i in range(dims):
            yield pa.RecordBatch.from_arrays([pa.array([i] * dims, pa.int32()), pa.array(range(dims), pa.int32()), pa.array([Decimal(int(x)) for x in total[i]], pa.decimal128(38, 0))], ["i", "j", "t"])

    scatter = np.zeros((dims, dims), object)
    for r in xs.select("_v").mapInArrow(run, "i int, j int, t decimal(38,0)").groupBy("i", "j").agg(F.sum("t").alias("t")).collect():
        scatter[r["i"], r["j"]] = int(r["t"])
    rest = np.array([x - n * int(m) for x, m in zip(s, middle)], object)
    scatter = (n * scatter - np.outer(rest, rest)) / (n * n)
    scatter = scatter.astype(float)
    lower, _ = factor(scatter)
    values, vectors = rotate(lower)
    return Whitener(n, s, float(np.trace(scatter)), values, vectors)


def whiten(xs: DataFrame, model: Whitener, components: int = 8) -> DataFrame:
    """``_id, component, deviation, whitened`` of every vector ``_v`` and component from 1, up to the rank."""
    k = min(components, len(model.values))
    mean = [divmod(s, model.n) for s in model.sums]
    whole, part = np.array([q for q, _ in mean], np.int64), np.array([r / model.n for _, r in mean])
    spread = model.vectors[:, :k] / np.sqrt(model.values[:k])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = np.array([r for _, r in mean], object)
        for batch in batches:
            m = batch.num_rows
            if not m:
                continue
            y = matrix(batch.column("_v")) - whole
            top = (float(np.abs(y).max(initial=0)) + 1) * model.n
            if top * top * y.shape[1] < 2**62:
                exact = y * model.n - rest.astype(np.int64)
                deviation = (exact * exact).sum(1)
            else:
                exact = y.astype(object) * model.n - rest
                deviation = (exact * exact).sum(1)
            z = (y - part) @ spread
            ids = batch.column("_id").take(pa.array(np.repeat(np.arange(m), k)))
            yield pa.RecordBatch.from_arrays([ids, pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()), pa.array(np.repeat(deviation, k).tolist(), pa.int64()), pa.array(z.reshape(-1), pa.float64())],
                                             ["_id", "component", "deviation", "whitened"])

    return xs.select("_id", "_v").mapInArrow(run, f"_id {xs.schema['_id'].dataType.simpleString()}, component int, deviation long, whitened double")


def identity_error(xs: DataFrame, model: Whitener, components: int = 8) -> float:
    """The largest absolute entry of the whitened vectors' covariance (divisor n, centred before multiplying) minus the identity."""
    k = min(components, len(model.values))
    mean = np.array([s / model.n for s in model.sums])
    spread = model.vectors[:, :k] / np.sqrt(model.values[:k])

    def total(centre: np.ndarray | None) -> np.ndarray:
        """Sums of the whitened vectors, or of their products about ``centre``; every task gives one small row an entry."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = np.zeros(k if centre is None else k * k)
            for batch in batches:
                if batch.num_rows:
                    z = (matrix(batch.column(0)) - mean) @ spread
                    out += z.sum(0) if centre is None else ((z - centre).T @ (z - centre)).reshape(-1)
            yield pa.RecordBatch.from_arrays([pa.array(range(len(out)), pa.int32()), pa.array(out)], ["i", "t"])

        rows = xs.select("_v").mapInArrow(run, "i int, t double").groupBy("i").agg(F.sum("t").alias("t")).orderBy("i").collect()
        return np.array([r["t"] for r in rows])

    if not k:
        return 0.0
    covariance = total(total(None) / model.n).reshape(k, k) / model.n
    return float(np.abs(covariance - np.eye(k)).max())


def whitened(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 8, scale: int = 1024, shift: int = 100_000) -> DataFrame:
    """Every vector on the leading principal components, each brought to variance 1: ``_id, component, n, deviation, whitened, explained, identity_error``.

    Vectors that are null or hold a null or non-finite entry take no part, and neither do empty ones nor those that are not of the commonest
    length (ties: the longer). Entries are made integers by ``scale`` and ``shift``; they stay exact below 2^62. The covariance has fewer components
    than asked for where its rank is lower (equal vectors have none, so no rows). Repeated rows and ids, null ids too, count and return each. An
    empty table gives no rows. Of equal eigenvalues, any basis of their space is a right one; the same serves all rows. A ``deviation`` beyond a long stops the job.
    """
    xs = integers(vectors, id_col, vector_col, scale, shift)
    model = fit(xs)
    if model is None or not len(model.values):
        kind = vectors.schema[id_col].dataType.simpleString()
        return vectors.sparkSession.createDataFrame([], f"_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    share = F.element_at(F.array(*[F.lit(float(v / model.trace)) for v in model.values[:components]]), F.col("component"))
    return whiten(xs, model, components).withColumns({"n": F.lit(model.n).cast("long"), "explained": share, "identity_error": F.lit(identity_error(xs, model, components))})
