"""Language identification with error-correcting output codes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Letters and bytes beyond ASCII stay, everything else is a gap.
KEEP = np.where([chr(b).islower() and b < 128 or b >= 128 for b in range(256)], np.arange(256), 32).astype(np.uint32)
LETTER = regex.compile(r"\p{L}")
PIECE = 1 << 20


def gram_counts(text: str, buckets: int) -> np.ndarray:
    """How often each bucket is hit by the 3- and 4-byte grams of the whole lower-cased text.

    ``buckets`` is a power of two. The text is walked in pieces of 1 MB, so memory does not follow its length.
    """
    out = np.zeros(buckets, np.int64)
    raw = np.frombuffer(b" " + text.lower().encode("utf-8", "replace") + b" ", np.uint8)
    shift = np.uint32(32 - (buckets.bit_length() - 1))
    for at in range(0, len(raw), PIECE):
        x = KEEP[raw[at : at + PIECE + 3]]
        three = x[:-2] | x[1:-1] << np.uint32(8) | x[2:] << np.uint32(16)
        four = three[:-1] | x[3:] << np.uint32(24)
        # Full pieces overlap by three bytes: each gram is counted where it starts.
        for grams in (three[:PIECE], four[:PIECE]):
            out += np.bincount((grams * np.uint32(2654435761)) >> shift, minlength=buckets)
    return out


def code_words(languages: int) -> np.ndarray:
    """One row of +1 and -1 for each language: rows of a Hadamard matrix, any two of which differ in half of the bits.

    Columns that are the same for all languages decide nothing and are left out.
    """
    n = 8
    while n < 2 * languages:
        n *= 2
    a, b = np.meshgrid(np.arange(languages), np.arange(n), indexing="ij")
    bits = 1 - 2 * (np.array([[int(v).bit_count() & 1 for v in row] for row in a & b], dtype=np.int64).reshape(languages, n))
    return bits[:, np.abs(bits.sum(0)) < languages] if languages > 1 else bits[:, :1]


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray      # languages x bits
    weights: np.ndarray   # buckets x bits, log odds of each binary classifier
    trust: np.ndarray     # languages x bits, how far each classifier is right for the language; rows sum to the number of bits

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, score from 0 to 1 and whether the two nearest code words lie too close to tell."""
        if not text or not self.languages or not LETTER.search(text):
            return "und", 0.0, True
        counts = gram_counts(text, len(self.weights))
        n = counts.sum()
        # Mean log odds a gram, as sure as 64 grams can be.
        margin = counts @ self.weights / n * min(n, 64)
        loss = (self.trust * np.logaddexp(0, -self.code * margin)).sum(1)
        p = np.exp(loss.min() - loss)
        p /= p.sum()
        order = np.argsort(loss, kind="stable")
        close = len(order) > 1 and loss[order[1]] - loss[order[0]] < 0.05
        return self.languages[order[0]], float(p[order[0]]), bool(close)


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", buckets: int = 1 << 13) -> Model:
    """Binary n-gram classifiers for the bits of the languages' code words, from all rows of ``docs`` with a language.

    Each task adds up the grams of its rows by language; Spark adds up the tasks. What reaches the driver is
    one count for a language and bucket, a size that does not follow the rows. Languages weigh alike in
    each classifier, however many rows they have. Rows with a null language or text teach nothing.
    """
    src = docs.filter(F.col(f"`{lang_col}`").isNotNull() & F.col(f"`{text_col}`").isNotNull()).select(F.col(f"`{lang_col}`").cast("string").alias("lang"), F.col(f"`{text_col}`").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column("lang"), batch.column("text"), strict=True):
                seen[k] = seen.get(k := lang.as_py(), 0) + gram_counts(text.as_py(), buckets)
        for lang, n in seen.items():
            hit = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(hit), pa.string()), pa.array(hit, pa.int32()), pa.array(n[hit], pa.int64())], ["lang", "bucket", "n"])

    rows = src.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    return fit(rows, buckets)


def fit(rows: pd.DataFrame, buckets: int) -> Model:
    languages = sorted(rows["lang"].unique())
    if not languages:
        return Model([], np.zeros((0, 1)), np.zeros((buckets, 1)), np.zeros((0, 1)))
    counts = np.zeros((len(languages), buckets))
    counts[np.searchsorted(languages, rows["lang"].to_numpy()), rows["bucket"].to_numpy()] = rows["n"].to_numpy()
    p = (counts + 0.5) / (counts.sum(1, keepdims=True) + 0.5 * buckets)
    code = code_words(len(languages))
    yes, no = (np.array([p[code[:, b] == side].mean(0) if (code[:, b] == side).any() else np.full(buckets, 1 / buckets) for b in range(code.shape[1])]) for side in (1, -1))
    weights = np.log(yes / no).T
    # Expected margin of the right sign for each language: the classifier's worth in its decoding.
    worth = np.clip(code * (p @ weights), 1e-3, None)
    return Model(languages, code, weights, worth / worth.mean(1, keepdims=True))


def predictor(model: Model):
    """A column function ``text -> struct(lang, score, ambiguous)``; its only input is the text."""

    @F.pandas_udf("lang string, score double, ambiguous boolean")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([model.predict(t) for t in texts], columns=["lang", "score", "ambiguous"])

    return run


def remainder(id_col: str) -> Column:
    """The fold of a row; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 3


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` in ``doc`` and the prediction in ``guess`` (``lang``, ``score``, ``ambiguous``).

    A null or empty text, one without a letter, or a model that learned no language gives ``und``, score 0,
    ambiguous. Texts of any length are read whole. Repeated rows get the same answer; an empty table gives no rows.
    """
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), predictor(model)(F.col(f"`{text_col}`")).alias("guess"))
