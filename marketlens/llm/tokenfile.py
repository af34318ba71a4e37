"""Token ids in Parquet files that allow selective reads."""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from marketlens.llm.bpe import byte_letters, slices
from marketlens.llm.common import parts, worker_memory

SCHEMA = "part int, doc_id long, local_start long, n_tokens long, ids array<int>"
#: Row groups of about 32 MB, pages of at most 1 MB and 2,000 rows, dictionary or delta encoding, compressed pages.
LAYOUT = {"parquet.block.size": str(32 << 20), "parquet.page.size": str(1 << 20), "parquet.page.row.count.limit": "2000", "parquet.enable.dictionary": "true",
          "parquet.dictionary.page.size": str(2 << 20), "parquet.writer.version": "PARQUET_2_0", "compression": "zstd"}
#: ASCII white space. A tokenizer whose words hold no white space encodes the chunks between it independently.
GAPS = {ord(c): " " for c in "\t\n\x0b\x0c\r"}
#: Anything else that splitting a text at white space would take for a gap.
OTHER_GAP = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


#: Punctuation that ends a word for the tokenizer and takes no part in a contraction or special token.
TAIL = ".,;:!?#$%&*+=/)(\"-_"
LETTER_OF = {v: k for k, v in byte_letters().items()}


def packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class Chunks(dict):
    """Encodes texts with the library through what it made of each white-space chunk before.

    Only for tokenizers that drop white space between words, fold case, split at the border of letters and punctuation, and
    have no special token with a blank in it. A chunk that is a word of Latin letters, with or without punctuation
    after it, is put together from its two parts, and the word goes straight to the library's model; any other chunk
    goes through the whole library. ``remember`` bounds the chunks and the parts that are kept: half as many start a
    new generation, and what is asked for again comes over from the one before.
    """

    def __init__(self, spec: str, remember: int = 400_000):
        super().__init__()
        self.lib, self.remember, self.old, self.words, self.old_words = Tokenizer.from_str(spec), remember, {}, {}, {}
        self.tokenize = self.lib.model.tokenize
        self.lib.no_truncation()
        self.lib.no_padding()

    def __missing__(self, c: str) -> bytes:
        ids = self.old.get(c)
        self[c] = ids = self.made(c) if ids is None else ids
        return ids

    def made(self, c: str) -> bytes:
        low = c.lower()
        core = low.rstrip(TAIL)
        # Letters below U+0250 fold one by one; a chunk that is not composed is left to the library.
        if not core.isalpha() or not low.isascii() and (max(c) >= "\u0250" or "\u0130" in c or not is_normalized("NFC", core)):
            return self.whole(c)
        ids = self.words.get(core)
        if ids is None:
            ids = self.old_words.get(core)
            if ids is None:
                shown = core if core.isascii() else "".join(map(LETTER_OF.__getitem__, core.encode("utf-8")))
                ids = packed([t.id for t in self.tokenize(shown)])
            self.words[core] = ids
        if len(core) == len(low):
            return ids
        tail = low[len(core):]
        after = self.words.get(tail)
        if after is None:
            self.words[tail] = after = self.whole(tail)
        return ids + after

    def whole(self, c: str) -> bytes:
        return packed(self.lib.encode(c, add_special_tokens=False).ids)

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        out = []
        for t in texts:
            if 2 * len(self) > self.remember:
                self.old = dict(self)
                self.clear()
            if 2 * len(self.words) > self.remember:
                self.words, self.old_words = {}, self.words
            words = (t or "").split() if OTHER_GAP.search(t or "") is None else [c for c in t.translate(GAPS).split(" ") if c]
            out.append(np.frombuffer(b"".join(map(self.__getitem__, words)), "<u4"))
        return out


def write(docs: DataFrame, tokenizer: str, end: int, path: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Token ids of every whole text, each followed by ``end``, as files in ascending id order.

    Texts (a sixth of what their ids would take) are dealt into ranges of the id and sorted, then encoded
    as they are written. ``tokenizer`` is the JSON text of the vocabulary file. Every row also has its part and the
    number of ids before it in the part, so that places in the whole are known from narrow columns alone.
    The write is committed by task: a lost executor's task is repeated without trace.

    A null text is empty and has the end id only; null ids come first; rows with one id are ordered by text;
    an empty table makes a file set without rows. Extra columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(tokenizer)
    d = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("_t"))
    d = d.repartitionByRange(parts(docs.sparkSession), "doc_id").sortWithinPartitions("doc_id", "_t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory, key = worker_memory(), ("chunks", hash(shared.value))
        if key not in memory:
            memory[key] = Chunks(shared.value)
        part, before = TaskContext.get().partitionId(), 0
        for batch in batches:
            at = 0
            for texts in slices(batch.column("_t")):
                ids = [np.append(x, np.uint32(end)) for x in memory[key].encode(texts)]
                n = np.array([len(x) for x in ids], np.int64)
                places = before + np.cumsum(n) - n
                before += int(n.sum())
                flat = pa.array(np.concatenate(ids).astype(np.int32))
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)), pa.int32()), flat)
                yield pa.RecordBatch.from_arrays([pa.array([part] * len(n), pa.int32()), batch.column("doc_id").slice(at, len(n)), pa.array(places), pa.array(n), lists],
                                                 ["part", "doc_id", "local_start", "n_tokens", "ids"])
                at += len(n)

    d.mapInArrow(run, SCHEMA).write.options(**LAYOUT).parquet(path)


def places(spark: SparkSession, path: str) -> DataFrame:
    """``part, doc_id, start, n_tokens`` of every document from the narrow columns; no id is read."""
    d = spark.read.schema("part int, doc_id long, local_start long, n_tokens long").parquet(path)
    sums = d.groupBy("part").agg(F.sum("n_tokens").alias("_n"))
    base = sums.select("part", (F.sum("_n").over(Window.orderBy("part")) - F.col("_n")).alias("_base"))  # a row for each part
    return d.join(F.broadcast(base), "part").select("part", "doc_id", (F.col("_base") + F.col("local_start")).alias("start"), "n_tokens")


def read(spark: SparkSession, path: str, low: int | None = None, high: int | None = None) -> DataFrame:
    """``part, doc_id, local_start, n_tokens, ids``, of ids from ``low`` to ``high`` only if given (row groups and pages without them are skipped)."""
    d = spark.read.schema(SCHEMA).parquet(path)
    if low is not None:
        d = d.filter(F.col("doc_id") >= low)
    return d if high is None else d.filter(F.col("doc_id") <= high)


def check_sums(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, from the ids as read back."""
    d = read(spark, path)
    sums = spark.read.schema("part int, n_tokens long").parquet(path).groupBy("part").agg(F.sum("n_tokens").alias("_n"))
    base = sums.select("part", (F.sum("_n").over(Window.orderBy("part")) - F.col("_n")).alias("_base"))

    def crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("ids")
            sums = [zlib.crc32(x.values.to_numpy(zero_copy_only=False).astype("<u4").tobytes()) for x in lists]
            sizes = [len(x) for x in lists]
            yield pa.RecordBatch.from_arrays([batch.column("part"), batch.column("doc_id"), batch.column("local_start"), pa.array(sizes, pa.int64()), pa.array(sums, pa.int64())],
                                             ["part", "doc_id", "local_start", "n_tokens", "ids_crc32"])

    d = d.select("part", "doc_id", "local_start", "ids").mapInArrow(crc, "part int, doc_id long, local_start long, n_tokens long, ids_crc32 long")
    return d.join(F.broadcast(base), "part").select("doc_id", (F.col("_base") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")
