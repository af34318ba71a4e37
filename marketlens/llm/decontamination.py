"""Benchmark passages in documents: an FM-index for every shard, searched for all passages in blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql import types as T

from marketlens.llm.common import stored
from marketlens.llm.fmindex import FIELDS, Cutter, Index, Phrases, as_bytes, build, cut_text


def index_shards(docs: DataFrame, text_col: str = "text", carry: list[str] | None = None, shard_bytes: int = 1 << 20, every: int = 8) -> DataFrame:
    """One row for each shard of about ``shard_bytes`` of text, written to the shared folder: its FM-index and its documents' ``carry`` columns.

    A task cuts the documents it reads into shards, so nothing is shuffled; a longer document is a shard of its own. Every
    ``every``-th place and the head of every document are sampled. The index knows nothing of the passages and serves any number of searches.
    """
    carry = docs.columns if carry is None else carry
    src = docs.select(F.struct(*[F.col(f"`{c}`") for c in carry]).alias("doc"), F.col(f"`{text_col}`").alias("text"))
    schema = T.StructType([T.StructField("shard", T.LongType()), T.StructField("docs", T.ArrayType(src.schema["doc"].dataType)), *[T.StructField(f, T.BinaryType()) for f in FIELDS]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter, held, texts, size, made = Cutter(), [], [], 0, 0

        def shard() -> pa.RecordBatch:
            rows = pa.concat_arrays(held)
            index = build(texts, cutter, every)
            number = (TaskContext.get().partitionId() << 32) + made
            listed = pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), rows)
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), listed, *[pa.array([index[f]], pa.binary()) for f in FIELDS]], ["shard", "docs", *FIELDS])

        for batch in batches:
            rows, begin = batch.column("doc"), 0
            for i, t in enumerate(as_bytes(batch.column("text"))):
                texts.append(t)
                size += len(t) + 1
                if size >= shard_bytes:
                    held.append(rows.slice(begin, i + 1 - begin))
                    yield shard()
                    held, texts, size, made, begin = [], [], 0, made + 1, i + 1
            if begin < len(rows):
                held.append(rows.slice(begin))
        if texts:
            yield shard()

    return stored(src.mapInArrow(run, schema), "word-index")


def windows(items: DataFrame, id_col: str = "item_id", text_col: str = "text", words: int = 10) -> DataFrame:
    """Distinct ``item, phrase``: every ``words`` consecutive words of an item, joined by spaces; all of a shorter item's, if it has any."""
    src = items.select(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).alias("item"), F.col(f"`{text_col}`").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = Cutter()
        for batch in batches:
            for item, text in zip(batch.column("item"), as_bytes(batch.column("text"))):
                w = cut_text(text, cutter)
                found = {b" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set()
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([item.as_py()] * len(found), pa.string()), pa.array(sorted(found), pa.binary())], ["item", "phrase"])

    return src.mapInArrow(run, "item string, phrase binary").distinct()


def search(shards: DataFrame, pairs: list, all_docs: bool) -> DataFrame:
    """Rows of the documents (of all, or of those that are hit) after a search for ``pairs`` of item and phrase."""
    of: dict[bytes, list[int]] = {}
    items = sorted({r["item"] for r in pairs})
    number = {x: k for k, x in enumerate(items)}
    for r in pairs:
        of.setdefault(bytes(r["phrase"]), []).append(number[r["item"]])
    phrases = Phrases(list(of))
    ends = np.cumsum([len(x) for x in of.values()], dtype=np.int64)
    owners = np.array([k for x in of.values() for k in x], np.int64)
    doc = shards.schema["docs"].dataType.elementType
    schema = T.StructType([T.StructField("shard", T.LongType()), T.StructField("no", T.IntegerType()), T.StructField("doc", doc), T.StructField("n_words", T.LongType()),
                           *T._parse_datatype_string("runs array<struct<first:long,last:long,start:long,end:long>>, items array<string>").fields])
    runs_type, items_type = to_arrow_type(schema["runs"].dataType), pa.list_(pa.string())

    def listed(counts: np.ndarray, values: pa.Array, kind: pa.DataType) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)), pa.int32()), values.cast(kind.value_type))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                x = Index({f: batch.column(f)[row].as_py() for f in FIELDS})
                n = len(x.counts)
                phrase, place, size = phrases.hits(x)
                of_doc = np.searchsorted(x.heads, place, "right") - 1
                # Items of each document: every owner of every phrase that it holds.
                pair = np.unique(of_doc * len(ends) + phrase)
                d, p = pair // max(1, len(ends)), pair % max(1, len(ends))
                many = ends[p] - np.where(p, ends[p - 1], 0)
                at = np.repeat(ends[p] - np.cumsum(many), many) + np.arange(int(many.sum()))
                held = np.unique(np.repeat(d, many) * len(items) + owners[at])
                item_counts = np.bincount(held // max(1, len(items)), minlength=n)
                # Words under any occurrence, in maximal runs.
                depth = np.zeros(x.text_rows + 1, np.int64)
                np.add.at(depth, place, 1)
                np.add.at(depth, place + size, -1)
                edge = np.diff((np.cumsum(depth) > 0).astype(np.int8), prepend=np.int8(0))
                first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
                run_doc = np.searchsorted(x.heads, first, "right") - 1
                run_counts = np.bincount(run_doc, minlength=n)
                start, end = x.spans()
                head = x.doc_starts[run_doc]
                places = (first - x.heads[run_doc], last - x.heads[run_doc], start[first - run_doc] - head, end[last - 1 - run_doc] - head)
                runs = pa.StructArray.from_arrays([pa.array(v, pa.int64()) for v in places], ["first", "last", "start", "end"])
                out = [pa.array(np.full(n, batch.column("shard")[row].as_py()), pa.int64()), pa.array(np.arange(n), pa.int32()), batch.column("docs")[row].values, pa.array(x.counts, pa.int64()),
                       listed(run_counts, runs, runs_type), listed(item_counts, pa.array([items[k] for k in held % max(1, len(items))], pa.string()), items_type)]
                full = pa.RecordBatch.from_arrays(out, schema.names)
                yield full if all_docs else full.take(pa.array(np.flatnonzero(run_counts)))

    return shards.mapInArrow(run, schema)


def find(docs: DataFrame, items: DataFrame, text_col: str = "text", carry: list[str] | None = None, item_col: str = "item_id", words: int = 10, block: int = 1 << 16, shard_bytes: int = 1 << 20) -> DataFrame:
    """Benchmark passages in documents: ``doc`` (the ``carry`` columns), ``n_words``, ``runs`` and ``items`` of every document.

    Words are runs of digits, letters and non-ASCII characters, A-Z lower-cased. A passage is ``words`` consecutive words of an item, or all of
    a shorter one's. ``runs`` are the maximal runs of words under any occurrence: their first word and the one after the last, and the bytes of
    the UTF-8 text that they take, which is what goes; ``items`` are the ids, as strings, of the items with an occurrence.

    Each shard's index is searched backwards for all passages at once. Passages come in blocks of about ``block`` pairs of item and passage, dealt
    by hash, one after the other, so a block's size is what the driver and a task hold of the benchmark, however large it is; a passage that many items share is dealt over
    the blocks. With several blocks a document's runs and items are united by its place in the index.

    Null and empty texts, and texts without a word, have no words and no runs; an item without a word has no passage. Texts of any length are taken
    whole. Repeated documents have a row each; items of one id are one item, a null id is written as an empty string. Empty
    tables give no rows, or no runs. Document columns travel in one struct, so their names cannot clash.
    """
    spark = docs.sparkSession
    shards = index_shards(docs, text_col, carry, shard_bytes)
    pairs = stored(windows(items, item_col, text_col, words), "passages")
    blocks = max(1, -(-pairs.count() // block))
    pairs = pairs.withColumn("block", F.pmod(F.xxhash64("item", "phrase"), F.lit(blocks)))
    found = search(shards, pairs.filter("block = 0").collect(), True)
    if blocks == 1:
        return found.drop("shard", "no")
    for k in range(1, blocks):
        found = found.unionByName(search(shards, pairs.filter(F.col("block") == k).collect(), False))
    found = stored(found, "passage-hits")

    def unite(done, r):
        last = F.element_at(done, -1)
        joined = F.struct(last["first"].alias("first"), F.greatest(last["last"], r["last"]).alias("last"), last["start"].alias("start"), F.greatest(last["end"], r["end"]).alias("end"))
        return F.when((F.size(done) > 0) & (F.try_element_at(done, F.lit(-1))["last"] >= r["first"]), F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(joined))).otherwise(F.concat(done, F.array(r)))

    runs = F.array_sort(F.flatten(F.collect_list("runs")))
    kind = found.schema["runs"].dataType.simpleString()
    return found.groupBy("shard", "no").agg(F.first("doc").alias("doc"), F.first("n_words").alias("n_words"), F.aggregate(runs, F.array().cast(kind), unite).alias("runs"),
                                            F.array_distinct(F.flatten(F.collect_list("items"))).alias("items")).drop("shard", "no")
