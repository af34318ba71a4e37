"""Mixing sources to target weights by capped water-filling."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketlens.llm.common import WORD, chunk, digits_for, stored


def water_level(sources: DataFrame, total: int) -> float:
    """The share of one unit of weight once no source is above its cap.

    Each round clamps the sources whose cap the level reaches and spreads what is left over the weights of
    the others; the level only rises, and stops when a round clamps no further source.
    """
    level, clamped = 0.0, -1
    while True:
        over = F.col("_cap") <= F.lit(level) * F.col("_w")
        fixed, open_weight, n = sources.agg(F.coalesce(F.sum(F.when(over, F.col("_cap"))), F.lit(0)), F.coalesce(F.sum(F.when(~over, F.col("_w"))), F.lit(0)), F.count(F.when(over, 1))).first()
        if n == clamped or not open_weight:
            return level
        level, clamped = (total - fixed) / open_weight, n


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), epochs: int = 3, seed: int = 17, id_col: str = "doc_id", text_col: str = "text",
        source_col: str = "source", carry: list[str] | None = None) -> DataFrame:
    """How often the mix takes each document: the ``carry`` columns in ``doc``, with ``size, source_size, target, times, taken``.

    Sources in code-point order, null last, get ``weights`` in turn and share as many words as there are.
    A target stops at ``epochs`` times its source; the rest is shared again by weight. Every document is
    taken the whole number of times its source repeats; the fraction left is filled in the order of a
    seeded hash of the id, so reruns agree, and stops at the document that would pass its middle.

    A null text has size 0; a null source is a source of its own; documents without words are taken as
    rows but add no words; repeated rows count each; an empty table gives no rows. A source that holds a
    third of all rows is summed in chunks of the hash.
    """
    carry = docs.columns if carry is None else carry
    words = F.regexp_count(F.coalesce(F.col(f"`{text_col}`"), F.lit("")), F.lit(WORD)).cast("long")
    src = F.col(f"`{source_col}`").cast("string")
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))))
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in carry]).alias("_d"), F.coalesce(src, F.lit("")).alias("_s"), src.isNull().alias("_none"), words.alias("_size"), order.alias("_h"))
    if set(carry) <= {id_col, source_col}:
        d = stored(d, "mix-sizes")  # narrow: the texts are read once

    per = d.groupBy("_none", "_s").agg(F.sum("_size").alias("_sum"), F.count(F.lit(1)).alias("_rows"))
    turn = (F.row_number().over(Window.orderBy("_none", "_s")) - 1) % len(weights)  # one row a source
    per = stored(per.withColumn("_w", F.element_at(F.array(*map(F.lit, weights)), (turn + 1).cast("int"))).withColumn("_cap", F.col("_sum") * epochs), "mix-sources")
    total, rows = per.agg(F.coalesce(F.sum("_sum"), F.lit(0)), F.coalesce(F.sum("_rows"), F.lit(0))).first()
    level = water_level(per, total)
    per = per.withColumn("_target", F.least(F.col("_cap").cast("double"), F.lit(level) * F.col("_w")))
    whole = F.when(F.col("_sum") > 0, F.floor(F.col("_target") / F.col("_sum"))).otherwise(F.lit(0)).cast("int")
    per = per.withColumn("_whole", whole).withColumn("_need", F.col("_target") - F.col("_whole") * F.col("_sum"))

    d = d.withColumn("_chunk", chunk(F.col("_h"), digits_for(rows, 100_000, 2)))
    cells = d.groupBy("_none", "_s", "_chunk").agg(F.sum("_size").alias("_cell"))
    before = F.sum("_cell").over(Window.partitionBy("_none", "_s").orderBy("_chunk")) - F.col("_cell")
    cells = cells.withColumn("_before", before).join(per.select("_none", "_s", "_sum", "_target", "_whole", "_need"), ["_none", "_s"])
    keys = ["_none", "_s", "_chunk"]
    inside = F.sum("_size").over(Window.partitionBy(*keys).orderBy("_h", "_size").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_size")
    d = d.join(cells.hint("merge"), keys).withColumn("_run", F.col("_before") + inside)
    times = F.col("_whole") + ((F.col("_run") * 2 + F.col("_size")).cast("double") <= F.col("_need") * 2).cast("int")
    return d.select(F.col("_d").alias("doc"), F.col("_size").alias("size"), F.col("_sum").alias("source_size"), F.col("_target").alias("target"), times.cast("int").alias("times"), (F.col("_size") * times).cast("long").alias("taken"))
