"""Minimax contiguous sharding of ordered atomic groups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketlens.llm.common import chunk, digits_for, ranged, stored


def _ends(groups: DataFrame) -> DataFrame:
    """Every group with the running sum of sizes up to and including it, in the order of the hash.

    The sum is taken in chunks of the hash (uniform, so chunks are even) over a running sum of one row a
    chunk; sorted files let each later look-up read a few row groups.
    """
    digits = digits_for(groups.count(), 100_000, 3)
    g = groups.withColumn("_chunk", chunk(F.hex("_h"), digits))
    before = g.groupBy("_chunk").agg(F.sum("_size").alias("_total"))
    before = before.select("_chunk", (F.sum("_total").over(Window.orderBy("_chunk")) - F.col("_total")).alias("_before"))
    inside = F.sum("_size").over(Window.partitionBy("_chunk").orderBy("_h").rowsBetween(Window.unboundedPreceding, 0))
    out = g.withColumn("_inside", inside).join(before, "_chunk").select("_h", "_size", (F.col("_before") + F.col("_inside")).alias("_end"))
    return stored(ranged(out, "_end").select("_h", "_size", "_end"), "shard-ends")


def _greedy(ends: DataFrame, capacities: list[int], shards: int, total: int) -> dict[int, list[int]]:
    """For each capacity the cuts of the greedy filling, one aggregate per shard for all capacities."""
    cuts: dict[int, list[int]] = {c: [] for c in capacities}
    at = dict.fromkeys(capacities, 0)
    for _ in range(shards):
        live = [c for c in capacities if at[c] < total]
        if not live:
            break
        most = max(at[c] + c for c in live)
        seen = ends.filter((F.col("_end") > min(at[c] for c in live)) & (F.col("_end") <= most))
        goals = sorted({at[c] + c for c in live})
        # The largest end up to each goal, through the largest end between two goals: a row for each goal.
        below = F.size(F.filter(F.array(*map(F.lit, goals)), lambda g: g < F.col("_end")))
        top = {r[0]: r[1] for r in seen.groupBy(below).agg(F.max("_end")).collect()}
        reached, most = {}, 0
        for i, g in enumerate(goals):
            reached[g] = most = max(most, top.get(i, 0))
        for c in live:
            at[c] = max(at[c], reached[at[c] + c])
            cuts[c].append(at[c])
    return cuts


def smallest_capacity(ends: DataFrame, shards: int, total: int, largest: int, probes: int = 32) -> tuple[int, list[int]]:
    """The smallest capacity that ``shards`` contiguous shards can keep, with its cuts.

    Bisection between the two proven bounds, with several probes a round instead of one: greedy filling
    is feasible at mean plus largest group, and no capacity under the mean or the largest group is.
    """
    low, high = max(-(-total // shards), largest), -(-total // shards) + largest
    best: tuple[int, list[int]] | None = None
    while best is None or low < high:
        step = max(1, (high - low) // (probes + 1))
        tried = sorted({*range(low, high, step)} | {high}) if high - low > probes else [*range(low, high + 1)]
        cuts = _greedy(ends, tried, shards, total)
        good = [c for c in tried if cuts[c] and cuts[c][-1] >= total]
        high = good[0]
        best = (high, cuts[high])
        bad = [c for c in tried if c < high]
        low = bad[-1] + 1 if bad else high
    return best


def shard(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Contiguous shards of near equal bytes that never split a group of equal texts.

    Returns ``id_col, size, text_crc32, shard, slot``. Groups are ordered by the SHA-256 of their text, the
    smallest feasible capacity is searched with greedy checks, and the order is cut there. ``slot`` counts
    the rows of a shard from 0 in the order of (hash, id).

    A null text counts as empty (size 1, checksum 0); null ids come first in a group; repeated rows take
    slots of their own; shards beyond the number of groups stay empty; an empty table gives no rows.
    A group larger than an even share fills a shard alone. Only the total, the largest group and the cuts
    reach the driver.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").alias("_id"), (F.octet_length(text) + F.lit(1)).cast("long").alias("_size"), F.crc32(text).alias("_crc"), F.unhex(F.sha2(text, 256)).alias("_h"))
    rows = stored(ranged(rows, "_h", "_id"), "shard-rows")
    ends = _ends(rows.groupBy("_h").agg(F.sum("_size").alias("_size")))
    total, largest = ends.agg(F.coalesce(F.sum("_size"), F.lit(0)), F.coalesce(F.max("_size"), F.lit(0))).first()
    number: Column = F.lit(0)
    if total:
        _, cuts = smallest_capacity(ends, shards, total, largest)
        last = ends.filter(F.col("_end").isin(cuts[:-1])).select("_h").collect()
        number = reduce(lambda a, r: a + (F.col("_h") > F.lit(bytes(r[0]))).cast("int"), last, number)
    rows = rows.withColumn("_shard", number)

    # Slots: what earlier parts hold of the shard, less what this part holds of lower shards.
    held = rows.groupBy("_part", "_shard").agg(F.count(F.lit(1)).alias("_n"))
    earlier = F.coalesce(F.sum("_n").over(Window.partitionBy("_shard").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    lower = F.coalesce(F.sum("_n").over(Window.partitionBy("_part").orderBy("_shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = held.select("_part", "_shard", (earlier - lower).alias("_base"))
    # At most a row for each part and cut, whatever the input.
    out = rows.join(F.broadcast(base), ["_part", "_shard"])
    return out.select(F.col("_id").alias(id_col), F.col("_size").alias("size"), F.col("_crc").alias("text_crc32"), F.col("_shard").alias("shard"), (F.col("_at") + F.col("_base")).alias("slot"))
