"""Keyed table operators: first and last rows, set operations, bounded lists and rankings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def first_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """First row per key with the number of later repeats.

    An aggregate with a partial stage: a hot key is reduced on every task before it is shuffled.
    """
    best = F.min_by(F.struct(*[c for c in df.columns if c not in keys]), F.struct(*order))
    g = df.groupBy(*keys).agg(best.alias("_r"), (F.count(F.lit(1)) - 1).alias("repeats"))
    return g.select(*keys, "_r.*", "repeats")


def last_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    best = F.max_by(F.struct(*[c for c in df.columns if c not in keys]), F.struct(*order))
    return df.groupBy(*keys).agg(best.alias("_r")).select(*keys, "_r.*")


def union_members(*sets: DataFrame) -> DataFrame:
    """Distinct union of identifier sets."""
    return reduce(lambda a, z: a.unionByName(z), sets).distinct()


def set_overlap(left: DataFrame, right: DataFrame, member: str) -> DataFrame:
    """One row: members in common and on one side only; disjoint sets have ``common`` = 0."""
    side = lambda d, name: d.select(member, F.lit(name).alias("_s"))
    g = side(left, "l").unionByName(side(right, "r")).groupBy(member).agg(F.max(F.col("_s") == "l").alias("_l"), F.max(F.col("_s") == "r").alias("_r"))
    return g.agg(F.count_if(F.col("_l") & F.col("_r")).alias("common"), F.count_if(~F.col("_r")).alias("only_left"), F.count_if(~F.col("_l")).alias("only_right"))


def case_cards(df: DataFrame, key: str, peak: str, last: str, n: int = 12) -> DataFrame:
    """The best half by peak and, of the others, the worst by last value; both are bounded top lists."""
    best = df.orderBy(F.desc(F.coalesce(F.col(peak), F.lit(0.0))), key).limit(n // 2)
    rest = df.join(best.select(key), key, "left_anti").filter(F.col(last).isNotNull()).orderBy(last, key).limit(n - n // 2)
    return best.withColumn("side", F.lit("best")).unionByName(rest.withColumn("side", F.lit("worst")))


def latest_n(df: DataFrame, order: Column, size: str, n: int = 1000, max_total: int = 2**30) -> DataFrame:
    """The latest ``n`` rows up to a total size; the running sum covers the ``n`` rows only."""
    top = df.orderBy(order).limit(n)
    used = F.sum(size).over(Window.orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return top.withColumn("used", used).filter(F.col("used") <= max_total)
