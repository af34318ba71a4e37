"""Exact deduplication by progressive refinement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlens.llm.common import BLANKS, finished, stored


def normal(text: str) -> Column:
    """Null counts as empty; each run of white space becomes one space."""
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), BLANKS, " ")


def refine(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None,
           prefix: int = 256, digest: bool = False) -> DataFrame:
    """Groups of equal normalised texts: the ``carry`` columns in ``doc``, with ``keep_id``, ``group_size`` and ``kept``.

    Three rounds, each only over rows that the one before left in a group of several: byte length,
    hash of the first ``prefix`` characters, SHA-256 of the whole text. The first two rounds see narrow
    rows; whole texts are read and hashed for the survivors. ``digest`` adds ``text_sha256`` for every row.

    Null texts equal empty ones. A null id sorts after every id; ``keep_id`` is null if a group has no
    id. Of repeated rows with the smallest id exactly one is kept. An empty table gives an empty result.
    The group tables are written, so each join meets plain shuffles and Spark can split a hot key's rows.
    All names inside carry an underscore and source columns travel in one struct, so extra or clashing
    columns do no harm.
    """
    carry = docs.columns if carry is None else carry
    src = docs.select(F.struct(*[F.col(f"`{c}`") for c in carry]).alias("_d"), F.col(f"`{id_col}`").alias("_id"), normal(text_col).alias("_t"))
    src = src.withColumn("_len", F.octet_length("_t")).withColumn("_head", F.xxhash64(F.substring("_t", 1, prefix)))

    narrow = stored(src.select("_id", "_len", "_head"), "dedup-narrow")
    lengths = stored(narrow.groupBy("_len").count().filter("count > 1").select("_len"), "dedup-lengths")
    same_length = stored(narrow.join(lengths, "_len", "left_semi"), "dedup-length")
    heads = stored(same_length.groupBy("_len", "_head").count().filter("count > 1").select("_len", "_head"), "dedup-heads")
    same_head = stored(same_length.join(heads, ["_len", "_head"], "left_semi"), "dedup-head")
    marks = same_head.select(F.col("_id").alias("_mid"), F.col("_len").alias("_mlen"), F.col("_head").alias("_mhead")).distinct().withColumn("_hit", F.lit(True))

    on = F.col("_id").eqNullSafe(F.col("_mid")) & (F.col("_len") == F.col("_mlen")) & (F.col("_head") == F.col("_mhead"))
    # Always a shuffled join: the marks grow with the rows, so broadcasting them only works on small inputs.
    whole = src.join(marks.hint("merge"), on, "left").withColumn("_full", F.when(F.col("_hit"), F.sha2("_t", 256)))
    extra = [F.coalesce("_full", F.sha2("_t", 256)).alias("_sha")] if digest else []
    whole = stored(whole.select("_d", "_id", "_len", "_head", "_full", F.monotonically_increasing_id().alias("_row"), *extra), "dedup-whole")
    finished(docs.sparkSession, narrow, lengths, same_length, heads, same_head)

    key = ["_len", "_head", "_full"]
    first = stored(whole.filter("_full IS NOT NULL").groupBy(*key).agg(
        F.min(F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("id"), F.col("_row").alias("row"))).alias("_first"), F.count(F.lit(1)).alias("_n")), "dedup-first")
    out = whole.join(first.hint("merge"), key, "left")
    return out.select(F.col("_d").alias("doc"), F.when(F.col("_n").isNull(), F.col("_id")).otherwise(F.col("_first.id")).alias("keep_id"), F.coalesce("_n", F.lit(1)).alias("group_size"),
                      (F.col("_n").isNull() | (F.col("_row") == F.col("_first.row"))).alias("kept"), *([F.col("_sha").alias("text_sha256")] if digest else []))
