"""What several operators of the package share."""

from __future__ import annotations

import gc
import sys
import time
import types

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlens.session import work_path

#: Whitespace of the word rule, as a regular expression.
BLANKS = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def stored(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it again.

    This cuts the lineage: a lost executor re-reads files, and what is written once is computed once.
    The files go when the driver's file system closes.
    """
    spark = df.sparkSession
    path = work_path(spark, name)
    df.write.parquet(path, compression=compression)
    target, fs = _target(spark, path)
    fs.deleteOnExit(target)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def _target(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark._jsc.hadoopConfiguration())


def finished(spark: SparkSession, *tables: DataFrame) -> None:
    """Give back disk in a job of many steps: delete ``tables`` that nothing reads any more, and let Spark's cleaner drop the
    shuffle files of plans that are gone (it waits for the driver to collect its garbage)."""
    for t in tables:
        target, fs = _target(spark, t._stored_at)
        fs.delete(target, True)
    gc.collect()
    time.sleep(0.5)  # the gateway lets go of collected frames in a thread of its own
    spark._jvm.System.gc()


def parts(spark: SparkSession) -> int:
    """How many ranges to deal rows into."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ranged(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt into ranges of ``keys`` and sorted, numbered by ``_part`` and ``_at`` (from 0 in each part).

    Several key columns split even a value that a third of the rows share.
    """
    d = df.repartitionByRange(parts(df.sparkSession), *keys).sortWithinPartitions(*keys)
    mid = F.monotonically_increasing_id()
    return d.withColumn("_part", F.shiftright(mid, 33).cast("int")).withColumn("_at", mid.bitwiseAND(F.lit((1 << 33) - 1)))


def digits_for(rows: int, per_chunk: int, least: int) -> int:
    """Hexadecimal digits of a uniform hash that leave about ``per_chunk`` rows in each chunk."""
    d = least
    while rows > per_chunk * 16 ** d:
        d += 1
    return d


def chunk(hex_hash: Column, digits: int) -> Column:
    return F.conv(F.substring(hex_hash, 1, digits), 16, 10).cast("long")


def worker_memory() -> dict:
    """A dictionary that outlives one task of a Python worker; functions sent by value have no module globals to keep."""
    return sys.modules.setdefault("_marketlens_worker_memory", types.ModuleType("_marketlens_worker_memory")).__dict__
