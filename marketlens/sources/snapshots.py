"""Minute snapshots, entity dimension, raw payloads, archive and retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlens.functions.numeric import number
from marketlens.functions.text import is_address
from marketlens.functions.times import bucket, utc_day
from marketlens.operators.tables import last_per_key


def bucket_snapshots(df: DataFrame, key: str = "mint", ts: str = "ts", seconds: int = 60, order: tuple = ("ts", "id")) -> DataFrame:
    """One row per key and time bucket; the last write wins."""
    d = df.withColumn("bucket", bucket(ts, seconds))
    return last_per_key(d, [key, "bucket"], list(order))


POLICIES = ("overwrite", "keep_first", "coalesce_new", "insert_only")


def merge_dimension(old: DataFrame, new: DataFrame, key: str, order: str, policies: dict[str, str]) -> DataFrame:
    """Keyed upsert. Per column: ``overwrite`` takes the newest value even if null, ``coalesce_new`` the
    newest non-null, ``keep_first`` the oldest non-empty, ``insert_only`` the value of the first row.

    One aggregation over both sides; nothing is joined, so a hot key only costs partial aggregates.
    """
    u = old.withColumn("_side", F.lit(0)).unionByName(new.withColumn("_side", F.lit(1)))
    at = F.struct("_side", order)

    def pick(c: str, policy: str) -> Column:
        v = F.col(c)
        if policy == "overwrite":
            return F.max_by(F.struct(v), at)[c]
        if policy == "coalesce_new":
            return F.max_by(v, F.when(v.isNotNull(), at))
        if policy == "keep_first":
            return F.min_by(v, F.when(v.isNotNull() & (v.cast("string") != ""), at))
        if policy == "insert_only":
            return F.min_by(F.struct(v), at)[c]
        raise ValueError(f"unknown policy {policy}")

    return u.groupBy(key).agg(*[pick(c, p).alias(c) for c, p in policies.items()])


def flatten_pair_json(df: DataFrame, body: str) -> DataFrame:
    """Nested market payload to typed columns; numbers that do not parse become 0."""
    g = lambda path: F.get_json_object(body, path)
    whole = lambda path: F.coalesce(g(path).try_cast("long"), F.lit(0).cast("long"))
    return df.select(*[c for c in df.columns if c != body], g("$.pairAddress").alias("pair"),
                     number(g("$.priceUsd")).alias("price"), number(g("$.marketCap")).alias("mc"), number(g("$.liquidity.usd")).alias("liq"),
                     number(g("$.volume.m5")).alias("vol_m5"), number(g("$.volume.h1")).alias("vol_h1"),
                     whole("$.txns.m5.buys").alias("buys_m5"), whole("$.txns.m5.sells").alias("sells_m5"),
                     whole("$.txns.h1.buys").alias("buys_h1"), whole("$.txns.h1.sells").alias("sells_h1"),
                     number(g("$.priceChange.m5")).alias("pc_m5"), number(g("$.priceChange.h1")).alias("pc_h1"))


def normalize_ticks(df: DataFrame, provider: str = "provider", body: str = "body", received: str = "ts", max_age: int = 120, ahead: int = 5) -> DataFrame:
    """Latest trade of each payload as (source_ts, price): a list with ms ``T``, an object with ISO
    ``time``, or a result list with ms ``time``. ``tick_reason`` tells why a payload gives none."""
    a = F.from_json(F.when(F.col(provider) == "binance", F.col(body)), "array<struct<T:double,p:string>>")
    b = F.from_json(F.when(F.col(provider) == "coinbase", F.col(body)), "struct<time:string,price:string>")
    c = F.from_json(F.when(F.col(provider) == "bybit", F.col(body)), "struct<retCode:int,result:struct<list:array<struct<time:double,price:string>>>>")
    last_a = F.array_max(F.transform(a, lambda r: F.struct(r["T"].alias("t"), r["p"].alias("p"))))
    last_c = F.array_max(F.transform(F.when(c["retCode"] == 0, c["result"]["list"]), lambda r: F.struct(r["time"].alias("t"), r["price"].alias("p"))))
    stamp = F.coalesce(last_a["t"] / 1000, F.unix_micros(F.to_timestamp(b["time"])) / 1e6, last_c["t"] / 1000)
    price = F.coalesce(last_a["p"], b["price"], last_c["p"]).try_cast("double")
    d = df.withColumn("source_ts", stamp).withColumn("price", price)
    age = F.col(received) - F.col("source_ts")
    why = (F.when(F.col("source_ts").isNull(), "no_trade").when(F.col("price").isNull() | F.isnan("price") | (F.col("price") <= 0), "invalid_trade")
           .when(~age.between(-ahead, max_age), "stale_trade"))
    return d.withColumn("tick_reason", why).drop(body)


def normalize_catalog(df: DataFrame, provider: str = "provider", body: str = "body") -> DataFrame:
    """Product lists of three layouts to (provider, symbol, base, quote, active, category)."""
    def rows(name, schema, path):
        return df.filter(F.col(provider) == name).select(provider, F.explode(path(F.from_json(body, schema))).alias("r"))

    a = rows("binance", "struct<symbols:array<struct<symbol:string,baseAsset:string,quoteAsset:string,status:string,isSpotTradingAllowed:boolean>>>", lambda c: c["symbols"])
    a = a.select(provider, "r.symbol", F.col("r.baseAsset").alias("base"), F.col("r.quoteAsset").alias("quote"),
                 F.coalesce((F.col("r.status") == "TRADING") & F.col("r.isSpotTradingAllowed"), F.lit(False)).alias("active"), F.lit("spot").alias("category"))
    b = rows("coinbase", "array<struct<id:string,base_currency:string,quote_currency:string,status:string,trading_disabled:boolean>>", lambda c: c)
    b = b.select(provider, F.col("r.id").alias("symbol"), F.col("r.base_currency").alias("base"), F.col("r.quote_currency").alias("quote"),
                 F.coalesce((F.col("r.status") == "online") & ~F.coalesce(F.col("r.trading_disabled"), F.lit(False)), F.lit(False)).alias("active"), F.lit("spot").alias("category"))
    c = df.filter(F.col(provider) == "bybit").select(provider, F.from_json(body, "struct<result:struct<category:string,list:array<struct<symbol:string,baseCoin:string,quoteCoin:string,status:string>>>>").alias("d"))
    c = c.select(provider, F.col("d.result.category").alias("category"), F.explode("d.result.list").alias("r"))
    c = c.select(provider, "r.symbol", F.col("r.baseCoin").alias("base"), F.col("r.quoteCoin").alias("quote"),
                 F.coalesce(F.col("r.status") == "Trading", F.lit(False)).alias("active"), "category")
    return a.unionByName(b).unionByName(c)


def incremental_copy(src: DataFrame, archived: DataFrame, now: int, checkpoint: tuple | None = None, holdback: int = 120, keys: tuple = ("ts", "mint")) -> DataFrame:
    """Rows after the composite checkpoint and before the mutable tail that the archive lacks.

    Keyset resume: the comparison is on the whole key, so equal times are neither lost nor repeated. Of several
    rows with one key in the batch the smallest is kept, as an insert that ignores known keys keeps one.
    """
    d = src.filter(F.col(keys[0]) <= now - holdback)
    if checkpoint is not None:
        d = d.filter(F.struct(*keys) > F.struct(*[F.lit(v).alias(k) for k, v in zip(keys, checkpoint)]))
    rest = [c for c in d.columns if c not in keys]
    d = d.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_row")).select(*keys, "_row.*").select(*src.columns) if rest else d.distinct()
    return d.join(archived.select(*keys), list(keys), "left_anti")


def append_observations(df: DataFrame, existing: DataFrame, key: list[str], cols: list[str], valid: Column) -> DataFrame:
    """``outcome`` per key of a batch: invalid, conflict (rows of the batch or the store differ), duplicate or append."""
    ok = df.withColumn("_ok", F.coalesce(valid, F.lit(False)))
    body = F.struct(*cols)
    g = ok.groupBy(*key).agg(F.count(F.lit(1)).alias("rows"), F.min(F.when(F.col("_ok"), body)).alias("_lo"), F.max(F.when(F.col("_ok"), body)).alias("_hi"))
    old = existing.groupBy(*key).agg(F.min(body).alias("_old"))
    d = g.join(old, key, "left")
    why = (F.when(F.col("_lo").isNull(), "invalid").when(~F.col("_lo").eqNullSafe(F.col("_hi")), "conflict").when(F.col("_old").isNull(), "append")
           .when(F.col("_old").eqNullSafe(F.col("_lo")), "duplicate").otherwise("conflict"))
    return d.withColumn("outcome", why).select(*key, "rows", "outcome", "_lo.*")


def valid_identity(c: Column) -> Column:
    return is_address(c)


def write_daily(df: DataFrame, path: str, ts: str = "ts") -> None:
    """Parquet partitioned by UTC day; rows of a day are spread before the write so no task gets a whole day."""
    d = df.withColumn("day", utc_day(ts))
    writers = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    d.repartition("day", F.pmod(F.xxhash64(*df.columns), F.lit(writers))).write.mode("append").partitionBy("day").parquet(path)


def read_retained(spark, path: str, now: int, days: int, schema=None) -> DataFrame:
    """Days inside the retention; the filter is on the partition column, so older days are never read."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    cutoff = F.date_format(F.timestamp_seconds(F.lit(now - days * 86_400)), "yyyy-MM-dd")
    return reader.parquet(path).filter(F.col("day") >= cutoff)


def store_evidence(df: DataFrame, source: str, body: str, observed: str) -> DataFrame:
    """Content-addressed store: one row per digest of source and body with its first observation."""
    d = df.withColumn("evidence_id", F.sha2(F.concat_ws("|", source, body), 256))
    return d.groupBy("evidence_id").agg(F.min(observed).alias("first_observed"), F.count(F.lit(1)).alias("seen"), F.min(source).alias("source"))
