"""Streams: bars, freshness, stateful alarms, outcome tracking, de-duplication and archiving."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from marketlens.session import cut_lineage, work_path


def run_available(stream: DataFrame, name: str, mode: str = "append", closing: str | None = None) -> DataFrame:
    """Process everything that is there and return what was written.

    Output, offsets and state live in the shared folder, so a lost executor or driver resumes. ``closing`` is the folder of a
    ``keyed_rule`` stream's clock: once all is read the source counts as complete, the clock strikes the end of time and what was held comes out.
    """
    spark = stream.sparkSession
    path = work_path(spark, name)

    def run():
        q = (stream.writeStream.format("parquet").outputMode(mode).option("path", f"{path}/out")
             .option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start())
        q.awaitTermination()

    run()
    if closing is not None:
        strike(spark, closing)
        run()
    return spark.read.schema(stream.schema).parquet(f"{path}/out")


CLOCK = "_mark timestamp"


def clock(spark: SparkSession) -> str:
    """A folder of clock files for one stream, empty so far."""
    path = work_path(spark, "clock")
    spark.createDataFrame([], CLOCK).write.parquet(path)
    return path


def strike(spark: SparkSession, path: str, at: str = "9999-01-01") -> None:
    """Tell a stream that all rows before ``at`` have been handed over."""
    spark.range(1).select(F.lit(at).cast("timestamp").alias("_mark")).write.mode("append").parquet(path)


def stream_snapshots(stream: DataFrame, event_time: str, key: str, cols: list[str], seconds: int = 60, late: int = 180) -> DataFrame:
    """Tumbling bars with the last value per key; rows later than ``late`` seconds are dropped."""
    bar = F.window(event_time, f"{seconds} seconds")
    last = F.max_by(F.struct(*cols), F.col(event_time))
    g = stream.withWatermark(event_time, f"{late} seconds").groupBy(F.col(key), bar).agg(last.alias("_r"))
    return g.select(key, F.unix_timestamp("window.start").alias("bucket"), "_r.*")


class Rule:
    """A rule of event time: ``step(state, row)`` for every row in order, ``expire(state, now)`` when time has passed, ``due(state)`` the next time at which it would do something."""

    def __init__(self, step, expire=None, due=None):
        self.step, self.expire, self.due = step, expire or (lambda s, now: (s, [])), due or (lambda s: None)


def keyed_rule(stream: DataFrame, keys: list[str], rule, output: str, order: tuple = ("ts", "id"), delay: int = 0, closing: str | None = None, unit: int = 1000, idle: int | None = None,
               slots: int | None = None) -> DataFrame:
    """Run a rule per key in event time, whatever order and cut the source hands rows over in.

    Rows wait in the state of their key until the watermark (the greatest time seen anywhere, less ``delay`` seconds) has passed them; a
    timer then releases them in the order of ``order``, whose first column is the time in 1 / ``unit`` milliseconds (1000: whole seconds). So rows that are out of
    order by ``delay`` at most give the same output however they are cut into micro-batches. A row that arrives after a later row of its key
    was released cannot turn the rule back: it comes out by itself, with ``reason`` late and the output columns it has. All other rows have
    a null ``reason``. Rows of one key and the lateness are held in its state; ``idle`` seconds after its last row a key's state goes.
    With ``slots`` the keys are hashed into so many records of state, which are read and written as a whole: fewer calls where many keys
    come at once, more rewriting where a micro-batch brings few of them. The rows are the same.

    The watermark is taken from a copy of each row that only passes by the watermark node, as Spark would drop late rows at the state;
    files in the ``closing`` folder (see ``clock``) move it without rows.
    """
    rule = rule if isinstance(rule, Rule) else Rule(rule)
    names = [c.strip().split(" ")[0] for c in output.split(",")]
    by = [c for c in order if c in stream.columns]
    at = F.timestamp_millis((F.col(by[0]) * unit if unit >= 1 else F.col(by[0]) / round(1 / unit)).cast("long"))
    marked = stream.withColumn("_mark", F.explode(F.array(F.lit(None).cast("timestamp"), at)))
    if closing is not None:
        ticks = stream.sparkSession.readStream.schema(CLOCK).parquet(closing)
        marked = marked.unionByName(ticks, allowMissingColumns=True)
    # A row goes over as one struct: what Spark does for a group grows with its columns, and most groups are small.
    rows = marked.withWatermark("_mark", f"{delay} seconds").filter("_mark IS NULL").select(*([] if slots else keys), "_mark", F.struct(*stream.columns).alias("_row"))
    if slots:
        rows = rows.withColumn("_slot", F.pmod(F.xxhash64(*[F.col(f"_row.{k}") for k in keys]), F.lit(slots)))
    cols = [*stream.columns]
    spot = {c: i for i, c in enumerate(cols)}
    turn, who = [spot[c] for c in by], [spot[k] for k in keys]

    def plain(v):
        """A value as Python has it, NaN as missing."""
        v = v.item() if hasattr(v, "item") else v
        return None if v != v else v

    def advance(last, s, held, now, out):
        """Release what time has passed; last, state, what is still held and the next time at which something is due."""
        held.sort(key=lambda r: [r[i] for i in turn])
        ready = [r for r in held if r[turn[0]] < now]
        held = held[len(ready):]
        for r in ready:
            last = [r[i] for i in turn]
            s, passed = rule.expire(s, last[0])
            s, fired = rule.step(s, dict(zip(cols, r)))
            out += passed + fired
        s, passed = rule.expire(s, now)
        out += passed
        due = rule.due(s)
        if not held and idle is not None and last and last[0] + idle * 1000 / unit < now and due is None:
            return None, None
        times = [t for t in (held[0][turn[0]] if held else None, due, last[0] + idle * 1000 / unit if idle is not None and last else None) if t is not None]
        return [last, s, held], min(times, default=None)

    def apply(group, batches, state):
        # Of every key: its values, the order of its last released row, the state of the rule and the rows held, as lists of values.
        known = {tuple(k): rest for k, *rest in json.loads(state.get[0])} if state.exists else {}
        now = state.getCurrentWatermarkMs() / unit
        out, times, kept = [], [], []
        if not state.hasTimedOut:
            for frame in batches:
                for row in frame["_row"].tolist():
                    r = [plain(row[c]) for c in cols]
                    last, _, held = known.setdefault(tuple(r[i] for i in who), [None, None, []])
                    if last is not None and [r[i] for i in turn] < last:
                        out.append({**{n: r[spot[n]] if n in spot else None for n in names}, "reason": "late"})
                    else:
                        held.append(r)
        for key, (last, s, held) in known.items():
            made = []
            rest, due = advance(last, s, held, now, made)
            out += [{**r, **dict(zip(keys, key))} for r in made]
            if rest is not None:
                kept.append([key, *rest])
            if due is not None:
                times.append(due)
        if not kept:
            state.remove()
        else:
            state.update((json.dumps(kept, default=float),))
            if times:
                state.setTimeoutTimestamp(max(int(min(times) * unit), state.getCurrentWatermarkMs() + 1))
        if out:
            yield pd.DataFrame({n: pd.Series([r.get(n) for r in out], dtype=object) for n in (*names, "reason")})

    return rows.groupBy(*(["_slot"] if slots else keys)).applyInPandasWithState(apply, output + ", reason string", "blob string", "append", GroupStateTimeout.EventTimeTimeout)


#: Records of state of a source that is read whole: one for each key would cost a call of Python a key.
SLOTS = 2048


def run_rule(stream: DataFrame, keys: list[str], rule, output: str, name: str, order: tuple = ("ts", "id"), delay: int = 0, unit: int = 1000) -> DataFrame:
    """What ``keyed_rule`` gives for a source that is complete once it has been read."""
    closing = clock(stream.sparkSession)
    return run_available(keyed_rule(stream, keys, rule, output, order, delay, closing, unit, slots=SLOTS), name, closing=closing)


def track_outcomes(horizons: list[int], late: int) -> Rule:
    """The first observation of each case in each horizon's window ``[at + horizon, at + horizon + late]``, or its expiry; all in one unit of time.

    Rows are cases (``entry`` set: id, ts) or observations (``mc`` set). Every case gives one row a horizon: OBSERVED with the time and multiple, as soon as one is seen,
    or EXPIRED once time has passed the window; nothing is filled in later. State holds open windows only.
    """

    def step(s, r):
        s = s or []
        if r["entry"] is not None:
            return s + [[r["id"], h, r["ts"] + h, r["ts"] + h + late, r["entry"]] for h in horizons], []
        if r["mc"] is None:
            return s, []
        hit = [w for w in s if w[2] <= r["ts"] <= w[3]]
        out = [{"id": i, "horizon": h, "status": "OBSERVED", "seen": r["ts"], "multiple": r["mc"] / max(1.0, e)} for i, h, _, _, e in hit]
        return [w for w in s if w not in hit], out

    def expire(s, now):
        gone = [w for w in s or [] if w[3] < now]
        return [w for w in s or [] if w[3] >= now], [{"id": i, "horizon": h, "status": "EXPIRED", "seen": None, "multiple": None} for i, h, _, _, _ in gone]

    return Rule(step, expire, lambda s: min((w[3] for w in s or []), default=None))


def once(stream: DataFrame, event_id: str) -> DataFrame:
    """Each event id once, for ever."""
    return stream.dropDuplicates([event_id])


def once_within(stream: DataFrame, event_id: str, event_time: str, ttl: int) -> DataFrame:
    """Each event id once while its message lives; expired ids leave the state with the watermark."""
    return stream.withWatermark(event_time, f"{ttl} seconds").dropDuplicatesWithinWatermark([event_id])


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def archive_stream(stream: DataFrame, path: str, checkpoint: str, ts: str, holdback: int = 120, now: int | None = None):
    """Append new rows to a daily archive, without the mutable tail and without repeating a key.

    Rows younger than ``holdback`` seconds before ``now`` (by default the newest time seen) wait in
    ``{checkpoint}-tail/{batch}`` and join the next micro-batch, so none is lost when the source moves on. A batch
    that is run again reads the same tail and writes the same next one. Only the archive's days that the rows
    belong to are read.
    """
    from marketlens.functions.times import utc_day
    from marketlens.sources.snapshots import incremental_copy, write_daily

    def write(batch: DataFrame, epoch: int) -> None:
        spark: SparkSession = batch.sparkSession
        tail = f"{checkpoint}-tail/{epoch - 1}"
        rows = cut_lineage(batch.unionByName(spark.read.schema(batch.schema).parquet(tail)) if exists(spark, tail) else batch)
        newest = rows.agg(F.max(ts)).first()[0]
        limit = now if now is not None else newest
        if limit is not None:
            ripe = rows.filter(F.col(ts) <= limit - holdback)
            days = ripe.agg(F.min(utc_day(ts)), F.max(utc_day(ts))).first()
            seen = ripe.limit(0)
            if days[0] is not None and exists(spark, path):
                seen = spark.read.parquet(path).filter(F.col("day").between(*days))
            write_daily(incremental_copy(ripe, seen, limit, holdback=holdback), path, ts)
            rows = rows.filter(F.coalesce(F.col(ts) > limit - holdback, F.lit(True)))
        rows.write.mode("overwrite").parquet(f"{checkpoint}-tail/{epoch}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
