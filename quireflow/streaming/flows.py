"""Incremental flows: streaming jobs and their batch twins."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from quireflow.session import dealt
from quireflow.sources.scratch import materialize, scratch_path
from quireflow.streaming.tables import EpochTable


def run(stream: DataFrame, each: Callable[[DataFrame, int], None], mode: str = "append", **conf: str) -> None:
    """Run a stream over all that is available, giving every micro-batch and its epoch to `each`; conf holds while it runs."""
    spark = stream.sparkSession
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        writer = stream.writeStream.outputMode(mode).option("checkpointLocation", scratch_path(spark, "state"))
        writer.trigger(availableNow=True).foreachBatch(each).start().awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def drain(stream: DataFrame, mode: str = "append", name: str = "flow", keys: tuple[str, ...] = (), **conf: str) -> DataFrame:
    """Run a stream over all that is available and read what it wrote; with keys, of each key the last epoch's row."""
    out = EpochTable(stream.sparkSession, scratch_path(stream.sparkSession, name), stream.schema, keys)
    run(stream, out.write, mode, **conf)
    return out.rows()


def stream_of(spark: SparkSession, sf_dir: str, name: str, files: int = 1000) -> DataFrame:
    """One of the tables as a stream of files, at most `files` in a micro-batch."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(f"{sf_dir}/{name}.parquet*")


def rolling_usage(events: DataFrame) -> DataFrame:
    """Hits of each user in windows of 24 hours every hour; the state has all of them, so up to 24 rows for a hit (rolling keeps one)."""
    w = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "1 day").groupBy(F.window("ts", "24 hours", "1 hour"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return w.select(F.col("window.start").alias("start"), "user_id", "n")


def hourly_usage(events: DataFrame) -> DataFrame:
    """Hits of each user in each hour; the watermark lets an hour go when the last of its 24 windows would go in rolling_usage."""
    w = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "2 days").groupBy(F.window("ts", "1 hour"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return w.select(F.col("window.start").alias("start"), "user_id", "n")


def windows_of(hours: DataFrame, width: int = 24) -> DataFrame:
    """Hits of each user in windows of `width` hours every hour, from hits by hour; users are dealt so that a task sums a bounded number of windows."""
    before = F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("before")
    each = dealt(materialize(hours, "hours"), "user_id", rows=WINDOWS // width).select("start", "user_id", "n", before)
    start = F.timestamp_micros(F.unix_micros("start") - F.col("before") * 3_600_000_000)
    return each.groupBy(start.alias("start"), "user_id").agg(F.sum("n").alias("n"))


def rolling(events: DataFrame) -> DataFrame:
    """rolling_usage of a stream, run over all that is available: its state and its epochs have hours, from which windows are summed when they are read.

    The state is on disk, and a file is read in parts of a few MB, as a part's hours are summed in memory first.
    """
    return windows_of(drain(hourly_usage(events), "update", "usage", ("start", "user_id"), **BOUNDED))


#: Windows that a task sums, before equal ones are added up.
WINDOWS = 1 << 20


#: State of a key (a mark of time, and tokens left), and what each rule answers for an event.
STATE = "mark double, left double"
Rule = Callable[[float | None, float | None, float], tuple[float, float, bool]]


def debounce_rule(gap_s: float) -> Rule:
    """An event counts if the last counted one is gap_s seconds or more before it."""

    def rule(mark: float | None, left: float | None, t: float) -> tuple[float, float, bool]:
        counts = mark is None or t - mark >= gap_s
        return (t if counts else mark), 0.0, counts

    return rule


def bucket_rule(per_minute: float) -> Rule:
    """An event is allowed if it finds a token; a bucket starts full and refills by per_minute / 60 a second, in event time."""

    def rule(mark: float | None, left: float | None, t: float) -> tuple[float, float, bool]:
        have = per_minute if mark is None else min(per_minute, left + (t - mark) * per_minute / 60)
        return t, (have - 1 if have >= 1 else have), have >= 1

    return rule


TIMED, JUDGED = "user_id long, t double, event_id long", f"user_id long, event_id long, passed boolean, {STATE}"


def timed(events: DataFrame) -> DataFrame:
    return events.select("user_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"), "event_id")


def fold(rows: DataFrame, rule: Rule, states: DataFrame | None = None) -> DataFrame:
    """Each event judged by a rule that follows its user's events in order, then a row without event for the user's last state.

    Rows (user_id, t, event_id) are exchanged by user and sorted within partitions, a given state
    (user_id, mark, left) before its user's events; a task carries the state of one user only, so a
    user of any number of events takes no memory.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        user, mark, left = None, None, None
        for batch in batches:
            out: list[tuple] = []
            for u, t, event, m, x in zip(*(batch.column(c).to_pylist() for c in ("user_id", "t", "event_id", "mark", "left")), strict=True):
                if u != user:
                    out += [(user, None, None, mark, left)] if user is not None and mark is not None else []
                    user, mark, left = u, None, None
                if event is None:
                    mark, left = m, x
                else:
                    mark, left, ok = rule(mark, left, t)
                    out.append((u, event, ok, mark, left))
            yield pa.RecordBatch.from_pylist([dict(zip(shape.names, r, strict=True)) for r in out], shape)
        if user is not None and mark is not None:
            yield pa.RecordBatch.from_pylist([dict(zip(shape.names, (user, None, None, mark, left), strict=True))], shape)

    shape = pa.schema([("user_id", pa.int64()), ("event_id", pa.int64()), ("passed", pa.bool_()), ("mark", pa.float64()), ("left", pa.float64())])
    blank = [F.lit(None).cast("double").alias(c) for c in ("mark", "left")]
    both = rows.select("user_id", "t", "event_id", *blank)
    if states is not None:
        both = both.unionByName(states.select("user_id", F.lit(None).cast("double").alias("t"), F.lit(None).cast("long").alias("event_id"), "mark", "left"))
    ordered = both.repartition("user_id").sortWithinPartitions("user_id", "t", "event_id")  # nulls, so states, come first
    return ordered.mapInArrow(run, JUDGED)


def judged(events: DataFrame, rule: Rule) -> DataFrame:
    """Batch twin: user_id, event_id, passed of every event."""
    return fold(timed(events), rule).where("event_id IS NOT NULL").select("user_id", "event_id", "passed")


class OrderedFold:
    """The same over micro-batches in event time, equal to the batch twin for events at most `delay_s` seconds late.

    An epoch judges the events up to its watermark (the newest time seen less the delay), those
    above it wait in a table for the next; events below the watermark of the epoch before are too
    late and are left out. Users' states are a keyed table. All three tables are written by epoch,
    from those before it, so a repeated epoch gives the same again. A task holds one user's state.
    """

    def __init__(self, spark: SparkSession, rule: Rule, delay_s: float, root: str):
        self.rule, self.delay = rule, delay_s
        table = lambda name, schema, *keys: EpochTable(spark, f"{root}/{name}", spark.createDataFrame([], schema).schema, keys)
        self.results = table("results", JUDGED)
        self.states = table("states", f"user_id long, {STATE}", "user_id")
        self.waiting = table("waiting", TIMED + ", at_epoch long")
        self.marks = table("marks", "mark double")

    def apply(self, batch: DataFrame, epoch: int, last: bool = False) -> None:
        before = self.marks.rows(epoch).agg(F.max("mark")).first()[0]
        kept = self.waiting.rows(epoch).where(F.col("at_epoch") == epoch - 1).drop("at_epoch")
        fresh = timed(batch) if before is None else timed(batch).where(F.col("t") >= before)
        rows = materialize(kept.unionByName(fresh), "epoch")
        newest = rows.agg(F.max("t")).first()[0]
        mark = max(x for x in (before, None if newest is None else newest - self.delay, float("-inf")) if x is not None)
        ready = rows if last else rows.where(F.col("t") <= mark)
        folded = materialize(fold(ready, self.rule, self.states.rows(epoch)), "folded")
        self.results.write(folded.where("event_id IS NOT NULL"), epoch)
        self.states.write(folded.where("event_id IS NULL"), epoch)
        self.waiting.write(rows.where(F.lit(not last) & (F.col("t") > mark)).withColumn("at_epoch", F.lit(epoch).cast("long")), epoch)
        self.marks.write(batch.sparkSession.createDataFrame([(mark,)], "mark double"), epoch)


def judged_stream(events: DataFrame, rule: Rule, delay_s: float = 600) -> DataFrame:
    """user_id, event_id, passed of a stream's events, run over all that is available."""
    spark = events.sparkSession
    folded, epochs = OrderedFold(spark, rule, delay_s, scratch_path(spark, "fold")), []

    def each(batch: DataFrame, epoch: int) -> None:
        folded.apply(batch, epoch)
        epochs.append(epoch)

    run(events, each)
    folded.apply(spark.createDataFrame([], events.schema), max(epochs, default=-1) + 1, last=True)
    return folded.results.rows().select("user_id", "event_id", "passed")


def debounce(events: DataFrame, gap_s: int = 10) -> DataFrame:
    """user_id, event_id of the events that count; of a stream or a table."""
    return (judged_stream if events.isStreaming else judged)(events, debounce_rule(gap_s)).where("passed").select("user_id", "event_id")


def token_bucket(events: DataFrame, per_minute: float) -> DataFrame:
    """user_id, event_id, allowed of every event; of a stream or a table."""
    return (judged_stream if events.isStreaming else judged)(events, bucket_rule(per_minute)).withColumnRenamed("passed", "allowed")


def sessions(events: DataFrame, gap: str = "2 hours") -> DataFrame:
    s = events.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return s.select("user_id", F.col("w.start").alias("start"), "n")


class Silences(StatefulProcessor):
    """Emits a user's last event before each silence of more than limit_ms; an event-time timer ends the wait.

    Times above the watermark wait in the state, so events may come in any order within its
    delay. After a silence has been told the user's state goes, so only active users have any.
    """

    def __init__(self, limit_ms: int):
        self.limit_ms = limit_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.times = handle.getListState("times", "t long")
        self.last = handle.getValueState("last", "t long")

    def _set_timers(self, times: list[int], last: int | None) -> None:
        for t in [*self.handle.listTimers()]:
            self.handle.deleteTimer(t)
        if times:
            self.handle.registerTimer(-(-times[0] // 1000))
        if last is not None:
            self.handle.registerTimer(-(-last // 1000) + self.limit_ms)

    def _keep(self, times: list[int], last: int | None) -> None:
        self.times.put([(t,) for t in times]) if times else self.times.clear()
        self.last.update((last,)) if last is not None else self.last.clear()
        self._set_timers(times, last)

    def _state(self) -> tuple[list[int], int | None]:
        return sorted(t for (t,) in self.times.get()), self.last.get()[0] if self.last.exists() else None

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        times, last = self._state()
        fresh = [int(t) for frame in rows for t in frame["t"]]
        self._keep(sorted(times + fresh), last)
        return iter([pd.DataFrame({"user_id": pd.Series(dtype="int64"), "last": pd.Series(dtype="int64")})])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        times, last = self._state()
        told = []
        while times and -(-times[0] // 1000) <= now:
            if last is not None and times[0] - last > self.limit_ms * 1000:
                told.append(last)
            last = times.pop(0)
        if last is not None and -(-last // 1000) + self.limit_ms <= now:
            told.append(last)
            last = None
        self._keep(times, last)
        yield pd.DataFrame({"user_id": [key[0]] * len(told), "last": told})

    def close(self) -> None:
        pass


def silences(events: DataFrame, limit_ms: int, delay: str = "10 minutes") -> DataFrame:
    """Stream of user_id, last (microseconds) of each silence; to be run with ROCKS."""
    late = events.select("user_id", F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", delay).withColumn("t", F.unix_micros("ts"))
    return late.groupBy("user_id").transformWithStateInPandas(Silences(limit_ms), "user_id long, last long", "append", "eventTime")


#: The state store that keyed timers need.
ROCKS = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
#: The same with a bound on the memory of all stores of an executor together, and small parts of files.
BOUNDED = ROCKS | {"spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true", "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "500", "spark.sql.files.maxPartitionBytes": "8m"}


def silent(events: DataFrame, limit_ms: int, delay_ms: int = 600_000) -> DataFrame:
    """Batch twin: each event without another of its user within the limit, if that has passed before the newest of all less the delay."""
    t = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = events.select("user_id", t.alias("last"), F.lead(t).over(Window.partitionBy("user_id").orderBy(t)).alias("next"))
    newest = events.agg(F.floor(F.max(t) / 1000).alias("now"))  # one row
    alone = F.col("next").isNull() | (F.col("next") - F.col("last") > limit_ms * 1000)
    return rows.crossJoin(F.broadcast(newest)).where(alone & (F.ceil(F.col("last") / 1000) + limit_ms <= F.col("now") - delay_ms)).select("user_id", "last")


def ingest_new(stream: DataFrame, key: str, there: DataFrame | None = None) -> DataFrame:
    """Rows of a stream whose key no earlier epoch, nor the table `there`, has; of one epoch's rows with a key one stays."""
    spark = stream.sparkSession
    kept = EpochTable(spark, scratch_path(spark, "ingest"), stream.schema)

    def each(batch: DataFrame, epoch: int) -> None:
        old = kept.rows(epoch).select(key)
        kept.write(batch.dropDuplicates([key]).join(old if there is None else old.union(there.select(key)), key, "left_anti"), epoch)

    run(stream, each)
    return kept.rows()


def upsert(stream: DataFrame, keys: tuple[str, ...], *order: str) -> DataFrame:
    """The row of each key that is last in order of all that a stream brought, a late one included; a batch reads only the stored rows of its keys."""
    spark = stream.sparkSession
    kept = EpochTable(spark, scratch_path(spark, "upsert"), stream.schema, keys)
    rest = [c for c in stream.columns if c not in keys]

    def each(batch: DataFrame, epoch: int) -> None:
        old = kept.rows(epoch).join(batch.select(*keys).distinct(), [*keys], "left_semi")
        last = batch.unionByName(old).groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("last"))
        kept.write(last.select(*keys, "last.*"), epoch)

    run(stream, each)
    return kept.rows()


class Retries:
    """A keyed table of states in which each epoch, after its own rows, tries the first `most` rows of one state again.

    resolve maps a row's columns to its new state; rows that keep the old one are tried again later.
    """

    def __init__(self, spark: SparkSession, root: str, schema: StructType, key: str, state: str, resolve: Column, most: int):
        self.table, self.key, self.state, self.resolve, self.most = EpochTable(spark, root, schema, (key,)), key, state, resolve, most

    def apply(self, batch: DataFrame, epoch: int) -> None:
        before = self.table.rows(epoch).join(batch.select(self.key), self.key, "left_anti")
        rows = materialize(before.where(F.col("status") == self.state).select(*self.table.columns).union(batch.select(*self.table.columns)), "epoch")
        tried = rows.where(F.col("status") == self.state).orderBy(self.key).limit(self.most).withColumn("status", self.resolve)
        changed = materialize(tried, "tried")
        self.table.write(changed.unionByName(batch.select(*self.table.columns).join(changed, self.key, "left_anti")), epoch)


def keep_first(events: DataFrame, by: list[str], order: str) -> DataFrame:
    return events.withColumn("k", F.row_number().over(Window.partitionBy(*by).orderBy(order))).where("k = 1").drop("k")
