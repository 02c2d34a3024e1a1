"""Streams over tables that grow, each with a batch reading of what it wrote."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tessera.operators import audit, findings
from tessera.sources.scratch import shared_path

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def table_stream(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table, or the files of a folder, as a stream."""
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path}*")


def events_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a stream of files, with ts as an instant so that it can carry a watermark."""
    stream = table_stream(spark, f"{sf_dir}/events.parquet")
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


class Clock:
    """A second source beside a stream that says, at the end, that time has gone on.

    Rows of the clock have a time and nulls. A stream in append mode holds back what
    the watermark has not passed; after tick() a last run gives it out. Results under a
    null key, the clock's own, are dropped when they are read: on the stream the filter
    would be pushed below the watermark, which then saw no tick.
    """

    def __init__(self, stream: DataFrame, time: str, key: str):
        self.spark, self.schema, self.time, self.key = stream.sparkSession, stream.schema, time, key
        self.path = shared_path(self.spark, "clock")
        self.spark.createDataFrame([], self.schema).write.parquet(self.path)
        ticks = self.spark.readStream.schema(self.schema).parquet(self.path)
        self.stream = stream.unionByName(ticks)

    def tick(self, at: str = "2200-01-01") -> None:
        row = self.spark.range(1).select(*[F.lit(at if f.name == self.time else None).cast(f.dataType).alias(f.name) for f in self.schema.fields])
        row.write.mode("append").parquet(self.path)


def put_batch(target: str):
    """A sink keyed by the batch's number: a batch that runs again replaces what it wrote before."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={number}")

    return put


def run(stream: DataFrame, mode: str, target: str, marks: str) -> None:
    """Run a stream over what is there; run again with the same marks it goes on from there."""
    query = stream.writeStream.outputMode(mode).foreachBatch(put_batch(target)).option("checkpointLocation", marks).trigger(availableNow=True).start()
    query.awaitTermination()


def drain(stream: DataFrame, mode: str, name: str, keys: tuple[str, ...] = (), clock: Clock | None = None) -> DataFrame:
    """Run a stream over what is there and return what it says at the end.

    In append mode that are all rows; in update mode the latest row of each of keys.
    With a clock, windows that are still open are closed by its tick.
    """
    spark = stream.sparkSession
    target, marks = shared_path(spark, name), shared_path(spark, f"{name}-marks")
    run(stream, mode, target, marks)
    if clock:
        clock.tick()
        run(stream, mode, target, marks)
    kind = T.StructType([*stream.schema.fields, T.StructField("batch", T.LongType())])
    rows = spark.read.schema(kind).option("basePath", target).parquet(target)
    if keys:
        rest = F.struct(*[c for c in stream.columns if c not in keys])
        rows = rows.groupBy(*keys).agg(F.max_by(rest, "batch").alias("r")).select(*keys, "r.*")
    return rows.where(F.col(clock.key).isNotNull()).select(stream.columns) if clock else rows.select(stream.columns)


def rate_windows(events: DataFrame, limit: int, length: str = "1 hour", lateness: str = "10 minutes") -> DataFrame:
    """Events of each user in aligned windows, and whether there are more than the limit.

    In append mode a window is given out once, when the watermark has passed it, and leaves the state.
    """
    per = events.withWatermark("ts", lateness).groupBy("user_id", F.window("ts", length).alias("w")).agg(F.count("*").alias("n"))
    return per.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), "n", (F.col("n") > limit).alias("limited"))


class FirstEventWindows(StatefulProcessor):
    """Windows of one key that begin with its first event, and then with the first event after the last window's end.

    Times that arrive wait, with how often each was seen, until the watermark has
    passed the end of their window, so the order of arrival does not matter. The
    state of a key is its waiting times and the window that is open.
    """

    def __init__(self, length: int):
        """length is in microseconds."""
        self.length = length

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "at long", "n long")
        self.open = handle.getValueState("open", "start long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for batch in rows:
            seen = batch["micros"].groupby(batch["micros"]).size()
            for at, n in zip(seen.index.tolist(), seen.tolist()):
                before = self.waiting.getValue((at,))[0] if self.waiting.containsKey((at,)) else 0
                self.waiting.updateValue((at,), (before + n,))
        yield self.advance(key, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self.advance(key, timerValues.getCurrentWatermarkInMs())

    def wake(self, at: int) -> None:
        """Ask for a call when the watermark, which counts in milliseconds, has passed at."""
        self.handle.registerTimer(at // 1000 + 1)

    def advance(self, key, millis: int) -> pd.DataFrame:
        """Close what the watermark has passed, and ask to be woken for what comes next."""
        watermark = millis * 1000
        times = sorted((at[0], n[0]) for at, n in self.waiting.iterator())
        start = self.open.get()[0] if self.open.exists() else None
        closed, place = [], 0
        while True:
            if start is None:
                if place == len(times):
                    break
                if times[place][0] >= watermark:  # an earlier event may still come
                    self.wake(times[place][0])
                    break
                start = times[place][0]
            if start + self.length > watermark:
                self.wake(start + self.length)
                break
            n, first = 0, place
            while place < len(times) and times[place][0] < start + self.length:
                n += times[place][1]
                place += 1
            for at, _ in times[first:place]:
                self.waiting.removeKey((at,))
            closed.append((key[0], start, n))
            start = None
        if start is None:
            self.open.clear()
        else:
            self.open.update((start,))
        return pd.DataFrame(closed, columns=["user_id", "micros", "n"])

    def close(self) -> None:
        pass


def first_event_windows(events: DataFrame, limit: int, seconds: int, lateness: str = "10 minutes") -> DataFrame:
    """(user_id, start, n, limited): windows of each user that begin with an event, given out once they are over.

    Events that come later than the watermark allows are left out; others may come in any order.
    """
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    rows = events.withWatermark("ts", lateness).select("user_id", "ts", F.unix_micros("ts").alias("micros"))
    got = rows.groupBy("user_id").transformWithStateInPandas(
        statefulProcessor=FirstEventWindows(seconds * 1_000_000), outputStructType="user_id long, micros long, n long", outputMode="Append", timeMode="EventTime"
    )
    start = F.timestamp_micros("micros").cast("timestamp_ntz")
    return got.select("user_id", start.alias("start"), "n", (F.col("n") > limit).alias("limited"))


def status_counts(events: DataFrame) -> DataFrame:
    """Counts of each type so far; in update mode only types that changed are given out."""
    return events.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.max("value"), 4).alias("most"))


def scan_added(added: DataFrame, *carried: str, key: str = "path") -> DataFrame:
    """(key, carried, line_no, kind, rule, category, severity, finding_id) of text that was added: rows (key, language, text).

    Secrets, insecure code and orders to a model, on each line with the three after
    it. Only the row itself is looked at, so it runs on a stream as on a table.
    """
    lines = F.split("text", "\n")
    each = F.transform(F.sequence(F.lit(1), F.size(lines)), lambda i: F.struct(i.alias("line_no"), F.get(lines, i - 1).alias("line"), F.array_join(F.slice(lines, i, 4), "\n").alias("block")))
    rows = added.where("text is not null").select(key, *carried, "language", F.explode(each).alias("l")).select(key, *carried, "language", "l.*")
    finding = lambda kind, rule, category, severity: F.struct(F.lit(kind).alias("kind"), rule.alias("rule"), category.alias("category"), severity.alias("severity"))
    secret = F.transform(findings.secret_hits(F.col("line")), lambda h: finding("secret", h["rule"], F.lit("secrets"), h["severity"]))
    code = F.transform(audit.rule_hits(F.col("block"), F.col("line"), F.col("language")), lambda h: finding("code", h["rule"], h["category"], h["severity"]))
    orders = F.transform(findings.injection(F.col("line")), lambda m: finding("injection", F.lit("orders-to-a-model"), F.lit("model"), F.lit("high")))
    found = rows.select(key, *carried, "line_no", F.explode(F.array_distinct(F.concat(secret, code, orders))).alias("f")).select(key, *carried, "line_no", "f.*")
    return found.withColumn("finding_id", F.sha2(F.concat_ws("\x1f", F.col(key), "line_no", "rule"), 256))


def scan_on_arrival(added: DataFrame, window: str = "1 hour") -> DataFrame:
    """scan_added on a stream, each finding once, however often its text arrives within the window."""
    stamped = added.withColumn("arrived", F.current_timestamp()).withWatermark("arrived", window)
    return scan_added(stamped, "arrived").dropDuplicatesWithinWatermark(["finding_id"]).drop("arrived")


def feed(events: DataFrame) -> DataFrame:
    """What a feed shows of an event; appended as it comes."""
    return events.select("event_id", "user_id", "event_type", "ts")
