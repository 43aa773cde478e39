"""Streams of events; each aggregate has a batch twin of the same shape."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

from termlake.tasks import ship

ship(__name__)


def read_events(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Parquet files as they arrive; ts becomes an instant in the session's zone, as watermarks need."""
    return spark.readStream.schema(schema).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def hourly(events: DataFrame) -> DataFrame:
    """(bucket, event_type, n)"""
    return events.groupBy(F.date_trunc("hour", "ts").alias("bucket"), "event_type").agg(F.count("*").alias("n"))


def hourly_stream(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """hourly() over a stream; hours are final when the watermark has passed them."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("bucket"), "event_type", "n")


def sessions(events: DataFrame, gap_seconds: int = 1800) -> DataFrame:
    """(user_id, session_start, n): a session ends where a user is silent for longer than the gap."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    seconds = F.unix_micros(F.col("ts").cast("timestamp"))
    new = F.coalesce((seconds - F.lag(seconds).over(order)) > gap_seconds * 1_000_000, F.lit(True))
    numbered = events.withColumn("new", new).withColumn("session", F.sum(F.col("new").cast("int")).over(order))
    return numbered.groupBy("user_id", "session").agg(F.min("ts").alias("session_start"), F.count("*").alias("n")).drop("session")


def counts_stream(events: DataFrame, keys: list[str]) -> DataFrame:
    """Running counts by key for output mode update: writers only append, so counts of concurrent ones add up."""
    return events.groupBy(*keys).agg(F.count("*").alias("n"))


def payload_stream(spark: SparkSession, path: str) -> DataFrame:
    """Files of telemetry payloads as they arrive, one payload each, replayed file by file."""
    from termlake.operators.telemetry import parse_payloads

    texts = spark.readStream.option("wholetext", True).text(path)
    return texts.select(parse_payloads(F.col("value")).alias("p")).select("p.*")


def mapped_batches(signals: DataFrame, load: Callable[[], DataFrame], write: Callable[[DataFrame, int], None], checkpoint: str):
    """A query that maps each micro-batch by the mapping as it is then (load), so that it is never staler than one batch; available files
    are read and the query ends."""
    from termlake.operators.telemetry import mapped

    return signals.writeStream.foreachBatch(lambda batch, n: write(mapped(batch, load()), n)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def deduplicated(events: DataFrame, keys: list[str], late: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def sessions_stream(events: DataFrame, gap_seconds: int = 1800, late: str = "1 hour") -> DataFrame:
    """sessions() over a stream, each when the watermark has passed its end. Two events exactly the gap apart are one session, as there."""
    gap = F.session_window("ts", f"{gap_seconds} seconds 1 microseconds")
    closed = events.withWatermark("ts", late).groupBy(gap, "user_id").agg(F.count("*").alias("n"))
    return closed.select("user_id", F.col("session_window.start").alias("session_start"), "n")


def sliding(events: DataFrame, keys: list[str], width: str = "1 hour", step: str = "15 minutes") -> DataFrame:
    """(start, keys, n) of windows of `width` that begin every `step`."""
    return events.groupBy(F.window("ts", width, step), *keys).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), *keys, "n")


def sliding_stream(events: DataFrame, keys: list[str], width: str = "1 hour", step: str = "15 minutes", late: str = "1 hour") -> DataFrame:
    """sliding() over a stream; a window is final when the watermark has passed its end, and what comes for it later is left out."""
    return sliding(events.withWatermark("ts", late), keys, width, step)


def increments(points: DataFrame) -> DataFrame:
    """points (series, ts, value) of a monotonic sum with the increment of each; a fall is a reset, from 0. Points of one instant go by value."""
    before = F.lag("value").over(Window.partitionBy("series").orderBy("ts", "value"))
    return points.withColumn("increment", F.when(before.isNull(), F.lit(0.0)).when(F.col("value") >= before, F.col("value") - before).otherwise(F.col("value")))


class _Increments(StatefulProcessor):
    """The last point of a series, and those that wait for the watermark: points may come in any order until it passes them."""

    def __init__(self, keep_ms: int) -> None:
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "micros bigint, value double")
        self.waiting = handle.getListState("waiting", "micros bigint, value double")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        for some in rows:
            micros = some["ts"].astype("int64") // (1 if some["ts"].dt.unit == "us" else 1000)
            self.waiting.appendList([(int(at), float(value)) for at, value in zip(micros, some["value"], strict=True)])
            for ms in {int(at) // 1000 + 1 for at in micros}:
                self.handle.registerTimer(ms)
        yield from ()

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        until, out, left = expiredTimerInfo.getExpiryTimeInMs() * 1000, [], []
        before = self.last.get() if self.last.exists() else None
        for at, value in sorted((tuple(x) for x in self.waiting.get()) if self.waiting.exists() else ()):
            if at >= until:
                left.append((at, value))
                continue
            out.append((key[0], at, value, 0.0 if before is None else value - before[1] if value >= before[1] else value))
            before = (at, value)
        if left:
            self.waiting.put(left)
        elif self.waiting.exists():
            self.waiting.clear()
        if out:
            self.last.update(before)
            self.handle.registerTimer(before[0] // 1000 + self.keep_ms)
            table = pd.DataFrame(out, columns=["series", "ts", "value", "increment"])
            table["ts"] = pd.to_datetime(table["ts"], unit="us", utc=True)
            yield table
        elif not left and before is not None and before[0] // 1000 + self.keep_ms <= expiredTimerInfo.getExpiryTimeInMs():
            self.last.clear()  # nothing came for so long: the series leaves the state

    def close(self) -> None:
        pass


def increments_stream(points: DataFrame, late: str = "1 hour", keep_seconds: int = 7 * 86400) -> DataFrame:
    """increments() over a stream of points (series, ts, value), each when the watermark has passed it: points that come in any order
    until then give the same rows. A series without a point for keep_seconds of event time leaves the state and starts anew when
    it returns. The session needs the RocksDB state store (spark.sql.streaming.stateStore.providerClass)."""
    marked = points.select(F.col("series").cast("string").alias("series"), "ts", F.col("value").cast("double").alias("value")).withWatermark("ts", late)
    return marked.groupBy("series").transformWithStateInPandas(_Increments(keep_seconds * 1000), "series string, ts timestamp, value double, increment double", "Append", "EventTime")
