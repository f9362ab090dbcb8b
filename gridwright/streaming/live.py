"""Frames that arrive: streams that end when everything there is has been read, with a watermark, late rows and timers.

Files of events land in a folder of the shared place. ``drained`` starts a stream over that folder, lets it read what has
come since the last time, and stops it; where it stood, its state and its watermark are kept beside the output, so that a run that dies goes on
where the last finished batch left it, and a later run reads only what is new. ``in_arrivals`` feeds a table to such a stream arrival by arrival.

Windows of an hour close when the watermark, WATERMARK behind the latest event seen, has passed their end. A row for a
closed window is late and dropped. Output is appended once a window has closed; the last windows stay open until later events come.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..plans.iterate import shared_path
from .frames import WATERMARK

#: State lives on the executors' disks, so that it may be larger than their memory; stateful processors need it.
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
ARRIVALS, DELAY = 5, 2
#: A stream whose frames stay away for so many hours begins anew; a frame closes so many hours after its start.
SILENCE_HOURS, FRAME_HOURS = 12, 1
HOUR_MS = 3_600_000
SMOOTHED = "stream_id long, start timestamp, mean double, smooth double, gain double"

Transform = Callable[[DataFrame], DataFrame]


def drained(spark: SparkSession, source: str, schema, transform: Transform, out: str) -> None:
    """Appends to out what transform makes of the files of source that have come since the last call; returns when they are read."""
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    try:
        made = transform(spark.readStream.schema(schema).parquet(source))
        query = made.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{out}-progress").trigger(availableNow=True).start(out)
        query.awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def with_arrival(rows: DataFrame, n: int = ARRIVALS, delay: int = DELAY, every: int = 20) -> DataFrame:
    """rows with `arrival`, 0 to n - 1: its share of the time that all rows span, and for each row whose event_id is a multiple of
    `every` that much later, if there is such an arrival."""
    span = rows.agg(F.min(F.unix_micros("ts")).alias("first"), (F.max(F.unix_micros("ts")) - F.min(F.unix_micros("ts")) + 1).alias("whole"))
    own = F.floor((F.unix_micros("ts") - F.col("first")) * n / F.col("whole")).cast("int")
    # one row of two numbers
    placed = rows.crossJoin(F.broadcast(span)).withColumn("own", own)
    late = (F.col("event_id") % every == 0) & (F.col("own") + delay < n)
    return placed.withColumn("arrival", F.col("own") + F.when(late, delay).otherwise(0)).drop("first", "whole", "own")


def in_arrivals(rows: DataFrame, transform: Transform, name: str) -> DataFrame:
    """What a stream appends when the rows come arrival by arrival (with_arrival()), each written to a folder and drained."""
    spark = rows.sparkSession
    source, out = shared_path(spark, f"{name}-arrivals"), shared_path(spark, name)
    for k in range((rows.agg(F.max("arrival")).first()[0] or 0) + 1):
        rows.where(F.col("arrival") == k).drop("arrival").write.mode("append").parquet(source)
        drained(spark, source, rows.drop("arrival").schema, transform, out)
    return spark.read.schema(transform(rows.drop("arrival").limit(0)).schema).parquet(out)


class Smoothing(StatefulProcessor):
    """Keeps the last frame's time and smoothed mean of each stream; a timer forgets a stream that has been silent too long."""

    def __init__(self, alpha: float, silence_ms: int) -> None:
        self.alpha, self.silence_ms = alpha, silence_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "start_ms long, smooth double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frames = pd.concat(list(rows)).sort_values("start")
        old = self.last.get() if self.last.exists() else None
        out = []
        for start, mean in zip(frames["start"], frames["mean"], strict=True):
            at = pd.Timestamp(start).value // 1_000_000
            fresh = old is None or at - old[0] > self.silence_ms
            old = (at, mean if fresh else self.alpha * mean + (1 - self.alpha) * old[1])
            out.append((key[0], start, mean, old[1], old[1] / mean if mean else 1.0))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        # a frame within the silence may still be open so long after its start
        self.handle.registerTimer(old[0] + self.silence_ms + FRAME_HOURS * HOUR_MS + 1)
        self.last.update(old)
        yield pd.DataFrame(out, columns=["stream_id", "start", "mean", "smooth", "gain"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.last.clear()
        yield pd.DataFrame({"stream_id": [], "start": pd.to_datetime([]), "mean": [], "smooth": [], "gain": []})

    def close(self) -> None:
        pass


def deflicker_live(frames: DataFrame, alpha: float = 0.25, silence_hours: int = SILENCE_HOURS) -> DataFrame:
    """stream_id, start, mean, smooth, gain of closed frames (stream_id, start, mean): smoothing that begins anew after a silence."""
    keyed = frames.select("stream_id", "start", "mean").groupBy("stream_id")
    return keyed.transformWithStateInPandas(Smoothing(alpha, silence_hours * HOUR_MS), SMOOTHED, "append", "eventTime")


def frame_means(rows: DataFrame) -> DataFrame:
    """stream_id, start, mean of each frame of FRAME_HOURS; the watermark goes on to what comes after."""
    grouped = rows.withWatermark("ts", WATERMARK).groupBy(F.window("ts", f"{FRAME_HOURS} hour").alias("w"), "stream_id").agg(F.round(F.avg("value"), 6).alias("mean"))
    return grouped.select("stream_id", F.col("w.start").alias("start"), "mean")
