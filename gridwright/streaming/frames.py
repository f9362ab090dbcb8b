"""Frames that arrive: Structured Streaming forms of local, histogram and statistics operators, and deflickering.

Rows are frame events: ts, stream_id, channel, value. Every transform takes a streaming or a batch frame
alike but for deflicker, whose state is the last smoothed mean of each stream.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

WATERMARK = "2 hours"


def frame_events(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """ts, stream_id, channel, value of an events table; as a file stream where asked."""
    schema = spark.read.parquet(path).schema
    rows = spark.readStream.schema(schema).parquet(path) if stream else spark.read.parquet(path)
    return rows.select(F.col("ts").cast("timestamp").alias("ts"), (F.col("user_id") % 8).alias("stream_id"), F.col("event_type").alias("channel"), F.least(F.floor(F.col("value") / 2), F.lit(255)).cast("int").alias("value"))


def stream_local(rows: DataFrame, threshold: int = 90) -> DataFrame:
    """A local operator on arriving values."""
    return rows.select("ts", "stream_id", "channel", F.when(F.col("value") > threshold, 255).otherwise(0).alias("value"))


def stream_histogram(rows: DataFrame, width: str = "1 hour", slide: str | None = None) -> DataFrame:
    """start, channel, bin, n by event-time window; rows later than the watermark are left out of a stream."""
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    counted = rows.withWatermark("ts", WATERMARK).groupBy(window.alias("w"), "channel", F.col("value").alias("bin")).agg(F.count("*").alias("n"))
    return counted.select(F.col("w.start").alias("start"), "channel", "bin", "n")


def stream_frame_stats(rows: DataFrame, width: str = "1 hour") -> DataFrame:
    """start, stream_id, low, high, mean, n of each frame (an hour of a stream)."""
    stats = rows.withWatermark("ts", WATERMARK).groupBy(F.window("ts", width).alias("w"), "stream_id").agg(F.min("value").alias("low"), F.max("value").alias("high"), F.round(F.avg("value"), 6).alias("mean"), F.count("*").alias("n"))
    return stats.select(F.col("w.start").alias("start"), "stream_id", "low", "high", "mean", "n")


def stream_sessions(rows: DataFrame, gap: str = "3 hours") -> DataFrame:
    """start, stop, stream_id, n of the bursts of a stream."""
    found = rows.withWatermark("ts", WATERMARK).groupBy(F.session_window("ts", gap).alias("w"), "stream_id").agg(F.count("*").alias("n"))
    return found.select(F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "stream_id", "n")


SMOOTHED = "stream_id long, start timestamp, mean double, smooth double, gain double"


def smoothing(alpha: float):
    """The state function of deflicker."""

    def run(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(parts)).sort_values("start")
        last = state.get[0] if state.exists else None
        out = []
        for start, mean in zip(rows["start"], rows["mean"], strict=True):
            last = mean if last is None else alpha * mean + (1 - alpha) * last
            out.append((key[0], start, mean, last, last / mean if mean else 1.0))
        state.update((last,))
        yield pd.DataFrame(out, columns=["stream_id", "start", "mean", "smooth", "gain"])

    return run


def deflicker(frames: DataFrame, alpha: float = 0.25) -> DataFrame:
    """Per stream, exponential smoothing of the frame means in time, and the gain that takes a frame to it. frames: stream_id, start, mean."""
    return frames.groupBy("stream_id").applyInPandasWithState(smoothing(alpha), SMOOTHED, "last double", "append", "NoTimeout")


#: Frames of a block that one row folds.
BLOCK = 64


def _scanned(rows: DataFrame, most: int, rest: float) -> DataFrame:
    """stream_id, k, n, v: what is smoothed up to each row of stream_id, k (0, 1, ... in each stream), n (frames that it stands for), v (their fold from zero).

    Rows are folded in blocks; the blocks' ends are rows of the same kind, fewer by BLOCK, and are scanned alike. So a stream of
    any length is spread over its blocks, and nothing that a value looks back on is cut off.
    """
    own = W.partitionBy("stream_id", "block").orderBy("k").rowsBetween(W.unboundedPreceding, 0)
    fold = F.aggregate(F.collect_list(F.struct("n", "v")).over(own), F.lit(0.0), lambda acc, b: acc * F.pow(F.lit(rest), b["n"]) + b["v"])
    inner = rows.withColumn("block", F.floor(F.col("k") / BLOCK)).select("stream_id", "block", "k", F.sum("n").over(own).alias("n"), fold.alias("v"))
    if most <= BLOCK:
        return inner.drop("block")
    ends = inner.groupBy("stream_id", F.col("block").alias("k")).agg(F.max_by("n", "k").alias("n"), F.max_by("v", "k").alias("v"))
    before = _scanned(ends, -(-most // BLOCK), rest).select("stream_id", (F.col("k") + 1).alias("block"), F.col("n").alias("bn"), F.col("v").alias("bv"))
    carried = F.coalesce("bv", F.lit(0.0)) * F.pow(F.lit(rest), F.col("n"))
    return inner.join(before, ["stream_id", "block"], "left").select("stream_id", "k", (F.col("n") + F.coalesce("bn", F.lit(0))).alias("n"), (F.col("v") + carried).alias("v"))


def deflicker_batch(frames: DataFrame, alpha: float = 0.25, block: str = "day") -> DataFrame:
    """The same on a finished table, exact for every alpha from 0 to 1. Frames are numbered in time blocks of their stream, of which one row a block
    carries the number on; then they are scanned in blocks of blocks.
    """
    day = W.partitionBy("stream_id", "day").orderBy("start")
    rows = frames.select("stream_id", "start", "mean", F.date_trunc(block, "start").alias("day")).withColumn("nth", F.row_number().over(day))
    sizes = rows.groupBy("stream_id", "day").agg(F.max("nth").alias("size"))
    before = F.coalesce(F.sum("size").over(W.partitionBy("stream_id").orderBy("day").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    # one number: how many blocks of blocks there are
    most = sizes.groupBy("stream_id").agg(F.sum("size").alias("n")).agg(F.max("n")).first()[0] or 0
    placed = rows.join(sizes.select("stream_id", "day", before.alias("before")), ["stream_id", "day"]).select("stream_id", (F.col("before") + F.col("nth") - 1).alias("k"), "start", "mean")
    # before the first frame the state is that frame
    share = F.col("mean") * F.when(F.col("k") == 0, 1.0).otherwise(alpha)
    smooth = _scanned(placed.select("stream_id", "k", F.lit(1).cast("long").alias("n"), share.alias("v")), most, 1 - alpha)
    joined = placed.join(smooth.select("stream_id", "k", F.col("v").alias("smooth")), ["stream_id", "k"])
    return joined.select("stream_id", "start", "mean", "smooth").withColumn("gain", F.when(F.col("mean") == 0, 1.0).otherwise(F.col("smooth") / F.col("mean")))
