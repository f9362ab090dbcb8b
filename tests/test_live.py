"""Streams that arrive: late rows, restarts, timers; and smoothing of finished tables at every alpha."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridwright.plans.iterate import shared_path
from gridwright.streaming import frames, live


def table(spark, rows):
    """(hour, stream, value) as events."""
    made = spark.createDataFrame([(i, float(h), s, v) for i, (h, s, v) in enumerate(rows, 1)], "event_id long, h double, stream_id long, value int")
    return made.select("event_id", (F.lit("2024-01-01 00:00:00").cast("timestamp") + F.make_interval(mins=(F.col("h") * 60).cast("int"))).alias("ts"), "stream_id", F.lit("c").alias("channel"), "value")


def test_late_rows_are_dropped_and_others_kept(spark):
    rows = table(spark, [(0.5, 1, 10), (1.5, 1, 20), (9.0, 1, 30), (0.7, 1, 40), (7.2, 1, 50), (30.0, 1, 60)])
    came = rows.withColumn("arrival", F.when(F.col("event_id") <= 3, 0).when(F.col("event_id") <= 5, 1).otherwise(2))
    got = {r.bin: r.n for r in live.in_arrivals(came, frames.stream_histogram, "late").collect()}
    # 40 comes when hour 0 has closed at 9:00 - 2 hours; hour 7 is open still; the last hour never closes
    assert got == {10: 1, 20: 1, 30: 1, 50: 1}


def test_a_later_run_reads_only_what_is_new(spark):
    source, out = (shared_path(spark, n) for n in ("again-in", "again"))
    rows = table(spark, [(h, 1, h) for h in range(20)])
    step = lambda lo, hi: (rows.where(F.col("value").between(lo, hi)).write.mode("append").parquet(source), live.drained(spark, source, rows.schema, frames.stream_frame_stats, out))
    step(0, 9)
    first = {r.low for r in spark.read.parquet(out).collect()}
    live.drained(spark, source, rows.schema, frames.stream_frame_stats, out)
    assert {r.low for r in spark.read.parquet(out).collect()} == first == set(range(7))
    step(10, 19)
    assert sorted(r.low for r in spark.read.parquet(out).collect()) == list(range(17))


def test_silence_starts_smoothing_anew(spark):
    hours = [0, 1, 2, 14, 15, 40, 41, 60, 80]
    rows = table(spark, [(h, s, 10 * (i + 1)) for s in (1, 2) for i, h in enumerate(hours)]).withColumn("arrival", F.when(F.hour("ts") + 24 * (F.dayofmonth("ts") - 1) < 15, 0).when(F.dayofmonth("ts") < 3, 1).otherwise(2))
    got = sorted((r.stream_id, r.mean, round(r.smooth, 9)) for r in live.in_arrivals(rows, lambda r: live.deflicker_live(live.frame_means(r), 0.5), "silence").collect())
    want, last, before = [], None, None
    for i, h in enumerate(hours[:-1]):
        m = 10.0 * (i + 1)
        last = m if before is None or h - before > 12 else 0.5 * m + 0.5 * last
        before = h
        want.append((m, last))
    assert got == [(s, m, v) for s in (1, 2) for m, v in want]


@pytest.mark.parametrize("alpha", [0.0, 0.001, 0.01, 0.25, 0.9, 1.0])
def test_smoothing_is_exact_at_every_alpha(spark, alpha, monkeypatch):
    rng = np.random.default_rng(2)
    means = rng.uniform(1, 255, 5000).tolist()
    rows = spark.createDataFrame([(s, i, m) for s, n in ((1, 5000), (2, 70), (3, 1)) for i, m in enumerate(means[:n])], "stream_id long, i int, mean double")
    table_ = rows.select("stream_id", (F.lit("2024-01-01 00:00:00").cast("timestamp") + F.make_interval(secs=F.col("i") * 20)).alias("start"), "mean")
    got = {}
    for r in frames.deflicker_batch(table_, alpha).collect():
        got.setdefault(r.stream_id, []).append((r.start, r.mean, r.smooth))
    assert {s: len(v) for s, v in got.items()} == {1: 5000, 2: 70, 3: 1}
    for own in got.values():
        last = None
        for _, m, smooth in sorted(own):
            last = m if last is None else alpha * m + (1 - alpha) * last
            assert abs(smooth - last) < 1e-9
