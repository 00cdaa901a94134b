"""Recorded streams in segments (stream, t0, t1, rate): local sample numbers, master time, windows, gaps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import rangejoin


def cumulative(segments: DataFrame) -> DataFrame:
    """segments with n, first and last_plus: samples, and the range of local sample numbers [first, last_plus)."""
    n = F.rint((F.col("t1") - F.col("t0")) * F.col("rate")).cast("long")
    w = Window.partitionBy("stream").orderBy("t0").rowsBetween(Window.unboundedPreceding, 0)
    out = segments.withColumn("n", n).withColumn("last_plus", F.sum("n").over(w))
    return out.withColumn("first", F.col("last_plus") - F.col("n"))


def to_master(samples: DataFrame, segments: DataFrame, width: int = 100_000) -> DataFrame:
    """samples (stream, idx) with t, the master time of each; outside of the segments they are dropped."""
    ranges = cumulative(segments).select("stream", F.col("first").alias("start"), F.col("last_plus").alias("stop"), "t0", "rate")
    found = rangejoin.points_in_periods(samples, ranges, width, ("stream",), "idx")
    return found.withColumn("t", F.col("t0") + (F.col("idx") - F.col("start")) / F.col("rate")).drop("start", "stop", "t0", "rate")


def to_local(points: DataFrame, segments: DataFrame, width: float) -> DataFrame:
    """points (stream, t) with idx, the nearest local sample number; points outside of the segments are dropped.

    A point within half a sample of a segment's end gets the number that follows it, which is the first of the next segment.
    """
    ranges = cumulative(segments).select("stream", F.col("t0").alias("start"), F.col("t1").alias("stop"), "first", "rate")
    found = rangejoin.points_in_periods(points, ranges, width, ("stream",), "t")
    return found.withColumn("idx", F.col("first") + F.rint((F.col("t") - F.col("start")) * F.col("rate")).cast("long")).drop("start", "stop", "first", "rate")


def gaps(segments: DataFrame) -> DataFrame:
    """(stream, start, stop) between consecutive segments."""
    nxt = F.lead("t0").over(Window.partitionBy("stream").orderBy("t0"))
    return segments.select("stream", F.col("t1").alias("start"), nxt.alias("stop")).where("stop > start")


def restrict(segments: DataFrame, windows: DataFrame) -> DataFrame:
    """Segments clipped to windows (stream, w0, w1)."""
    both = segments.join(windows, "stream").where("t0 < w1 AND w0 < t1")
    return both.select("stream", F.greatest("t0", "w0").alias("t0"), F.least("t1", "w1").alias("t1"), "rate")


def grid(windows: DataFrame, samples: DataFrame, by: tuple[str, ...] = ("session",)) -> DataFrame:
    """(by, idx, value): every index of the windows (by, first, last_plus), with 0 where no sample was recorded."""
    wide = windows.select(*by, F.explode(F.sequence("first", F.col("last_plus") - 1)).alias("idx"))
    return wide.join(samples.select(*by, "idx", "value"), [*by, "idx"], "left").select(*by, "idx", F.coalesce("value", F.lit(0.0)).alias("value"))
