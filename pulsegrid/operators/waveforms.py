"""Shapes of a unit's waveforms (unit, spike, channel, sample, value): amplitude, noise, widths, symmetry."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import quantiles


def mean_waveforms(waveforms: DataFrame, unit: str = "unit") -> DataFrame:
    """(unit, channel, sample, mean)."""
    return waveforms.groupBy(unit, "channel", "sample").agg(F.avg("value").alias("mean"))


def metrics(waveforms: DataFrame, rate: float, unit: str = "unit") -> DataFrame:
    """(unit, channel, amplitude, snr, width_ms, left_ms, right_ms, symmetry) of the channel with the greatest mean amplitude.

    snr: amplitude over twice the noise, the median distance of all values to their mean over 0.6745 (null without noise).
    width: from the trough to the greatest value after it. left: back to the last sample at half the trough or above;
    right: on to the second one after it (null where there is none). symmetry: right over left. Of equal channels and
    samples the first counts. A trough in the last sample leaves the widths null.
    """
    means = mean_waveforms(waveforms, unit)
    reach = means.groupBy(unit, "channel").agg((F.max("mean") - F.min("mean")).alias("amplitude"), F.min_by("sample", F.struct("mean", "sample")).alias("trough"), F.min("mean").alias("low"), F.max("sample").alias("last"))
    best = reach.groupBy(unit).agg(F.min_by(F.struct("channel", "amplitude", "trough", "low", "last"), F.struct(-F.col("amplitude"), "channel")).alias("b")).select(unit, "b.*")
    rows = means.join(best, [unit, "channel"])
    after, high = F.col("sample") >= F.col("trough"), F.col("mean") >= F.col("low") / 2
    order = F.row_number().over(Window.partitionBy(unit).orderBy((~(after & high)).cast("int"), "sample"))
    rows = rows.withColumn("_k", F.when(after & high, order))
    shape = rows.groupBy(unit).agg(
        F.min_by(F.when(after, F.col("sample")), F.when(after, F.struct(-F.col("mean"), F.col("sample")))).alias("peak"),
        F.max(F.when(~after & high, F.col("sample"))).alias("left"), F.max(F.when(F.col("_k") == 2, F.col("sample"))).alias("right"),
    )
    centre = waveforms.groupBy(unit).agg(F.avg("value").alias("_m"))
    off = waveforms.select(unit, "value").join(centre, unit)
    noise = quantiles.exact(off.select(unit, F.abs(F.col("value") - F.col("_m")).alias("off")), [unit], "off", {"_noise": 0.5})
    ms, whole = 1000.0 / rate, F.col("last") > F.col("trough")
    out = best.join(shape, unit).join(noise, unit, "left")
    out = out.select(
        unit, "channel", "amplitude", F.when(F.col("_noise") > 0, F.col("amplitude") / (2 * F.col("_noise") / 0.6745)).alias("snr"),
        F.when(whole, (F.col("peak") - F.col("trough")) * ms).alias("width_ms"), F.when(whole, (F.col("trough") - F.col("left")) * ms).alias("left_ms"), F.when(whole, (F.col("right") - F.col("trough")) * ms).alias("right_ms"),
    )
    return out.withColumn("symmetry", F.when(F.col("left_ms") > 0, F.col("right_ms") / F.col("left_ms")))
