"""Periods of behaviour and oscillation by rule, and filling of gaps in tracked positions."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import save, ship
from . import intervals, quantiles, rangejoin, scans, sequence, signal


def moving(track: DataFrame, threshold: float, rate: float, half: int, min_interval: int, by: Sequence[str] = ("session",), idx: str = "idx", width: int | None = None) -> DataFrame:
    """(by, left, right): the median-filtered speed of (x, y) over a threshold for more than min_interval rows.

    With a width, a number of rows, idx must be gapless and keys not null, and no task sorts a whole session.
    """
    group = list(by)
    if width is not None:
        # One row more before: the speed of a part's first row isn't known.
        track, group = scans.near(track.select(*by, idx, "x", "y"), idx, width, half + 1, half), [*by, "_part"]
    rows = sequence.speed(track, rate, group, ("x", "y"), idx)
    rows = sequence.rolling_median(rows, half, group, idx, "speed")
    rows = rows.withColumn("median", F.coalesce("median", F.lit(0.0)))
    if width is not None:
        rows = save(rows.where("NOT _side").select(*by, idx, "median"))
    return sequence.crossings(rows, threshold, min_interval, by, idx, "median", width)


def rearing(markers: DataFrame, threshold: float, min_interval: int, head: str, body: str, by: Sequence[str] = ("session",), idx: str = "idx") -> DataFrame:
    """(by, left, right): the head's height over the body's by more than a threshold."""
    by = list(by)
    height = markers.groupBy(*by, idx).agg((F.max(F.when(F.col("marker") == head, F.col("z"))) - F.max(F.when(F.col("marker") == body, F.col("z")))).alias("height"))
    return sequence.crossings(height.where("height IS NOT NULL"), threshold, min_interval, by, idx, "height")


def without(periods: DataFrame, others: DataFrame, trim: float, by: Sequence[str] = ("session",)) -> DataFrame:
    """periods away from others by trim or more."""
    return intervals.subtract(periods, intervals.shift(others, -trim, trim), by)


def fill_linear(samples: DataFrame, longest: int, by: Sequence[str] = ("session",), idx: str = "idx", value: str = "value") -> DataFrame:
    """samples in which nulls between two values at most `longest` + 1 rows apart are filled along a line; others stay."""
    w = Window.partitionBy(*by).orderBy(idx)
    known = F.when(F.col(value).isNotNull(), F.struct(F.col(idx).alias("i"), F.col(value).alias("v")))
    before = F.last(known, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    # From the end on: Spark adds up a frame that has no end anew for each row.
    after = F.last(known, ignorenulls=True).over(Window.partitionBy(*by).orderBy(F.desc(idx)).rowsBetween(Window.unboundedPreceding, 0))
    rows = samples.withColumns({"_p": before, "_q": after})
    gap = F.col("_q.i") - F.col("_p.i")
    line = F.col("_p.v") + (F.col(idx) - F.col("_p.i")) / gap * (F.col("_q.v") - F.col("_p.v"))
    return rows.withColumn(value, F.coalesce(F.col(value), F.when(gap <= longest + 1, line))).drop("_p", "_q")


def _pchip(x: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Monotone cubic interpolation with harmonic-mean slopes."""
    h, d = np.diff(x), np.diff(y) / np.diff(x)
    m = np.zeros(len(x))
    if len(x) == 2:
        m[:] = d[0]
    else:
        w1, w2 = 2 * h[1:] + h[:-1], h[1:] + 2 * h[:-1]
        same = d[:-1] * d[1:] > 0
        m[1:-1][same] = ((w1 + w2)[same]) / (w1[same] / d[:-1][same] + w2[same] / d[1:][same])
        for end, a, b, ha, hb in ((0, d[0], d[1], h[0], h[1]), (-1, d[-1], d[-2], h[-1], h[-2])):
            slope = ((2 * ha + hb) * a - ha * b) / (ha + hb)
            m[end] = 0 if slope * a <= 0 else (3 * a if a * b < 0 and abs(slope) > 3 * abs(a) else slope)
    i = np.clip(np.searchsorted(x, at, side="right") - 1, 0, len(x) - 2)
    t = (at - x[i]) / h[i]
    return (1 + 2 * t) * (1 - t) ** 2 * y[i] + t * (1 - t) ** 2 * h[i] * m[i] + t * t * (3 - 2 * t) * y[i + 1] + t * t * (t - 1) * h[i] * m[i + 1]


def fill_smooth(samples: DataFrame, longest: int, by: Sequence[str] = ("session",)) -> DataFrame:
    """samples (by, idx, value) in which inner gaps of up to `longest` rows are filled by a monotone cubic through the known rows (four or more)."""
    ship(samples.sparkSession)
    by = list(by)
    rows = samples.select(*by, "idx", F.col("value").cast("double").alias("value"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("idx")
        x, y = group["idx"].to_numpy().astype(float), group["value"].to_numpy().copy()
        known = np.isfinite(y)
        if known.sum() >= 4:
            left = np.searchsorted(x[known], x, side="right") - 1
            inner = ~known & (left >= 0) & (left < known.sum() - 1)
            reach = np.diff(x[known])
            inner[inner] &= reach[left[inner]] <= longest + 1
            y[inner] = _pchip(x[known], y[known], x[inner])
        return group.assign(value=y)

    return rows.groupBy(*by).applyInPandas(run, schema)


def oscillations(samples: DataFrame, band: tuple[float, float], rate: float, peak_z: float, edge_z: float, min_cycles: int, by: Sequence[str] = ("session",)) -> DataFrame:
    """(by, left, right, peak, z): stretches in which the envelope of a band is over edge_z deviations, with a peak over peak_z,
    that last min_cycles of the band's mean frequency or more. peak is the row of the greatest envelope."""
    by = list(by)
    zpk = signal.butter(3, band, rate, "bandpass")
    envelope = signal.by_channel(samples, lambda x: np.abs(signal.analytic(signal.zero_phase(x, zpk, rate))), by, "power")
    w = Window.partitionBy(*by)
    rows = envelope.withColumn("z", (F.col("power") - F.avg("power").over(w)) / F.stddev_pop("power").over(w))
    least = int(min_cycles / (sum(band) / 2) * rate)
    found = sequence.runs(rows, F.col("z") > edge_z, by).where(F.col("n") >= least).select(*by, F.col("first").alias("start"), (F.col("last") + 1).alias("stop"), F.coalesce("left", "first").alias("left"), F.col("last").alias("right"))
    from . import rangejoin

    inside = rangejoin.points_in_periods(rows.select(*by, "idx", "z"), found, max(least, 1) * 4, by, "idx")
    best = inside.groupBy(*by, "left", "right").agg(F.max_by("idx", "z").alias("peak"), F.max("z").alias("z"))
    return best.where(F.col("z") > peak_z)


def basic_states(
    track: DataFrame, rate: float, walk: float = 3.0, rear: float = 1.25, smooth: float = 0.2, gap: float = 0.1, least: float = 0.5,
    by: Sequence[str] = ("session",), idx: str = "idx", width: int | None = None,
) -> DataFrame:
    """(by, label, start, stop in seconds) of walk, rear and pause, from track (by, idx, x, y, head_z) with gapless idx.

    walk: the speed of (x, y), in units a second and averaged over `smooth` seconds, is above `walk`. rear: the head is
    above `rear` times the median of its positive heights, and it's no walk (a null height is none). pause: neither.
    Gaps shorter than `gap` are closed, and periods shorter than `least` go. With a width, a number of rows, keys mustn't be null, and no task sorts a whole session.
    """
    by = list(by)
    parts = track.withColumns({"_part": F.lit(0), "_side": F.lit(False)}) if width is None else scans.near(track, idx, width, 1, 0)
    w = Window.partitionBy(*by, *(["_part"] if width is not None else [])).orderBy(idx)
    step = lambda c: (F.col(c) - F.lag(c).over(w)) * (F.col(c) - F.lag(c).over(w))
    rows = parts.select(*by, idx, F.coalesce(F.sqrt(step("x") + step("y")) * rate, F.lit(0.0)).alias("speed"), "head_z", "_side").where("NOT _side").drop("_side")
    if width is not None:
        rows = save(rows)
    rows = sequence.boxcar_mirrored(rows, max(1, round(smooth * rate)), by, idx, "speed", width)
    level = quantiles.exact(track.where("head_z > 0"), by, "head_z", {"_level": 0.5})
    up = F.coalesce(F.col("head_z") > rear * F.coalesce(F.col("_level"), F.lit(1.0)), F.lit(False))
    rows = rows.join(level, by, "left").withColumn("label", F.when(F.col("smooth") > walk, "walk").when(up, "rear").otherwise("pause"))
    rows = rows.select(*by, "label", idx)
    runs = intervals.from_mask(rows if width is None else save(rows), [*by, "label"], idx, width)
    found = intervals.fill_gaps(runs if width is None else save(runs), gap * rate, [*by, "label"], width)
    long = found.where(F.col("stop") - F.col("start") >= least * rate)
    return long.select(*by, "label", (F.col("start") / rate).alias("start"), (F.col("stop") / rate).alias("stop"))


def band_periods(samples: DataFrame, rate: float, band: tuple[float, float], threshold: float, length: int, n_fft: int, by: Sequence[str] = ("session",)) -> DataFrame:
    """(by, first, last, t_first, t_last): runs of spectral windows whose mean power in a band is above a threshold.

    samples (by, idx, value) are whitened by a second-order model; windows of `length` move by a quarter of that.
    Sniffing: the distance of head and spine, 8 to 14 Hz; shaking: the difference of two body azimuths, 14 to 16 Hz.
    A constant signal has none.
    """
    power = signal.spectrogram(signal.whitened(samples, by), rate, by, length=length, step=max(1, length // 4), n_fft=n_fft)
    rows = power.where(F.col("freq").between(*band)).groupBy(*by, "win").agg(F.avg("power").alias("power"), F.first("t").alias("t"))
    runs = sequence.runs(rows, F.col("power") > threshold, by, "win").select(*by, "first", "last")
    at = rows.select(*by, F.col("win"), "t")
    ends = lambda end: at.select(*by, F.col("win").alias(end), F.col("t").alias(f"t_{end}"))
    return runs.join(ends("first"), [*by, "first"]).join(ends("last"), [*by, "last"]).select(*by, "first", "last", "t_first", "t_last")


def _of(markers: DataFrame, names: Sequence[str], by: Sequence[str], idx: str) -> DataFrame:
    """(by, idx, a struct of x, y and z for each name) of the frames that have all the markers."""
    at = F.struct("x", "y", "z")
    wide = markers.where(F.col("marker").isin(list(names))).groupBy(*by, idx).agg(*(F.max(F.when(F.col("marker") == n, at)).alias(n) for n in names))
    return wide.dropna(subset=list(names))


def sniffing(
    markers: DataFrame, rate: float, threshold: float = 10**-3.5, band: tuple[float, float] = (8.0, 14.0), head: str = "head_back", spine: str = "spine_upper",
    length: int = 256, n_fft: int = 1024, by: Sequence[str] = ("session",), idx: str = "idx",
) -> DataFrame:
    """band_periods() of the distance of head and spine, from markers (by, idx, marker, x, y, z); frames without both are left out."""
    rows = _of(markers, (head, spine), by, idx)
    far = F.sqrt(sum(((F.col(f"{head}.{d}") - F.col(f"{spine}.{d}")) ** 2 for d in "xyz"), F.lit(0.0)))
    return band_periods(rows.select(*by, F.col(idx).alias("idx"), far.alias("value")), rate, band, threshold, length, n_fft, by)


def shaking(
    markers: DataFrame, rate: float, threshold: float = 1e-4, band: tuple[float, float] = (14.0, 16.0), names: Sequence[str] = ("spine_lower", "pelvis_root", "spine_middle"),
    length: int = 64, n_fft: int = 256, by: Sequence[str] = ("session",), idx: str = "idx", width: float | None = None,
) -> DataFrame:
    """band_periods() of the difference of two azimuths, from the first of `names` to the third and to the second, both unwrapped along idx."""
    rows = _of(markers, names, by, idx)
    azimuth = lambda name: F.atan2(F.col(f"{name}.y") - F.col(f"{names[0]}.y"), F.col(f"{name}.x") - F.col(f"{names[0]}.x"))
    rows = rows.select(*by, F.col(idx).alias("idx"), azimuth(names[1]).alias("_a"), azimuth(names[2]).alias("_b"))
    rows = scans.along(rows, by, "idx", width, lags={"_wa": F.col("_a"), "_wb": F.col("_b")})
    turn = lambda now, was: F.coalesce(-F.round((F.col(now) - F.col(was)) / (2 * np.pi)), F.lit(0.0))  # noqa: E731  whole turns since the row before
    rows = scans.along(rows, by, "idx", width, sums={"_ta": turn("_a", "_wa"), "_tb": turn("_b", "_wb")})
    value = F.col("_b") + 2 * np.pi * F.col("_tb") - F.col("_a") - 2 * np.pi * F.col("_ta")
    return band_periods(rows.select(*by, "idx", value.alias("value")), rate, band, threshold, length, n_fft, by)


def head_moving(
    markers: DataFrame, rate: float, method: str = "com", threshold: float = 2.0, min_interval: int = 40, half: int = 16,
    names: Sequence[str] = ("head_back", "head_left", "head_front", "head_right"), front: str = "head_front", by: Sequence[str] = ("session",), idx: str = "idx",
) -> DataFrame:
    """moving() of the head: of the mean of its markers (`com`), or of its front over 21 rows (`vel`)."""
    if method not in ("com", "vel"):
        raise ValueError("method is com or vel")
    names = list(names) if method == "com" else [front]
    rows = _of(markers, names, by, idx)
    mean = lambda d: sum((F.col(f"{n}.{d}") for n in names), F.lit(0.0)) / len(names)
    return moving(rows.select(*by, idx, mean("x").alias("x"), mean("y").alias("y")), threshold, rate, half if method == "com" else 10, min_interval, by, idx)


def walk_by_pitch(
    walk: DataFrame, markers: DataFrame, angle: float = -0.45, back: str = "head_back", front: str = "head_front", min_interval: int = 20,
    by: Sequence[str] = ("session",), idx: str = "idx", width: float = 4096,
) -> DataFrame:
    """(by, label, start, stop): stretches of the walk periods (by, start, stop) of min_interval rows or more with the head below `angle` (walk_lang) or above it (walk_hang)."""
    rows = _of(markers, (back, front), by, idx)
    d = {c: F.col(f"{front}.{c}") - F.col(f"{back}.{c}") for c in "xyz"}
    pitch = F.atan2(d["z"], F.sqrt(d["x"] * d["x"] + d["y"] * d["y"]))
    rows = rows.select(*by, idx, F.when(pitch < angle, "walk_lang").when(pitch > angle, "walk_hang").alias("label")).where("label IS NOT NULL")
    rows = rangejoin.points_in_periods(rows, walk, width, by, idx, how="left_semi")
    return intervals.from_mask(rows, [*by, "label"], idx).where(F.col("stop") - F.col("start") >= min_interval)
