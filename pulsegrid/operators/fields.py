"""Rate-map fields: smoothing, resampled maps, patches, scores by direction and distance, egocentric frames."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import circular, geometry
from ..session import ship, small
from . import binning


def smooth(maps: DataFrame, sigma: float, nx: int, ny: int, value: str, by: Sequence[str] = ("unit",), reach: float = 4.0) -> DataFrame:
    """(by, ix, iy, value) smoothed by a Gaussian of sigma bins; outside of the map counts as 0.

    Each bin with a value spreads it over the kernel's bins and sums are partial, so empty bins cost nothing.
    """
    r = int(reach * sigma + 0.5)
    weights = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    weights /= weights.sum()
    kernel = F.array(*(F.struct(F.lit(k).alias("k"), F.lit(float(w)).alias("w")) for k, w in zip(range(-r, r + 1), weights)))
    spread = lambda df, axis, n: df.withColumn("_k", F.explode(kernel)).withColumn(axis, (F.col(axis) + F.col("_k.k")).cast("int")).where(F.col(axis).between(0, n - 1)).groupBy(*by, "ix", "iy").agg(F.sum(F.col(value) * F.col("_k.w")).alias(value))
    return spread(spread(maps.select(*by, "ix", "iy", F.col(value).cast("double").alias(value)), "ix", nx), "iy", ny)


def bootstrap_rows(rows: DataFrame, iterations: int, key: Sequence[str], seed: int = 0) -> DataFrame:
    """rows with iter: in each iteration a row appears as often as a Poisson draw of mean 1 says (a bootstrap without a shuffle).

    key: columns that tell rows apart, so that equal ones are drawn independently.
    """
    draw = F.shiftrightunsigned(F.xxhash64(*[F.col(c) for c in key], F.col("iter"), F.lit(seed)), 11) / float(1 << 53)
    steps, total = [], 0.0
    for k in range(1, 19):  # the odds of more are below 2**-53
        total += math.exp(-1) / math.factorial(k - 1)
        steps.append(total)
    times = F.size(F.filter(F.array(*map(F.lit, steps)), lambda least: F.col("_draw") >= least))
    many = rows.withColumn("iter", F.explode(F.sequence(F.lit(0), F.lit(iterations - 1)))).withColumn("_draw", draw).withColumn("_n", times)
    return many.where("_n > 0").withColumn("_n", F.explode(F.sequence(F.lit(1), F.col("_n")))).drop("_n", "_draw")


def shuffle_blocks(samples: DataFrame, block: int, columns: Sequence[str], seed: int, by: Sequence[str] = ("session",), idx: str = "idx", salt: Sequence[str] = ()) -> DataFrame:
    """samples in which whole blocks of rows trade the given columns at random; rows after the last whole block stay.

    salt: columns of `by` whose values give each group an order of its own.
    """
    by = list(by)
    last = samples.groupBy(*by).agg((F.floor((F.max(idx) + 1) / block) * block).cast("long").alias("_whole"))
    rows = samples.join(last, by).withColumns({"_block": F.floor(F.col(idx) / block).cast("long"), "_at": F.col(idx) % block})
    blocks = rows.where(F.col(idx) < F.col("_whole")).select(*by, "_block").distinct()
    order = lambda *c: F.row_number().over(Window.partitionBy(*by).orderBy(*c))
    to = blocks.select(*by, "_block", order("_block").alias("_k"))
    source = blocks.select(*by, F.col("_block").alias("_from"), order(F.xxhash64("_block", *salt, F.lit(seed)), "_block").alias("_k"))
    trade = to.join(source, [*by, "_k"]).select(*by, "_block", "_from")
    given = rows.select(*by, F.col("_block").alias("_from"), "_at", *(F.col(c).alias("_" + c) for c in columns))
    moved = rows.join(trade, [*by, "_block"], "left").join(given, [*by, "_from", "_at"], "left")
    return moved.select(*(F.when(F.col("_from").isNotNull(), F.col("_" + c)).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in samples.columns))


def _label(hit: np.ndarray) -> np.ndarray:
    """8-connected components of a small mask, numbered from 1."""
    labels = np.where(hit, np.arange(1, hit.size + 1).reshape(hit.shape), 0)
    while True:
        wide = np.pad(labels, 1)
        best = np.max([wide[i : i + hit.shape[0], j : j + hit.shape[1]] for i in range(3) for j in range(3)], axis=0)
        new = np.where(hit, best, 0)
        if (new == labels).all():
            return np.searchsorted(np.unique(np.concatenate([[0], new.ravel()])), new)
        labels = new


def patches(maps: DataFrame, nx: int, ny: int, share: float = 0.9, most: int = 2, by: Sequence[str] = ("unit",)) -> DataFrame:
    """(by, patch, area, peak, mean, com_x, com_y): connected bins above the given quantile of each map, the `most` largest ones."""
    ship(maps.sparkSession)
    by = list(by)
    keys = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in maps.schema.fields if f.name in by)

    def run(key, group: pd.DataFrame) -> pd.DataFrame:
        grid = np.full((nx, ny), np.nan)
        grid[group.ix, group.iy] = group.rate
        labels = _label(np.nan_to_num(grid, nan=-np.inf) > np.quantile(group.rate, share))
        rows = []
        for k in range(1, labels.max() + 1):
            at = np.argwhere(labels == k)
            r = grid[at[:, 0], at[:, 1]]
            rows.append((len(at), r.max(), r.mean(), *(r @ at / r.sum())))
        rows = sorted(rows, key=lambda x: (-x[0], x[3], x[4]))[:most]
        out = pd.DataFrame(rows, columns=["area", "peak", "mean", "com_x", "com_y"]).astype({"area": "int64"})
        out.insert(0, "patch", np.arange(len(out), dtype="int32"))
        for name, value in zip(by, key):
            out[name] = value
        return out[[*by, "patch", "area", "peak", "mean", "com_x", "com_y"]]

    return maps.select(*by, "ix", "iy", "rate").groupBy(*by).applyInPandas(run, f"{keys}, patch int, area long, peak double, mean double, com_x double, com_y double")


def peak_patches(maps: DataFrame, nx: int, ny: int, share: float = 0.9, most: int = 2, by: Sequence[str] = ("state", "iter", "unit")) -> DataFrame:
    """(by, area, peak, mean, com_x, com_y): of the patches of each map that whose peak times area is greatest. A map is one task's group, with nx * ny bins at most."""
    by = list(by)
    columns = ["area", "peak", "mean", "com_x", "com_y"]
    best = F.max_by(F.struct(*columns), F.struct(F.col("peak") * F.col("area"), -F.col("patch"))).alias("b")
    return patches(maps, nx, ny, share, most, by).groupBy(*by).agg(best).select(*by, *(f"b.{c}" for c in columns))


def patch_spread(peaks: DataFrame, by: Sequence[str] = ("state", "unit"), low: float = 0.025, high: float = 0.975) -> DataFrame:
    """(by, what, n, mean, sd, low, high) over the iterations of peak_patches(): what is area, peak, com_x or com_y."""
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("what"), F.col(c).cast("double").alias("v")) for c in ("area", "peak", "com_x", "com_y")))).alias("e")
    rows = peaks.select(*by, each).select(*by, "e.what", "e.v")
    return rows.groupBy(*by, "what").agg(F.count("v").alias("n"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("sd"), F.percentile("v", F.lit(low)).alias("low"), F.percentile("v", F.lit(high)).alias("high"))


def rate_at(points: DataFrame, maps: DataFrame, low: tuple[float, float], size: tuple[float, float], by: Sequence[str] = ("unit",)) -> DataFrame:
    """points (by, x, y) with rate: the map read off between bin centres; bins without a rate and outside count as 0.

    A unit's map goes along as one map column, so points are not multiplied.
    """
    key = lambda ix, iy: ix.cast("long") * 100_000 + iy.cast("long")
    packed = maps.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct(key(F.col("ix"), F.col("iy")), F.col("rate")))).alias("_map"))
    u, v = (F.col("x") - low[0]) / size[0] - 0.5, (F.col("y") - low[1]) / size[1] - 0.5
    rows = points.join(small(packed, 1000), list(by), "left").withColumns({"_u": u, "_v": v, "_i": F.floor(u), "_j": F.floor(v)})
    at = lambda di, dj: F.coalesce(F.try_element_at("_map", key(F.col("_i") + di, F.col("_j") + dj)), F.lit(0.0))
    fu, fv = F.col("_u") - F.col("_i"), F.col("_v") - F.col("_j")
    rate = at(0, 0) * (1 - fu) * (1 - fv) + at(1, 0) * fu * (1 - fv) + at(0, 1) * (1 - fu) * fv + at(1, 1) * fu * fv
    return rows.withColumn("rate", rate).drop("_map", "_u", "_v", "_i", "_j")


def zone_scores(track: DataFrame, centres: DataFrame, by: Sequence[str] = ("session",), idx: str = "idx", sigma: float = 150.0) -> DataFrame:
    """track (by, idx, x, y) for each unit of centres (unit, cx, cy): (by, idx, unit, distance, ddz, gdz).

    ddz: distance to the centre, positive while heading towards it, else negative; gdz: the same sign on a Gaussian of
    the distance. Heading is the step to the next row; the last row repeats the step before.
    """
    w = Window.partitionBy(*by).orderBy(idx)
    step = lambda c: F.coalesce(F.lead(c).over(w) - F.col(c), F.col(c) - F.lag(c).over(w))
    rows = track.withColumns({"_dx": step("x"), "_dy": step("y")}).crossJoin(small(centres))
    ex, ey = F.col("cx") - F.col("x"), F.col("cy") - F.col("y")
    turn = circular.wrap(F.atan2(ey, ex) - F.atan2("_dy", "_dx"))
    distance = geometry.norm(ex, ey)
    sign = geometry.heading_sign(turn)
    return rows.select(*by, idx, "unit", distance.alias("distance"), (sign * distance).alias("ddz"), (sign * F.exp(-distance * distance / (2 * sigma * sigma))).alias("gdz"))


def egocentric(track: DataFrame, cx: Column, cy: Column, yaw_offset: float = 0.0) -> DataFrame:
    """track (x, y, nose_x, nose_y) with ahead and left: the point (cx, cy) in the frame of the head."""
    yaw = F.atan2(F.col("nose_y") - F.col("y"), F.col("nose_x") - F.col("x")) + yaw_offset
    ahead, left = geometry.to_frame(cx - F.col("x"), cy - F.col("y"), yaw)
    return track.withColumns({"ahead": ahead, "left": left})


def egocentric_maps(
    track: DataFrame, spikes: DataFrame, centres: DataFrame, axes, rate: float, condition: Sequence[str] = (), min_occupancy: float = 0.0, sigma: float | None = None,
    by: Sequence[str] = ("session",), idx: str = "idx", unit: str = "unit",
) -> DataFrame:
    """(unit, condition, ix, iy, n_spikes, occ, rate): place maps over where a unit's centre lies as seen from the head.

    track (by, idx, x, y, nose_x, nose_y, condition), spikes (by, idx, unit), centres (unit, cx, cy); axes name ix and iy
    over the columns ahead and left. condition: columns of the track whose values get maps of their own, in the same pass.
    Frames meet each unit once and are summed map-side. sigma: smoothing of counts and occupancy, in bins.
    """
    keys = [unit, *condition]
    bins = [binning.bin_index(c, low, high, n).alias(name) for name, (c, low, high, n) in axes.items()]
    few = small(centres.select(unit, "cx", "cy"))
    placed = lambda rows: egocentric(rows, F.col("cx"), F.col("cy")).select(*keys, *bins).where("ix IS NOT NULL AND iy IS NOT NULL").groupBy(*keys, "ix", "iy")
    occ = placed(track.crossJoin(few)).agg((F.count("*") / F.lit(float(rate))).alias("occ"))
    counts = placed(spikes.select(*by, idx, unit).join(few, unit).join(track, [*by, idx])).agg(F.count("*").cast("double").alias("n_spikes"))
    if sigma is not None:
        nx, ny = (n for _, _, _, n in axes.values())
        occ, counts = smooth(occ, sigma, nx, ny, "occ", keys), smooth(counts, sigma, nx, ny, "n_spikes", keys)
    maps = counts.join(occ.where(F.col("occ") > min_occupancy), [*keys, "ix", "iy"])
    return maps.withColumn("rate", F.col("n_spikes") / F.col("occ"))


def inside_boundary(x: Column, y: Column, shape: str, size: float) -> Column:
    """Whether a bin centre is in a maze: circle of a radius, square or line of an edge length, around the origin."""
    if shape == "circle":
        return x * x + y * y <= size * size
    if shape == "square":
        return (F.abs(x) <= size / 2) & (F.abs(y) <= size / 2)
    if shape == "line":
        return F.abs(x) <= size / 2
    raise ValueError(shape)
