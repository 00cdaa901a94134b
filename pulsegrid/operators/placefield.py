"""Place fields from spike times and tracked positions: state mask, occupancy, smoothed counts, rates, information."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import binning, fields, rangejoin, scans

Axes = Mapping[str, tuple[Column, float, float, int]]


def in_state(positions: DataFrame, state: DataFrame | None, rate: float, width: float, by: Sequence[str] = ("session",), idx: str = "idx") -> DataFrame:
    """positions with finite x and y whose frame lies in the state's periods (seconds): [rint(start * rate), rint(stop * rate))."""
    finite = [F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")) for c in ("x", "y")]
    rows = positions.where(finite[0] & finite[1])
    if state is None:
        return rows
    frames = state.select(*by, *(F.rint(F.col(c) * rate).cast("long").alias(c) for c in ("start", "stop")))
    return rangejoin.points_in_periods(rows, frames, max(1, round(width * rate)), by, idx, how="left_semi")


def at_frames(spikes: DataFrame, positions: DataFrame, rate: float, by: Sequence[str] = ("session",), t: str = "t", idx: str = "idx") -> DataFrame:
    """spikes (by, unit, t in seconds) with the position of their frame, the nearest one; those without a position go."""
    rows = spikes.withColumn(idx, F.rint(F.col(t) * rate).cast("long"))
    return rows.join(positions.select(*by, idx, "x", "y"), [*by, idx])


def place_field(
    spikes: DataFrame, positions: DataFrame, rate: float, axes: Axes, state: DataFrame | None = None, width: float = 60.0, sigma: float | None = 2.2,
    min_occupancy: float = 0.06, min_spikes: int = 11, by: Sequence[str] = ("session",), unit: str = "unit",
) -> tuple[DataFrame, DataFrame]:
    """(maps, summary) of units: (unit, ix, iy, n_spikes, occ, rate) and (unit, n_spikes, mean_rate, information, sparsity).

    spikes (by, unit, t) and positions (by, idx, x, y) count inside the state's periods (by, start, stop in seconds) only;
    `width` is near their usual length. axes name ix and iy over x and y. Occupancy and counts are smoothed apart by a
    Gaussian of sigma bins (None: not at all); bins with a smoothed occupancy over min_occupancy seconds belong to the map.
    Those without a row for a unit have rate 0. Units with fewer than min_spikes spikes are left out. Information and
    sparsity weigh bins by their occupancy as it was counted.
    """
    seen = in_state(positions, state, rate, width, by)
    return _maps(at_frames(_spikes_in(spikes, state, width, by), seen, rate, by), seen, rate, axes, sigma, min_occupancy, min_spikes, unit)


def _spikes_in(spikes: DataFrame, state: DataFrame | None, width: float, by: Sequence[str]) -> DataFrame:
    return spikes if state is None else rangejoin.points_in_periods(spikes, state.select(*by, "start", "stop"), width, by, "t", how="left_semi")


def shuffled_place_field(
    spikes: DataFrame, positions: DataFrame, rate: float, axes: Axes, iterations: int, block: int, state: DataFrame | None = None, width: float = 60.0, sigma: float | None = 2.2,
    min_occupancy: float = 0.06, min_spikes: int = 11, seed: int = 0, by: Sequence[str] = ("session",), unit: str = "unit", idx: str = "idx",
) -> tuple[DataFrame, DataFrame]:
    """place_field() with a column iter, from 1: in each iteration blocks of positions inside the state trade places at random.

    Occupancy is the same in all iterations, as positions only trade places, so it is counted once. Spikes meet the positions of all iterations by one join.
    """
    seen = in_state(positions, state, rate, width, by)
    numbered = scans.along(seen, by, idx, max(1, round(width * rate)), sums={"_k": F.lit(1)}).withColumn("_k", F.col("_k") - 1)
    many = numbered.select(*by, idx, "_k", "x", "y", F.explode(F.sequence(F.lit(1), F.lit(iterations))).alias("iter"))
    mixed = fields.shuffle_blocks(many, block, ["x", "y"], seed, [*by, "iter"], "_k", salt=["iter"])
    at = _spikes_in(spikes, state, width, by).withColumn(idx, F.rint(F.col("t") * rate).cast("long"))
    placed = at.join(mixed, [*by, idx]).withColumn("_unit", F.struct(F.col(unit).alias(unit), "iter"))
    maps, summary = _maps(placed, seen, rate, axes, sigma, min_occupancy, min_spikes, "_unit")
    flat = lambda df: df.select(f"_unit.{unit}", "_unit.iter", *(c for c in df.columns if c != "_unit"))
    return flat(maps), flat(summary)


def information_rank(summary: DataFrame, shuffled: DataFrame, unit: str = "unit") -> DataFrame:
    """(unit, information, n_shuffles, share): the share of a unit's shuffles, itself counted, whose information is as great or greater."""
    both = summary.select(unit, "information").join(shuffled.select(unit, F.col("information").alias("_s")), unit)
    return both.groupBy(unit, "information").agg(F.count("*").alias("n_shuffles"), ((F.count_if(F.col("_s") >= F.col("information")) + 1) / (F.count("*") + 1)).alias("share"))


def _maps(placed: DataFrame, seen: DataFrame, rate: float, axes: Axes, sigma: float | None, min_occupancy: float, min_spikes: int, unit: str) -> tuple[DataFrame, DataFrame]:
    """(maps, summary) of spikes with positions and of all positions."""
    (nx, ny) = (n for _, _, _, n in axes.values())
    enough = placed.groupBy(unit).agg(F.count("*").alias("n_spikes")).where(F.col("n_spikes") >= min_spikes)
    raw = binning.occupancy(seen, axes, rate)
    bins = [binning.bin_index(c, low, high, n).alias(name) for name, (c, low, high, n) in axes.items()]
    counts = placed.select(unit, *bins).where("ix IS NOT NULL AND iy IS NOT NULL").groupBy(unit, "ix", "iy").agg(F.count("*").cast("double").alias("n_spikes"))
    smooth = lambda df, value, keys: df if sigma is None else fields.smooth(df, sigma, nx, ny, value, keys)
    mapped = smooth(raw, "occ", ()).where(F.col("occ") > min_occupancy)
    shown = smooth(counts.join(enough.select(unit), unit, "left_semi"), "n_spikes", (unit,))
    maps = shown.join(mapped, ["ix", "iy"]).withColumn("rate", F.col("n_spikes") / F.col("occ")).select(unit, "ix", "iy", "n_spikes", "occ", "rate")
    weights = mapped.select("ix", "iy").join(raw, ["ix", "iy"])
    weighed = maps.drop("occ").join(weights, ["ix", "iy"])
    summary = enough.join(binning.spatial_information(weighed, weights, unit), unit)
    return maps, summary
