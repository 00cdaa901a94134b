"""Binned aggregation: edges, histograms, bin statistics, occupancy, rate maps, information."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import quantiles


def n_bins(low: float, high: float, size: float) -> int:
    return max(round((high - low) / size), 1)


def bin_index(x: Column, low: float, high: float, n: int) -> Column:
    """Number of the bin of x among n equal ones; the last is closed, outside is null."""
    at = F.floor((x - low) / ((high - low) / n)).cast("int")
    return F.when(x == high, n - 1).when((x >= low) & (x < high), F.least(at, F.lit(n - 1)))


def edge_index(x: Column, edges: Sequence[float]) -> Column:
    """Number of the bin of x among explicit edges; the last is closed, outside is null."""
    at = F.size(F.filter(F.array(*map(F.lit, edges[1:-1])), lambda e: e <= x))
    return F.when((x >= edges[0]) & (x <= edges[-1]), at)


#: Statistics by name.
STATS = {
    "count": lambda v: F.count(v),
    "mean": lambda v: F.avg(v),
    "std": lambda v: F.stddev_pop(v),
    "max": lambda v: F.max(v),
    "min": lambda v: F.min(v),
}
#: Statistics that need quantiles.
QUANTILES = {"median": {"_q2": 0.5}, "iqr": {"_q1": 0.25, "_q3": 0.75}}


def bin_statistic(df: DataFrame, axes: Mapping[str, tuple[Column, float, float, int]], value: Column, stats: Sequence[str] = ("count", "mean", "std"), dense: bool = False, drop_zero: bool = True) -> DataFrame:
    """(one bin number for each axis, one column for each statistic) of a value over 1 to 3 axes.

    axes: name -> (column, low, high, bins). Values of 0 and NaN count as missing. dense: bins without values as rows of 0.
    """
    rows = df.select(*(bin_index(c, low, high, n).alias(name) for name, (c, low, high, n) in axes.items()), value.cast("double").alias("_v"))
    rows = rows.where(" AND ".join(f"{name} IS NOT NULL" for name in axes)).where(F.col("_v").isNotNull() & ~F.isnan("_v"))
    if drop_zero:
        rows = rows.where("_v <> 0")
    shares = {share: q for s in stats for share, q in QUANTILES.get(s, {}).items()}
    out = rows.groupBy(*axes).agg(F.count("*").alias("_n"), *(STATS[s](F.col("_v")).alias(s) for s in stats if s not in QUANTILES))
    if shares:
        out = out.join(quantiles.exact(rows, list(axes), "_v", shares), list(axes))
        out = out.withColumns({s: F.col("_q3") - F.col("_q1") if s == "iqr" else F.col("_q2") for s in stats if s in QUANTILES})
    out = out.select(*axes, *stats)
    if not dense:
        return out
    grid = df.sparkSession.range(1)
    for name, (_, _, _, n) in axes.items():
        grid = grid.select(*grid.columns, F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name))
    grid = grid.drop("id")
    return grid.join(out, list(axes), "left").fillna(0, list(stats))


def occupancy(positions: DataFrame, axes: Mapping[str, tuple[Column, float, float, int]], rate: float, by: Sequence[str] = ()) -> DataFrame:
    """(by, bin numbers, occ): seconds spent in each visited bin."""
    rows = positions.select(*by, *(bin_index(c, low, high, n).alias(name) for name, (c, low, high, n) in axes.items()))
    return rows.where(" AND ".join(f"{name} IS NOT NULL" for name in axes)).groupBy(*by, *axes).agg((F.count("*") / F.lit(float(rate))).alias("occ"))


def rate_map(spikes: DataFrame, positions: DataFrame, axes: Mapping[str, tuple[Column, float, float, int]], rate: float, min_occupancy: float = 0.0, unit: str = "unit") -> DataFrame:
    """(unit, bins, n_spikes, occ, rate): spikes per second in each bin that was visited long enough.

    spikes carry the position of their frame in the same columns. The occupancy is aggregated once for all units.
    """
    occ = occupancy(positions, axes, rate).where(F.col("occ") > min_occupancy)
    rows = spikes.select(unit, *(bin_index(c, low, high, n).alias(name) for name, (c, low, high, n) in axes.items()))
    counts = rows.where(" AND ".join(f"{name} IS NOT NULL" for name in axes)).groupBy(unit, *axes).agg(F.count("*").alias("n_spikes"))
    return counts.join(occ, list(axes)).withColumn("rate", F.col("n_spikes") / F.col("occ"))


def spatial_information(maps: DataFrame, occ: DataFrame, unit: str = "unit") -> DataFrame:
    """(unit, mean_rate, information in bits a spike, sparsity) of rate maps over all visited bins.

    Bins in which a unit has no spike have rate 0 and add nothing to the sums, so the sparse map is enough;
    their occupancy counts in the total.
    """
    total = occ.agg(F.sum("occ").alias("_total"))
    rows = maps.crossJoin(F.broadcast(total)).withColumn("_p", F.col("occ") / F.col("_total"))  # one row
    first = rows.groupBy(unit).agg(F.sum(F.col("_p") * F.col("rate")).alias("mean_rate"), F.sum(F.col("_p") * F.col("rate") * F.col("rate")).alias("_square"), F.sum(F.when(F.col("rate") > 0, F.col("_p") * F.col("rate") * F.log2("rate"))).alias("_log"))
    m = F.col("mean_rate")
    # sum p r/m log2(r/m) = (sum p r log2 r) / m - log2 m
    return first.select(unit, m, (F.col("_log") / m - F.log2(m)).alias("information"), (m * m / F.col("_square")).alias("sparsity"))


def bin_smooth(df: DataFrame, x: str, y: str, low: float, width: float, n: int) -> DataFrame:
    """(bin, n, mean, std with n - 1, sem, median, iqr, median_x); the last bin is open to the right, below `low` is dropped.

    Quantiles are exact, by counts of cells that close in on them (quantiles.exact), so no task holds a bin's values.
    """
    at = F.least(F.floor((F.col(x) - low) / width).cast("int"), F.lit(n - 1))
    rows = df.where(F.col(x) >= low).select(at.alias("bin"), F.col(x).alias("_x"), F.col(y).cast("double").alias("_y"))
    out = rows.groupBy("bin").agg(F.count("*").alias("n"), F.avg("_y").alias("mean"), F.stddev_samp("_y").alias("std"))
    of_y = quantiles.exact(rows, ["bin"], "_y", {"median": 0.5, "_q1": 0.25, "_q3": 0.75})
    of_x = quantiles.exact(rows, ["bin"], "_x", {"median_x": 0.5})
    out = out.join(F.broadcast(of_y), "bin", "left").join(F.broadcast(of_x), "bin", "left")  # a row for each of the n bins
    return out.withColumns({"iqr": F.col("_q3") - F.col("_q1"), "sem": F.col("std") / F.sqrt(F.col("n"))}).drop("_q1", "_q3")


def mutual_information(pairs: DataFrame, by: Sequence[str], a: str, b: str) -> DataFrame:
    """(by, mi in bits) of two discrete columns."""
    joint = pairs.groupBy(*by, a, b).agg(F.count("*").alias("_n"))
    total = F.sum("_n").over(Window.partitionBy(*by))
    pa, pb = F.sum("_n").over(Window.partitionBy(*by, a)), F.sum("_n").over(Window.partitionBy(*by, b))
    rows = joint.withColumns({"_t": total, "_a": pa, "_b": pb})
    p = F.col("_n") / F.col("_t")
    return rows.groupBy(*by).agg(F.sum(p * F.log2(F.col("_n") * F.col("_t") / (F.col("_a") * F.col("_b")))).alias("mi"))
