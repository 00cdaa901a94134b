"""Markers in space (by..., marker, x, y, z): distances, angles, centres, frames, alignment of sessions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry
from . import binning


def pairs(markers: DataFrame, by: Sequence[str], marker: str = "marker") -> DataFrame:
    """(by, marker_i, marker_j, theta, phi, dist) of all pairs i < j of a frame, from i to j."""
    by = list(by)
    other = markers.select(*by, F.col(marker).alias("marker_j"), F.col("x").alias("_x"), F.col("y").alias("_y"), F.col("z").alias("_z"))
    both = markers.withColumnRenamed(marker, "marker_i").join(other, by).where("marker_i < marker_j")
    theta, phi, dist = geometry.spherical(F.col("_x") - F.col("x"), F.col("_y") - F.col("y"), F.col("_z") - F.col("z"))
    return both.select(*by, "marker_i", "marker_j", theta.alias("theta"), phi.alias("phi"), dist.alias("dist"))


def centre(markers: DataFrame, by: Sequence[str], names: Sequence | None = None, marker: str = "marker") -> DataFrame:
    """(by, x, y, z): mean position of the named markers."""
    rows = markers if names is None else markers.where(F.col(marker).isin(list(names)))
    return rows.groupBy(*by).agg(*(F.avg(d).alias(d) for d in "xyz"))


def add_centre(markers: DataFrame, by: Sequence[str], name, names: Sequence | None = None, marker: str = "marker") -> DataFrame:
    """markers and, as a further marker, the centre of the named ones."""
    made = centre(markers, by, names, marker).withColumn(marker, F.lit(name).cast(markers.schema[marker].dataType))
    return markers.select(*by, marker, "x", "y", "z").unionByName(made)


def error_frames(markers: DataFrame, by: Sequence[str], frame: str, threshold: float, marker: str = "marker") -> DataFrame:
    """(by, frame, z): frames in which the spread of the markers is off by more than threshold deviations."""
    spread = markers.groupBy(*by, frame).agg(F.sum(F.lit(0.0) + F.col("x")).alias("_x"), F.stddev_pop("x").alias("_sx"), F.stddev_pop("y").alias("_sy"), F.stddev_pop("z").alias("_sz"))
    size = F.sqrt(F.col("_sx") * F.col("_sx") + F.col("_sy") * F.col("_sy") + F.col("_sz") * F.col("_sz"))
    w = Window.partitionBy(*by)
    rows = spread.withColumn("_size", size)
    z = (F.col("_size") - F.avg("_size").over(w)) / F.stddev_pop("_size").over(w)
    return rows.select(*by, frame, z.alias("z")).where(F.abs("z") > threshold)


def manifold(features: DataFrame, axes, feature: Column, by: Sequence[str]) -> DataFrame:
    """(by, bins, n, mean) of a feature over bins of behaviour."""
    rows = features.select(*by, *(binning.bin_index(c, low, high, n).alias(name) for name, (c, low, high, n) in axes.items()), feature.alias("_v"))
    rows = rows.where(" AND ".join(f"{name} IS NOT NULL" for name in axes))
    return rows.groupBy(*by, *axes).agg(F.count("_v").alias("n"), F.avg("_v").alias("mean"))


def offsets(maps: DataFrame, reference: DataFrame, axes: Sequence[str], by: Sequence[str]) -> DataFrame:
    """(by, offset): median difference of the bin means to those of a reference session, to be added to the feature."""
    both = maps.join(reference.select(*axes, F.col("mean").alias("_ref")), list(axes))
    return both.groupBy(*by).agg(F.median(F.col("_ref") - F.col("mean")).alias("offset"), F.count("*").alias("n_bins"))


def nearest(nodes: DataFrame, samples: DataFrame, k: int, radius: float, value: str, node: str = "node", key: str = "sample_id") -> DataFrame:
    """(node, mean, n): mean value of the k nearest samples within radius, by (x, y); nodes with fewer are left out.

    Samples go to square cells of side radius, nodes to their own and the eight cells around: an equi-join.
    """
    cell = lambda c: F.floor(F.col(c) / radius).cast("long")
    steps = F.array(*(F.struct(F.lit(i).cast("long").alias("i"), F.lit(j).cast("long").alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)))
    near = nodes.withColumn("_s", F.explode(steps)).select(node, F.col("x").alias("_nx"), F.col("y").alias("_ny"), (cell("x") + F.col("_s.i")).alias("_cx"), (cell("y") + F.col("_s.j")).alias("_cy"))
    both = near.join(samples.withColumns({"_cx": cell("x"), "_cy": cell("y")}), ["_cx", "_cy"])
    d = F.sqrt((F.col("x") - F.col("_nx")) * (F.col("x") - F.col("_nx")) + (F.col("y") - F.col("_ny")) * (F.col("y") - F.col("_ny")))
    ranked = both.withColumn("_d", d).where(F.col("_d") <= radius).withColumn("_k", F.row_number().over(Window.partitionBy(node).orderBy("_d", key)))
    return ranked.where(F.col("_k") <= k).groupBy(node).agg(F.avg(value).alias("mean"), F.count("*").alias("n")).where(F.col("n") == k)
