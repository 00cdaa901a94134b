"""Tracked rigid bodies: markers that traded places, the joint a body turns about, and splines along a spine."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry
from ..session import ship
from . import intervals, rangejoin
from .assignment import assign_many

#: Frames of the periods that are dealt at once.
AT_ONCE = 1 << 14


def _parts(sizes: np.ndarray) -> Iterator[np.ndarray]:
    """Numbers of periods, the longest first, in parts of about AT_ONCE frames."""
    order = np.argsort(-sizes, kind="stable")
    part = (np.cumsum(sizes[order]) - 1) // AT_ONCE
    for p in np.unique(part):
        yield order[part == p]


def relabel(frames: DataFrame, periods: DataFrame, names: Sequence[str], width: float, by: Sequence[str] = ("session",), idx: str = "idx") -> DataFrame:
    """frames (from posture.wide()) in which the named markers of the frames inside the periods (by, start, stop) are
    dealt anew: each frame gets the assignment with the least sum of squared steps from the frame before.

    The frame before a period is its anchor; a period without one, or of one frame, stays as it is. One task takes whole
    periods, not a session. Periods that touch are one. Any number of markers can be dealt; of equal sums the first found is taken.
    """
    ship(frames.sparkSession)
    by, names = list(by), list(names)
    spans = intervals.coalesce(periods.select(*by, "start", "stop"), by).where(F.col("stop") - F.col("start") > 1)
    wide = spans.select(*by, F.col("start").alias("_start"), (F.col("start") - 1).alias("start"), "stop")
    value = [F.col(f"{n}.{d}").cast("double").alias(f"{n}_{d}") for n in names for d in "xyz"]
    rows = rangejoin.points_in_periods(frames.select(*by, idx, *value), wide, width, by, idx)
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    columns = [f"{n}_{d}" for n in names for d in "xyz"]
    # A period is one row, so that a task steps through many of them at once.
    rows = rows.groupBy(*by, "_start").agg(F.sort_array(F.collect_list(F.struct(idx, F.array(*columns).alias("_v")))).alias("_r")).where(F.col("_r")[0][idx] < F.col("_start"))
    rows = rows.select(*by, F.col(f"_r.{idx}").alias("_i"), F.flatten("_r._v").alias("_v"))

    def run(batches):
        for batch in batches:
            sizes = batch["_i"].map(len).to_numpy()
            for some in _parts(sizes):
                at = [np.array(batch["_v"].iat[i], float).reshape(-1, len(names), 3) for i in some]
                for k in range(1, len(at[0])):
                    now = [a for a in at if k < len(a)]  # the longest come first
                    one, before = np.stack([a[k] for a in now]), np.stack([a[k - 1] for a in now])
                    order = assign_many(((one[:, None, :, :] - before[:, :, None, :]) ** 2).sum(axis=3))
                    for a, o in zip(now, order):
                        a[k] = a[k][o]
                if any(len(a) > 1 for a in at):
                    made = {c: np.repeat(batch[c].to_numpy()[some], sizes[some] - 1) for c in by}
                    made[idx] = np.concatenate([batch["_i"].iat[i][1:] for i in some])
                    flat = np.concatenate([a[1:].reshape(len(a) - 1, len(columns)) for a in at])
                    yield pd.DataFrame({**made, **dict(zip(columns, flat.T))})

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in [*by, idx, *columns])
    dealt = rows.mapInPandas(run, schema)
    dealt = dealt.select(*by, idx, *(F.struct(*(F.col(f"{n}_{d}").alias(d) for d in "xyz")).alias(f"_{n}") for n in names))
    both = frames.join(dealt, [*by, idx], "left")
    return both.select(*(F.coalesce(F.col(f"_{c}"), F.col(c)).alias(c) if c in names else F.col(c) for c in frames.columns))


def joint_costs(
    frames: DataFrame, rate: float, low: float = -100.0, high: float = 100.0, step: float = 1.0, slow: float = 5.0, fast: float = 100.0, top: float = 150.0,
    by: Sequence[str] = ("session",), idx: str = "idx",
) -> DataFrame:
    """(by, axis, shift, cost): how much the body's centre, moved along one of its axes, travels in the body's own frame.

    frames: from posture.basis(). cost: log10 of the sum of squared steps from the frame before to the one after, by
    component at most 100, over frames whose own speed (cm/s) lies between slow and fast and whose centre is below top.
    Shifts are tried inside the projection and summed map-side, so frames aren't multiplied in a shuffle.
    """
    w = Window.partitionBy(*by).orderBy(idx)
    axes = ("axis_x", "axis_y", "axis_z")
    moved = lambda c: F.coalesce(F.lead(c).over(w) - F.lag(c).over(w), F.lit(0.0))
    rows = frames.select(
        *by, "com", *axes, *(moved(f"com.{d}").alias(f"_v{d}") for d in "xyz"), *(moved(f"{a}.{d}").alias(f"_{a}{d}") for a in axes for d in "xyz")
    ).where(" AND ".join(f"{a} IS NOT NULL" for a in axes))
    along = lambda a, v: F.col(f"{a}.x") * v[0] + F.col(f"{a}.y") * v[1] + F.col(f"{a}.z") * v[2]
    velocity = [F.col(f"_v{d}") for d in "xyz"]
    clip = lambda c, most: F.greatest(F.least(c, F.lit(most)), F.lit(-most))
    speed = geometry.norm(*(clip(along(a, velocity) * (rate / 20), 1000.0) for a in axes))
    rows = rows.withColumn("_speed", speed).where((F.col("_speed") > slow) & (F.col("_speed") < fast) & (F.col("com.z") < top))
    n = int((high + 0.5 * step - low) / step) + (0 if ((high + 0.5 * step - low) / step).is_integer() else 1)
    shifts = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.lit(low) + k * F.lit(step))
    parts = []
    for axis in axes:
        still, turn = [along(a, velocity) for a in axes], [along(a, [F.col(f"_{axis}{d}") for d in "xyz"]) for a in axes]
        parts.append(F.struct(F.lit(axis[-1]).alias("axis"), F.array(*still).alias("still"), F.array(*turn).alias("turn")))
    rows = rows.select(*by, F.explode(F.array(*parts)).alias("_p")).select(*by, "_p.*").withColumn("shift", F.explode(shifts))
    squares = [clip(F.col("still")[i] + F.col("turn")[i] * F.col("shift"), 100.0) for i in range(3)]
    cost = F.sum(squares[0] * squares[0] + squares[1] * squares[1] + squares[2] * squares[2])
    return rows.groupBy(*by, "axis", "shift").agg(F.log10(cost + F.lit(2.2250738585072014e-308)).alias("cost"))


def joint(costs: DataFrame, by: Sequence[str] = ("session",)) -> DataFrame:
    """(by, x, y, z): the shift with the least cost along each axis; of equal ones the least."""
    best = costs.groupBy(*by, "axis").agg(F.min_by("shift", F.struct("cost", "shift")).alias("shift"))
    return best.groupBy(*by).agg(*(F.max(F.when(F.col("axis") == d, F.col("shift"))).alias(d) for d in "xyz"))


def move_to_joint(frames: DataFrame, offsets: DataFrame, names: Sequence[str], made: str = "hcom", by: Sequence[str] = ("session",)) -> DataFrame:
    """frames (from posture.basis()) with the named markers, and the centre as `made`, moved by the body's offset (by, x, y, z)."""
    rows = frames.join(offsets.select(*by, F.struct("x", "y", "z").alias("_o")), list(by))
    way = {d: sum((F.col(f"axis_{a}.{d}") * F.col(f"_o.{a}") for a in "xyz"), F.lit(0.0)) for d in "xyz"}
    shifted = lambda name: F.struct(*((F.col(f"{name}.{d}") + way[d]).alias(d) for d in "xyz"))
    return rows.withColumns({**{n: shifted(n) for n in names}, made: shifted("com")}).drop("_o")


def _natural(t: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Natural cubic splines of many frames at once: knots t (n, m), values y (n, m, 3), places at (n, k)."""
    n, m = t.shape
    h = np.diff(t, axis=1)
    slope = np.diff(y, axis=1) / h[..., None]
    bend = np.zeros_like(y)  # second derivatives; 0 at both ends
    a = np.zeros((n, m - 2, m - 2))
    i = np.arange(m - 2)
    a[:, i, i] = 2 * (h[:, :-1] + h[:, 1:])
    a[:, i[:-1], i[1:]] = a[:, i[1:], i[:-1]] = h[:, 1:-1]
    bend[:, 1:-1] = np.linalg.solve(a, 6 * np.diff(slope, axis=1))
    j = np.clip((at[:, :, None] >= t[:, None, :]).sum(axis=2) - 1, 0, m - 2)
    r = np.arange(n)[:, None]
    s, hj = (at - t[r, j])[..., None], h[r, j][..., None]
    c = slope[r, j] - hj * (2 * bend[r, j] + bend[r, j + 1]) / 6
    return y[r, j] + s * (c + s * (bend[r, j] / 2 + s * (bend[r, j + 1] - bend[r, j]) / (6 * hj)))


def spine(frames: DataFrame, by: Sequence[str], names: Sequence[str], places: Sequence[float], density: int = 100, equal_length: bool = True) -> DataFrame:
    """(by, place, x, y, z): a natural cubic spline through the named markers (three or more), knots at their chord lengths.

    places: shares of the way, 0 to 1. equal_length: of the curve's length, read off a line through `density` points;
    else of the chord length. Frames with a missing or repeated marker in a row give 0. frames: from posture.wide().
    """
    ship(frames.sparkSession)
    by, names, places = list(by), list(names), [float(p) for p in places]
    value = [F.col(f"{n}.{d}").cast("double").alias(f"{n}_{d}") for n in names for d in "xyz"]
    rows = frames.select(*by, "valid", *value)
    keys = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name in by)

    def run(batches):
        for batch in batches:
            y = batch.iloc[:, len(by) + 1 :].to_numpy().reshape(len(batch), len(names), 3)
            chord = np.sqrt((np.diff(y, axis=1) ** 2).sum(axis=2))
            good = batch["valid"].to_numpy(dtype=bool) & (chord > 0).all(axis=1)
            out = np.zeros((len(batch), len(places), 3))
            if good.any():
                t = np.concatenate([np.zeros((good.sum(), 1)), np.cumsum(chord[good], axis=1)], axis=1)
                if equal_length:
                    dense = _natural(t, y[good], np.linspace(0, 1, density) * t[:, -1:])
                    length = np.concatenate([np.zeros((len(t), 1)), np.cumsum(np.sqrt((np.diff(dense, axis=1) ** 2).sum(axis=2)), axis=1)], axis=1)
                    want = np.array(places) * length[:, -1:]
                    j = np.clip((want[:, :, None] >= length[:, None, :]).sum(axis=2) - 1, 0, density - 2)
                    r = np.arange(len(t))[:, None]
                    share = (want - length[r, j]) / np.maximum(length[r, j + 1] - length[r, j], 1e-300)
                    out[good] = dense[r, j] + share[..., None] * (dense[r, j + 1] - dense[r, j])
                else:
                    out[good] = _natural(t, y[good], np.array(places) * t[:, -1:])
            made = {c: np.repeat(batch[c].to_numpy(), len(places)) for c in by}
            made["place"] = np.tile(places, len(batch))
            yield pd.DataFrame({**made, **{d: out[..., k].ravel() for k, d in enumerate("xyz")}})

    return rows.mapInPandas(run, f"{keys}, place double, x double, y double, z double")


def evened(frames: DataFrame, by: Sequence[str], names: Sequence[str], density: int = 100, lengths: Sequence[float] | None = None) -> DataFrame:
    """frames whose inner named markers are put along the spline: evenly, or at the given shares of its length; the ends stay."""
    inner = list(names)[1:-1]
    places = list(lengths) if lengths is not None else [(i + 1) / (len(inner) + 1) for i in range(len(inner))]
    curve = spine(frames, by, names, places, density)
    at = curve.groupBy(*by).agg(*(F.max(F.when(F.col("place") == p, F.struct("x", "y", "z"))).alias(f"_{n}") for n, p in zip(inner, places)))
    both = frames.join(at, list(by))
    return both.select(*(F.when(F.col("valid"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in inner else F.col(c) for c in frames.columns))
