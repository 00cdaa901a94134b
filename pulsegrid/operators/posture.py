"""Posture and movement of tracked bodies: pitches, head and body angles, velocities in body frames, aligned origins.

Frames are made wide first: one row a frame, a struct (x, y, z) for each named marker, and `valid`. Everything else is
columns over that row, or a window over the frames of a session for velocities; nothing is joined.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import circular, geometry

Vector = tuple[Column, Column, Column]


def wide(markers: DataFrame, by: Sequence[str], names: Mapping[str, object], marker: str = "marker") -> DataFrame:
    """(by, one struct x, y, z for each name, valid) of frames that have all named markers.

    names: role -> marker. valid: all values of the frame are finite and not all of them are 0.
    """
    at = lambda m: F.max(F.when(F.col(marker) == m, F.struct("x", "y", "z")))
    bad = F.max(sum((F.when(F.isnan(d) | F.col(d).isNull() | (F.abs(d) == float("inf")), 1).otherwise(0) for d in "xyz"), F.lit(0)))
    size = F.max(F.greatest(F.abs("x"), F.abs("y"), F.abs("z")))
    out = markers.groupBy(*by).agg(*(at(m).alias(name) for name, m in names.items()), ((bad == 0) & (size > 0)).alias("valid"))
    return out.where(" AND ".join(f"`{name}` IS NOT NULL" for name in names))


def vector(a: str, b: str) -> Vector:
    """From one named marker to another."""
    return tuple(F.col(f"{b}.{d}") - F.col(f"{a}.{d}") for d in "xyz")


def pitch(a: str, b: str) -> Column:
    """Elevation of the way from a to b."""
    x, y, z = vector(a, b)
    return F.atan2(z, geometry.norm(x, y))


def azimuth(a: str, b: str) -> Column:
    x, y, _ = vector(a, b)
    return F.atan2(y, x)


def features(frames: DataFrame, correction: float = 0.0, offset: float = 0.0) -> DataFrame:
    """frames (from wide(), with the roles pelvis_root, spine_upper, bcom, hcom, nose, head_back, head_front) with

    head_x, head_y, head_height: the head's centre; head_yaw, from the y axis clockwise; head_pitch, back to front;
    body_pitch, neck_pitch, nose_pitch: pelvis to upper spine, that to the head's centre, that to the nose;
    head_minus_body_pitch; head_body_angle: minus the head's turn against the body, corrected. Invalid frames have 0.
    """
    x, y, _ = vector("hcom", "head_front")
    body, nose = pitch("pelvis_root", "spine_upper"), pitch("hcom", "nose")
    made = {
        "head_x": F.col("hcom.x"), "head_y": F.col("hcom.y"), "head_height": F.col("hcom.z"), "head_yaw": F.atan2(x, y), "head_pitch": pitch("head_back", "head_front"),
        "body_pitch": body, "neck_pitch": pitch("spine_upper", "hcom"), "nose_pitch": nose, "head_minus_body_pitch": circular.distance(nose, body),
        "head_body_angle": -(circular.distance(azimuth("hcom", "nose"), azimuth("bcom", "spine_upper")) + correction) + offset,
    }
    return frames.withColumns({name: F.when(F.col("valid"), c).otherwise(F.lit(0.0)) for name, c in made.items()})


def centred(value: Column, w) -> Column:
    """The value of the next frame minus that of the one before; 0 at both ends."""
    return F.coalesce(F.lead(value).over(w) - F.lag(value).over(w), F.lit(0.0))


def angular_velocity(frames: DataFrame, angle: str, rate: float, by: Sequence[str], idx: str) -> DataFrame:
    """frames with angular_velocity of a column, which should be low-passed before; 0 in invalid frames."""
    change = centred(F.col(angle), Window.partitionBy(*by).orderBy(idx)) * (rate / 2)
    return frames.withColumn("angular_velocity", F.when(F.col("valid"), change).otherwise(F.lit(0.0)))


def frame_velocity(frames: DataFrame, back: str, front: str, moved: str, rate: float, by: Sequence[str], idx: str, turn: float = 0.0, scale: float = 0.1) -> DataFrame:
    """frames with speed_ahead and speed_left: the velocity of a marker in the frame that points from back to front.

    Differences reach from the frame before to the one after, times rate and scale; turn rotates the frame. Positions
    should be low-passed before (signal.filtered). Invalid frames have 0.
    """
    w = Window.partitionBy(*by).orderBy(idx)
    x, y, _ = vector(back, front)
    n = geometry.norm(x, y)
    ux, uy = (F.when(n > 0, c / n).otherwise(F.lit(0.0)) for c in (x, y))
    vx, vy = (centred(F.col(f"{moved}.{d}"), w) for d in "xy")
    ahead, left = vx * ux + vy * uy, vy * ux - vx * uy
    c, s = F.cos(F.lit(turn)), F.sin(F.lit(turn))
    both = {"speed_ahead": ahead * c + left * s, "speed_left": left * c - ahead * s}
    return frames.withColumns({name: F.when(F.col("valid"), v * (rate * scale)).otherwise(F.lit(0.0)) for name, v in both.items()})


def turn_by_azimuth(v: Vector) -> tuple[Vector, Column]:
    """A vector turned about z by its own azimuth, and that angle; a vector along z is turned by a quarter."""
    angle = F.when((v[0] == 0) & (v[1] == 0), F.lit(1.5707963267948966)).otherwise(F.atan2(v[1], v[0]))
    return (v[0] * F.cos(angle) - v[1] * F.sin(angle), v[0] * F.sin(angle) + v[1] * F.cos(angle), v[2]), angle


def turn_by_elevation(v: Vector) -> tuple[Vector, Column]:
    """A vector turned about y by its elevation in the xz plane, and that angle."""
    angle = F.atan2(v[2], F.abs(v[0]))
    return (v[0] * F.cos(angle) - v[2] * F.sin(angle), v[1], v[0] * F.sin(angle) + v[2] * F.cos(angle)), angle


def roll_of(v: Vector) -> Column:
    """Angle of a vector's yz part to the y axis, positive above it."""
    flat = geometry.norm(v[1], v[2])
    size = F.acos(F.least(F.abs(v[1]) / F.when(flat > 0, flat).otherwise(F.lit(1.0)), F.lit(1.0)))
    return F.when(v[2] > 0, size).otherwise(-size)


def turn_about_x(v: Vector, angle: Column) -> Vector:
    return v[0], v[1] * F.cos(angle) - v[2] * F.sin(angle), v[1] * F.sin(angle) + v[2] * F.cos(angle)


def transform_origin(frames: DataFrame, origin: str, orientation: str, others: Sequence[str] = ()) -> DataFrame:
    """frames with direction, pitch, roll, reach and one struct `<name>_at` for each other marker.

    The frame is moved to the origin marker, then turned so that the way to the orientation marker lies along x: reach is
    its length. Each other marker is turned about x by its own roll; roll is that of the first one, 0 without any.
    """
    x, y, z = vector(origin, orientation)
    flat = geometry.norm(x, y)
    direction, up = F.atan2(y, x), F.atan2(z, flat)
    made = {"direction": direction, "pitch": up, "reach": geometry.norm(x, y, z), "roll": F.lit(0.0)}
    for i, name in enumerate(others):
        ahead, left = geometry.to_frame(*vector(origin, name)[:2], direction)
        h = vector(origin, name)[2]
        v = (ahead * F.cos(up) + h * F.sin(up), left, h * F.cos(up) - ahead * F.sin(up))
        # A vector along x has no roll.
        roll = F.when((v[1] == 0) & (v[2] == 0), F.lit(0.0)).otherwise(roll_of(v)) * (1 if i == 0 else -1)
        if i == 0:
            made["roll"] = roll
        made[f"{name}_at"] = F.struct(*(c.alias(d) for c, d in zip(turn_about_x(v, roll), "xyz")))
    return frames.withColumns(made)


def basis(frames: DataFrame, names: Sequence[str]) -> DataFrame:
    """frames with com and the unit vectors axis_x, axis_y, axis_z of the body that the named markers span.

    The first two markers, seen from the centre, give the axes; parallel ones give null axes.
    """
    com = tuple(sum((F.col(f"{n}.{d}") for n in names[1:]), F.col(f"{names[0]}.{d}")) / len(names) for d in "xyz")
    cross = lambda a, b: (a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])
    as_struct = lambda v: F.struct(*(c.alias(d) for c, d in zip(v, "xyz")))
    of = lambda name: tuple(F.col(f"{name}.{d}") for d in "xyz")

    def unit(v: Vector) -> Column:
        n = geometry.norm(*v)
        return F.when(n > 0, as_struct(tuple(c / n for c in v)))

    out = frames.withColumn("com", as_struct(com))
    v0, v1 = (tuple(F.col(f"{n}.{d}") - F.col(f"com.{d}") for d in "xyz") for n in names[:2])
    out = out.withColumn("axis_z", unit(cross(v1, v0)))
    out = out.withColumn("axis_y", unit(cross(of("axis_z"), v0)))
    return out.withColumn("axis_x", unit(cross(of("axis_z"), of("axis_y"))))


def triads(frames: DataFrame, by: Sequence[str], names: Sequence[str]) -> DataFrame:
    """(by, i, j, k, arm_k, arm_i, angle, com) of all triples i < j < k of the named markers: lengths of the arms from j to k
    and to i, the angle between them, and the centre."""

    def triple(i: str, j: str, k: str) -> Column:
        a, b = vector(j, k), vector(j, i)
        across = geometry.norm(a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])
        dot = a[0] * b[0] + a[1] * b[1] + a[2] * b[2]
        centre = F.struct(*(((F.col(f"{i}.{d}") + F.col(f"{j}.{d}") + F.col(f"{k}.{d}")) / 3).alias(d) for d in "xyz"))
        return F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(k).alias("k"), geometry.norm(*a).alias("arm_k"), geometry.norm(*b).alias("arm_i"), F.atan2(across, dot).alias("angle"), centre.alias("com"))

    return frames.select(*by, F.explode(F.array(*(triple(*t) for t in combinations(names, 3)))).alias("t")).select(*by, "t.*")


def subdivide(samples: DataFrame, periods: DataFrame, value: str, threshold: float, least: int, width: float, by: Sequence[str] = ("session",), idx: str = "idx") -> DataFrame:
    """(by, side, start, stop): runs of at least `least` samples inside the periods whose value is below or above a threshold."""
    from . import intervals, rangejoin

    inside = rangejoin.points_in_periods(samples.select(*by, idx, value), intervals.coalesce(periods, by), width, by, idx, how="left_semi")
    sided = inside.where(F.col(value) != threshold).withColumn("side", F.when(F.col(value) < threshold, "low").otherwise("high"))
    return intervals.from_mask(sided, [*by, "side"], idx).where(F.col("stop") - F.col("start") >= least)


def to_frames(estimates: DataFrame, frames: DataFrame, by: Sequence[str], idx: str, delta: int, pad: int = 0, turn: float = 0.0, session: Sequence[str] = ()) -> DataFrame:
    """Position estimates (by, x, y) in the frames of the head and of its path: (by, head_ahead, head_left, path_ahead, path_left).

    frames: from wide(), with hcom and nose. The head's frame points to the nose, that of the path from where the head was
    `delta` frames before to where it will be; without those it has no direction and gives 0. The first and last `pad`
    frames of a session are left out.
    """
    w = Window.partitionBy(*session).orderBy(idx)
    count = F.row_number().over(w), F.count("*").over(Window.partitionBy(*session))
    path = [F.lead(f"hcom.{d}", delta).over(w) - F.lag(f"hcom.{d}", delta).over(w) for d in "xy"]
    rows = frames.withColumns({"_px": F.coalesce(path[0], F.lit(0.0)), "_py": F.coalesce(path[1], F.lit(0.0)), "_k": count[0], "_n": count[1]})
    rows = rows.where((F.col("_k") > pad) & (F.col("_k") <= F.col("_n") - pad))
    both = estimates.select(*by, F.col("x").alias("_x"), F.col("y").alias("_y")).join(rows, list(by))
    dx, dy = F.col("_x") - F.col("hcom.x"), F.col("_y") - F.col("hcom.y")

    def project(x: Column, y: Column, angle: float) -> tuple[Column, Column]:
        n = geometry.norm(x, y)
        ux, uy = (F.when(n > 0, c / n).otherwise(F.lit(0.0)) for c in (x, y))
        a, b = dx * ux + dy * uy, dy * ux - dx * uy
        c, s = F.cos(F.lit(angle)), F.sin(F.lit(angle))
        return a * c + b * s, b * c - a * s

    x, y, _ = vector("hcom", "nose")
    head, way = project(x, y, turn), project(F.col("_px"), F.col("_py"), 0.0)
    return both.select(*by, head[0].alias("head_ahead"), head[1].alias("head_left"), way[0].alias("path_ahead"), way[1].alias("path_left"))
