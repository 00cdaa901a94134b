"""Angles, vectors and rotations as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def norm(*v: Column) -> Column:
    return F.sqrt(sum((x * x for x in v[1:]), v[0] * v[0]))


def spherical(dx: Column, dy: Column, dz: Column) -> tuple[Column, Column, Column]:
    """(azimuth, elevation, distance) of a difference of positions."""
    flat = F.sqrt(dx * dx + dy * dy)
    return F.atan2(dy, dx), F.atan2(dz, flat), norm(dx, dy, dz)


def rotate(v: tuple[Column, Column, Column], axis: tuple[Column, Column, Column], angle: Column) -> tuple[Column, Column, Column]:
    """A vector turned around a unit axis (Rodrigues)."""
    c, s = F.cos(angle), F.sin(angle)
    dot = v[0] * axis[0] + v[1] * axis[1] + v[2] * axis[2]
    cross = (axis[1] * v[2] - axis[2] * v[1], axis[2] * v[0] - axis[0] * v[2], axis[0] * v[1] - axis[1] * v[0])
    return tuple(v[i] * c + cross[i] * s + axis[i] * dot * (1 - c) for i in range(3))


def quaternion_to_euler(w: Column, x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    """(yaw, pitch, roll) of a quaternion; the sine of the pitch is clamped from above."""
    yaw = F.atan2(2 * (w * z + x * y), 1 - 2 * (y * y + z * z))
    pitch = F.asin(F.least(2 * (w * y - z * x), F.lit(1.0)))
    roll = F.atan2(2 * (w * x + y * z), 1 - 2 * (x * x + y * y))
    return yaw, pitch, roll


def rotation_matrix(w: Column, x: Column, y: Column, z: Column) -> list[list[Column]]:
    """The 3 x 3 matrix of a unit quaternion."""
    return [
        [1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y)],
        [2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x)],
        [2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)],
    ]


def to_frame(x: Column, y: Column, yaw: Column) -> tuple[Column, Column]:
    """A vector in the frame whose first axis points to yaw: (ahead, left)."""
    return x * F.cos(yaw) + y * F.sin(yaw), y * F.cos(yaw) - x * F.sin(yaw)


def heading_sign(angle: Column) -> Column:
    """1 if an angle points ahead (below a quarter turn), else -1."""
    return F.when(F.abs(angle) < 1.5707963267948966, F.lit(1)).otherwise(F.lit(-1))
