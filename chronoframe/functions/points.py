"""Column expressions on points and vectors of space."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from chronoframe.functions.boxes import angle_between

Point = tuple[Column, Column, Column]


def world_point(p: Point, turn: Column, tilt: Column, origin: tuple[float, float, float]) -> Point:
    """A camera's point in the world: tilted about x, then turned about y (degrees), then moved to the camera's place."""
    t, r = F.radians(tilt), F.radians(turn)
    y, z = p[1] * F.cos(t) - p[2] * F.sin(t), p[1] * F.sin(t) + p[2] * F.cos(t)
    return p[0] * F.cos(r) + z * F.sin(r) + origin[0], y + origin[1], z * F.cos(r) - p[0] * F.sin(r) + origin[2]


def up_angle(p: Point) -> Column:
    """Degrees between a normal and the y axis, whichever way the normal points."""
    zero, one = F.lit(0.0), F.lit(1.0)
    return F.degrees(angle_between([p[0], F.abs(p[1]), p[2]], [zero, one, zero]))


def yaw_matrix(angle: Column) -> Column:
    """Rows of the 4 x 4 rotation about y."""
    c, s, o, i = F.cos(angle), F.sin(angle), F.lit(0.0), F.lit(1.0)
    return F.array(F.array(c, o, s, o), F.array(o, i, o, o), F.array(-s, o, c, o), F.array(o, o, o, i))


def rigid_matrix(scale: float, rotation: Column, shift: list[Column]) -> Column:
    """Rows of the 4 x 4 matrix of a scaled rotation (rows of 4) and a shift."""
    rows = F.transform(F.slice(rotation, 1, 3), lambda r, k: F.concat(F.transform(F.slice(r, 1, 3), lambda v: v * scale), F.array(F.element_at(F.array(*shift), k + 1))))
    return F.concat(rows, F.array(F.array(*(F.lit(v) for v in (0.0, 0.0, 0.0, 1.0)))))


def applied(matrix: Column, point: Column) -> Column:
    """Matrix (rows) times vector."""
    return F.transform(matrix, lambda row: F.aggregate(F.zip_with(row, point, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v))


def on_screen(matrix: Column, point: Column) -> tuple[Column, Column]:
    """A point of space through a projection matrix: the first two coordinates over the last one."""
    seen = applied(matrix, point)
    return F.try_divide(seen[0], seen[3]), F.try_divide(seen[1], seen[3])
