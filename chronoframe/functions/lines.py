"""Column expressions on line segments: distances, agreement, movement."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from chronoframe.functions.boxes import line_angle, norm, overlap_1d

Line = tuple[Column, Column, Column, Column]


def length(a: Line) -> Column:
    return norm(a[2] - a[0], a[3] - a[1])


def orientation(a: Line) -> Column:
    return line_angle(*a)


def point_gap(x: Column, y: Column, a: Line) -> Column:
    """Distance of a point to a segment; of a segment without length, to its point."""
    dx, dy = a[2] - a[0], a[3] - a[1]
    along = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide((x - a[0]) * dx + (y - a[1]) * dy, dx * dx + dy * dy)))
    return norm(x - a[0] - along * dx, y - a[1] - along * dy)


def proximity(a: Line, b: Line) -> Column:
    """The least distance of an end of either segment to the other."""
    return F.least(point_gap(a[0], a[1], b), point_gap(a[2], a[3], b), point_gap(b[0], b[1], a), point_gap(b[2], b[3], a))


def agreement(a: Line, b: Line, longest: float, farthest: float, far: float = 20.0) -> Column:
    """0.1 for equal length, 0.6 for equal direction, 0.3 for nearness; 0 for segments more than ``far`` apart."""
    turn = F.abs(orientation(a) - orientation(b))
    turn = F.when(turn > math.pi, 2 * math.pi - turn).otherwise(turn)
    near = proximity(a, b)
    score = 0.1 * (1 - F.abs(length(a) - length(b)) / longest) + 0.6 * (1 - turn / math.pi) + 0.3 * (1 - near / farthest)
    return F.when(near > far, 0.0).otherwise(score)


def projections(a: Line, b: Line, tolerance: float) -> tuple[Column, Column]:
    """Overlap of the two segments' extents along x and along y, each widened by the tolerance."""
    sides = []
    for k in (0, 1):
        ends = [F.least(s[k], s[k + 2]) for s in (a, b)], [F.greatest(s[k], s[k + 2]) for s in (a, b)]
        sides.append(overlap_1d(ends[0][0], ends[1][0], ends[0][1], ends[1][1], tolerance))
    return sides[0], sides[1]


def overlap_share(a: Line, b: Line, tolerance: float) -> Column:
    """Mean of both overlaps as a share of the longer segment."""
    x, y = projections(a, b, tolerance)
    return F.try_divide(x + y, 2 * F.greatest(length(a), length(b)))


def moved_through(a: Line, x: Column, y: Column) -> Line:
    """The segment moved at right angles to itself until its line goes through a point."""
    dx, dy = a[2] - a[0], a[3] - a[1]
    size = norm(dx, dy)
    px, py = F.try_divide(-dy, size), F.try_divide(dx, size)
    far = (x - (a[0] + a[2]) / 2) * px + (y - (a[1] + a[3]) / 2) * py
    return a[0] + px * far, a[1] + py * far, a[2] + px * far, a[3] + py * far


def hull_match(a: Line, corners: list[tuple[Column, Column]], longest: float = 1000.0, farthest: float = 40.0) -> Column:
    """The best agreement with an edge of the polygon of these corners."""
    edges = zip(corners, [*corners[1:], corners[0]], strict=True)
    return F.greatest(*(agreement(a, (*p, *q), longest, farthest) for p, q in edges))
