"""Column expressions on boxes, points and directions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

Box = tuple[Column, Column, Column, Column]


def box(prefix: str = "") -> Box:
    """The columns x1, y1, x2, y2 under a prefix such as "a."."""
    return tuple(F.col(f"{prefix}{c}") for c in ("x1", "y1", "x2", "y2"))


def centre(b: Box) -> tuple[Column, Column]:
    return (b[0] + b[2]) / 2, (b[1] + b[3]) / 2


def area(b: Box) -> Column:
    return F.greatest(b[2] - b[0], F.lit(0.0)) * F.greatest(b[3] - b[1], F.lit(0.0))


def intersection(a: Box, b: Box) -> Column:
    wide = F.least(a[2], b[2]) - F.greatest(a[0], b[0])
    high = F.least(a[3], b[3]) - F.greatest(a[1], b[1])
    return F.greatest(wide, F.lit(0.0)) * F.greatest(high, F.lit(0.0))


def iou(a: Box, b: Box) -> Column:
    """Intersection over union; null where both boxes are empty."""
    both = intersection(a, b)
    return F.try_divide(both, area(a) + area(b) - both)


def inside_share(a: Box, b: Box) -> Column:
    """Share of a's area that lies in b."""
    return F.try_divide(intersection(a, b), area(a))


def point_distance(x: Column, y: Column, b: Box) -> Column:
    """Distance of a point to a box, 0 inside."""
    dx = F.greatest(b[0] - x, F.lit(0.0), x - b[2])
    dy = F.greatest(b[1] - y, F.lit(0.0), y - b[3])
    return F.sqrt(dx * dx + dy * dy)


def to_xywh(b: Box) -> Box:
    return b[0], b[1], b[2] - b[0], b[3] - b[1]


def from_xywh(b: Box) -> Box:
    return b[0], b[1], b[0] + b[2], b[1] + b[3]


def shifted(b: Box, dx: Column, dy: Column) -> Box:
    """A box of a crop in the coordinates of the whole."""
    return b[0] + dx, b[1] + dy, b[2] + dx, b[3] + dy


def cells_of(b: Box) -> tuple[Column, Column]:
    """Columns and rows of the cells that a box cuts from a grid, both ends included."""
    whole = lambda c: c.cast("int")
    return whole(b[2]) - whole(b[0]) + 1, whole(b[3]) - whole(b[1]) + 1


def padded(b: Box, by: float, width: Column, height: Column) -> Box:
    """The box with a margin, clamped to the image."""
    return (
        F.greatest(b[0] - by, F.lit(0.0)),
        F.greatest(b[1] - by, F.lit(0.0)),
        F.least(b[2] + by, width),
        F.least(b[3] + by, height),
    )


def near_crop_edge(b: Box, crop: Box, whole: Box, tolerance: float = 20.0) -> Column:
    """Some side lies near the crop's edge and that edge is not near the whole's."""
    sides = [(F.abs(x - c) <= tolerance) & ~(F.abs(x - w) <= tolerance) for x, c, w in zip(b, crop, whole, strict=True)]
    return reduce(lambda x, y: x | y, sides)


def transformed(b: Box, m: list[float]) -> Box:
    """The bounding box of the corners under a homography (row-major 3 x 3), cut to whole numbers."""
    xs, ys = [], []
    for x in (b[0], b[2]):
        for y in (b[1], b[3]):
            w = m[6] * x + m[7] * y + m[8]
            xs.append((m[0] * x + m[1] * y + m[2]) / w)
            ys.append((m[3] * x + m[4] * y + m[5]) / w)
    cut = lambda c: c.cast("int")
    return cut(F.least(*xs)), cut(F.least(*ys)), cut(F.greatest(*xs)), cut(F.greatest(*ys))


def grid_cell(b: Box, surface: Box) -> Column:
    """Name of the third of the surface, across and along, that the box's centre lies in."""
    x, y = centre(b)
    u = (x - surface[0]) / (surface[2] - surface[0])
    v = (y - surface[1]) / (surface[3] - surface[1])
    across = F.when(u < 1 / 3, "left").when(u > 2 / 3, "right").otherwise("center")
    along = F.when(v < 1 / 3, "back").when(v > 2 / 3, "front").otherwise("middle")
    return F.concat_ws(" ", along, across)


def direction_words(components: list[tuple[Column, str, str]], threshold: float, joiner: str = " and ", otherwise: str | None = None) -> Column:
    """Words of the components beyond the threshold: (value, word above, word below)."""
    words = F.filter(
        F.array(*(F.when(v > threshold, up).when(v < -threshold, down) for v, up, down in components)), lambda w: w.isNotNull()
    )
    text = F.array_join(words, joiner)
    return text if otherwise is None else F.when(F.size(words) == 0, otherwise).otherwise(text)


def norm(*parts: Column) -> Column:
    return F.sqrt(sum((p * p for p in parts[1:]), parts[0] * parts[0]))


def angle_between(a: list[Column], b: list[Column]) -> Column:
    dot = sum((x * y for x, y in zip(a[1:], b[1:], strict=True)), a[0] * b[0])
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot / (norm(*a) * norm(*b)))))


def line_angle(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.atan2(y2 - y1, x2 - x1)


def line_polar(x1: Column, y1: Column, x2: Column, y2: Column) -> tuple[Column, Column]:
    """(distance from the origin, angle of the normal) of the line through two points."""
    a, b = y2 - y1, x1 - x2
    c = a * x1 + b * y1
    return F.abs(c) / norm(a, b), F.atan2(b, a)


def overlap_1d(a0: Column, a1: Column, b0: Column, b1: Column, tolerance: float = 0.0) -> Column:
    return F.greatest(F.lit(0.0), F.least(a1, b1) + tolerance - F.greatest(a0, b0) + tolerance)


def camera_point(u: Column, v: Column, depth: Column, fx: float, fy: float, cx: float, cy: float) -> tuple[Column, Column, Column]:
    """Back-projection of a pixel with its depth through a pinhole camera."""
    return (u - cx) * depth / fx, (v - cy) * depth / fy, depth


def plane_foot(p: tuple[Column, Column, Column], plane: tuple[float, float, float, float]) -> tuple[Column, ...]:
    """Foot of the perpendicular from a point to a plane a x + b y + c z + d = 0."""
    a, b, c, d = plane
    t = (p[0] * a + p[1] * b + p[2] * c + d) / (a * a + b * b + c * c)
    return tuple(x - n * t for x, n in zip(p, (a, b, c), strict=True))


def wrapped(angle: Column) -> Column:
    """An angle in (-pi, pi]."""
    return F.atan2(F.sin(angle), F.cos(angle))
