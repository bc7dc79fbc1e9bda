"""A gripper's pose as column expressions: place (x, y, z) and turns about the three axes, applied in that order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Triple = tuple[Column, Column, Column]
Rows = list[list[Column]]


def turned(turn: Triple) -> Rows:
    """The matrix that turns about x, then y, then z."""
    (cr, cp, cw), (sr, sp, sw) = [F.cos(a) for a in turn], [F.sin(a) for a in turn]
    return [
        [cw * cp, cw * sp * sr - sw * cr, cw * sp * cr + sw * sr],
        [sw * cp, sw * sp * sr + cw * cr, sw * sp * cr - cw * sr],
        [-sp, cp * sr, cp * cr],
    ]


def handle_place(place: Triple, turn: Triple, back: float = 0.08) -> Triple:
    """The point ``back`` behind a gripper along its own vertical."""
    return tuple(p - u * back for p, u in zip(place, turned(turn)[2], strict=True))


def gripper_view(place: Triple, turn: Triple, offset: tuple[float, float, float], mount: tuple[tuple[float, float, float], ...]) -> list[Column]:
    """The 16 numbers, column after column, of the view matrix of a camera that sits at ``offset`` of the gripper, turned by ``mount``.

    The camera looks along its own second axis, with its third one down; so its right is against its first.
    """
    m = turned(turn)
    eye = [p + sum(m[i][k] * offset[k] for k in range(3)) for i, p in enumerate(place)]
    axis = [[sum(m[i][k] * mount[k][c] for k in range(3)) for i in range(3)] for c in range(3)]
    along = lambda c: sum(a * b for a, b in zip(axis[c], eye, strict=True))
    out = [entry for i in range(3) for entry in (-axis[0][i], -axis[2][i], -axis[1][i], F.lit(0.0))]
    return [*out, along(0), along(2), along(1), F.lit(1.0)]
