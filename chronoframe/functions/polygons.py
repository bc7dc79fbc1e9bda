"""Convex polygons and quadrilaterals as numpy arrays of corners, counter-clockwise: small helpers of one group's task."""

from __future__ import annotations

import math

import numpy as np


def _next(a: np.ndarray) -> np.ndarray:
    """Each row's next one; np.roll costs several times as much on a few rows."""
    return np.concatenate([a[1:], a[:1]])


def signed_area(p: np.ndarray) -> float:
    x, y = p.T
    return float(x @ _next(y) - y @ _next(x)) / 2 if len(p) > 2 else 0.0


def clipped(p: np.ndarray, by: np.ndarray) -> np.ndarray:
    """The part of a convex polygon that lies in another one."""
    # Plain numbers: a polygon has few corners, and a call of numpy costs more than they do.
    edges, p = by.tolist(), p.tolist()
    for (ax, ay), (bx, by_) in zip(edges, [*edges[1:], *edges[:1]], strict=True):
        side = [(bx - ax) * (y - ay) - (by_ - ay) * (x - ax) for x, y in p]
        out = []
        for (x, y), (u, v), s, t in zip(p, [*p[1:], *p[:1]], side, [*side[1:], *side[:1]], strict=True):
            if s >= 0:
                out.append((x, y))
            if s * t < 0:
                out.append((x + (u - x) * (s / (s - t)), y + (v - y) * (s / (s - t))))
        p = out
    return np.array(p, float).reshape(-1, 2)


def polygon_iou(p: np.ndarray, q: np.ndarray) -> float:
    """Intersection over union of two convex polygons; 0 where both are empty."""
    both = abs(signed_area(clipped(p, q)))
    whole = abs(signed_area(p)) + abs(signed_area(q)) - both
    return both / whole if whole > 0 else 0.0


def best_four(hull: np.ndarray) -> np.ndarray:
    """Numbers of the four corners whose quadrilateral has the greatest IoU with the hull; the first ones on ties.

    A quadrilateral of a hull's corners lies in it, so that is the largest one: for each diagonal the farthest corner on either side of it.
    """
    best, found, n = -1.0, (0, 1, 2, 3), len(hull)
    x, y = hull.T
    turn = np.arange(n)
    for i in range(n - 2):
        # All diagonals from i at once; corners after the other end are on its other side, with those before i.
        off = np.abs((x - x[i])[:, None] * (y - y[i]) - (y - y[i])[:, None] * (x - x[i]))
        for j in range(i + 2, n if i else n - 1):
            far = off[j]
            k = i + 1 + int(far[i + 1 : j].argmax())
            m = int(np.concatenate([turn[j + 1 :], turn[:i]])[np.concatenate([far[j + 1 :], far[:i]]).argmax()])
            size = (far[k] + far[m]) / 2
            if size > best * (1 + 1e-12):
                best, found = size, tuple(sorted((i, k, j, m)))
    return np.array(found)


def line_through(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """(normal, offset) of the line, the normal to the right of the way from a to b: outwards for a side of a polygon."""
    d = b - a
    d = d / math.sqrt(d @ d)
    n = np.array([d[1], -d[0]])
    return np.array([*n, n @ a])


def fitted_line(points: np.ndarray, guess: np.ndarray) -> np.ndarray:
    """The line with the least sum of distances to the points: one through two of them, which suffices; the first such one on ties.

    Of one place only, the guess's parallel through it; of none, the guess.
    """
    places = sorted(set(map(tuple, points.tolist())))
    if len(places) == 2:
        # A side's own two corners, as most sides have: there is one line to choose from.
        (x, y), (u, v) = places
        size = math.sqrt((u - x) * (u - x) + (v - y) * (v - y))
        n0, n1 = (v - y) / size, -(u - x) / size
        turn = 1.0 if n0 * guess[0] + n1 * guess[1] >= 0 else -1.0
        return np.array([turn * n0, turn * n1, turn * (n0 * x + n1 * y)])
    points = np.array(places).reshape(-1, 2)
    if len(points) < 2:
        return guess if not len(points) else np.array([*guess[:2], guess[:2] @ points[0]])
    a, b = np.triu_indices(len(points), 1)
    d = points[b] - points[a]
    n = np.stack([d[:, 1], -d[:, 0]], axis=1) / np.linalg.norm(d, axis=1, keepdims=True)
    offset = (n * points[a]).sum(axis=1)
    cost = np.zeros(len(a))
    for p in points:
        cost += np.abs(n @ p - offset)
    k = int(np.flatnonzero(cost <= cost.min() + 1e-9 * (1 + np.abs(points).max()))[0])
    turn = 1.0 if n[k] @ guess[:2] >= 0 else -1.0
    return np.array([*(turn * n[k]), turn * offset[k]])


def corners_of(lines: np.ndarray) -> np.ndarray | None:
    """Where each line meets the next one; None where two of them are parallel."""
    both = np.stack([lines, _next(lines)], axis=1)
    m = both[:, :, :2]
    if (np.abs(m[:, 0, 0] * m[:, 1, 1] - m[:, 0, 1] * m[:, 1, 0]) < 1e-9).any():
        return None
    return np.linalg.solve(m, both[:, :, 2:])[:, :, 0]


def by_angle(p: np.ndarray) -> np.ndarray:
    """Corners in the order of their angles about their mean."""
    d = p - p.mean(axis=0)
    return p[np.argsort(np.arctan2(d[:, 1], d[:, 0]), kind="stable")]


def quadrilaterals(hull: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(best, fitted, around): the best four corners; their sides fitted to the hull corners nearest to each; those sides moved out until all corners lie within.

    A corner as near to two sides counts for both, as the best four do.
    Where two sides that follow each other are parallel, the best four stand for the fitted ones; the sides moved out are then the best four's.
    """
    best = hull[best_four(hull)]
    sides = np.array([line_through(a, b) for a, b in zip(best, _next(best), strict=True)])
    far = np.abs(hull @ sides[:, :2].T - sides[:, 2])
    nearest = far <= far.min(axis=1, keepdims=True) + 1e-9 * max(float(np.abs(hull).max()), 1e-300)
    lines = np.array([fitted_line(hull[nearest[:, k]], side) for k, side in enumerate(sides)])
    fitted = corners_of(lines)
    if fitted is None:
        lines, fitted = sides, best
    moved = np.column_stack([lines[:, :2], (hull @ lines[:, :2].T).max(axis=0)])
    around = corners_of(moved)
    return by_angle(best), by_angle(fitted), by_angle(best if around is None else around)
