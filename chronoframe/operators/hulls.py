"""Convex hulls of point clouds in the plane and in space, and membership in them.

Each task keeps the extreme points of what it has read of a cloud, and only those are shuffled; a cloud's hull is
that of its tasks' extreme points. A hull is its half-spaces, so membership is a column expression.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Points that a task holds before it takes their hulls again, and points of a cloud that are sent on as they are.
HELD, FEW = 200_000, 32
#: Share of the greatest coordinate by which a point may lie outside and still be on a face.
SLACK = 1e-12


def _cross(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    (x, y, z), (u, v, w) = a.T, b.T
    return np.stack([y * w - z * v, z * u - x * w, x * v - y * u], axis=-1)


def _chain(p: np.ndarray) -> np.ndarray:
    """Corners of the hull in the plane, counter-clockwise."""
    order = np.lexsort((p[:, 1], p[:, 0]))
    halves = []
    for way in (order, order[::-1]):
        half: list[int] = []
        for i in way.tolist():
            while len(half) > 1:
                a, b = p[half[-2]], p[half[-1]]
                if (b[0] - a[0]) * (p[i][1] - a[1]) - (b[1] - a[1]) * (p[i][0] - a[0]) > 0:
                    break
                half.pop()
            half.append(i)
        halves.append(half[:-1])
    return np.array(halves[0] + halves[1], np.int64)


def _simplex(p: np.ndarray, slack: float) -> list[int]:
    """Up to four points, each as far as can be from the point, line or plane of those before; fewer where the cloud is flat."""
    a = int(p[:, 0].argmin())
    far = np.linalg.norm(p - p[a], axis=1)
    b = int(far.argmax())
    if far[b] <= slack:
        return [a]
    along = (p[b] - p[a]) / far[b]
    off = p - p[a] - np.outer((p - p[a]) @ along, along)
    far = np.linalg.norm(off, axis=1)
    c = int(far.argmax())
    if far[c] <= slack:
        return [a, b]
    normal = _cross(along, off[c] / far[c])
    far = np.abs((p - p[a]) @ normal)
    d = int(far.argmax())
    return [a, b, c] if far[d] <= slack else [a, b, c, d]


def _space(p: np.ndarray, start: list[int], slack: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Triangles, outward normals and offsets: the farthest point outside is taken in until none is left."""

    def planes(faces: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a, b, c = p[faces.T]
        n = _cross(b - a, c - a)
        n /= np.sqrt((n * n).sum(axis=1))[:, None]
        return n, (n * a).sum(axis=1)

    a, b, c, d = start
    faces = np.array([[a, b, c], [a, c, d], [a, d, b], [b, d, c]])
    normals, offsets = planes(faces)
    if (normals @ p[start].mean(axis=0) > offsets).any():
        faces = faces[:, ::-1].copy()
        normals, offsets = planes(faces)
    rest = np.arange(len(p))
    beyond = p @ normals.T - offsets
    while True:
        out = beyond.max(axis=1) > slack
        rest, beyond = rest[out], beyond[out]
        if not len(rest):
            return faces, normals, offsets
        i = int(rest[beyond.max(axis=1).argmax()])
        seen = normals @ p[i] - offsets > slack
        edges = faces[seen][:, [[0, 1], [1, 2], [2, 0]]].reshape(-1, 2)
        held = set(map(tuple, edges.tolist()))
        rim = np.array([[u, v, i] for u, v in held if (v, u) not in held])
        n, d_ = planes(rim)
        faces, normals, offsets = np.concatenate([faces[~seen], rim]), np.concatenate([normals[~seen], n]), np.concatenate([offsets[~seen], d_])
        beyond = np.concatenate([beyond[:, ~seen], p[rest] @ n.T - d_], axis=1)


def _slack(p: np.ndarray) -> float:
    return SLACK * max(float(np.abs(p).max()), 1e-300)


def extreme(p: np.ndarray) -> np.ndarray:
    """Numbers of the points that span the same hull; of a flat cloud too."""
    if p.shape[1] == 2:
        return _chain(p) if len(p) > 1 else np.arange(len(p))
    start = _simplex(p, _slack(p))
    if len(start) < 3:
        return np.array(start)
    if len(start) == 3:
        a, b, c = p[start]
        return _chain(np.delete(p, np.abs(_cross(b - a, c - a)).argmax(), axis=1))
    return np.unique(_space(p, start, _slack(p))[0])


def half_spaces(p: np.ndarray) -> np.ndarray:
    """Rows (normal, offset) of the hull's faces, offsets with their slack; none for a cloud that is flat in its space."""
    if p.shape[1] == 2:
        corners = p[_chain(p)] if len(p) > 2 else p[:0]
        if len(corners) < 3:
            return np.zeros((0, 3))
        side = np.roll(corners, -1, axis=0) - corners
        normals = np.stack([side[:, 1], -side[:, 0]], axis=1) / np.linalg.norm(side, axis=1, keepdims=True)
        return np.column_stack([normals, np.einsum("ij,ij->i", normals, corners) + _slack(p)])
    start = _simplex(p, _slack(p))
    if len(start) < 4:
        return np.zeros((0, 4))
    _, normals, offsets = _space(p, start, _slack(p))
    return np.column_stack([normals, offsets + _slack(p)])


def _runs(table: pa.Table) -> Iterator[np.ndarray]:
    """The rows of each cloud, told apart by 128 bits."""
    one, two = table.column("one_").to_numpy(), table.column("two_").to_numpy()
    order = np.lexsort((two, one))
    new = np.flatnonzero((np.diff(one[order]) != 0) | (np.diff(two[order]) != 0)) + 1
    yield from np.split(order, new)


def _reduced(table: pa.Table, axes: tuple[str, ...]) -> pa.Table:
    p = np.column_stack([table.column(c).to_numpy() for c in axes])
    kept = [rows[extreme(p[rows])] if len(rows) > FEW else rows for rows in _runs(table)] if len(table) else []
    return table.take(pa.array(np.concatenate(kept))) if kept else table


def extreme_points(points: DataFrame, group: list[str], axes: tuple[str, ...] = ("x", "y", "z")) -> DataFrame:
    """Rows (group, axes) that span the hull of each group's points; a point may come once from each task. Points with a null or non-finite coordinate are left out."""
    sound = [F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c).cast("double")) < float("inf")) for c in axes]
    for test in sound:
        points = points.filter(test)
    rows = points.select(F.struct(*group).alias("g_"), F.xxhash64(*group).alias("one_"), F.xxhash64(F.lit("second"), *group).alias("two_"), *(F.col(c).cast("double").alias(c) for c in axes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for batch in batches:
            held.append(_reduced(pa.Table.from_batches([batch]), axes))
            if sum(map(len, held)) > HELD:
                held = [_reduced(pa.concat_tables(held).combine_chunks(), axes)]
                # Very many small clouds don't shrink: what is held goes on.
                if len(held[0]) > HELD // 2:
                    yield from held.pop().to_batches()
        if held:
            yield from _reduced(pa.concat_tables(held).combine_chunks(), axes).to_batches()

    return rows.mapInArrow(run, rows.schema).select("g_.*", *axes)


KIND = pa.list_(pa.struct([("n", pa.list_(pa.float64())), ("d", pa.float64())]))


def _faces(clouds: pa.Array) -> list[list[dict]]:
    return [[{"n": f[:-1].tolist(), "d": f[-1]} for f in half_spaces(np.unique(np.array(p), axis=0))] if p else [] for p in clouds.to_pylist()]


def faces_of(points: Column, axes: tuple[str, ...] = ("x", "y", "z")) -> Column:
    """The half-spaces of the hull of an array of few points (structs); null where all are in one plane (or line, for two axes)."""

    @F.arrow_udf("array<struct<n:array<double>,d:double>>")
    def run(clouds: pa.Array) -> pa.Array:
        return pa.array([f or None for f in _faces(clouds)], KIND)

    sound = lambda p: reduce(and_, (p[c].isNotNull() & ~F.isnan(p[c].cast("double")) & (F.abs(p[c].cast("double")) < float("inf")) for c in axes))
    known = F.transform(F.filter(points, sound), lambda p: F.array(*(p[c].cast("double") for c in axes)))
    return run(F.when(F.size(known) > len(axes), known))


def hulls(points: DataFrame, group: list[str], axes: tuple[str, ...] = ("x", "y", "z")) -> DataFrame:
    """(group, faces) of each group whose points are not all in one plane (or line, for two axes): its half-spaces n * p <= d.

    What meets in one task are a cloud's extreme points from all tasks. Groups may be null; an empty table gives no hulls.
    """
    # As many tasks as the session shuffles to: the work is in Python, however few bytes it is.
    tasks = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spans = extreme_points(points, group, axes).repartition(tasks, *group).groupBy(*group).agg(F.collect_list(F.array(*axes)).alias("p_")).filter(F.size("p_") > len(axes))
    rows = spans.select(F.struct(*group).alias("g_"), "p_")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("g_"), pa.array(_faces(batch.column("p_")), KIND)], names=["g_", "faces"])

    schema = f"g_ {rows.schema['g_'].dataType.simpleString()}, faces array<struct<n:array<double>,d:double>>"
    return rows.mapInArrow(run, schema).filter(F.size("faces") > 0).select("g_.*", "faces")


def inside(faces: Column, point: list[Column]) -> Column:
    """Whether a point lies in a hull or on it; false where there is no hull or a coordinate is null."""
    beyond = lambda f: sum(f.n[k] * c for k, c in enumerate(point)) > f.d
    return F.coalesce(F.forall(faces, lambda f: ~beyond(f)), F.lit(False))
