"""Work on very many small groups, all groups of a batch that have the same number of rows at once, and density clusters of them."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Numbers that a step holds at once, where a single group doesn't need more.
CELLS = 1 << 20


def listed(df: DataFrame, group: list[str], order: list[Column], values: dict[str, Column]) -> DataFrame:
    """(group, rows_): each group's rows in ``order`` as an array of structs of ``values``."""
    row = F.struct(*(c.alias(f"by{k}_") for k, c in enumerate(order)), *(c.alias(n) for n, c in values.items()))
    return df.groupBy(*group).agg(F.sort_array(F.collect_list(row)).alias("rows_"))


def marks(mark: Callable[[np.ndarray], np.ndarray], columns: list[Column], square: bool = False) -> Column:
    """What ``mark`` says of every row of arrays of equal length, as an array of longs.

    ``mark`` takes numbers of groups of one size (groups, rows, columns) and gives (groups, rows); where ``square``, it holds all pairs of a group's rows.
    A call for each group would cost far more than its few rows.
    """

    @F.arrow_udf("array<bigint>")
    def run(*lists: pa.Array) -> pa.Array:
        ends = lists[0].offsets.to_numpy()
        at = np.column_stack([c.flatten().to_numpy(zero_copy_only=False).astype(float) for c in lists])
        starts, sizes, out = (ends - ends[0])[:-1], np.diff(ends), np.zeros(len(at), np.int64)
        for size in np.unique(sizes[sizes > 0]).tolist():
            own, step = starts[sizes == size], max(1, CELLS // (size * size if square else size))
            for k in range(0, len(own), step):
                rows = own[k : k + step, None] + np.arange(size)
                out[rows] = mark(at[rows])
        return pa.ListArray.from_arrays(pa.array(ends - ends[0], pa.int32()), pa.array(out))

    return run(*columns)


def density_places(points: np.ndarray, eps: float, least: int) -> np.ndarray:
    """For points (groups, rows, axes) the place in its group of the first point of each one's cluster; -1 for those in none.

    Clusters are of points within ``eps`` of one that has ``least`` points (itself counted) that near; what two clusters reach is of the one whose first such point comes first.
    """
    many, n = points.shape[:2]
    near = np.sqrt(((points[:, :, None] - points[:, None]) ** 2).sum(axis=3)) <= eps
    dense = near.sum(axis=2) >= least
    link = near & dense[:, None]
    first = np.where(dense, np.arange(n), n)
    while True:
        low = np.where(link, first[:, None], n).min(axis=2, initial=n)
        # A label is a core point of the same cluster, so its own label may stand for it.
        low = np.where(dense, np.take_along_axis(np.column_stack([low, np.full(many, n)]), low, axis=1), n)
        if (low == first).all():
            break
        first = low
    own = np.where(link, first[:, None], n).min(axis=2, initial=n)
    place, groups = np.full((many, n + 1), n), np.arange(many)
    for k in range(n - 1, -1, -1):
        place[groups, own[:, k]] = k
    return np.where(own < n, np.take_along_axis(place, own, axis=1), -1)


def density_labels(points: np.ndarray, eps: float, least: int) -> np.ndarray:
    """Clusters of one group, numbered from 0; -1 for points in none."""
    place = density_places(points[None], eps, least)[0]
    known, label = np.unique(place, return_inverse=True)
    return label - int(len(known) > 0 and known[0] < 0)


def clusters(df: DataFrame, group: list[str], id_: str, values: list[str], eps: float, least: int) -> DataFrame:
    """``df`` with ``cluster``: the smallest id of the row's cluster in its group (a frame's rows, which are few), -1 for none."""
    points = {f"v{k}_": F.col(v).cast("double") for k, v in enumerate(values)}
    rows = listed(df, group, [F.col(id_)], {**points, "row_": F.struct(*df.columns)})
    place = marks(lambda p: density_places(p, eps, least), [F.col("rows_")[c] for c in points], square=True)
    each = rows.withColumn("places_", place).select(F.posexplode("rows_").alias("at_", "r_"), "rows_", "places_")
    first = F.get("places_", F.col("at_"))
    name = F.when(first >= 0, F.get("rows_", first.cast("int"))["by0_"].cast("long")).otherwise(-1).cast("long")
    return each.select(*(F.col("r_.row_")[c].alias(c) for c in df.columns), name.alias("cluster"))
