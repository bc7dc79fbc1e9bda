"""Distances between point clouds by cells with bounds, instead of all pairs of points.

A cloud is cut into cells of about PER points (MOST cells on an axis at most), each with the box of the points that it really holds.
Two boxes bound every distance between their points from below and from above. For the points of a cell only
those cells of another cloud matter whose lower bound doesn't exceed the least upper bound: the nearest point lies in one of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PER, MOST = 16, 12


def _placed(points: DataFrame, group: list[str], name: str, axes: tuple[str, ...]) -> DataFrame:
    """Different points (group, name, axes) with how often each occurs (``w_``) and its cell."""
    own = points.groupBy(*group, name, *axes).agg(F.count("*").alias("w_"))
    for c in axes:
        own = own.filter(F.col(c).isNotNull())
    cloud = Window.partitionBy(*group, name)
    own = own.withColumns({"n_": F.count("*").over(cloud), **{f"{n}_{c}": f(c).over(cloud) for c in axes for f, n in ((F.min, "lo"), (F.max, "hi"))}})
    for c in (*group, name):
        own = own.filter(F.col(c).isNotNull())
    splits = F.least(F.lit(MOST), F.ceil(F.pow(F.col("n_") / PER, F.lit(1 / len(axes)))).cast("int"))
    cell = F.lit(0)
    for c in axes:
        share = F.coalesce(F.try_divide(F.col(c) - F.col(f"lo_{c}"), F.col(f"hi_{c}") - F.col(f"lo_{c}")), F.lit(0.0))
        cell = cell * MOST + F.least(F.floor(share * splits).cast("int"), splits - 1)
    return own.select(*group, name, *axes, "w_", cell.alias("cell_"))


def _near_cells(placed: DataFrame, group: list[str], name: str, axes: tuple[str, ...], whole: bool) -> DataFrame:
    """(group, a, cell_, b, r_cell_): cells of b that can hold the nearest point to one of the cell of a; where ``whole``, to any of the cloud."""
    corners = [f(c).alias(f"{n}_{c}") for c in axes for f, n in ((F.min, "lo"), (F.max, "hi"))]
    cells = placed.groupBy(*group, name, "cell_").agg(*corners)
    other = cells.select(*group, F.col(name).alias("b"), F.col("cell_").alias("r_cell_"), *(F.col(f"{n}_{c}").alias(f"r_{n}_{c}") for c in axes for n in ("lo", "hi")))
    pairs = cells.withColumnRenamed(name, "a").join(other, group).filter("a <> b")
    near, far = F.lit(0.0), F.lit(0.0)
    for c in axes:
        low, high, r_low, r_high = (F.col(f"{p}_{c}") for p in ("lo", "hi", "r_lo", "r_hi"))
        gap, reach = F.greatest(F.lit(0.0), r_low - high, low - r_high), F.greatest(r_high - low, high - r_low)
        near, far = near + gap * gap, far + reach * reach
    least = F.min(far).over(Window.partitionBy(*group, "a", "b", *([] if whole else ["cell_"])))
    # A shade more than the bound, for squares are rounded.
    return pairs.withColumn("least_", least).filter(near <= F.col("least_") * (1 + 1e-12)).select(*group, "a", "cell_", "b", "r_cell_")


def _met(points: DataFrame, group: list[str], name: str, axes: tuple[str, ...], whole: bool, tasks: int | None = None) -> DataFrame:
    """Where ``tasks`` is given, points meet in so many tasks; else Spark merges them by bytes, though each point meets many."""
    placed = _placed(points, group, name, axes)
    cells = _near_cells(placed, group, name, axes, whole)
    own = placed.withColumnRenamed(name, "a")
    other = placed.select(*group, F.col(name).alias("b"), F.col("cell_").alias("r_cell_"), *(F.col(c).alias(f"r_{c}") for c in axes))
    if tasks:
        own, other = own.repartition(tasks, *group, "a", "cell_"), other.repartition(tasks, *group, "b", "r_cell_")
    met = own.join(cells, [*group, "a", "cell_"]).join(other, [*group, "b", "r_cell_"])
    squared = sum(((F.col(c) - F.col(f"r_{c}")) * (F.col(c) - F.col(f"r_{c}")) for c in axes), F.lit(0.0))
    return met.withColumn("squared_", squared)


def nearest_gaps(points: DataFrame, group: list[str], name: str, axes: tuple[str, ...] = ("x", "y", "z"), tasks: int | None = None) -> DataFrame:
    """(group, a, b, axes, w, gap): from each different point of cloud a, which holds it ``w`` times, to the nearest of cloud b of its group.

    Points with a null coordinate are left out, and so are rows whose group or name is null.
    """
    met = _met(points, group, name, axes, False, tasks)
    return met.groupBy(*group, "a", "b", *axes).agg(F.min("w_").alias("w"), F.sqrt(F.min("squared_")).alias("gap"))


def least_gaps(points: DataFrame, group: list[str], name: str, axes: tuple[str, ...] = ("x", "y", "z")) -> DataFrame:
    """(group, a, b, gap): the least distance between the points of two clouds of a group, for either order."""
    return _met(points, group, name, axes, True).groupBy(*group, "a", "b").agg(F.sqrt(F.min("squared_")).alias("gap"))
