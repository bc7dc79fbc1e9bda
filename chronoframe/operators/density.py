"""Density clusters of groups of any size, by cells instead of all pairs of points.

Cells are so small that the points of one are all within eps of each other: a cell with ``least`` points holds core points only, of
one cluster, and none of its points are compared. Only points of sparser cells, fewer than ``least`` in each, look at the cells around
theirs, so a point is met by a bounded number of others, however crowded its cell is.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoframe.operators.tables import HOT_SHARE, Tables, components, hot_join


def _offsets(dims: int) -> list[tuple[int, ...]]:
    """Cells that can hold a point within eps of one of cell 0, which has the side eps / sqrt(dims)."""
    reach = math.floor(math.sqrt(dims)) + 1
    return [o for o in itertools.product(range(-reach, reach + 1), repeat=dims) if sum(max(0, abs(d) - 1) ** 2 for d in o) <= dims]


def _moved(offsets: list[tuple[int, ...]], dims: int) -> list[Column]:
    """Rows exploded to the cells around theirs, as columns c0, c1 and so on."""
    steps = F.explode(F.array(*(F.struct(*(F.lit(v).alias(f"o{k}") for k, v in enumerate(o))) for o in offsets))).alias("o_")
    return [steps, *((F.col(f"c{k}") + F.col(f"o_.o{k}")).alias(f"c{k}") for k in range(dims))]


def _cell(value: str, side: float) -> Column:
    place = F.col(value) / side
    return F.when(F.abs(place) < 2.0**52, F.floor(place)).otherwise(F.raise_error(F.lit("a value is too large for cells of eps")))


def _squared(dims: int) -> Column:
    gaps = [F.col(f"v{k}") - F.col(f"r{k}") for k in range(dims)]
    return sum((g * g for g in gaps[1:]), gaps[0] * gaps[0])


def _linked_cells(placed: DataFrame, keys: list[str], dims: int, eps: float) -> DataFrame:
    """(keys, u, v): crowded cells, by their first points, some points of which are within eps of each other.

    Boxes around the points of parts of the cells decide most pairs: a greatest distance of eps or less links, a least one of more doesn't. Points are
    compared only between parts that neither bound decides, of cells that nothing has linked.
    """
    cell, per = [f"c{k}" for k in range(dims)], 8 if dims < 3 else 4
    side = eps / math.sqrt(dims)
    part = F.lit(0)
    for k in range(dims):
        share = F.col(f"v{k}") / side - F.col(f"c{k}")
        part = part * per + F.greatest(F.lit(0), F.least(F.lit(per - 1), F.floor(share * per).cast("int")))
    crowd = placed.filter("crowded").withColumn("p", part)
    corners = [f(f"v{k}").alias(f"{n}{k}") for k in range(dims) for f, n in ((F.min, "lo"), (F.max, "hi"))]
    parts = crowd.groupBy(*keys, *cell, "first", "p").agg(*corners)
    other = parts.select(*keys, *cell, F.col("first").alias("r_first"), F.col("p").alias("r_p"), *(F.col(f"{n}{k}").alias(f"r_{n}{k}") for k in range(dims) for n in ("lo", "hi")))
    ahead = [o for o in _offsets(dims) if o > (0,) * dims]
    steps, *moved = _moved(ahead, dims)
    asked = parts.select("*", steps).select(*(c for c in parts.columns if c not in cell), *moved)
    near, far = F.lit(0.0), F.lit(0.0)
    for k in range(dims):
        low, high, r_low, r_high = (F.col(f"{n}{k}") for n in ("lo", "hi", "r_lo", "r_hi"))
        gap, reach = F.greatest(F.lit(0.0), r_low - high, low - r_high), F.greatest(r_high - low, high - r_low)
        near, far = near + gap * gap, far + reach * reach
    # A shade off eps either way, for squares are rounded: what lies between is compared.
    met = asked.join(other, [*keys, *cell]).filter(near <= eps * eps * (1 + 1e-12)).withColumn("sure", far <= eps * eps * (1 - 1e-12))
    pair = met.select(*keys, F.col("first").alias("u"), F.col("r_first").alias("v"), "p", "r_p", "sure")
    sure = pair.filter("sure").select(*keys, "u", "v").distinct()
    open_ = pair.filter("not sure").drop("sure").join(sure, [*keys, "u", "v"], "left_anti")
    mine = crowd.select(*keys, F.col("first").alias("u"), "p", *(f"v{k}" for k in range(dims)))
    theirs = crowd.select(*keys, F.col("first").alias("v"), F.col("p").alias("r_p"), *(F.col(f"v{k}").alias(f"r{k}") for k in range(dims)))
    found = mine.join(open_, [*keys, "u", "p"]).join(theirs, [*keys, "v", "r_p"]).filter(F.sqrt(_squared(dims)) <= eps)
    return sure.unionByName(found.select(*keys, "u", "v").distinct())


def density_clusters(df: DataFrame, group: list[str], id_: str, values: list[str], eps: float, least: int | str) -> DataFrame:
    """``df`` with ``cluster``: the smallest id of a core point of the row's cluster in its group; -1 for none.

    A core point has ``least`` points (itself counted; a number, or a column that is the same in all rows of a group) within ``eps``. A point that is no core joins
    the cluster, among those with a core point within eps, whose name is smallest. Equal points count as often as they occur and share a cluster.
    Rows with a null group or id, or a value that is null or not finite, are in no cluster. ``id_`` is a whole number, unique in its group.
    Values of 2**52 cells or more are refused. Works at once (several jobs and written tables); the result reads those tables.
    """
    if "cluster" in df.columns:
        raise ValueError("df has a column cluster already")
    dims, tables = len(values), Tables(df.sparkSession, shuffled=True)
    keys, cell, own = [f"g{k}" for k in range(len(group))], [f"c{k}" for k in range(dims)], [f"v{k}" for k in range(dims)]
    wanted = F.col(least).cast("long") if isinstance(least, str) else F.lit(int(least)).cast("long")
    # Adding zero makes one of the two zeros.
    named = [*(F.col(g).alias(k) for g, k in zip(group, keys, strict=True)), *((F.col(v).cast("double") + 0.0).alias(o) for v, o in zip(values, own, strict=True))]
    rows = df.select(*named, F.col(id_).cast("long").alias("id_"), wanted.alias("least_"))
    sound = " and ".join([f"{c} is not null" for c in (*keys, *own, "id_", "least_")] + [f"abs({c}) < double('infinity')" for c in own])
    points = rows.filter(sound).groupBy(*keys, *own).agg(F.min("id_").alias("id_"), F.count("*").alias("w"), F.max("least_").alias("least_"))
    side = eps / math.sqrt(dims) * (1 - 1e-9)
    points = tables.keep(points.select("*", *(_cell(o, side).alias(c) for o, c in zip(own, cell, strict=True))), "points")
    cells = points.groupBy(*keys, *cell).agg(F.sum("w").alias("n"), F.count("*").alias("n_points"), F.min("id_").alias("first"))
    total = points.count()
    placed = tables.keep(hot_join(points, cells, [*keys, *cell], "n_points", total).withColumn("crowded", F.col("n") >= F.col("least_")), "placed")

    # Points of sparse cells look around; the points of a crowded cell are one node to them.
    steps, *moved = _moved(_offsets(dims), dims)
    sparse = placed.filter("not crowded").select(*keys, *own, F.col("id_").alias("u"), "least_", *cell)
    asked = sparse.select("*", steps).select(*keys, *own, "u", "least_", *moved)
    node = F.when(F.col("crowded"), F.col("first")).otherwise(F.col("id_"))
    seen = placed.select(*keys, *cell, *(F.col(o).alias(f"r{k}") for k, o in enumerate(own)), node.alias("v"), "w", "crowded")
    met = asked.join(seen, [*keys, *cell]).filter(F.sqrt(_squared(dims)) <= eps)
    met = tables.keep(met.groupBy(*keys, "u", "v", "crowded").agg(F.sum("w").alias("w"), F.max("least_").alias("least_")), "met")
    cores = met.groupBy(*keys, "u").agg(F.sum("w").alias("n"), F.max("least_").alias("least_")).filter("n >= least_").select(*keys, "u")
    crowds = placed.filter("crowded").select(*keys, F.col("first").alias("u")).distinct()
    cores = tables.keep(cores.unionByName(crowds), "cores")
    to_core = met.join(cores.withColumnRenamed("u", "v"), [*keys, "v"]).select(*keys, "u", "v")
    to_core = tables.keep(to_core, "to_core")
    links = to_core.join(cores, [*keys, "u"]).select(*keys, "u", "v").unionByName(_linked_cells(placed, keys, dims, eps))
    found = components(links, keys, tables, "links")
    named_cores = cores.withColumnRenamed("u", "node").join(found, [*keys, "node"], "left").select(*keys, "node", F.coalesce("component", "node").alias("cluster"))
    named_cores = tables.keep(named_cores, "named")
    border = to_core.join(cores, [*keys, "u"], "left_anti").join(named_cores.withColumnRenamed("node", "v"), [*keys, "v"])
    border = border.groupBy(*keys, "u").agg(F.min("cluster").alias("cluster")).withColumnRenamed("u", "node")
    known = named_cores.unionByName(border).withColumnRenamed("node", "node_")
    # A crowded cell's points bear its node: as many rows as it has points, so the join is by counts again.
    nodes = placed.select(*keys, *own, "w", node.alias("node_"))
    sizes = nodes.groupBy(*keys, "node_").agg(F.count("*").alias("size_"))
    of_points = hot_join(nodes, known.join(sizes, [*keys, "node_"]).hint("merge"), [*keys, "node_"], "size_", total).select(*keys, *own, "w", "cluster")
    of_points = tables.keep(of_points, "clusters")
    mine = [f"_{c}_of_row" for c in (*keys, *own)]
    matched = df.hint("merge").select("*", *(c.alias(m) for c, m in zip(named, mine, strict=True)))
    hot, of_row = F.col("w") > matched.count() / HOT_SHARE, [F.col(c).alias(m) for c, m in zip((*keys, *own), mine, strict=True)]
    # Equal points with more than one row in HOT_SHARE are HOT_SHARE at most: their rows are not shuffled.
    few = F.broadcast(of_points.filter(hot).select(*of_row, "cluster"))
    many = matched.join(few.select(*mine), mine, "left_anti").join(of_points.filter(~hot).select(*of_row, "cluster"), mine, "left")
    wanting = F.col(id_).isNull() | (F.col(least).isNull() if isinstance(least, str) else F.lit(False))
    label = F.when(wanting, -1).otherwise(F.coalesce("cluster", F.lit(-1))).cast("long").alias("cluster")
    return matched.join(few, mine).unionByName(many).select(*df.columns, label)
