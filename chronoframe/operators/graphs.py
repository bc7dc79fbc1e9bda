"""Scene graphs as edge tables: relations, majorities, smoothing, differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoframe.functions.boxes import box, centre, direction_words, inside_share, intersection, norm


def relation_2d(extent: float, contact: float = 0.01, close: float = 0.17, axis: float = 0.85, touches: Column | None = None) -> tuple[Column, Column]:
    """(relation, distance) of box r_ to the row's own box; null where they are apart.

    In contact: ``touching`` if the masks do (``touches``; without masks, if the boxes overlap), else ``inside`` if 85 % of r_ lies in the other. Close: the axis that the unit
    vector from r_ to the other follows by more than ``axis``, else the words of both components, else ``close to``.
    """
    a, b = box(), box("r_")
    (ax, ay), (bx, by) = centre(a), centre(b)
    dx, dy = (ax - bx) / extent, (ay - by) / extent
    length = norm(dx, dy)
    distance = F.when(intersection(a, b) > 0, 0.0).otherwise(length)
    nx, ny = F.try_divide(dx, length), F.try_divide(dy, length)
    words = direction_words([(ny, "behind of", "in front of"), (-nx, "right of", "left of")], 0.62, " and ", "close to")
    relation = (
        F.when((distance < contact) & (intersection(a, b) > 0 if touches is None else touches), "touching")
        .when((distance < contact) & (inside_share(b, a) >= 0.85), "inside")
        .when(distance >= close, None)
        .when(ny > axis, "behind of")
        .when(ny < -axis, "in front of")
        .when(nx < -axis, "right of")
        .when(nx > axis, "left of")
        .otherwise(words)
    )
    return relation, distance


def edges(nodes: DataFrame, group: list[str], name: str, extent: float, mask: str | None = None) -> DataFrame:
    """(group, start, end, edge_type, dist): one edge at most for each ordered pair of a group's nodes.

    ``mask`` names a column of the pixels set, as an array of numbers; without one, boxes stand for masks.
    """
    columns = (name, "x1", "y1", "x2", "y2", *([mask] if mask else []))
    other = nodes.select(*group, *(F.col(c).alias(f"r_{c}") for c in columns))
    touches = F.arrays_overlap(mask, f"r_{mask}") if mask else None
    relation, distance = relation_2d(extent, touches=touches)
    pairs = nodes.join(other, group).filter(F.col(name) != F.col(f"r_{name}"))
    found = pairs.select(*group, F.col(f"r_{name}").alias("start"), F.col(name).alias("end"), relation.alias("edge_type"), distance.alias("dist"))
    return found.filter("edge_type is not null")


def majority_edges(found: DataFrame, part: list[str], order: str, least: int | Column) -> DataFrame:
    """For each pair the relation seen most often, ``least`` times or more; the first seen on ties."""
    counts = found.groupBy(*part, "start", "end", "edge_type").agg(F.count("*").alias("n"), F.min(order).alias("first_"))
    return _most_frequent(counts, part, least)


def average_edges(found: DataFrame, part: list[str], order: str) -> DataFrame:
    """The same with two graphs as the least number, or half of the part's graphs if that is less."""
    graphs = found.groupBy(*part).agg(F.least(F.floor(F.countDistinct(order) / 2), F.lit(2)).alias("least_"))
    counts = found.groupBy(*part, "start", "end", "edge_type").agg(F.count("*").alias("n"), F.min(order).alias("first_"))
    return _most_frequent(counts.join(graphs, part), part, F.col("least_")).drop("least_")


def _most_frequent(counts: DataFrame, part: list[str], least: int | Column) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*part, "start", "end").orderBy(F.desc("n"), "first_", "edge_type"))
    return counts.filter(F.col("n") >= least).withColumn("rank_", rank).filter("rank_ = 1").drop("rank_", "first_")


def denoised(found: DataFrame, part: list[str], order: str, reach: int, least: int) -> DataFrame:
    """Edges that their centred window of 2 reach + 1 groups holds ``least`` times or more, for every group of the window's middle."""
    spread = found.withColumn("offset_", F.explode(F.sequence(F.lit(-reach), F.lit(reach)))).withColumn("mid_", F.col(order) + F.col("offset_"))
    known = found.groupBy(*part).agg(F.min(order).alias("lo_"), F.max(order).alias("hi_"))
    counts = spread.groupBy(*part, F.col("mid_").alias(order), "start", "end", "edge_type").agg(F.count("*").alias("n"))
    return counts.join(known, part).filter((F.col(order) >= F.col("lo_")) & (F.col(order) <= F.col("hi_")) & (F.col("n") >= least)).drop("lo_", "hi_")


def differences(found: DataFrame, part: list[str], order: str) -> DataFrame:
    """(part, order, start, end, edge_type, change): edges of a group that the next one lacks (removed), and new ones there (added).

    An edge's neighbours in order tell both, so one shuffle by the part serves all.
    """
    keys = [*part, order, "start", "end", "edge_type"]
    whole = Window.partitionBy(*part)
    own = Window.partitionBy(*part, "start", "end", "edge_type").orderBy(order)
    seen = found.select(*keys).withColumn("lo_", F.min(order).over(whole)).withColumn("hi_", F.max(order).over(whole))
    seen = seen.withColumn("before_", F.lag(order).over(own)).withColumn("after_", F.lead(order).over(own))
    at = F.col(order)
    ends = F.when((at < F.col("hi_")) & (F.col("after_").isNull() | (F.col("after_") > at + 1)), F.struct(at.alias("g_"), F.lit("removed").alias("change")))
    begins = F.when((at > F.col("lo_")) & (F.col("before_").isNull() | (F.col("before_") < at - 1)), F.struct((at - 1).alias("g_"), F.lit("added").alias("change")))
    both = seen.withColumn("c_", F.explode(F.array(ends, begins))).filter("c_ is not null")
    return both.select(*part, F.col("c_.g_").alias(order), "start", "end", "edge_type", "c_.change")


def change_keystates(changes: DataFrame, part: list[str], order: str, movable: Column, gap: int) -> DataFrame:
    """(part, object, frame_idx, n): changes at movable objects; stretches with gaps of at most ``gap`` give their last group and their number."""
    seen = changes.filter(movable).select(*part, F.col("start").alias("object"), order).distinct()
    w = Window.partitionBy(*part, "object").orderBy(order)
    cut = F.when(F.col(order) - F.lag(order).over(w) > gap, 1).otherwise(0)
    runs = seen.withColumn("cut_", cut).withColumn("run_", F.sum("cut_").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(*part, "object", "run_").agg(F.max(order).alias("frame_idx"), F.count("*").alias("n")).drop("run_")


def same_nodes(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of either side that the other lacks; empty where the graphs are equal."""
    return left.select(*keys).exceptAll(right.select(*keys)).unionByName(right.select(*keys).exceptAll(left.select(*keys)))


def node_changes(nodes: DataFrame, part: str, order: str, name: str) -> DataFrame:
    """(part, order, name): nodes that one of two neighbouring graphs of a part has and the other lacks, under the earlier graph's number."""
    rows = nodes.select(part, order, name).distinct()
    along = Window.partitionBy(part).orderBy(order)
    graphs = rows.select(part, order).distinct().select(part, order, F.lag(order).over(along).alias("before_"), F.lead(order).over(along).alias("next_"))
    own = Window.partitionBy(part, name).orderBy(order)
    seen = rows.join(graphs, [part, order]).withColumns({"had_": F.lag(order).over(own), "has_": F.lead(order).over(own)})
    gone = F.when(F.col("next_").isNotNull() & ~F.col("next_").eqNullSafe(F.col("has_")), F.col(order))
    come = F.when(F.col("before_").isNotNull() & ~F.col("before_").eqNullSafe(F.col("had_")), F.col("before_"))
    return seen.select(part, F.explode(F.array_compact(F.array(gone, come))).alias(order), name)


def sentence(start: Column, relation: Column, end: Column) -> Column:
    """"a is inside b", "a left of b"."""
    return F.concat_ws(" ", start, F.when(relation.isin("inside", "touching"), F.concat(F.lit("is "), relation)).otherwise(relation), end)
