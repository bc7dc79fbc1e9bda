"""Movements of objects between frames and graphs, their gripper relations, and texts of both."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoframe.functions.boxes import direction_words, norm
from chronoframe.operators import series
from chronoframe.operators.intervals import overlap_join


def averaged_nodes(nodes: DataFrame, part: list[str], order: str, name: str, values: list[str]) -> DataFrame:
    """(part, name, values, visible): means over the graphs that show the node; visible if more than half of the part's graphs do."""
    graphs = nodes.groupBy(*part).agg(F.countDistinct(order).alias("graphs_"))
    seen = nodes.groupBy(*part, name).agg(*(F.avg(v).alias(v) for v in values), F.countDistinct(order).alias("seen_"))
    return seen.join(graphs, part).select(*part, name, *values, (F.col("seen_") / F.col("graphs_") > 0.5).alias("visible"))


def movement_between(first: DataFrame, last: DataFrame, part: list[str], name: str, values: list[str]) -> DataFrame:
    """(part, name, values): how far each node of ``first`` is in ``last``; 0 where either place is unknown."""
    later = last.select(*part, name, *(F.col(v).alias(f"l_{v}") for v in values))
    known = lambda v: F.coalesce(F.col(f"l_{v}") - F.col(v), F.lit(0.0)).alias(v)
    return first.join(later, [*part, name], "left").select(*part, name, *map(known, values))


def trimmed_vectors(flow: DataFrame, keys: list[str], values: list[str], z: float = 2.0) -> DataFrame:
    """The mean vector of each key without those that are more than z deviations off in any component."""
    part = Window.partitionBy(*keys)
    off = [F.coalesce(F.abs(series.zscore(F.col(v), part)), F.lit(0.0)) for v in values]
    kept = flow.withColumn("off_", F.greatest(*off) if len(off) > 1 else off[0]).filter(F.col("off_") <= z)
    return kept.groupBy(*keys).agg(*(F.avg(v).alias(v) for v in values))


def largest(movements: DataFrame, keys: list[str], order: str, values: list[str]) -> DataFrame:
    """(keys, values): the longest movement of each key; the first on ties."""
    size = F.round(norm(*map(F.col, values)), 9)
    best = movements.groupBy(*keys).agg(F.max(F.struct(size.alias("size"), (-F.col(order)).alias("turn"), *values)).alias("b_"))
    return best.select(*keys, *(F.col(f"b_.{v}").alias(v) for v in values))


def most_moved(movements: DataFrame, part: list[str], name: str, values: list[str]) -> DataFrame:
    """(part, name, total): the object that moved farthest in all; the first by name on ties."""
    totals = movements.groupBy(*part, name).agg(F.round(F.sum(norm(*map(F.col, values))), 6).alias("total"))
    rank = F.row_number().over(Window.partitionBy(*part).orderBy(F.desc("total"), name))
    return totals.withColumn("rank_", rank).filter("rank_ = 1").drop("rank_")


def directions(x: Column, y: Column, least: float) -> Column:
    """The parts of a movement beyond ``least`` pixels, as (word, whole pixels); y grows downwards."""
    across = F.when(x > least, F.struct(F.lit("right").alias("word"), x.cast("int").alias("pixels"))).when(x < -least, F.struct(F.lit("left").alias("word"), x.cast("int").alias("pixels")))
    along = F.when(y <= -least, F.struct(F.lit("up").alias("word"), y.cast("int").alias("pixels"))).when(y > least, F.struct(F.lit("down").alias("word"), y.cast("int").alias("pixels")))
    return F.filter(F.array(across, along), lambda d: d.isNotNull())


def movement_texts(movements: DataFrame, keys: list[str], name: str, found: Column) -> DataFrame:
    """(keys, text): all movements of a graph as one text, by name."""
    words = F.transform(found, lambda d: F.concat(F.col(name), F.lit("("), d.word, F.lit(","), d.pixels.cast("string"), F.lit("),")))
    listed = movements.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(name, F.array_join(words, "").alias("t")))).alias("all_"))
    return listed.select(*keys, F.concat(F.lit("Object Movements:\n {"), F.array_join(F.transform("all_", lambda a: a.t), ""), F.lit("}")).alias("text"))


def one_place(x: Column) -> Column:
    return F.floor(x * 10 + 0.5) / 10


def distance_texts(distances: DataFrame, keys: list[str], name: str, distance: str) -> DataFrame:
    """(keys, text): the gripper's distances to the known objects, to one place, by name."""
    shown = F.concat(F.col(name), F.lit(": "), one_place(F.col(distance)).cast("string"), F.lit(","))
    listed = distances.filter(F.col(distance).isNotNull()).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(name, shown.alias("t")))).alias("all_"))
    return listed.select(*keys, F.concat(F.lit("Distances to Robot Gripper:\n{"), F.array_join(F.transform("all_", lambda a: a.t), ""), F.lit("}")).alias("text"))


def gripper_edges(distances: DataFrame, keys: list[str], name: str, distance: str, inside: float = 0.02) -> DataFrame:
    """(keys, start, end, edge_type, dist): what the gripper holds."""
    held = distances.filter(F.col(distance) < inside)
    return held.select(*keys, F.col(name).alias("start"), F.lit("robot").alias("end"), F.lit("inside").alias("edge_type"), F.col(distance).alias("dist"))


def without_robot(edges: DataFrame) -> DataFrame:
    return edges.filter((F.col("start") != "robot") & (F.col("end") != "robot"))


def held(distances: DataFrame, keys: list[str], name: str, distance: str, inside: float = 0.02, near: float = 0.8) -> DataFrame:
    """(keys, held, near): the first object by name that the gripper holds, or "nothing"; whether any is near."""
    first = F.min(F.when(F.col(distance) < inside, F.col(name)))
    return distances.groupBy(*keys).agg(F.coalesce(first, F.lit("nothing")).alias("held"), F.coalesce(F.max(F.col(distance) < near), F.lit(False)).alias("near"))


def close_objects(distances: DataFrame, part: str, order: str, name: str, distance: str, last: int = 2, least: float = 30.0) -> DataFrame:
    """Rows of the two objects closest in one of the part's last frames, and of those nearer than the mean second distance there (``least`` at least)."""
    frames = F.dense_rank().over(Window.partitionBy(part).orderBy(F.desc(order)))
    turn = F.row_number().over(Window.partitionBy(part, order).orderBy(F.col(distance).asc_nulls_last(), name))
    late = distances.withColumn("back_", frames).filter(F.col("back_") <= last).withColumn("turn_", turn)
    chosen = late.groupBy(part).agg(
        F.collect_set(F.when(F.col("turn_") <= 2, F.col(name))).alias("chosen_"), F.avg(F.when(F.col("turn_") == 2, F.col(distance))).alias("second_")
    )
    found = distances.filter(F.col(distance).isNotNull()).join(chosen, part)
    near = (F.col(distance) < F.greatest(F.col("second_"), F.lit(least))) | F.array_contains("chosen_", F.col(name))
    return found.filter(near).select(*distances.columns)


def occlusion(areas: DataFrame, keys: list[str], area: str, occluded: float = 0.85, noise: float = 1.1) -> DataFrame:
    """Adds whether an area is well below, or above, its object's mean.

    An area right on a limit is neither: it must pass the limit by a shade, for sums of the same numbers in another order differ by less.
    """
    mean, shade = F.avg(area).over(Window.partitionBy(*keys)), 1e-12 * F.abs("mean_")
    return areas.withColumn("mean_", mean).withColumn("occluded", F.col(area) < occluded * F.col("mean_") - shade).withColumn("noise", F.col(area) > noise * F.col("mean_") + shade).drop("mean_")


def carried_nodes(nodes: DataFrame, part: str, order: str, name: str, values: list[str]) -> DataFrame:
    """A node of each graph for each object seen in it or before: an object that is missing keeps its last place and is not visible."""
    graphs = nodes.select(part, order).distinct()
    names = nodes.select(part, name).distinct()
    grid = graphs.join(names, part).join(nodes.select(part, order, name, F.struct(*values).alias("at_")), [part, order, name], "left")
    known = F.last("at_", ignorenulls=True).over(series.upto(Window.partitionBy(part, name).orderBy(order)))
    return grid.withColumn("kept_", known).filter("kept_ is not null").select(part, order, name, *(F.col(f"kept_.{v}").alias(v) for v in values), F.col("at_").isNotNull().alias("visible"))


def interval_moves(intervals: DataFrame, places: DataFrame, part: str, order: str, name: str, x: str, y: str) -> DataFrame:
    """(part, start, end, name, dx, dy): how far each object seen in an interval is at its last sight there from its first."""
    seen = overlap_join(intervals, places.select(part, order, name, x, y), [part], ("start", "end"), (order, order))
    ends = seen.groupBy(part, "start", "end", name).agg(*((F.max_by(c, order) - F.min_by(c, order)).alias(a) for c, a in ((x, "dx"), (y, "dy"))))
    return ends.select(part, "start", "end", name, "dx", "dy")


def moved_phrase(name: Column, dx: Column, dy: Column, least: float, more: float = 1.7) -> Column:
    """"X moved to the right and forward"; the second component must be ``more`` times as far."""
    words = direction_words([(dx, "to the right", "to the left"), (dy / more, "forward", "backward")], least)
    return F.when(words == "", F.concat(name, F.lit(" did not move"))).otherwise(F.concat_ws(" ", name, F.lit("moved"), words))


def settled(keystates: DataFrame, movement: DataFrame, part: str, order: str, moved: str, least: float) -> DataFrame:
    """Keystates moved on to the first frame, from their own on, at which the movement is ``least`` or less; where there is none they stay."""
    still = F.first(F.when(~(F.col(moved) > least), F.col(order)), ignorenulls=True).over(series.onward(Window.partitionBy(part).orderBy(order)))
    ahead = movement.select(part, order, still.alias("still_"))
    return keystates.join(ahead, [part, order], "left").select(part, order, F.coalesce("still_", order).cast("int").alias("settled"))


def relation_reasons(keystates: DataFrame, edges: DataFrame, part: str, order: str, reach: int, words: Column) -> DataFrame:
    """(part, object, frame_idx, reason): relations of the object seen in half of the ``reach`` graphs up to a keystate, and of those after it, as text."""
    own = edges.select(part, F.col("start").alias("object"), F.col(order).alias("at_"), words.alias("words_"))
    near = keystates.select(part, "object", "frame_idx").join(own, [part, "object"]).filter((F.col("at_") > F.col("frame_idx") - reach) & (F.col("at_") <= F.col("frame_idx") + reach))
    counts = near.groupBy(part, "object", "frame_idx", (F.col("at_") > F.col("frame_idx")).alias("final_"), "words_").agg(F.count("*").alias("n_"))
    text = lambda final: F.concat_ws("", F.transform(F.array_sort(F.collect_set(F.when((F.col("n_") >= reach // 2) & (F.col("final_") == final), F.col("words_")))), lambda w: F.concat(w, F.lit(","))))
    found = counts.groupBy(part, "object", "frame_idx").agg(text(False).alias("before_"), text(True).alias("after_"))
    reason = F.concat(F.lit("Object relation changes: \nInitial object relations: "), "before_", F.lit("\nFinal object relations: "), "after_", F.lit("\n"))
    return keystates.select(part, "object", "frame_idx").join(found, [part, "object", "frame_idx"]).select(part, "object", "frame_idx", reason.alias("reason"))


def turned_text(yaw: Column, least: float = 1.0) -> Column:
    """What a change of yaw (radians) is called: over ``least`` to either side, in whole degrees."""
    wrapped = F.atan2(F.sin(yaw), F.cos(yaw))
    by = F.concat(F.floor(F.abs(F.degrees(wrapped))).cast("string"), F.lit(" degrees"))
    return F.when(wrapped < -least, F.concat(F.lit("Gripper rotated right by "), by)).when(wrapped > least, F.concat(F.lit("Gripper rotated left by "), by)).otherwise("No rotation")
