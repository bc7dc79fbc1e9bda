"""Movement keystates from positions: a track is cleaned, its jumps are walked one after the other, and what flow tells is merged in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoframe.functions.boxes import box, iou, norm
from chronoframe.operators import series

#: Change of area and share of the mean area beyond which a place isn't trusted; a jump and a rest in shares of the picture;
#: overlap of boxes that undoes a jump; frames and scores of the merging.
CHANGE, SHARE, JUMP, REST, SAME, NEAR, MATCHED, ALONE = 0.1, 0.5, 0.07, 0.02, 0.5, 8, 0.4, 0.3


def cleaned(track: DataFrame, keys: list[str], order: str, x: str, y: str, area: str) -> DataFrame:
    """Adds ``row_`` (a place in the track, from 0) and the smoothed x_ and y_.

    Places whose area changes to the next by more than CHANGE, or is below SHARE of the track's mean, are taken from their neighbours in a straight line (at
    the ends: from the one that there is); then each but the first and last is the mean of three. Null where no place is trusted.
    """
    along = Window.partitionBy(*keys).orderBy(order)
    ahead = F.lead(area).over(along)
    jumpy = F.when(F.col(area) == 0, ahead > 0).otherwise(F.abs(ahead / F.col(area) - 1) > CHANGE)
    doubtful = F.coalesce(jumpy, F.lit(False)) | (F.col(area) < SHARE * F.avg(area).over(Window.partitionBy(*keys)))
    rows = track.withColumn("row_", F.row_number().over(along) - 1).withColumn("at_", F.when(~doubtful, F.struct("row_", F.col(x).alias("x"), F.col(y).alias("y"))))
    before, after = F.last("at_", ignorenulls=True).over(series.upto(along)), F.first("at_", ignorenulls=True).over(series.onward(along))
    rows = rows.withColumns({"before_": before, "after_": after})
    share = F.coalesce(F.try_divide(F.col("row_") - F.col("before_.row_"), F.col("after_.row_") - F.col("before_.row_")), F.lit(0.0))
    for c in ("x", "y"):
        low, high = F.coalesce(f"before_.{c}", f"after_.{c}"), F.coalesce(f"after_.{c}", f"before_.{c}")
        rows = rows.withColumn(f"p{c}_", low + (high - low) * share)
    mean = lambda c: (F.lag(c).over(along) + F.col(c) + F.lead(c).over(along)) / 3
    rows = rows.withColumns({"x_": F.coalesce(mean("px_"), "px_"), "y_": F.coalesce(mean("py_"), "py_")})
    return rows.drop("at_", "before_", "after_", "px_", "py_")


def position_jumps(track: DataFrame, keys: list[str], order: str, x: str, y: str, area: str, scale: Column) -> DataFrame:
    """(keys, order): where an object has come to rest after a jump, for rows with a box (x1 to y2).

    The walk begins at the first place. A place more than JUMP from the last rest is a jump; its rest is the first place from there on
    whose step to the next is below REST, else the last one. Where the boxes of jump and rest overlap by more than SAME nothing has moved but
    the last rest; else it is a keystate, and the walk goes on behind it. Rests and overlaps are column expressions; what walks
    is a row's place, its rest's and whether it counts, one track at a time.
    """
    rows = cleaned(track, keys, order, x, y, area).filter("x_ is not null and y_ is not null")
    along = Window.partitionBy(*keys).orderBy("row_")
    step = norm(F.lead("x_").over(along) - F.col("x_"), F.lead("y_").over(along) - F.col("y_"))
    rows = rows.withColumn("scale_", scale).withColumn("still_", F.when(step < REST * F.col("scale_"), F.col("row_")))
    last = F.max("row_").over(Window.partitionBy(*keys))
    rows = rows.withColumn("rest_", F.coalesce(F.first("still_", ignorenulls=True).over(series.onward(along)), last))
    ends = rows.select(*keys, F.col("row_").alias("rest_"), F.col(order).alias("order_"), F.col("x_").alias("rx_"), F.col("y_").alias("ry_"), *(F.col(c).alias(f"r_{c}") for c in ("x1", "y1", "x2", "y2")))
    same = F.coalesce(iou(box(), box("r_")) > SAME, F.lit(False))
    place = F.struct("row_", "rest_", "x_", "y_", "rx_", "ry_", (JUMP * F.col("scale_")).alias("far_"), same.alias("same_"), "order_")

    def run(track: list) -> list[int]:
        at_x, at_y, until, found = track[0]["x_"], track[0]["y_"], -1, []
        for k, p in enumerate(track):
            if p["row_"] <= until or (p["x_"] - at_x) ** 2 + (p["y_"] - at_y) ** 2 <= p["far_"] ** 2:
                continue
            at_x, at_y = p["rx_"], p["ry_"]
            if not p["same_"]:
                found.append(k)
                until = p["rest_"]
        return found

    # As many tasks as the session shuffles to: the work is in Python, however few bytes it is.
    tasks = int(track.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    walks = rows.join(ends, [*keys, "rest_"]).repartition(tasks, *keys).groupBy(*keys).agg(F.sort_array(F.collect_list(place)).alias("walk_"))
    found = walks.withColumn("at_", F.explode(F.udf(run, "array<int>", useArrow=True)("walk_")))
    return found.select(*keys, F.get("walk_", F.col("at_")).getField("order_").alias(order))


def merged_keystates(found: DataFrame, flow: DataFrame, keys: list[str], order: str, score: str) -> DataFrame:
    """(keys, order, score): position keystates with what flow tells of the same object; objects without any keep their flow keystates.

    A keystate takes the nearest flow keystate (of two the earlier) where the least of the signed distances to the object's flow keystates is below
    NEAR: it moves half way and scores MATCHED more for each keystate up to it that has taken the same one. Else it scores ALONE.
    """
    told = flow.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), F.col(score).alias("score")))).alias("flow_"))
    rows = found.select(*keys, order).join(told, keys, "left")
    gap = F.array_min(F.transform("flow_", lambda f: f.at - F.col(order)))
    nearest = F.array_min(F.transform("flow_", lambda f: F.struct(F.abs(f.at - F.col(order)).alias("gap"), f.at.alias("at"), f.score.alias("score"))))
    rows = rows.withColumn("near_", F.when(gap < NEAR, nearest))
    turn = F.row_number().over(Window.partitionBy(*keys, "near_.at").orderBy(order))
    at = F.coalesce(F.floor((F.col("near_.at") + F.col(order)) / 2), F.col(order)).cast("long")
    merged = rows.select(*keys, at.alias(order), F.coalesce(F.col("near_.score") + MATCHED * turn, F.lit(ALONE)).alias(score))
    rest = flow.join(found.select(*keys).distinct(), keys, "left_anti").select(*keys, F.col(order).cast("long").alias(order), score)
    return merged.unionByName(rest)
