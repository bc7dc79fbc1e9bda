"""One box for each object that does not move, from all the boxes that its series shows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoframe.functions.boxes import area, box, iou
from chronoframe.operators.density import density_clusters
from chronoframe.operators.tables import Tables

CORNERS = ("x1", "y1", "x2", "y2")


def fixed_boxes(detections: DataFrame, group: list[str], order: str, score: str, extent: float, picture: float, spread: Column) -> DataFrame:
    """(group, x1, y1, x2, y2, score): where each object of a series lies.

    Boxes of four fifths of the ``picture``'s area or more are left out, then those whose area is 2.5 standard deviations (of the population) or more from the mean.
    Centres are clustered within 4 % of ``extent``; a core has a sixth of the boxes (2 to 10) about it, or a seventh (2 at least) where that gives no cluster.
    The cluster with the greatest mean score plus share of the largest cluster's number is taken, on ties the one
    that begins first: its mean box in whole numbers and its mean score. Where ``spread`` holds (for the group), the means of other clusters that overlap it by more than
    0.15 widen the box. Areas all alike give the first box, no cluster the first that is left, nothing left a box of zeros. Rows without a score, a corner or a group
    don't count; an object without any other row has no row here. ``order`` is a whole number, unique in its group.
    """
    tables = Tables(detections.sparkSession, shuffled=True)
    needed = " and ".join(f"{c} is not null" for c in (*group, order, *CORNERS)) + f" and {score} is not null and not isnan({score})"
    rows = detections.filter(needed).select(*group, F.col(order).alias("at_"), *(F.col(c).cast("double").alias(c) for c in CORNERS), F.col(score).cast("double").alias("score_"), spread.alias("spread_"))
    rows = tables.keep(rows.withColumn("area_", area(box())), "rows")
    small = F.col("area_") < 0.8 * picture
    shape = rows.groupBy(*group).agg(
        F.count(F.when(small, 1)).alias("n_small"), F.min(F.when(small, F.col("area_"))).alias("lo_"), F.max(F.when(small, F.col("area_"))).alias("hi_"),
        F.avg(F.when(small, F.col("area_"))).alias("mean_"), F.stddev_pop(F.when(small, F.col("area_"))).alias("sd_"), F.max("spread_").alias("spread_"),
        F.min(F.when(small, F.struct("at_", *CORNERS, "score_"))).alias("first_"),
    )
    usual = rows.drop("spread_").filter(small).join(shape.filter("lo_ < hi_").select(*group, "mean_", "sd_", "spread_"), group)
    usual = usual.filter(F.abs(F.col("area_") - F.col("mean_")) < 2.5 * F.col("sd_")).drop("mean_", "sd_", "area_")
    usual = tables.keep(usual, "usual")
    count = usual.groupBy(*group).agg(F.count("*").alias("n_"), F.min(F.struct("at_", *CORNERS, "score_")).alias("left_"))
    # Both numbers at once, for the second is rarely of use and costs as much as the first.
    least = F.array(F.greatest(F.lit(2), F.least(F.floor(F.col("n_") / 6), F.lit(10))), F.greatest(F.lit(2), F.floor(F.col("n_") / 7)))
    tried = usual.join(count.select(*group, "n_"), group).select("*", F.posexplode(least).alias("try_", "least_"))
    middles = tried.withColumns({"mx_": (F.col("x1") + F.col("x2")) / 2, "my_": (F.col("y1") + F.col("y2")) / 2})
    found = density_clusters(middles, [*group, "try_"], "at_", ["mx_", "my_"], 0.04 * extent, "least_").filter("cluster >= 0")
    means = found.groupBy(*group, "try_", "cluster").agg(
        # Sums of the same numbers in another order differ by less than this rounding.
        *(F.round(F.avg(c), 6).cast("long").cast("double").alias(c) for c in CORNERS), F.avg("score_").alias("score"), F.count("*").alias("n"), F.max("spread_").alias("spread_"),
    )
    best_try = Window.partitionBy(*group)
    means = tables.keep(means.withColumn("used_", F.min("try_").over(best_try)).filter("try_ = used_").drop("used_", "try_"), "means")
    ranked = means.withColumn("worth_", F.round(F.col("score") + F.col("n") / F.max("n").over(best_try), 9))
    best = ranked.withColumn("rank_", F.row_number().over(best_try.orderBy(F.desc("worth_"), "cluster"))).filter("rank_ = 1").drop("rank_", "worth_", "n")
    other = means.select(*group, *(F.col(c).alias(f"r_{c}") for c in CORNERS))
    wide = best.filter("spread_").join(other, group).filter(iou(box(), box("r_")) > 0.15)
    wide = wide.groupBy(*group).agg(*(f(f"r_{c}").alias(f"w_{c}") for c, f in zip(CORNERS, (F.min, F.min, F.max, F.max), strict=True)))
    ends = [f(c, f"w_{c}").alias(c) for c, f in zip(CORNERS, (F.least, F.least, F.greatest, F.greatest), strict=True)]
    best = best.join(wide, group, "left").select(*group, F.struct(*ends, "score").alias("best_"))
    zero = F.struct(*(F.lit(0.0).alias(c) for c in CORNERS), F.lit(0.0).alias("score_"))
    plain = lambda s, p: F.struct(*(F.col(f"{s}.{c}").alias(c) for c in CORNERS), F.col(f"{s}.{p}").alias("score"))
    all_alike = F.when(F.col("lo_") == F.col("hi_"), plain("first_", "score_"))
    kept = F.when(F.col("left_").isNotNull(), plain("left_", "score_"))
    nothing = zero.cast("struct<x1:double,y1:double,x2:double,y2:double,score:double>")
    whole = shape.join(count, group, "left").join(best.hint("merge"), group, "left").withColumn("b_", F.coalesce(all_alike, "best_", kept, nothing))
    return whole.select(*group, *(F.col(f"b_.{c}").alias(c) for c in (*CORNERS, "score")))
