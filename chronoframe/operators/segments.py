"""Segments matched in their order, the best group of proposals, the gripper's place in its mask."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoframe.operators.detections import nms, overlaps


def first_matches(ours: DataFrame, news: DataFrame, group: list[str], id_: str, least: float) -> DataFrame:
    """(group, ours, news, outcome): new segments, in the order of their ids, each take the first of ours with an IoU above ``least`` that none has taken.

    The rest are ``unmatched`` (ours) or ``new``. Only overlapping pairs of a group (a frame's) meet, and they are walked in the JVM. Ids are unique in their group.
    """
    box = [*group, id_, "x1", "y1", "x2", "y2"]
    pairs = overlaps(ours.select(*box), news.select(*box), group).filter(F.col("iou") > least)
    pair = F.struct(F.col(f"r_{id_}").alias("news"), F.col(id_).alias("ours"))
    listed = pairs.groupBy(*group).agg(F.sort_array(F.collect_list(pair)).alias("pairs_"))
    free = lambda kept, p: ~F.exists(kept, lambda k: (k.news == p.news) | (k.ours == p.ours))
    none = F.filter("pairs_", lambda p: F.lit(False))
    kept = F.aggregate("pairs_", none, lambda kept, p: F.when(free(kept, p), F.concat(kept, F.array(p))).otherwise(kept))
    found = listed.select(*group, F.explode(kept).alias("k_")).select(*group, F.col("k_.ours").alias("ours"), F.col("k_.news").alias("news"))
    lone = lambda df, name: df.select(*group, F.col(id_).alias("id_")).join(found.select(*group, F.col(name).alias("id_")), [*group, "id_"], "left_anti")
    kind = ours.schema[id_].dataType
    left = lone(ours, "ours").select(*group, F.col("id_").alias("ours"), F.lit(None).cast(kind).alias("news"), F.lit("unmatched").alias("outcome"))
    new = lone(news, "news").select(*group, F.lit(None).cast(kind).alias("ours"), F.col("id_").alias("news"), F.lit("new").alias("outcome"))
    return found.withColumn("outcome", F.lit("matched")).unionByName(left).unionByName(new)


def best_group(proposals: DataFrame, part: list[str], group: str, id_: str, threshold: float) -> DataFrame:
    """(part, group): the group of each part whose proposals, after suppression, have the greatest sum of scores (to six places); the first on ties."""
    kept = nms(proposals, [*part, group], id_, threshold)
    sums = kept.groupBy(*part, group).agg(F.round(F.sum("score"), 6).alias("total_"))
    return sums.groupBy(*part).agg(F.max(F.struct("total_", (-F.col(group)).alias("n_"))).alias("b_")).select(*part, (-F.col("b_.n_")).alias(group))


def gripper_places(pixels: DataFrame, keys: list[str], gripper: Column, height: int, width: int) -> DataFrame:
    """(keys, x, y): the gripper's pixel with the greatest x + y (the first row by row), less 1/16 and 1/24 of the height; of an empty mask, the picture's first pixel.

    A pixel's number is counted in rows of ``width`` and cut into rows of ``height``, as the lists of labels that exist have it; both are equal in a square picture.
    """
    place = F.col("y") * width + F.col("x")
    best = pixels.groupBy(*keys).agg(F.max(F.when(gripper, F.struct((F.col("x") + F.col("y")).alias("w"), (-place).alias("n")))).alias("b_"))
    number = F.coalesce(-F.col("b_.n"), F.lit(0))
    return best.select(*keys, (number % height - height / 16).alias("x"), (F.floor(number / height) - height / 24).alias("y"))
