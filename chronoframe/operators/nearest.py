"""Joins of series by nearness in order: bands, before and after, nearest with tolerance."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def banded(df: DataFrame, part: list[str], order: str, reach: int, right: DataFrame, right_order: str) -> DataFrame:
    """Pairs of rows with equal keys ``part`` whose orders differ by at most ``reach``.

    Rows are joined on buckets of the band's width, the left ones also on the buckets beside their
    own, so that a long part does not pair all its rows.
    """
    size = max(1, reach)
    bucket = F.floor(F.col(order) / F.lit(size))
    left = df.withColumn("bucket_", F.explode(F.array(bucket - 1, bucket, bucket + 1)))
    other = right.withColumn("bucket_", F.floor(F.col(right_order) / F.lit(size)))
    return left.join(other, [*part, "bucket_"]).filter(F.abs(F.col(order) - F.col(right_order)) <= reach).drop("bucket_")


def gaussian_vote(df: DataFrame, part: str, order: str, label: str, reach: int, sigma: float) -> DataFrame:
    """The label with the most Gaussian weight within ``reach`` rows; the first by name on ties."""
    rows = df.select(part, order)
    votes = df.select(part, F.col(order).alias("voter_"), label)
    paired = banded(rows, [part], order, reach, votes, "voter_")
    gap = F.col(order) - F.col("voter_")
    weighed = paired.groupBy(part, order, label).agg(F.sum(F.exp(-(gap * gap) / F.lit(2 * sigma * sigma))).alias("weight"))
    best = Window.partitionBy(part, order).orderBy(F.round("weight", 9).desc(), label)
    return weighed.withColumn("rank_", F.row_number().over(best)).filter("rank_ = 1").drop("rank_")


def before_after_k(anchors: DataFrame, cands: DataFrame, part: str, anchor: str, cand: str, k: int) -> DataFrame:
    """The nearest candidate before each anchor, the nearest at or after it, then the nearest others, k in all.

    Candidates are numbered in their part's order, anchors by the candidates before them, so an anchor meets the k
    numbers on either side of its place and no others.
    """
    numbered = cands.select(part, cand).withColumn("number_", F.row_number().over(Window.partitionBy(part).orderBy(cand)))
    both = numbered.select(part, F.col(cand).alias("at_"), F.lit(1).alias("is_")).unionByName(anchors.select(part, F.col(anchor).alias("at_"), F.lit(0).alias("is_")))
    before = F.sum("is_").over(Window.partitionBy(part).orderBy("at_").rangeBetween(Window.unboundedPreceding, -1))
    placed = both.withColumn("before_", F.coalesce(before, F.lit(0))).filter("is_ = 0").select(part, F.col("at_").alias(anchor), "before_")
    beside = F.explode(F.sequence(F.col("before_") - (k - 1), F.col("before_") + k)).alias("number_")
    pairs = placed.select(part, anchor, "before_", beside).join(numbered, [part, "number_"])
    pairs = pairs.withColumn("d", F.abs(F.col(anchor) - F.col(cand)))
    first = F.when(F.col("number_").between(F.col("before_"), F.col("before_") + 1), 0).otherwise(1)
    turn = F.row_number().over(Window.partitionBy(part, anchor).orderBy(first, "d", cand))
    return pairs.withColumn("turn_", turn).filter(F.col("turn_") <= k).select(part, anchor, cand, F.col("d").cast("int").alias("d"))


def nearest_within(left: DataFrame, right: DataFrame, keys: list[str], at: str, other: str, reach: int, values: list[str]) -> DataFrame:
    """Each left row with the values of the nearest right row of its keys within ``reach``, null if there is none; the earlier one on ties."""
    size = max(1, reach)
    bucket = F.floor(F.col(at) / F.lit(size))
    asked = left.withColumn("row_", F.struct(*left.columns))
    paired = asked.withColumn("bucket_", F.explode(F.array(bucket - 1, bucket, bucket + 1))).join(
        right.withColumn("bucket_", F.floor(F.col(other) / F.lit(size))), [*keys, "bucket_"]
    )
    gap = F.abs(F.col(at) - F.col(other))
    found = paired.filter(gap <= reach).groupBy(*keys, at).agg(F.min(F.struct(gap.alias("gap"), F.col(other).alias("at"), *values)).alias("near_"))
    return left.join(found, [*keys, at], "left").select(*left.columns, F.col("near_.gap").alias("gap"), *(F.col(f"near_.{v}").alias(v) for v in values))


def contacts(pixels: DataFrame, part: str, name: str, reach: int) -> DataFrame:
    """(part, a, b): objects of a part with pixels (x, y) at most ``reach`` apart on either axis."""
    own = pixels.select(part, F.col(name).alias("a"), "x", "y")
    other = pixels.select(part, F.col(name).alias("b"), F.col("x").alias("r_x"), F.col("y").alias("r_y"))
    near = banded(own, [part], "x", reach, other, "r_x").filter((F.col("a") < F.col("b")) & (F.abs(F.col("y") - F.col("r_y")) <= reach))
    return near.select(part, "a", "b").distinct()


def closest(pixels: DataFrame, keys: list[str], x: Column, y: Column) -> DataFrame:
    """(keys, x, y): the pixel of each key that is nearest to a point; the first by x and y on ties."""
    gap = (F.col("x") - x) * (F.col("x") - x) + (F.col("y") - y) * (F.col("y") - y)
    best = pixels.groupBy(*keys).agg(F.min(F.struct(gap.alias("gap"), "x", "y")).alias("b_"))
    return best.select(*keys, "b_.x", "b_.y")


def gaussian(gap: Column, sigma: float) -> Column:
    return F.exp(-(gap * gap) / F.lit(2 * sigma * sigma)) / F.lit(sigma * math.sqrt(2 * math.pi))
