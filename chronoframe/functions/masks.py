"""Run-length masks, pixel grids and connected components."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronoframe.operators.series import with_islands


def rle_encoded(bits: DataFrame, keys: list[str], order: str, bit: str) -> DataFrame:
    """(keys, counts): lengths of the runs of false, true, false ... in order, the first one 0 if the series starts true."""
    series = Window.partitionBy(*keys).orderBy(order)
    runs = with_islands(bits, F.col(bit), series).groupBy(*keys, "island", bit).agg(F.count("*").alias("n"))
    listed = runs.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("island", bit, "n"))).alias("runs"))
    counts = F.transform("runs", lambda r: r.n)
    return listed.select(*keys, F.when(F.element_at("runs", 1)[bit], F.concat(F.array(F.lit(0).cast("long")), counts)).otherwise(counts).alias("counts"))


def rle_area(counts: Column) -> Column:
    """Pixels set: the sum of the runs at odd places."""
    return F.aggregate(F.filter(counts, lambda _, i: i % 2 == 1), F.lit(0).cast("long"), lambda a, n: a + n)


def rle_decoded(counts: Column) -> Column:
    """The mask as an array of 0 and 1."""
    return F.flatten(F.transform(counts, lambda n, i: F.array_repeat(i % 2, n.cast("int"))))


def point_grids(spark: SparkSession, per_side: int, layers: int, scale: int) -> DataFrame:
    """(layer, x, y): evenly spaced points of the unit square, fewer on each layer."""
    sides = spark.createDataFrame([(k, per_side // scale**k) for k in range(layers)], "layer int, n int")
    rows = sides.select("layer", "n", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i"))
    rows = rows.select("layer", "n", "i", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("j"))
    return rows.select("layer", ((F.col("i") + 0.5) / F.col("n")).alias("x"), ((F.col("j") + 0.5) / F.col("n")).alias("y"))


def crop_boxes(width: int, height: int, layers: int, overlap: float) -> list[tuple[int, int, int, int, int]]:
    """(layer, x1, y1, x2, y2) of overlapping tiles, 2 ** layer to a side, and the whole image on layer 0."""
    out = [(0, 0, 0, width, height)]
    for layer in range(1, layers + 1):
        n = 2**layer
        shared = int(overlap * min(width, height) * (2 / n))
        w, h = (int(np.ceil((shared * (n - 1) + side) / n)) for side in (width, height))
        for i in range(n):
            for j in range(n):
                x, y = i * (w - shared), j * (h - shared)
                out.append((layer, x, y, min(x + w, width), min(y + h, height)))
    return out


def components(mask: np.ndarray) -> np.ndarray:
    """Labels from 1 of the 8-connected components of a small mask; 0 outside."""
    label = np.zeros(mask.shape, int)
    number = 0
    for start in zip(*np.nonzero(mask), strict=True):
        if label[start]:
            continue
        number += 1
        label[start] = number
        todo = [start]
        while todo:
            y, x = todo.pop()
            for v in range(max(y - 1, 0), min(y + 2, mask.shape[0])):
                for u in range(max(x - 1, 0), min(x + 2, mask.shape[1])):
                    if mask[v, u] and not label[v, u]:
                        label[v, u] = number
                        todo.append((v, u))
    return label


def without_small_regions(mask: np.ndarray, least: int) -> np.ndarray:
    """The mask without islands of fewer than ``least`` pixels; the largest stays if all are small."""
    label = components(mask)
    size = np.bincount(label.ravel())
    size[0] = 0
    keep = np.flatnonzero(size >= least)
    if not len(keep) and len(size) > 1:
        keep = np.array([size.argmax()])
    return np.isin(label, keep) & (label > 0)


def rle_box(counts: Column, height: int) -> Column:
    """struct(x1, y1, x2, y2) of the pixels set in a mask that runs column after column; all 0 for none."""
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit(False).alias("on"), F.expr("cast(array() as array<struct<s: bigint, e: bigint>>)").alias("runs"))
    runs = F.aggregate(
        counts,
        start,
        lambda a, n: F.struct((a.at + n).alias("at"), (~a.on).alias("on"), F.when(a.on & (n > 0), F.concat(a.runs, F.array(F.struct(a.at.alias("s"), (a.at + n - 1).alias("e"))))).otherwise(a.runs).alias("runs")),
        lambda a: a.runs,
    )
    column, row = lambda p: F.floor(p / height), lambda p: p % height
    over = lambda r: column(r.s) < column(r.e)  # noqa: E731 - a run that goes on in the next column has pixels in the last and the first row
    least = lambda f: F.coalesce(F.array_min(F.transform(runs, f)), F.lit(0).cast("long"))
    most = lambda f: F.coalesce(F.array_max(F.transform(runs, f)), F.lit(0).cast("long"))
    return F.struct(
        least(lambda r: column(r.s)).alias("x1"),
        least(lambda r: F.when(over(r), F.lit(0).cast("long")).otherwise(row(r.s))).alias("y1"),
        most(lambda r: column(r.e)).alias("x2"),
        most(lambda r: F.when(over(r), F.lit(height - 1).cast("long")).otherwise(row(r.e))).alias("y2"),
    )


def stability(df: DataFrame, keys: list[str], value: str, threshold: float, offset: float) -> DataFrame:
    """(keys, stability): pixels above threshold + offset as a share of those above threshold - offset; null for none."""
    above = lambda limit: F.count(F.when(F.col(value) > limit, 1))
    return df.groupBy(*keys).agg(F.try_divide(above(threshold + offset), above(threshold - offset)).alias("stability"))


def agreement(df: DataFrame, keys: list[str], held: Column, share: float) -> DataFrame:
    """(keys, agreed): whether more than this share of the masks hold the pixel."""
    return df.groupBy(*keys).agg((F.avg(held.cast("int")) > share).alias("agreed"))


def set_iou(a: Column, b: Column) -> Column:
    """Overlap of two masks given as arrays of their pixels; 0 where both are empty."""
    both = F.size(F.array_intersect(a, b))
    return F.coalesce(F.try_divide(both, F.size(a) + F.size(b) - both), F.lit(0.0))
