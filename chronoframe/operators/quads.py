"""Quadrilaterals around the clouds of many groups."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoframe.functions.polygons import polygon_iou, quadrilaterals, signed_area
from chronoframe.operators.hulls import extreme, extreme_points


def fitted_quads(points: DataFrame, group: list[str], axes: tuple[str, str] = ("x", "y")) -> DataFrame:
    """(group, best, fitted, around, best_iou, fitted_iou): quadrilaterals for the convex hull of each group's points.

    ``best`` are the four corners of the hull with the greatest IoU with it; ``fitted`` has its sides refitted to the hull's corners by the least sum of distances;
    ``around`` has those sides moved out until they hold the hull. Each is four (x, y) in the order of their angles. A hull of fewer than four corners has no row here;
    points with a null or non-finite coordinate are left out. Only extreme points are shuffled; a hull's corners meet in one task, and cost their number's square times it.
    """
    tasks = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spans = extreme_points(points, group, axes).repartition(tasks, *group).groupBy(*group).agg(F.collect_list(F.array(*axes)).alias("p_")).filter(F.size("p_") > 3)
    rows = spans.select(F.struct(*group).alias("g_"), "p_")
    kind = pa.list_(pa.list_(pa.float64()))

    def of(cloud: list) -> tuple | None:
        p = np.unique(np.array(cloud, float), axis=0)
        hull = p[extreme(p)] if len(p) > 3 else p
        if len(hull) < 4 or signed_area(hull) <= 0:
            return None
        best, fitted, around = quadrilaterals(hull)
        return best.tolist(), fitted.tolist(), around.tolist(), polygon_iou(best, hull), polygon_iou(fitted, hull)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [of(cloud) for cloud in batch.column("p_").to_pylist()]
            kept = [k for k, f in enumerate(found) if f]
            parts = list(zip(*(found[k] for k in kept), strict=True)) or [()] * 5
            arrays = [pa.array(part, kind if n < 3 else pa.float64()) for n, part in enumerate(parts)]
            yield pa.RecordBatch.from_arrays([batch.column("g_").take(pa.array(kept, pa.int64())), *arrays], names=["g_", "best", "fitted", "around", "best_iou", "fitted_iou"])

    corners = "array<array<double>>"
    schema = f"g_ {rows.schema['g_'].dataType.simpleString()}, best {corners}, fitted {corners}, around {corners}, best_iou double, fitted_iou double"
    return rows.mapInArrow(run, schema).select("g_.*", "best", "fitted", "around", "best_iou", "fitted_iou")
