"""Key frames by embedding goals: walking back from a part's end, each goal is where the way to the one after it turns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Width and ridge of the smoothing kernel exp(-GAMMA (i - j) ** 2), and the least distance of two goals in frames.
GAMMA, RIDGE, LEAST = 0.08, 1.0, 20
#: Frames beyond which the kernel is nothing, and beyond which one frame has no bearing on another's smoothed value, in double precision.
REACH, MARGIN = 23, 80
_KERNEL = np.exp(-GAMMA * np.arange(-REACH, REACH + 1.0) ** 2)


def smoothed(values: np.ndarray) -> np.ndarray:
    """Kernel ridge regression of a series on its frame numbers: K (K + ridge)^-1 values.

    The kernel dies away within REACH frames, so a product with it is a short convolution, and conjugate gradients, whose
    matrix has a condition number under 8 at every length, end after some tens of those.
    """
    product = lambda v: np.convolve(v, _KERNEL)[REACH : REACH + len(v)]
    weights, rest = np.zeros(len(values)), values.astype(np.float64)
    way, size = rest.copy(), float(rest @ rest)
    floor = size * 1e-30
    for _ in range(200):
        if size <= floor:
            break
        ahead = product(way) + RIDGE * way
        step = size / float(way @ ahead)
        weights += step * way
        rest = rest - step * ahead
        size, before = float(rest @ rest), size
        way = rest + (size / before) * way
    return product(weights)


def goals(embeddings: np.ndarray, least: int = LEAST) -> list[tuple[int, float]]:
    """(frame, smoothed distance to the goal after it) of each goal, from the last frame on backwards.

    The next goal is the frame before the last strict maximum of the smoothed distance to the present one that is more than
    ``least`` frames before it. Only as much of the past is smoothed as the search needs: a maximum more than MARGIN frames from where the
    past is cut is what it would be with all of it.
    """
    goal = len(embeddings) - 1
    found = [(goal, 0.0)]
    while goal > least:
        reach = 512
        while True:
            start = max(0, goal + 1 - reach)
            d = smoothed(np.linalg.norm(embeddings[start : goal + 1] - embeddings[goal], axis=1))
            tops = np.flatnonzero((d[1:-1] > d[:-2]) & (d[1:-1] > d[2:])) + 1
            tops = tops[(goal - (tops + start) > least) & ((tops > MARGIN) | (start == 0))]
            if len(tops) or start == 0:
                break
            reach *= 2
        if not len(tops):
            break
        goal = int(tops[-1]) + start - 1
        found.append((goal, float(d[tops[-1] - 1])))
    return found


def key_frames(frames: DataFrame, part: str, order: str, embedding: str, least: int = LEAST) -> DataFrame:
    """(part, order, goal, distance) of each part's goals in order; the last one is its last frame.

    Frames without a sound embedding (null, empty, with a null or non-finite component, or of another length than the part's
    last one has) are left out, and frames count without them. A part's embeddings are one task's; parts are independent.
    """
    sound = F.forall(embedding, lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < float("inf")))
    kept = frames.filter(F.col(part).isNotNull() & F.col(order).isNotNull() & (F.size(embedding) > 0) & sound)
    kept = kept.select(F.col(part).alias("part_"), F.col(order).alias("order_"), F.col(embedding).cast("array<double>").alias("v_"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(batches).sort_by("order_").combine_chunks()
        lists = rows.column("v_").combine_chunks()
        size = lists.value_lengths().to_numpy()
        rows, width = rows.filter(pa.array(size == size[-1])), int(size[-1])
        v = rows.column("v_").combine_chunks().flatten().to_numpy().reshape(-1, width)
        found = goals(v, least)[::-1]
        at = rows.take(pa.array([f for f, _ in found]))
        columns = [at.column("part_").combine_chunks(), at.column("order_").combine_chunks(), pa.array(range(len(found)), pa.int32()), pa.array([d for _, d in found])]
        yield pa.RecordBatch.from_arrays(columns, names=["part_", "order_", "goal", "distance"])

    kind = lambda c: kept.schema[c].dataType.simpleString()
    out = kept.groupBy("part_").applyInArrow(run, f"part_ {kind('part_')}, order_ {kind('order_')}, goal int, distance double")
    return out.withColumnsRenamed({"part_": part, "order_": order})
