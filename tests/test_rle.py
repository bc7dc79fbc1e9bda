"""Compressed run lengths and crops against plain versions."""

from __future__ import annotations

import itertools
import random

import pytest
from pyspark.sql import functions as F

from chronoframe.functions import rle


def told(counts: list[int]) -> str:
    out = ""
    for i, n in enumerate(counts):
        x = n - counts[i - 2] if i > 2 else n
        more = True
        while more:
            c = x & 31
            x >>= 5
            more = x != -1 if c & 16 else x != 0
            out += chr((c | 32 if more else c) + 48)
    return out


@pytest.fixture(scope="module")
def masks():
    chosen = random.Random(7)
    return [(0, [5]), (1, [0, 4, 1]), (2, [100000, 1, 99999, 3, 1 << 33, 2, 16, 15, 17]), (3, [])] + [(k, [int(40 ** (4 * chosen.random())) for _ in range(chosen.randrange(1, 30))]) for k in range(4, 60)]


def test_compressed_text(spark, masks):
    df = spark.createDataFrame([*masks, (99, None)], "k int, counts array<long>")
    found = df.withColumn("text", rle.compressed(F.col("counts")))
    assert {r.k: r.text for r in found.collect()} == {**{k: told(c) for k, c in masks}, 99: None}
    back = rle.decompressed(found, ["k"], "text")
    assert {r.k: r.counts for r in back.collect()} == {k: c for k, c in masks if c}


def test_crops_in_the_whole(spark):
    chosen, rows, wanted = random.Random(3), [], {}
    for k in range(60):
        h, w = chosen.randrange(1, 6), chosen.randrange(1, 6)
        height, width = h + chosen.choice([0, 0, 2]), w + chosen.choice([0, 3])
        y, x = chosen.randrange(height - h + 1), chosen.randrange(width - w + 1)
        share = chosen.choice([0, 0.3, 0.8, 1])
        crop = [[int(chosen.random() < share) for _ in range(h)] for _ in range(w)]
        whole = [[0] * height for _ in range(width)]
        for c in range(w):
            whole[x + c][y : y + h] = crop[c]
        runs = lambda columns: [len(list(g)) for v, g in itertools.groupby(sum(columns, []))]
        first = lambda columns: [0] * (columns[0][0] == 1)
        rows.append((k, first(crop) + runs(crop), x, y, x + w, y + h, width, height))
        wanted[k] = first(whole) + runs(whole)
    df = spark.createDataFrame(rows, "k int, counts array<long>, x0 int, y0 int, x1 int, y1 int, w int, h int")
    found = rle.uncropped(df, ["k"], "counts", tuple(F.col(c) for c in ("x0", "y0", "x1", "y1")), F.col("w"), F.col("h"))
    assert {r.k: r.counts for r in found.collect()} == wanted
