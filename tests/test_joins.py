"""Interval joins, hulls and nearest points against plain versions."""

from __future__ import annotations

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoframe.operators import hulls, intervals, neighbours


def spans(seed: int, n: int, longest: int, whole: bool = True) -> list[tuple]:
    chosen = random.Random(seed)
    out = []
    for i in range(n):
        start = chosen.randrange(-3000, 3000)
        end = start + int(longest ** chosen.random()) - 1
        out.append((i, chosen.choice("ab"), start, end) if whole else (i, chosen.choice("ab"), start / 7, end / 7))
    kind = int if whole else float
    return [*out, (n, None, kind(0), kind(5)), (n + 1, "a", None, kind(5)), (n + 2, "b", kind(5), None), (n + 3, "a", kind(9), kind(3))]


@pytest.mark.parametrize(("whole", "width"), [(True, 256), (True, 8), (False, 256), (False, 8)])
def test_overlaps_equal_all_pairs(spark, whole, width):
    kind = "long" if whole else "double"
    left, right = spans(1, 150, 5000, whole), spans(2, 150, 600, whole)
    a = spark.createDataFrame(left, f"i long, k string, s {kind}, e {kind}").repartition(3)
    b = spark.createDataFrame(right, f"j long, k string, p {kind}, q {kind}").repartition(3)
    found = sorted((r.i, r.j) for r in intervals.overlap_join(a, b, ["k"], ("s", "e"), ("p", "q"), width).collect())
    sound = lambda r: None not in r and r[2] <= r[3]
    told = sorted((x[0], y[0]) for x in left for y in right if sound(x) and sound(y) and x[1] == y[1] and x[2] <= y[3] and y[2] <= x[3])
    assert found == told and len(told) > 500


def test_points_in_intervals_of_one_long_part(spark):
    frames = spark.range(100_000).select(F.lit(1).alias("k"), F.col("id").alias("frame"))
    runs = spark.range(20_000).select(F.lit(1).alias("k"), (F.col("id") * 5).alias("s"), (F.col("id") * 5 + 3).alias("e"), F.col("id").alias("run"))
    met = intervals.overlap_join(runs, frames, ["k"], ("s", "e"), ("frame", "frame"))
    assert met.groupBy("run").count().agg(F.min("count"), F.max("count"), F.count("*")).first()[:] == (4, 4, 20_000)


def test_overlaps_of_nothing_and_clashing_names(spark):
    a = spark.createDataFrame([], "k string, s long, e long")
    b = spark.createDataFrame([("x", 1, 2)], "k string, p long, q long")
    assert intervals.overlap_join(a, b, ["k"], ("s", "e"), ("p", "q")).count() == 0
    with pytest.raises(ValueError):
        intervals.overlap_join(a, a, ["k"], ("s", "e"), ("s", "e"))


def clouds(seed: int, n: int, dims: int) -> list[tuple]:
    chosen = random.Random(seed)
    out = []
    for g, name in ((1, "a"), (1, "b"), (1, "c"), (2, "a"), (2, "b")):
        middle = [chosen.uniform(-20, 20) for _ in range(dims)]
        for _ in range(n):
            out.append((g, name, *(m + chosen.gauss(0, 4) for m in middle)))
    return out + out[::7]


@pytest.mark.parametrize(("dims", "n"), [(2, 150), (3, 150), (3, 4)])
def test_nearest_points(spark, dims, n):
    axes = ("x", "y", "z")[:dims]
    rows = clouds(dims, n, dims)
    df = spark.createDataFrame(rows, "g int, o string, " + ", ".join(f"{c} double" for c in axes)).repartition(3)
    told, least = {}, {}
    for p in rows:
        for other in {r[1] for r in rows if r[0] == p[0]} - {p[1]}:
            d = min(math.dist(p[2:], q[2:]) for q in rows if q[:2] == (p[0], other))
            told[(*p[:2], other, *p[2:])] = (rows.count(p), pytest.approx(d, abs=1e-9))
            least[p[0], p[1], other] = min(d, least.get((p[0], p[1], other), d))
    found = {(r.g, r.a, r.b, *(r[c] for c in axes)): (r.w, r.gap) for r in neighbours.nearest_gaps(df, ["g"], "o", axes).collect()}
    assert found == told
    assert {(r.g, r.a, r.b): r.gap for r in neighbours.least_gaps(df, ["g"], "o", axes).collect()} == {k: pytest.approx(v, abs=1e-9) for k, v in least.items()}


def test_nearest_points_of_large_clouds_meet_few(spark):
    rows = spark.range(40_000).select(F.lit(1).alias("g"), (F.col("id") % 2).cast("string").alias("o"), *(F.rand(k).alias(c) for k, c in enumerate("xyz")))
    pairs = neighbours._met(rows, ["g"], "o", ("x", "y", "z"), False).count()
    assert pairs < 0.08 * 2 * 20_000**2
    assert neighbours._met(rows, ["g"], "o", ("x", "y", "z"), True).count() < pairs


def inside_plain(cloud: np.ndarray, p: np.ndarray) -> bool:
    """By all planes through three points with the cloud on one side."""
    found = False
    for i, j, k in itertools.combinations(range(len(cloud)), 3):
        n = np.cross(cloud[j] - cloud[i], cloud[k] - cloud[i])
        side = (cloud - cloud[i]) @ n
        if (n == 0).all() or side.min() == side.max() or (side.min() < 0 and side.max() > 0):
            continue
        found, sign = True, 1 if side.max() <= 0 else -1
        if sign * ((p - cloud[i]) @ n) > 0:
            return False
    return found


@pytest.mark.parametrize("spread", [3, 40])
def test_hull_membership(spark, spread):
    chosen = np.random.default_rng(spread)
    rows, tests = [], []
    for g in range(12):
        cloud = chosen.integers(-spread, spread + 1, (chosen.integers(1, 14), 3))
        if g % 4 == 3:
            cloud[:, 2] = cloud[:, 0] + 1
        rows += [(g, *map(float, p)) for p in cloud.tolist()]
        asked = chosen.integers(-spread, spread + 1, (30, 3))
        tests += [(g, *map(float, p), inside_plain(cloud, p)) for p in [*asked.tolist(), *cloud.tolist()]]
    rows.append((0, None, 1.0, float("nan")))
    hull = hulls.hulls(spark.createDataFrame(rows, "g int, x double, y double, z double").repartition(4), ["g"])
    asked = spark.createDataFrame(tests, "g int, x double, y double, z double, told boolean")
    found = asked.join(hull, "g", "left").withColumn("found", hulls.inside(F.col("faces"), [F.col(c) for c in "xyz"]))
    assert found.filter("found <> told").count() == 0 and found.filter("told").count() > 20


def test_hulls_of_large_clouds_and_of_the_plane(spark):
    ball = spark.range(60_000).select((F.col("id") % 2).alias("g"), *(F.randn(k).alias(c) for k, c in enumerate("xyz"))).repartition(5)
    assert hulls.extreme_points(ball, ["g"]).count() < 4000
    joined = ball.join(hulls.hulls(ball, ["g"]), "g")
    assert joined.filter(~hulls.inside(F.col("faces"), [F.col(c) for c in "xyz"])).count() == 0
    square = spark.createDataFrame([(None, float(x), float(y)) for x in range(5) for y in range(7)] + [(1, float(x), float(x)) for x in range(9)], "g int, x double, y double")
    assert {(r.x, r.y) for r in hulls.extreme_points(square.filter("g is null").coalesce(1), ["g"], ("x", "y")).collect()} == {(0, 0), (0, 6), (4, 0), (4, 6)}
    found = hulls.hulls(square, ["g"], ("x", "y")).collect()
    assert [r.g for r in found] == [None] and len(found[0].faces) == 4
    assert hulls.hulls(square.limit(0), ["g"], ("x", "y")).count() == 0
