"""Robust fits: planted outliers, repeatability, and every drawn model against a plain count."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoframe.operators import robust


def result(df):
    return sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def planted(spark):
    chosen, rows = np.random.default_rng(1), []
    for g in range(6):
        n = 200
        x, z = chosen.uniform(-10, 10, (2, n))
        y = 0.5 * x - 0.25 * z + g + chosen.normal(0, 0.01, n)
        bad = chosen.random(n) < 0.4
        y[bad] += chosen.uniform(3, 40, bad.sum())
        rows += [(g, *map(float, p)) for p in zip(x, y, z, strict=True)]
    rows += [(7, 1.0, 1.0, 1.0), (None, 1.0, 2.0, 3.0), (0, None, 1.0, 1.0), (0, float("nan"), 1.0, 1.0)] + [(8, float(i), float(i), float(i)) for i in range(9)]
    return spark.createDataFrame(rows, "g int, x double, y double, z double")


def test_planes_survive_outliers(planted):
    found = robust.robust_planes(planted.repartition(5), ["g"], 0.05)
    normal = np.array([-0.5, 1, 0.25]) / np.linalg.norm([-0.5, 1, 0.25])
    rows = found.collect()
    assert sorted(r.g for r in rows) == list(range(6))
    for r in rows:
        assert np.allclose([r.nx, r.ny, r.nz], normal, atol=2e-3) and abs(r.d - r.g * normal[1]) < 0.02 and 90 < r.inliers < 145 and r.n == 200
    assert result(found) == result(robust.robust_planes(planted.orderBy(F.desc("x")).coalesce(1), ["g"], 0.05))


def test_frames_stand_upright(planted):
    planes = robust.robust_planes(planted, ["g"], 0.05)
    frames = planes.withColumn("rotation", robust.upright_rotation()).collect()
    assert len(frames) == 6
    for r in frames:
        m = np.array(r.rotation)
        assert np.allclose(m @ m.T, np.eye(3), atol=1e-9) and np.linalg.det(m) == pytest.approx(1) and np.allclose(m @ [r.nx, r.ny, r.nz], [0, 1, 0], atol=1e-9)
    assert planes.filter(robust.upright_rotation(0.9).isNotNull()).count() == 0


@pytest.mark.parametrize("threshold", [0.05, None])
def test_lines_survive_outliers(spark, threshold):
    chosen, rows = np.random.default_rng(2), []
    for g in range(5):
        x = chosen.uniform(0, 100, 150)
        y = 2 * x + g + chosen.normal(0, 0.01, 150)
        bad = chosen.random(150) < 0.4
        y[bad] = chosen.uniform(-100, 300, bad.sum())
        rows += [(g, float(a), float(b)) for a, b in zip(x, y, strict=True)]
    rows += [(6, 1.0, float(i)) for i in range(5)] + [(7, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "g int, x double, y double")
    found = robust.robust_lines(df.repartition(4), ["g"], "x", "y", threshold)
    # The median distance is wide here, so it lets some outliers in.
    near = (0.01, 0.5) if threshold else (0.6, 40)
    assert all(abs(r.slope - 2) < near[0] and abs(r.intercept - r.g) < near[1] for r in found.collect())
    assert [r.g for r in found.orderBy("g").collect()] == list(range(5))
    assert result(found) == result(robust.robust_lines(df.orderBy("y").coalesce(1), ["g"], "x", "y", threshold))
    assert robust.robust_lines(df.limit(0), ["g"], "x", "y").count() == 0


def test_means_of_matrices(spark):
    chosen = np.random.default_rng(3)
    rows = [(1, *map(float, chosen.normal(v, 0.01, 4))) for v in [5.0] * 12 for _ in (0,)] + [(1, *map(float, chosen.uniform(-50, 50, 4))) for _ in range(8)] + [(2, 1.0, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "g int, a double, b double, c double, d double")
    found = robust.robust_means(df, ["g"], ["a", "b", "c", "d"], 0.2).collect()
    assert [(r.g, r.inliers, r.n) for r in found] == [(1, 12, 20)] and all(abs(found[0][c] - 5) < 0.02 for c in "abcd")


def test_best_model_is_the_best_of_all_drawn(planted):
    rows = planted.filter("g = 2")
    models = robust._models(robust._sound(rows, ["g"], ("x", "y")), ["g"], ("x", "y"), 2, 30, lambda p, q: F.when(p.x != q.x, F.struct(((q.y - p.y) / (q.x - p.x)).alias("a"), (p.y - (q.y - p.y) / (q.x - p.x) * p.x).alias("b"))))
    p = np.array([(r.x, r.y) for r in rows.collect()])
    most = max(int((np.abs(p[:, 1] - m.a * p[:, 0] - m.b) <= 0.5).sum()) for m in models.first().models)
    near = robust._agreeing(rows, models, ["g"], lambda m: F.abs(F.col("y") - m.a * F.col("x") - m.b), F.lit(0.5))
    assert near.count() == most
