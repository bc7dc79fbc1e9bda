"""Quadrilaterals against all choices of four corners, planted shapes and plain areas."""

from __future__ import annotations

import itertools
import random

import numpy as np
import pytest

from chronoframe.functions import polygons as pg
from chronoframe.operators.hulls import extreme
from chronoframe.operators.quads import fitted_quads


def cloud(seed: int, n: int = 60) -> np.ndarray:
    chosen = random.Random(seed)
    return np.array([(chosen.gauss(0, 5) + chosen.random(), chosen.gauss(3, 2)) for _ in range(n)])


@pytest.mark.parametrize("seed", range(12))
def test_best_four_beat_all_others(seed):
    p = cloud(seed)
    hull = p[extreme(p)]
    every = max(pg.polygon_iou(hull[list(c)], hull) for c in itertools.combinations(range(len(hull)), 4))
    best, fitted, around = pg.quadrilaterals(hull)
    assert pg.polygon_iou(best, hull) == pytest.approx(every, rel=1e-9)
    # A shade outside, for the corners are solved for.
    wide = around.mean(axis=0) + (around - around.mean(axis=0)) * (1 + 1e-6)
    assert abs(pg.signed_area(pg.clipped(hull, wide))) == pytest.approx(abs(pg.signed_area(hull)), rel=1e-9)
    assert 0 < pg.polygon_iou(fitted, hull) <= 1 + 1e-9


def test_areas_and_overlaps():
    square = np.array([(0, 0), (2, 0), (2, 2), (0, 2)], float)
    assert pg.signed_area(square) == 4
    assert pg.polygon_iou(square, square + 1) == pytest.approx(1 / 7)
    assert pg.polygon_iou(square, square + 5) == 0
    assert pg.polygon_iou(square, square / 2) == pytest.approx(1 / 4)


def test_fitted_line_has_the_least_sum_of_distances():
    chosen = random.Random(5)
    points = np.array([(k, 0.5 * k + chosen.gauss(0, 0.2)) for k in range(12)] + [(6, 20)])
    line = pg.fitted_line(points, np.array([0.0, 1.0, 0.0]))
    cost = lambda n, d: np.abs(points @ n - d).sum()
    for turn in np.linspace(0, np.pi, 721):
        n = np.array([np.cos(turn), np.sin(turn)])
        # The best offset of a direction is the median.
        assert cost(line[:2], line[2]) <= cost(n, np.median(points @ n)) + 1e-9


def test_groups_of_a_cut_rectangle_flat_and_odd_clouds(spark):
    """A quadrilateral is found again from its points, nearly so with cut corners; flat clouds, triangles and rows without a place have no row."""
    cut = [(0.1, 0), (9.9, 0), (10, 0.1), (10, 4.9), (9.9, 5), (0.1, 5), (0, 4.9), (0, 0.1)]
    skew = [(0, 0), (10, 1), (9, 6), (1, 5)]
    inner = [(1 + 8 * ((k * 37) % 97) / 97, 1 + 3 * ((k * 11) % 89) / 89) for k in range(400)]
    rows = [(1, float(x), float(y)) for x, y in cut + inner] + [(4, float(x), float(y)) for x, y in skew + inner] + [(2, float(k), 2.0 * k) for k in range(50)] + [(3, 0.0, 0.0), (3, 1.0, 0.0), (3, 0.0, 1.0), (3, 0.2, 0.2)]
    rows += [(1, None, 1.0), (1, float("nan"), 1.0), (1, float("inf"), 1.0), (None, 0.0, 0.0), (None, 1.0, 0.0), (None, 1.0, 1.0), (None, 0.0, 1.0)]
    df = spark.createDataFrame(rows, "g int, x double, y double").repartition(3)
    found = {r.g: r for r in fitted_quads(df, ["g"]).collect()}
    assert set(found) == {1, 4, None}
    assert all(np.allclose(part, skew) for part in (found[4].best, found[4].fitted, found[4].around))
    assert found[1].fitted_iou > 0.97 and found[1].best_iou > 0.97
    around = np.array(found[1].around)
    assert abs(pg.signed_area(pg.clipped(np.array(cut, float), around + (around - around.mean(axis=0)) * 1e-6))) == pytest.approx(49.98)
    assert found[None].best_iou == pytest.approx(1) and np.allclose(found[None].fitted, [(0, 0), (1, 0), (1, 1), (0, 1)])
    assert fitted_quads(df.limit(0), ["g"]).count() == 0
