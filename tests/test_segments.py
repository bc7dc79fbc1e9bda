"""Segments in order, the gripper's camera and fixed boxes on small planted cases."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoframe.functions.grippers import gripper_view, handle_place
from chronoframe.operators import segments
from chronoframe.operators.fixed import fixed_boxes


def test_first_match_is_not_the_best_match(spark):
    box = "g int, id long, x1 double, y1 double, x2 double, y2 double"
    ours = spark.createDataFrame([(1, 1, 0.0, 0.0, 10.0, 10.0), (1, 2, 0.0, 0.0, 9.0, 10.0), (1, 3, 50.0, 50.0, 60.0, 60.0), (2, 9, 0.0, 0.0, 1.0, 1.0)], box)
    news = spark.createDataFrame([(1, 11, 0.0, 0.0, 9.0, 10.0), (1, 12, 0.0, 0.0, 10.0, 10.0), (1, 13, 0.0, 0.0, 9.5, 10.0), (3, 14, 0.0, 0.0, 1.0, 1.0)], box)
    found = {tuple(r) for r in segments.first_matches(ours, news, ["g"], "id", 0.5).collect()}
    assert found == {(1, 1, 11, "matched"), (1, 2, 12, "matched"), (1, None, 13, "new"), (1, 3, None, "unmatched"), (2, 9, None, "unmatched"), (3, None, 14, "new")}
    assert segments.first_matches(ours.limit(0), news, ["g"], "id", 0.5).count() == 4


def turned(turn):
    (cr, cp, cw), (sr, sp, sw) = np.cos(turn), np.sin(turn)
    x = np.array([[1, 0, 0], [0, cr, -sr], [0, sr, cr]])
    y = np.array([[cp, 0, sp], [0, 1, 0], [-sp, 0, cp]])
    z = np.array([[cw, -sw, 0], [sw, cw, 0], [0, 0, 1]])
    return z @ y @ x


def look_at(eye, target, up):
    """The view of an eye towards a target, from its axes."""
    forward = (target - eye) / np.linalg.norm(target - eye)
    side = np.cross(forward, up)
    side = side / np.linalg.norm(side)
    axes = np.stack([side, np.cross(side, forward), -forward])
    return np.block([[axes, (-axes @ eye)[:, None]], [np.zeros((1, 3)), np.ones((1, 1))]])


def test_view_of_the_grippers_camera_equals_look_at(spark):
    place, turn = np.array([0.3, -0.2, 0.9]), np.array([0.4, -1.1, 2.3])
    offset, mount = np.array([0.1, 0.02, -0.1]), turned(np.array([0.2, 0.7, -0.5]))
    camera = turned(turn) @ mount
    eye = place + turned(turn) @ offset
    lits = [tuple(map(F.lit, v.tolist())) for v in (place, turn)]
    row = spark.range(1).select(F.array(*gripper_view(*lits, tuple(offset.tolist()), tuple(map(tuple, mount.tolist())))).alias("v"), F.array(*handle_place(*lits)).alias("h")).first()
    assert np.allclose(np.array(row.v).reshape(4, 4).T, look_at(eye, eye + camera[:, 1], -camera[:, 2]))
    up = turned(turn).T @ np.array([0, 0, 1])
    assert np.allclose(row.h, place - 0.08 * up / np.linalg.norm(up))


def test_fixed_boxes_of_odd_series(spark):
    """No score: no row; all too large: zeros; all alike: the first; no cluster: the first that is left; a drawer takes in what overlaps it."""
    rows = [("none", 0, 0.0, 0.0, 1.0, 1.0, None), ("none", 1, None, 0.0, 1.0, 1.0, 0.5)]
    rows += [("large", k, 0.0, 0.0, 100.0, 90.0 + k, 0.5) for k in range(3)]
    rows += [("alike", k, float(10 - k), 0.0, float(12 - k), 2.0, 0.1 * (k + 1)) for k in range(3)]
    rows += [("apart", k, 30.0 * k, 0.0, 30.0 * k + 2 + k, 2.0, 0.2 + 0.1 * k) for k in range(3)]
    two = [(0.0, 12.0, 0.9)] * 4 + [(6.0, 17.0, 0.6)] * 3 + [(60.0, 70.0, 0.5)] * 2
    rows += [(name, k, x, 0.0, y, 10.0 + 0.1 * (k % 2), s) for name in ("drawer", "door") for k, (x, y, s) in enumerate(two)]
    df = spark.createDataFrame(rows, "o string, at int, x1 double, y1 double, x2 double, y2 double, score double").repartition(3)
    found = {r.o: tuple(r)[1:] for r in fixed_boxes(df, ["o"], "at", "score", 100.0, 10_000.0, F.col("o") == "drawer").collect()}
    assert set(found) == {"large", "alike", "apart", "drawer", "door"}
    assert found["large"] == (0.0, 0.0, 0.0, 0.0, 0.0)
    assert found["alike"] == (10.0, 0.0, 12.0, 2.0, 0.1) and found["apart"] == (0.0, 0.0, 2.0, 2.0, 0.2)
    assert found["door"] == (0.0, 0.0, 12.0, 10.0, pytest.approx(0.9)) and found["drawer"] == (0.0, 0.0, 17.0, 10.0, pytest.approx(0.9))
