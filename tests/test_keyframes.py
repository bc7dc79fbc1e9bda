"""Key frames and position-based movements against plain versions."""

from __future__ import annotations

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from chronoframe.operators import jumps, keyframes
from chronoframe.plans import catalogue


def plain_goals(v: np.ndarray, least: int) -> list[int]:
    goal, found = len(v) - 1, [len(v) - 1]
    while goal > least:
        n = goal + 1
        i = np.arange(n)
        k = np.exp(-0.08 * (i[:, None] - i[None]) ** 2)
        d = k @ np.linalg.solve(k + np.eye(n), np.linalg.norm(v[:n] - v[goal], axis=1))
        tops = [e for e in range(1, n - 1) if d[e] > d[e - 1] and d[e] > d[e + 1] and goal - e > least]
        if not tops:
            break
        goal = tops[-1] - 1
        found.append(goal)
    return found[::-1]


@pytest.mark.parametrize(("n", "least"), [(1, 20), (21, 20), (90, 20), (400, 20), (1500, 3)])
def test_goals_equal_plain_version(n, least):
    chosen = np.random.default_rng(n)
    v = np.cumsum(chosen.normal(size=(n, 6)), axis=0)
    assert [g for g, _ in keyframes.goals(v, least)][::-1] == plain_goals(v, least)


def test_goals_where_nothing_turns():
    # The smoothing bends the ends of a straight way: a maximum at its beginning, found by the plain version too.
    way = np.arange(1200.0)[:, None]
    assert [g for g, _ in keyframes.goals(way)][::-1] == plain_goals(way, 20)
    assert [g for g, _ in keyframes.goals(np.zeros((50, 2)))] == [49]


def test_smoothing_is_the_ridge_regression():
    for n in (1, 2, 50, 700):
        d = np.random.default_rng(n).normal(size=n)
        i = np.arange(n)
        k = np.exp(-0.08 * (i[:, None] - i[None]) ** 2)
        assert np.allclose(keyframes.smoothed(d), k @ np.linalg.solve(k + np.eye(n), d), atol=1e-11)


def test_key_frames(spark):
    chosen = np.random.default_rng(3)
    v = {e: np.cumsum(chosen.normal(size=(150, 4)), axis=0) for e in "ab"}
    rows = [(e, f, x.tolist()) for e in v for f, x in enumerate(v[e])] + [("a", 200, None), ("a", 201, []), ("b", -1, [1.0]), ("b", 300, [math.nan] * 4), (None, 1, [1.0] * 4), ("c", 5, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "e string, f long, v array<double>").repartition(4)
    found = keyframes.key_frames(df, "e", "f", "v").orderBy("e", "f").collect()
    for e in v:
        assert [r.f for r in found if r.e == e] == plain_goals(v[e], 20)
    assert [(r.f, r.goal) for r in found if r.e == "c"] == [(5, 0)]
    assert keyframes.key_frames(df.limit(0), "e", "f", "v").count() == 0


def test_key_frames_query(spark, small):
    found = catalogue.QUERIES["key_frames"](spark, small).orderBy("episode", "frame").collect()
    table = spark.read.parquet(f"{small}/embeddings.parquet").orderBy("vec_id").collect()
    for e in {r.vec_id // 100 for r in table}:
        own = [r for r in table if r.vec_id // 100 == e]
        told = plain_goals(np.array([r.embedding for r in own], float), 20)
        assert [r.frame for r in found if r.episode == e] == [own[g].vec_id % 100 for g in told]


def plain_jumps(track: pd.DataFrame, scale: float) -> list[int]:
    area = track.area.to_numpy(float)
    with np.errstate(all="ignore"):
        change = np.abs(np.append(area[1:] / area[:-1], 1) - 1) > 0.1
    p = track[["x", "y"]].astype(float).copy()
    p[change | (area < 0.5 * area.mean())] = np.nan
    p = p.interpolate(method="linear", axis=0).bfill().to_numpy()
    if np.isnan(p).any():
        return []
    s = p.copy()
    s[1:-1] = (p[:-2] + p[1:-1] + p[2:]) / 3
    diff = np.linalg.norm(np.diff(s, axis=0), axis=1)
    last, skip, out = s[0], 0, []
    boxes = track[["x1", "y1", "x2", "y2"]].to_numpy(float)
    for i in range(len(s)):
        if skip > 0:
            skip -= 1
            continue
        if np.linalg.norm(s[i] - last) > 0.07 * scale:
            still = np.flatnonzero(diff[i:] < 0.02 * scale)
            n = int(still[0]) if len(still) else len(diff) - i
            last = s[i + n]
            a, b = boxes[i], boxes[i + n]
            both = max(0, min(a[2], b[2]) - max(a[0], b[0])) * max(0, min(a[3], b[3]) - max(a[1], b[1]))
            if both / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - both) > 0.5:
                continue
            out.append(int(track.f.iloc[i + n]))
            skip = n
    return out


def test_jumps_equal_plain_version(spark):
    chosen, rows = random.Random(4), []
    for o in range(30):
        x, y, size, still = chosen.uniform(0, 100), chosen.uniform(0, 100), 10.0, 0
        for f in range(chosen.choice([1, 2, 3, 60])):
            still = still - 1 if still > 0 else chosen.choice([0, 0, 4])
            if not still:
                x, y = x + chosen.gauss(0, 15), y + chosen.gauss(0, 15)
            area = 0.0 if chosen.random() < 0.05 else size * size * chosen.choice([1, 1, 1, 1.05, 1.3, 0.3])
            rows.append((o, f * 2, x, y, area, x - 5, y - 5, x + 5, y + 5))
    names = ["o", "f", "x", "y", "area", "x1", "y1", "x2", "y2"]
    df = spark.createDataFrame(rows, "o long, f long, x double, y double, area double, x1 double, y1 double, x2 double, y2 double").repartition(3)
    found = sorted(tuple(r) for r in jumps.position_jumps(df, ["o"], "f", "x", "y", "area", F.lit(100.0)).collect())
    told = sorted((o, f) for o, track in pd.DataFrame(rows, columns=names).groupby("o") for f in plain_jumps(track, 100.0))
    assert found == told and len(told) > 40


def test_merging(spark):
    found = spark.createDataFrame([(1, 10), (1, 12), (1, 40), (2, 5), (4, 3)], "o int, f long")
    flow = spark.createDataFrame([(1, 11, 1.0), (1, 30, 2.0), (3, 7, 0.5), (4, 20, 1.0)], "o int, f long, s double")
    merged = jumps.merged_keystates(found, flow, ["o"], "f", "s")
    assert sorted((r.o, r.f, round(r.s, 6)) for r in merged.collect()) == [(1, 10, 1.4), (1, 11, 1.8), (1, 35, 2.4), (2, 5, 0.3), (3, 7, 0.5), (4, 3, 0.3)]
