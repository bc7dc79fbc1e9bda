"""Findings of round 3: very many small groups, flags right on a limit, written tables in joins."""

from __future__ import annotations

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoframe.functions import polygons
from chronoframe.operators import detections as dt
from chronoframe.operators import clouds, groups, metrics, motion, segments, tables
from chronoframe.operators.tables import Tables
from chronoframe.plans import catalogue, detection


def rows_sorted(df) -> list[tuple]:
    return sorted(map(tuple, df.collect()), key=repr)


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_f2_area_on_the_limit(spark):
    """The mean is 129.8, and 110.33 is 0.85 of it: in every order of summation the doubles say less than that."""
    df = spark.createDataFrame([("a", v) for v in (147.31, 114.76, 99.88, 176.72, 110.33)], "o string, v double")
    flags = {r.v: (r.occluded, r.noise) for r in motion.occlusion(df, ["o"], "v").collect()}
    assert flags == {147.31: (False, True), 114.76: (False, False), 99.88: (True, False), 176.72: (False, True), 110.33: (False, False)}


def test_f10_locked_hits_in_batches(spark):
    """Videos without truths, with a tie and with fewer truths than predictions; no call of Python for each video and threshold."""
    preds = spark.createDataFrame([(1, 0, 10, 0.9), (1, 1, 10, 0.8), (1, 20, 30, 0.7), (2, 0, 4, 0.5), (3, 0, 10, 0.1), (3, 0, 12, 0.2)], "video long, t_start int, t_end int, score double")
    truths = spark.createDataFrame([(1, 0, 10), (1, 20, 25), (3, 0, 10), (4, 0, 1)], "video long, t_start int, t_end int")
    hits = metrics.locked_hits(truths, preds, [0.5, 0.9])
    assert "FlatMapCoGroupsInPandas" not in plan(hits)
    found = {(r.video, r.score, r.threshold) for r in hits.collect() if r.hit}
    assert hits.count() == 12 and found == {(1, 0.9, 0.5), (1, 0.9, 0.9), (1, 0.7, 0.5), (3, 0.2, 0.5), (3, 0.1, 0.9)}


def rows_of(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(1, 1, 1, 0.0, 0.0, 4.0, 4.0, 0.5), (1, 1, 2, 0.0, 0.0, 4.0, 5.0, 0.5), (1, 1, 3, 9.0, 9.0, 9.0, 9.0, 0.9), (1, 1, 4, 9.0, 9.0, 9.0, 9.0, 0.8), (1, 1, 5, nan, 0.0, 4.0, 4.0, 0.4)]
    rows += [(1, 1, 6, None, 0.0, 4.0, 4.0, 0.3), (1, 1, 7, 0.0, 0.0, inf, 4.0, 0.2), (1, 2, 8, 0.0, 0.0, 4.0, 4.0, nan), (1, 2, 9, 0.0, 0.0, 4.0, 4.0, 0.1), (1, 2, 10, 0.0, 0.0, 4.0, 4.0, None), (2, 1, 11, 0.0, 0.0, 1.0, 1.0, 0.1)]
    return spark.createDataFrame(rows, "e long, g int, id long, x1 double, y1 double, x2 double, y2 double, score double")


def test_f7_suppression_in_batches(spark):
    """Undefined boxes and scores, empty boxes, ties; no call of Python for each group."""
    kept = dt.nms(rows_of(spark), ["e", "g"], "id", 0.5)
    assert "FlatMapGroupsInPandas" not in plan(kept)
    assert {r.id for r in kept.collect()} == {1, 3, 4, 5, 6, 7, 9, 11}
    assert dt.nms(rows_of(spark).limit(0), ["e", "g"], "id", 0.5).count() == 0


def test_f4_leaders_in_batches(spark):
    found = dt.proposal_groups(rows_of(spark).filter("id in (1, 2, 8, 9, 11)"), ["e", "g"], "id", 0.5)
    assert "FlatMapGroupsInPandas" not in plan(found)
    assert {(r.leader, r.id) for r in found.collect()} == {(1, 1), (1, 2), (8, 8), (8, 9), (11, 11)}


def test_f8_best_group_in_batches(spark):
    found = segments.best_group(rows_of(spark).filter("score > 0"), ["e"], "g", "id", 0.5)
    assert "FlatMapGroupsInPandas" not in plan(found)
    assert {(r.e, r.g) for r in found.collect()} == {(1, 1), (2, 1)}


def walked(p, eps, least):
    """One group's clusters by walking from seed to seed."""
    near = np.sqrt(((p[:, None] - p[None]) ** 2).sum(axis=2)) <= eps
    dense, label = near.sum(axis=1) >= least, np.full(len(p), -1)
    for seed in range(len(p)):
        if label[seed] >= 0 or not dense[seed]:
            continue
        label[seed], todo = seed, [seed]
        while todo:
            for k in np.flatnonzero(near[todo.pop()] & (label < 0)).tolist():
                label[k] = seed
                todo += [k] * bool(dense[k])
    return [int(np.flatnonzero(label == v)[0]) if v >= 0 else -1 for v in label]


def test_f6_clusters_in_batches(spark):
    draw = np.random.default_rng(3)
    rows = [(g, 100 * g + k, *map(float, draw.integers(0, 9, 2))) for g in range(40) for k in range(1 + g % 17)] + [(99, 9900, float("nan"), 0.0), (99, 9901, 1.0, 0.0)]
    df = spark.createDataFrame(rows, "g long, id long, x double, y double")
    for eps, least in ((1.0, 2), (1.5, 3), (2.0, 5)):
        found = groups.clusters(df, ["g"], "id", ["x", "y"], eps, least)
        assert "FlatMapGroupsInPandas" not in plan(found)
        want = {}
        for g in {r[0] for r in rows}:
            own = [r for r in rows if r[0] == g]
            want |= {own[k][1]: own[f][1] if f >= 0 else -1 for k, f in enumerate(walked(np.array([r[2:] for r in own]), eps, least))}
        assert {r.id: r.cluster for r in found.collect()} == want


def test_f5_flattest_in_batches(spark, small):
    assert "FlatMapGroupsInPandas" not in plan(catalogue.QUERIES["flattest_line"](spark, small))


def test_f1_written_tables_are_not_broadcast_unasked(spark):
    """Files of numbers in order are far smaller than what a broadcast holds in the driver."""
    kept = Tables(spark, shuffled=True).keep(spark.range(1000).withColumn("v", F.col("id") % 7), "t")
    sums = kept.groupBy("v").agg(F.count("*").alias("n"))
    for joined in (spark.range(1000).join(kept, "id"), kept.join(sums, "v"), kept.join(kept.filter("v = 1").select("id"), "id", "left")):
        assert joined.count() and "BroadcastHashJoin" not in plan(joined)


def test_f11_lines_of_two_corners_without_a_search(monkeypatch):
    """A side with no corner near it but its own two has one line to choose from; pairs are only listed for more."""
    monkeypatch.setattr(np, "triu_indices", lambda *a: pytest.fail("pairs were listed"))
    line = polygons.fitted_line(np.array([[0.0, 0.0], [3.0, 4.0], [0.0, 0.0]]), np.array([1.0, 0.0, 0.0]))
    assert np.allclose(line, [0.8, -0.6, 0.0])
    square = np.array([[0.0, 0.0], [4.0, 0.0], [4.0, 4.0], [0.0, 4.0]])
    best, fitted, around = polygons.quadrilaterals(square)
    assert np.allclose(best, square) and np.allclose(fitted, square) and np.allclose(around, square) and polygons.polygon_iou(fitted, square) == 1.0


def partitions(df) -> set[int]:
    """To how many tasks the plan deals rows."""
    return {int(n) for n in re.findall(r"hashpartitioning\([^)]*?, (\d+)\)", plan(df))}


@pytest.mark.parametrize("name", ["close_objects", "proximity_contact_runs"])
def test_f9_f13_tasks_hold_as_many_rows_at_every_size(spark, small, name, monkeypatch):
    """1000 events at 100 a task: ten tasks, one shuffle to them, and nothing that Spark merges by its bytes."""
    want = rows_sorted(catalogue.QUERIES[name](spark, small))
    monkeypatch.setattr(tables, "TASK_ROWS", 100)
    found = catalogue.QUERIES[name](spark, small)
    assert partitions(found) == {10} and "ENSURE_REQUIREMENTS" not in plan(found)
    assert want and rows_sorted(found) == want


def test_f9_f13_distances_of_odd_rows(spark, tmp_path):
    """Rows without an episode or an object have no distances; other objects' distances in their frames stay."""
    rows = [(1, 1, 7, "a", 5.0, 0), (2, 2, 7, None, 5.0, 3), (3, 3, 7, "b", 5.0, 1), (4, 4, None, "a", 5.0, 1), (5, 5, None, "a", 5.0, 1), (6, 6, 7, "a", 5.0, 9)]
    df = spark.createDataFrame(rows, "event_id long, t long, user_id long, event_type string, value double, k int")
    df = df.withColumn("ts", F.timestamp_seconds("t").cast("timestamp_ntz")).withColumn("props", F.to_json(F.struct("k"))).drop("t", "k")
    df.write.parquet(str(tmp_path / "events.parquet"))
    found = {(r.episode_id, r.object, r.frame_idx) for r in detection.distances(spark, str(tmp_path)).collect()}
    assert found == {(7, "a", 1), (7, "a", 2), (7, "a", 3), (7, "b", 3)}


@pytest.mark.parametrize("name", ["trend_lines", "floor_planes"])
def test_f12_tried_models_of_as_many_rows_at_every_size(spark, small, name, monkeypatch):
    """Each row is tried with a hundred models, so tasks must not be merged by bytes; a model that was tried is not made again."""
    want = rows_sorted(catalogue.QUERIES[name](spark, small))
    monkeypatch.setattr(tables, "TASK_ROWS", 100)
    found = catalogue.QUERIES[name](spark, small)
    assert partitions(found) == {10} and "ENSURE_REQUIREMENTS" not in plan(found)
    assert want and rows_sorted(found) == want


@pytest.mark.parametrize("name", ["cloud_distance", "sg_edges_3d"])
def test_f14_f15_points_meet_in_tasks_of_as_many_rows_at_every_size(spark, small, name, monkeypatch):
    """What a task doesn't hold it spills, so points meet in ten tasks, not in as few as their bytes allow."""
    want = rows_sorted(catalogue.QUERIES[name](spark, small))
    monkeypatch.setattr(tables, "TASK_ROWS", 100)
    found = catalogue.QUERIES[name](spark, small)
    for cell in ("a#", "b#"):
        assert re.search(rf"hashpartitioning\([^)]*{cell}[^)]*cell_[^)]*, 10\), REPARTITION_BY_NUM", plan(found))
    assert want and rows_sorted(found) == want


@pytest.mark.parametrize(("name", "shuffles"), [("cloud_distance", 1), ("sg_edges_3d", 2)])
def test_f14_groups_of_few_points_stay_together(spark, small, name, shuffles, monkeypatch):
    """They are shuffled as events, and once more as clouds where Python sees them, never in a join; larger groups, here of more than 8 points or none, give the same."""
    monkeypatch.setattr(tables, "TASK_ROWS", 100)
    found = catalogue.QUERIES[name](spark, small)
    few = [line for line in plan(found).splitlines() if line.startswith("   :")]
    assert sum("Exchange" in line for line in few) == shuffles and not any("Join" in line for line in few)
    want = rows_sorted(found)
    for most in (8, 0):
        monkeypatch.setattr(clouds, "FEW", most)
        assert want and rows_sorted(catalogue.QUERIES[name](spark, small)) == want


def test_f14_odd_rows_of_few_points(spark, monkeypatch):
    """Equal points, unknown coordinates, flat clouds and clouds in a hull, clouds without a point, rows without a group or name, and one group of many points."""
    draw = np.random.default_rng(5)
    rows = [(g, "abc"[k % 3], *map(float, draw.integers(0, 4, 3))) for g in range(6) for k in range(1 + 5 * g)]
    rows += [(7, "a", float(x), float(y), float(z)) for x in (0, 9) for y in (0, 9) for z in (0, 9)] + [(7, "b", 5.0, 5.0, 8.95), (7, "b", 5.0, None, 5.0), (7, "c", None, None, None), (7, "c", None, 1.0, 1.0)]
    rows += [(8, "a", float(k), 0.0, 0.0) for k in range(5)] + [(8, "b", 2.0, 0.1, 0.0), (None, "a", 1.0, 1.0, 1.0), (None, "b", 1.0, 1.0, 1.0), (8, None, 1.0, 1.0, 1.0)]
    rows += [(9, "ab"[k % 2], *map(float, draw.integers(0, 9, 3))) for k in range(200)]
    df = spark.createDataFrame(rows, "g long, o string, x double, y double, z double")

    def told():
        gaps = {(r.g, r.a, r.b): (r.mean_gap, r.gap) for r in clouds.cloud_gaps(df, ["g"], "o").collect()}
        edges = clouds.edges_3d(df, ["g"], "o", 1.0, 5.0, 3).collect()
        return gaps, {(r.g, r.start, r.end): (r.edge_type, r.dist) for r in edges}

    gaps, edges = told()
    assert (7, "a", "c") not in gaps and (7, "b", "a") in gaps and edges[8, "b", "a"][0] and (9, "a", "b") in gaps
    monkeypatch.setattr(clouds, "FEW", 0)
    all_gaps, all_edges = told()
    assert edges == {k: (kind, pytest.approx(v, abs=1e-9)) for k, (kind, v) in all_edges.items()}
    assert gaps == {k: pytest.approx(v, abs=1e-9) for k, v in all_gaps.items()}
