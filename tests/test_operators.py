"""Operators that SQL can't express, or whose cases the tables lack, against plain versions."""

from __future__ import annotations

import json
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoframe.functions.text import repaired
from chronoframe.functions import vectors as vx
from chronoframe.operators import graphs, groups, metrics, nearest, predictors, voting
from chronoframe.plans import catalogue, evaluation
from chronoframe.plans.geometry import GROUP, detections
from chronoframe.plans.vectors import online_entries
from chronoframe.operators import detections as dt


def test_average_precision_equals_a_plain_version(spark, small):
    truths, preds = evaluation.segments(spark, small)
    gts, found = defaultdict(list), [tuple(r) for r in preds.select("video", "t_start", "t_end", "score").collect()]
    for r in truths.collect():
        gts[r.video].append((r.t_start, r.t_end))
    n = sum(map(len, gts.values()))
    want = {}
    for limit in evaluation.OVERLAPS:
        hits = []
        for video in {f[0] for f in found}:
            free = set(range(len(gts[video])))
            for _, p0, p1, score in sorted((f for f in found if f[0] == video), key=lambda f: (-f[3], f[1], f[2])):
                def iou(k):
                    g0, g1 = gts[video][k]
                    both = max(0, min(g1, p1) - max(g0, p0))
                    return both / ((g1 - g0) + (p1 - p0) - both)
                best = max((k for k in sorted(free)), key=iou, default=None)
                hit = best is not None and iou(best) >= limit
                if hit:
                    free.discard(best)
                hits.append((score, hit))
        scores = sorted({s for s, _ in hits}, reverse=True)
        curve = [(sum(h for s, h in hits if s >= x), sum(s >= x for s, _ in hits)) for x in scores]
        best_p = [max(tp / k for tp, k in curve[i:]) for i in range(len(curve))]
        want[limit] = sum(p * (tp - before) / n for p, (tp, _), before in zip(best_p, curve, [0] + [c[0] for c in curve[:-1]], strict=True))
    got = {r.threshold: r.ap for r in catalogue.QUERIES["average_precision"](spark, small).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-5 for k in want)
    hits = metrics.locked_hits(truths, preds, evaluation.OVERLAPS)
    few = {r.threshold: r.ap for r in metrics.average_precision(hits, n, ranges=3).collect()}
    assert all(abs(few[k] - want[k]) < 1e-9 for k in want)


def plain_entries(rows, least):
    out, memory = {}, defaultdict(list)
    for part, key, v in sorted(rows, key=lambda r: (r[0], r[1])):
        x = np.asarray(v, float) / np.linalg.norm(v)
        sims = [x @ m / np.linalg.norm(m) for m, _ in memory[part]]
        if sims and max(sims) >= least:
            k = int(np.argmax(sims))
            mean, n = memory[part][k]
            memory[part][k] = ((mean * n + x) / (n + 1), n + 1)
        else:
            k = len(memory[part])
            memory[part].append((x, 1))
        out[part, key] = k
    return out


def test_online_entries_over_the_whole_table(spark, small):
    table = spark.read.parquet(f"{small}/embeddings.parquet")
    want = plain_entries([(r.label, r.vec_id, r.embedding) for r in table.collect()], 0.3)
    got = {(r.label, r.vec_id): r.entry for r in catalogue.QUERIES["embedding_dedup"](spark, small).collect()}
    assert got == want
    again = {(r.label, r.vec_id): r.entry for r in online_entries(table.repartition(7), "label", "vec_id", "embedding", 0.3).collect()}
    assert again == want


def test_final_groups_by_hand():
    pairs = [("a", "b", 0.9), ("b", "a", 0.9), ("a", "c", 0.3), ("c", "a", 0.7), ("d", "a", 0.1), ("a", "d", 0.1)]
    assert dt.final_groups(pairs, 0.6) == [["a", "b"], ["c"], ["d"]]


def test_class_groups_cover_the_vocabulary(spark, small):
    got = catalogue.QUERIES["class_groups"](spark, small).collect()
    assert sorted(r.object for r in got) == ["click", "error", "purchase", "signup", "view"]


@pytest.mark.parametrize("masks", [False, True])
def test_inside_and_touching(spark, masks):
    rows = [(1, "big", 0.0, 0.0, 100.0, 100.0, [1, 2]), (1, "in", 40.0, 40.0, 50.0, 50.0, [3]), (1, "on", 90.0, 90.0, 110.0, 110.0, [2, 9])]
    nodes = spark.createDataFrame(rows, "g int, object string, x1 double, y1 double, x2 double, y2 double, m array<int>")
    found = {(r.start, r.end): r.edge_type for r in graphs.edges(nodes, ["g"], "object", 150.0, "m" if masks else None).collect()}
    assert found["on", "big"] == "touching"
    assert found["in", "big"] == ("inside" if masks else "touching")


def test_repaired_answers():
    whole = json.dumps({"tasks": ["pick \"it\" up", "a\\b"], "n": [1, 2.5, {"x": None}], "t": True})
    for end in range(1, len(whole) + 1):
        fixed = repaired(whole[:end])
        assert fixed is not None and isinstance(json.loads(fixed), dict)
    assert json.loads(repaired('```json\n{"a": "x')) == {"a": "x"}
    assert repaired(None) is None and repaired("") is None and repaired("}}}") is None
    assert json.loads(repaired('{"a": 1, "' + "b" * 20_000)) == {"a": 1}


def test_before_after_k_equals_all_pairs(spark):
    rng = np.random.default_rng(2)
    anchors = [(p, int(a)) for p in range(3) for a in sorted(set(rng.integers(0, 60, 9)))]
    cands = [(p, int(c)) for p in range(2) for c in sorted(set(rng.integers(0, 60, 12)))]
    got = defaultdict(list)
    found = nearest.before_after_k(spark.createDataFrame(anchors, "p int, a int"), spark.createDataFrame(cands, "p int, c int"), "p", "a", "c", 4)
    for r in found.collect():
        got[r.p, r.a].append(r.c)
    for p, a in anchors:
        own = [c for q, c in cands if q == p]
        first = [c for side in ([c for c in own if c < a], [c for c in own if c >= a]) for c in sorted(side, key=lambda c: abs(c - a))[:1]]
        rest = sorted((c for c in own if c not in first), key=lambda c: (abs(c - a), c))
        assert sorted(got[p, a]) == sorted((sorted(first, key=lambda c: (abs(c - a), c)) + rest)[:4])


def test_fifth_smallest_is_per_object(spark):
    rows = [(o, i, 100.0 if i % 7 else 1.0) for o in ("a", "b") for i in range(40)]
    rows += [("c", i, 1.0) for i in range(3)] + [("d", 0, None)]
    found = predictors.contact_runs(spark.createDataFrame(rows, "o string, i int, d double"), ["o"], "i", "d").collect()
    assert sorted((r.o, r.start, r.end) for r in found) == [("a", 0, 0), ("b", 0, 0), ("c", 0, 2)]


def test_suppression_cuts_chains_at_gaps(spark):
    rows = [(1, "a", 0, 0.5), (1, "b", 2, 0.9), (1, "a", 4, 0.7), (1, "c", 5, 0.95), (1, "a", 20, 0.1), (2, "z", 3, 0.4)]
    table = spark.createDataFrame(rows, "p int, object string, frame_idx int, score double")
    got = sorted((r.p, r.object, r.frame_idx) for r in voting.suppressed(table, "p", 3).collect())
    assert got == [(1, "a", 20), (1, "c", 5), (2, "z", 3)]


def test_classes_in_several_blocks(spark, small):
    rows = spark.read.parquet(f"{small}/embeddings.parquet").select("vec_id", "embedding").limit(40)
    classes = spark.read.parquet(f"{small}/embeddings.parquet").select(F.col("vec_id").alias("k"), F.col("embedding").alias("c"))
    one = {r.vec_id: [n.key for n in r.nearest] for r in vx.nearest_classes(rows, classes, "k", "embedding", "c", 3).collect()}
    several = {r.vec_id: [n.key for n in r.nearest] for r in vx.nearest_classes(rows, classes, "k", "embedding", "c", 3, most=100).collect()}
    assert one == several and all(k[0] == v for v, k in one.items())
    assert vx.similarities(rows, classes, "k", "embedding", "c", most=100).count() == 40 * classes.count()


def test_density_labels():
    points = np.array([[0.0, 0], [0, 1], [0, 2], [9, 9], [0, 3.4]])
    assert groups.density_labels(points, 1.0, 2).tolist() == [0, 0, 0, -1, -1]
    assert groups.density_labels(points, 1.5, 3).tolist() == [0, 0, 0, -1, 0]


def test_nms_by_hand(spark, small):
    d = detections(spark, small)
    kept = {r.event_id for r in dt.nms(d, GROUP, "event_id", 0.2).collect()}
    rows = d.collect()
    by = defaultdict(list)
    for r in rows:
        by[r.episode_id, r.g].append(r)
    want = set()
    for group in by.values():
        own = []
        for r in sorted(group, key=lambda r: (-r.score, r.event_id)):
            def iou(o):
                both = max(0, min(r.x2, o.x2) - max(r.x1, o.x1)) * max(0, min(r.y2, o.y2) - max(r.y1, o.y1))
                return both / ((r.x2 - r.x1) * (r.y2 - r.y1) + (o.x2 - o.x1) * (o.y2 - o.y1) - both)
            if all(iou(o) <= 0.2 for o in own):
                own.append(r)
        want |= {r.event_id for r in own}
    assert kept == want
