"""Queries on segments taken in order, the best frame for proposals, graphs that are alike, and the gripper's place."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoframe.functions.grippers import gripper_view, handle_place
from chronoframe.operators import quads, segments
from chronoframe.plans.geometry import AREA, DETS, GROUP, IOU, detections
from chronoframe.plans.regions import PIXELS, _greedy, pixels
from chronoframe.plans.registry import query, tidy
from chronoframe.plans.views import FRAMES, boxes, frames

_FREE = "NOT list_contains(w.ours_used, o.ours) AND NOT list_contains(w.news_used, o.news)"


@query(f"""WITH RECURSIVE {DETS}, p AS (SELECT a.episode_id, a.g, a.event_id AS ours, b.event_id AS news, ({IOU}) / nullif({AREA.format("a")} + {AREA.format("b")} - ({IOU}), 0) AS iou FROM dets a JOIN dets b ON a.episode_id = b.episode_id AND a.g + 1 = b.g),
o AS (SELECT *, row_number() OVER (PARTITION BY episode_id, g ORDER BY news, ours) AS rn FROM p WHERE iou > 0.3),
walk AS (SELECT episode_id, g, rn, ours, news, true AS kept, [ours] AS ours_used, [news] AS news_used FROM o WHERE rn = 1
  UNION ALL SELECT o.episode_id, o.g, o.rn, o.ours, o.news, {_FREE}, CASE WHEN {_FREE} THEN list_append(w.ours_used, o.ours) ELSE w.ours_used END, CASE WHEN {_FREE} THEN list_append(w.news_used, o.news) ELSE w.news_used END
  FROM walk w JOIN o ON o.episode_id = w.episode_id AND o.g = w.g AND o.rn = w.rn + 1),
m AS (SELECT * FROM walk WHERE kept)
SELECT episode_id, g, ours, news, 'matched' AS outcome FROM m
UNION ALL SELECT d.episode_id, d.g, d.event_id, NULL, 'unmatched' FROM dets d WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.episode_id = d.episode_id AND m.g = d.g AND m.ours = d.event_id)
UNION ALL SELECT d.episode_id, d.g - 1, NULL, d.event_id, 'new' FROM dets d WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.episode_id = d.episode_id AND m.g = d.g - 1 AND m.news = d.event_id)""")
def segment_first_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each new segment, in order, with the first one of the group before that it overlaps and that is free."""
    d = detections(spark, sf_dir)
    return segments.first_matches(d, d.withColumn("g", F.col("g") - 1), GROUP, "event_id", 0.3)


@query(f"""WITH RECURSIVE {DETS}, ordered AS (SELECT *, row_number() OVER (PARTITION BY episode_id, g ORDER BY score DESC, event_id) AS rn FROM dets), {_greedy(0.3)},
t AS (SELECT episode_id, g, round(sum(score), 6) AS total FROM walk WHERE stays GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY episode_id ORDER BY total DESC, g) AS r FROM t)
SELECT episode_id, g FROM r WHERE r = 1""")
def best_objectness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The group of each episode whose proposals, without those suppressed, have the greatest sum of objectness; the first on ties."""
    return segments.best_group(detections(spark, sf_dir), ["episode_id"], "g", "event_id", 0.3)


@query(f"""WITH {PIXELS}, r AS (SELECT *, row_number() OVER (PARTITION BY episode_id ORDER BY x + y DESC, y, x) AS r FROM pixels WHERE object = 'click'), e AS (SELECT DISTINCT episode_id FROM frames)
SELECT episode_id, coalesce((y * 100 + x) % 100, 0) - 100 / 16 AS gx, coalesce((y * 100 + x) // 100, 0) - 100 / 24 AS gy FROM e LEFT JOIN (SELECT * FROM r WHERE r = 1) USING (episode_id)""")
def gripper_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the gripper is in each episode: the farthest pixel of its mask to the lower right, less a fixed share of the picture."""
    return segments.gripper_places(pixels(spark, sf_dir), ["episode_id"], F.col("object") == "click", 100, 100).withColumnRenamed("x", "gx").withColumnRenamed("y", "gy")


_TURN = """a AS (SELECT event_id, k / 100.0 AS px, (event_id % 100) / 100.0 AS py, value / 100 AS pz, radians(k) AS r, radians(event_id % 90) AS p, radians(value) AS w FROM frames),
m AS (SELECT *, cos(w) * cos(p) AS m00, cos(w) * sin(p) * sin(r) - sin(w) * cos(r) AS m01, cos(w) * sin(p) * cos(r) + sin(w) * sin(r) AS m02, sin(w) * cos(p) AS m10, sin(w) * sin(p) * sin(r) + cos(w) * cos(r) AS m11,
  sin(w) * sin(p) * cos(r) - cos(w) * sin(r) AS m12, -sin(p) AS m20, cos(p) * sin(r) AS m21, cos(p) * cos(r) AS m22 FROM a)"""


@query(f"""WITH {FRAMES}, {_TURN}, e AS (SELECT *, px + m00 * 0.1 - m02 * 0.1 AS ex, py + m10 * 0.1 - m12 * 0.1 AS ey, pz + m20 * 0.1 - m22 * 0.1 AS ez FROM m)
SELECT event_id, round(px - 0.08 * m20, 6) AS hx, round(py - 0.08 * m21, 6) AS hy, round(pz - 0.08 * m22, 6) AS hz,
round(-(m01), 6) AS v00, round(-m02, 6) AS v01, round(m00, 6) AS v02, round(m01 * ex + m11 * ey + m21 * ez, 6) AS v30, round(m02 * ex + m12 * ey + m22 * ez, 6) AS v31, round(-(m00 * ex + m10 * ey + m20 * ez), 6) AS v32 FROM e""")
def gripper_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The handle behind each gripper pose, and the view of a camera that is fixed to the gripper and turned a quarter."""
    f, e = frames(spark, sf_dir), F.col("event_id")
    place = (F.col("k") / 100, (e % 100) / 100, F.col("value") / 100)
    turn = (F.radians(F.col("k")), F.radians(e % 90), F.radians(F.col("value")))
    quarter = ((0.0, -1.0, 0.0), (1.0, 0.0, 0.0), (0.0, 0.0, 1.0))
    view = gripper_view(place, turn, (0.1, 0.0, -0.1), quarter)
    seen = {f"v{r}{c}": view[4 * r + c] for r, c in ((0, 0), (0, 1), (0, 2), (3, 0), (3, 1), (3, 2))}
    return f.select("event_id", *(F.round(c, 6).alias(n) for c, n in zip(handle_place(place, turn), ("hx", "hy", "hz"), strict=True)), *(F.round(c, 6).alias(n) for n, c in seen.items()))


@query()
def episode_quads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quadrilaterals around the centres of each object's boxes of an episode."""
    b = boxes(spark, sf_dir).select("episode_id", "object", ((F.col("x1") + F.col("x2")) / 2).alias("x"), ((F.col("y1") + F.col("y2")) / 2).alias("y"))
    found = quads.fitted_quads(b, ["episode_id", "object"])
    flat = lambda c: F.transform(F.flatten(c), tidy)
    return found.select("episode_id", "object", *(flat(c).alias(c) for c in ("best", "fitted", "around")), F.round("best_iou", 6).alias("best_iou"), F.round("fitted_iou", 6).alias("fitted_iou"))
