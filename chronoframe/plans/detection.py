"""Queries on change-point detectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronoframe.functions.boxes import box, point_distance
from chronoframe.operators import predictors, series
from chronoframe.plans.registry import query
from chronoframe.plans.views import BOXES, episode, FRAMES, per_object, boxes, frames

E = "PARTITION BY episode_id ORDER BY frame_idx"

RELEASES = f"""{FRAMES}, was AS (SELECT *, coalesce(lag(gripper <= 0) OVER ({E}), false) AS was FROM frames),
began AS (SELECT *, last_value(CASE WHEN gripper <= 0 AND NOT was THEN frame_idx END IGNORE NULLS) OVER ({E}) AS began FROM was),
releases AS (SELECT episode_id, frame_idx FROM began WHERE gripper > 0 AND was AND frame_idx - began > 1),
objects AS (SELECT DISTINCT episode_id, object FROM frames)"""


@query(f"WITH {RELEASES} SELECT r.episode_id, object, frame_idx, 0.6::DOUBLE AS score FROM releases r JOIN objects o ON r.episode_id = o.episode_id")
def gripper_close_keystates(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = frames(spark, sf_dir)
    return predictors.for_each_object(predictors.gripper_releases(f, "episode_id", "frame_idx", "gripper", 1), f, "episode_id", 0.6)


TOUCH = f"""{BOXES}, objects AS (SELECT DISTINCT episode_id, object FROM boxes),
grid AS (SELECT f.episode_id, o.object, f.frame_idx, f.k::DOUBLE AS px, (f.event_id % 100)::DOUBLE AS py,
  CASE WHEN f.object = o.object THEN f.x1 END AS x1, CASE WHEN f.object = o.object THEN f.y1 END AS y1,
  CASE WHEN f.object = o.object THEN f.x2 END AS x2, CASE WHEN f.object = o.object THEN f.y2 END AS y2 FROM boxes f JOIN objects o ON f.episode_id = o.episode_id),
known AS (SELECT episode_id, object, frame_idx, px, py, last_value(x1 IGNORE NULLS) OVER w AS x1, last_value(y1 IGNORE NULLS) OVER w AS y1,
  last_value(x2 IGNORE NULLS) OVER w AS x2, last_value(y2 IGNORE NULLS) OVER w AS y2 FROM grid
  WINDOW w AS (PARTITION BY episode_id, object ORDER BY frame_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
distances AS (SELECT episode_id, object, frame_idx,
  sqrt(greatest(x1 - px, 0, px - x2) ** 2 + greatest(y1 - py, 0, py - y2) ** 2) AS distance FROM known WHERE x1 IS NOT NULL)"""


def distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distance of each frame's point to the box where each object was last seen before."""
    b = boxes(spark, sf_dir, spread=True).filter("episode_id is not null")
    objects = F.collect_set("object").over(Window.partitionBy("episode_id"))
    seen = b.select("episode_id", "frame_idx", F.col("object").alias("shown"), "event_id", "k", "x1", "y1", "x2", "y2", objects.alias("objects"))
    grid = seen.withColumn("object", F.explode("objects")).select(
        "episode_id", "object", "frame_idx", F.col("k").cast("double").alias("px"), (F.col("event_id") % 100).cast("double").alias("py"),
        F.when(F.col("shown") == F.col("object"), F.struct("x1", "y1", "x2", "y2")).alias("b"),
    )
    grid = grid.withColumn("b", F.last("b", ignorenulls=True).over(series.earlier(per_object()))).filter("b is not null")
    return grid.select("episode_id", "object", "frame_idx", point_distance(F.col("px"), F.col("py"), box("b.")).alias("distance"))


@query(f"WITH {TOUCH} SELECT episode_id, object, frame_idx, round(distance, 6) AS distance FROM distances")
def proximity_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distances(spark, sf_dir).withColumn("distance", F.round("distance", 6))


@query(f"""WITH {TOUCH}, smooth AS (SELECT *, avg(distance) OVER (PARTITION BY episode_id, object ORDER BY frame_idx ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS d FROM distances),
ranked AS (SELECT *, row_number() OVER (PARTITION BY episode_id, object ORDER BY d) AS r, count(*) OVER (PARTITION BY episode_id, object) AS n FROM smooth),
fifth AS (SELECT episode_id, object, d AS fifth FROM ranked WHERE r = least(n, 5)),
near AS (SELECT s.*, d < least(20.0, 2 * greatest(fifth, 3.0)) AS near FROM smooth s JOIN fifth USING (episode_id, object)),
changed AS (SELECT *, CASE WHEN near = lag(near) OVER w THEN 0 ELSE 1 END AS c FROM near WINDOW w AS (PARTITION BY episode_id, object ORDER BY frame_idx)),
runs AS (SELECT *, sum(c) OVER w AS island, max(near::INTEGER) OVER w AS led FROM changed WINDOW w AS (PARTITION BY episode_id, object ORDER BY frame_idx)),
filled AS (SELECT *, near OR (count(*) OVER (PARTITION BY episode_id, object, island) < 5 AND led = 1) AS touch FROM runs),
again AS (SELECT *, CASE WHEN touch = lag(touch) OVER w THEN 0 ELSE 1 END AS c2 FROM filled WINDOW w AS (PARTITION BY episode_id, object ORDER BY frame_idx)),
spans AS (SELECT *, sum(c2) OVER (PARTITION BY episode_id, object ORDER BY frame_idx) AS span FROM again)
SELECT episode_id, object, min(frame_idx) AS "start", max(frame_idx) AS "end", least((max(frame_idx) - min(frame_idx) + 1) / 8, 1.0) AS score
FROM spans WHERE touch GROUP BY episode_id, object, span""")
def proximity_contact_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predictors.contact_runs(distances(spark, sf_dir), ["episode_id", "object"], "frame_idx", "distance")


MOVES = f"""{FRAMES}, moved AS (SELECT episode_id, frame_idx, abs(value - lag(value) OVER ({E})) AS movement FROM frames),
limits AS (SELECT episode_id, least(quantile_cont(movement, 0.75) + 3 * (quantile_cont(movement, 0.75) - quantile_cont(movement, 0.25)), 0.015 * 4000) AS lim FROM moved GROUP BY episode_id),
flagged AS (SELECT m.*, coalesce(movement > lim, false) AS flag FROM moved m JOIN limits USING (episode_id)),
changed AS (SELECT *, CASE WHEN flag = lag(flag) OVER ({E}) THEN 0 ELSE 1 END AS c FROM flagged),
runs AS (SELECT *, sum(c) OVER ({E}) AS island FROM changed)"""


@query(f"""WITH {MOVES} SELECT episode_id, min(frame_idx) AS "start", max(frame_idx) AS frame_idx, (max(frame_idx) - min(frame_idx)) / 8 AS score
FROM runs WHERE flag GROUP BY episode_id, island HAVING count(*) >= 2""")
def movement_iqr_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = frames(spark, sf_dir).withColumn("movement", F.abs(F.col("value") - F.lag("value").over(episode())))
    return predictors.movement_runs(moved, ["episode_id"], "frame_idx", "movement", 0.015, F.lit(4000.0))


CAMERA = f"""{FRAMES}, smooth AS (SELECT episode_id, frame_idx, avg(value) OVER ({E} ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS a, least(value / 100, 1.0) AS s FROM frames),
scaled AS (SELECT *, round(0.8 * (a - min(a) OVER p) / nullif(max(a) OVER p - min(a) OVER p, 0) + 0.2 * s, 9) AS signal FROM smooth WINDOW p AS (PARTITION BY episode_id)),
fell AS (SELECT *, CASE WHEN signal - lag(signal) OVER ({E}) < -0.03 THEN 1 ELSE 0 END AS fell FROM scaled),
segments AS (SELECT *, sum(fell) OVER ({E}) AS segment FROM fell)"""


@query(f"""WITH {CAMERA} SELECT episode_id, min(frame_idx) AS "start", max(frame_idx) AS "end", (max(frame_idx) + 2)::INTEGER AS frame_idx
FROM segments GROUP BY episode_id, segment HAVING count(*) >= 4""")
def camera_monotonicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments in which the blended camera signal does not fall by more than 0.03."""
    smooth = frames(spark, sf_dir).withColumn("a", series.rolling_mean(F.col("value"), episode(), 3, 0))
    part = Window.partitionBy("episode_id")
    signal = F.round(0.8 * series.minmax(F.col("a"), part) + 0.2 * F.least(F.col("value") / 100, F.lit(1.0)), 9)
    return predictors.monotone_segments(smooth.withColumn("signal", signal), "episode_id", "frame_idx", "signal", 0.03, 4, 2)


@query(f"""WITH {FRAMES}, seen AS (SELECT episode_id, frame_idx, state IS NOT NULL AS visible,
  sum((state IS NOT NULL)::INTEGER) OVER ({E} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) >= 3 AS ok FROM frames),
changed AS (SELECT *, CASE WHEN ok = lag(ok) OVER ({E}) THEN 0 ELSE 1 END AS c FROM seen),
runs AS (SELECT *, sum(c) OVER ({E}) AS island FROM changed)
SELECT episode_id, min(frame_idx) AS "start", max(frame_idx) AS "end", sum(visible::INTEGER)::BIGINT AS n_visible FROM runs WHERE ok
GROUP BY episode_id, island HAVING sum(visible::INTEGER) >= 10""")
def visibility_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predictors.visible_sessions(frames(spark, sf_dir), "episode_id", "frame_idx", F.col("state").isNotNull(), 5, 2, 10)


STATES = f"""{FRAMES}, marked AS (SELECT episode_id, frame_idx, state, last_value(state IGNORE NULLS) OVER b AS old,
  frame_idx - last_value(CASE WHEN state IS NOT NULL THEN frame_idx END IGNORE NULLS) OVER b - 1 AS hidden,
  count(state) OVER a = 2 AND min(state) OVER a = max(state) OVER a AS holds FROM frames
  WINDOW b AS ({E} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), a AS ({E} ROWS BETWEEN CURRENT ROW AND 1 FOLLOWING))"""


@query(f"""WITH {STATES} SELECT episode_id, (frame_idx - hidden // 3)::INTEGER AS frame_idx, old, state AS "new",
  CASE WHEN hidden = 0 THEN 1.0 ELSE greatest(15.0 / (hidden + 1), 1.0) END::DOUBLE AS score FROM marked WHERE holds AND old <> state""")
def state_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predictors.state_changes(frames(spark, sf_dir), episode(), ["episode_id"], "frame_idx", "state", 1)


@query(f"""WITH {FRAMES}, intervals AS (SELECT episode_id, frame_idx AS "start", lead(frame_idx) OVER ({E}) AS "end" FROM frames WHERE object = 'purchase')
SELECT i.episode_id, i."start", i."end", arg_min(f.state, f.frame_idx) AS first_state, arg_max(f.state, f.frame_idx) AS last_state
FROM intervals i JOIN frames f ON i.episode_id = f.episode_id AND f.frame_idx BETWEEN i."start" AND i."end" WHERE i."end" IS NOT NULL AND f.state IS NOT NULL GROUP BY 1, 2, 3""")
def state_change_in_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = frames(spark, sf_dir)
    intervals = f.filter("object = 'purchase'").select("episode_id", F.col("frame_idx").alias("start"), F.lead("frame_idx").over(episode()).alias("end")).filter("end is not null")
    return predictors.boundary_states(intervals, f.select("episode_id", "frame_idx", "state"), "episode_id", "start", "end", "frame_idx", "state")
