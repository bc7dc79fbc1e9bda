"""Queries on single series: runs, fills, smoothing, scores, nearest known rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronoframe.operators import nearest, series
from chronoframe.plans.registry import query
from chronoframe.plans.views import episode, FRAMES, frames

E = "PARTITION BY episode_id ORDER BY frame_idx"
HOT = f"""{FRAMES}, flagged AS (SELECT episode_id, frame_idx, value > 40 AS flag FROM frames),
changed AS (SELECT *, CASE WHEN flag = lag(flag) OVER ({E}) THEN 0 ELSE 1 END AS c FROM flagged),
runs AS (SELECT *, sum(c) OVER ({E}) AS island FROM changed)"""


def hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames(spark, sf_dir).select("episode_id", "frame_idx", (F.col("value") > 40).alias("flag"))


@query(f"""WITH {HOT}, sized AS (SELECT *, count(*) OVER (PARTITION BY episode_id, island) AS n, max(flag::INTEGER) OVER ({E}) AS led FROM runs)
SELECT episode_id, frame_idx, flag, flag OR (n < 3 AND led = 1) AS filled FROM sized""")
def fill_false_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.fill_false_runs(hot(spark, sf_dir), "flag", 3, ["episode_id"], episode(), "filled")


@query(f"""WITH {HOT}, sized AS (SELECT *, count(*) OVER (PARTITION BY episode_id, island) AS n FROM runs)
SELECT episode_id, frame_idx, flag, flag AND n >= 2 AS kept FROM sized""")
def keep_true_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.keep_true_runs(hot(spark, sf_dir), "flag", 2, ["episode_id"], episode(), "kept")


@query(f"""WITH {HOT} SELECT episode_id, flag, min(frame_idx) AS "start", max(frame_idx) AS "end", count(*) AS length FROM runs GROUP BY episode_id, island, flag""")
def run_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.run_lengths(hot(spark, sf_dir), ["episode_id"], "flag", "frame_idx", episode()).drop("island")


@query(f"""WITH {FRAMES}, changed AS (SELECT episode_id, frame_idx, gripper, CASE WHEN gripper = lag(gripper) OVER ({E}) THEN 0 ELSE 1 END AS c FROM frames),
islands AS (SELECT *, sum(c) OVER ({E}) AS island FROM changed),
runs AS (SELECT episode_id, island, first(gripper) AS label, count(*) AS n FROM islands GROUP BY episode_id, island),
around AS (SELECT *, lag(label) OVER w AS b, lead(label) OVER w AS a FROM runs WINDOW w AS (PARTITION BY episode_id ORDER BY island)),
filled AS (SELECT *, CASE WHEN n <= 1 AND a = b THEN b ELSE label END AS f FROM around),
again AS (SELECT *, CASE WHEN f = lag(f) OVER (PARTITION BY episode_id ORDER BY island) THEN 0 ELSE 1 END AS c FROM filled),
joined AS (SELECT *, sum(c) OVER (PARTITION BY episode_id ORDER BY island) AS j FROM again),
long AS (SELECT *, sum(n) OVER (PARTITION BY episode_id, j) AS len, max(j) OVER (PARTITION BY episode_id) AS last FROM joined),
firm AS (SELECT episode_id, island, last_value(CASE WHEN len >= 3 OR j = 1 OR j = last THEN f END IGNORE NULLS) OVER (PARTITION BY episode_id ORDER BY island) AS kept FROM long)
SELECT episode_id, frame_idx, gripper, kept AS smooth FROM islands JOIN firm USING (episode_id, island)""")
def smooth_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    smoothed = series.smooth_labels(frames(spark, sf_dir), "gripper", 1, 3, ["episode_id"], "frame_idx", "smooth")
    return smoothed.select("episode_id", "frame_idx", "gripper", "smooth")


@query(f"""WITH {FRAMES}, votes AS (
  SELECT a.episode_id, a.frame_idx, b.object AS label, sum(exp(-((a.frame_idx - b.frame_idx) ** 2) / 8.0)) AS weight
  FROM frames a JOIN frames b ON a.episode_id = b.episode_id AND abs(a.frame_idx - b.frame_idx) <= 3 GROUP BY 1, 2, 3),
ranked AS (SELECT *, row_number() OVER (PARTITION BY episode_id, frame_idx ORDER BY round(weight, 9) DESC, label) AS r FROM votes)
SELECT episode_id, frame_idx, label, round(weight, 6) AS weight FROM ranked WHERE r = 1""")
def gaussian_label_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.gaussian_vote(frames(spark, sf_dir), "episode_id", "frame_idx", "object", 3, 2.0).select(
        "episode_id", "frame_idx", F.col("object").alias("label"), F.round("weight", 6).alias("weight")
    )


SPARSE = f"""{FRAMES}, sparse AS (SELECT episode_id, frame_idx, CASE WHEN object <> 'view' THEN value END AS v FROM frames),
known AS (SELECT *, last_value(CASE WHEN v IS NOT NULL THEN frame_idx END IGNORE NULLS) OVER (PARTITION BY episode_id ORDER BY frame_idx) AS b_at,
  last_value(v IGNORE NULLS) OVER (PARTITION BY episode_id ORDER BY frame_idx) AS b,
  first_value(CASE WHEN v IS NOT NULL THEN frame_idx END IGNORE NULLS) OVER (PARTITION BY episode_id ORDER BY frame_idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS a_at,
  first_value(v IGNORE NULLS) OVER (PARTITION BY episode_id ORDER BY frame_idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS a FROM sparse)"""


def sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames(spark, sf_dir).select("episode_id", "frame_idx", F.when(F.col("object") != "view", F.col("value")).alias("v"))


@query(f"""WITH {SPARSE} SELECT episode_id, frame_idx, v, round(CASE WHEN v IS NOT NULL THEN v WHEN frame_idx - b_at <= 2
  THEN CASE WHEN a_at IS NULL THEN b ELSE b + (a - b) * (frame_idx - b_at) / (a_at - b_at) END END, 6) AS filled FROM known""")
def interpolate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    filled = series.interpolated(sparse(spark, sf_dir), "v", "frame_idx", episode(), 2, "filled")
    return filled.withColumn("filled", F.round("filled", 6))


@query(f"""WITH {SPARSE} SELECT episode_id, frame_idx, CASE WHEN a_at IS NULL OR frame_idx - b_at <= a_at - frame_idx THEN b ELSE a END AS nearest,
  CASE WHEN least(frame_idx - b_at, a_at - frame_idx) <= 1 THEN CASE WHEN a_at IS NULL OR frame_idx - b_at <= a_at - frame_idx THEN b ELSE a END END AS within_one FROM known""")
def nearest_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = series.nearest_known(sparse(spark, sf_dir), "v", "frame_idx", episode(), "nearest")
    near = series.nearest_known(near, "v", "frame_idx", episode(), "within_one", reach=1)
    return near.select("episode_id", "frame_idx", "nearest", "within_one")


@query(f"""WITH {FRAMES} SELECT episode_id, frame_idx, round(avg(value) OVER ({E} ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) AS centred,
  round(avg(value) OVER ({E} ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), 6) AS trailing FROM frames""")
def rolling_centred(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames(spark, sf_dir).select(
        "episode_id",
        "frame_idx",
        F.round(series.rolling_mean(F.col("value"), episode(), 2, 2), 6).alias("centred"),
        F.round(series.rolling_mean(F.col("value"), episode(), 3, 0), 6).alias("trailing"),
    )


@query(f"""WITH {FRAMES}, z AS (SELECT *, (value - avg(value) OVER p) / nullif(stddev_pop(value) OVER p, 0) AS z FROM frames WINDOW p AS (PARTITION BY episode_id, object))
SELECT episode_id, object, frame_idx, round(z, 6) AS z, CASE WHEN z > 2 OR z < -3.2 THEN NULL ELSE value END AS refined FROM z""")
def zscore_refine(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = series.zscore(F.col("value"), Window.partitionBy("episode_id", "object"))
    scored = frames(spark, sf_dir).withColumn("z", z)
    return scored.select("episode_id", "object", "frame_idx", F.round("z", 6).alias("z"), F.when(~((F.col("z") > 2) | (F.col("z") < -3.2)) | F.col("z").isNull(), F.col("value")).alias("refined"))


@query(f"""WITH {FRAMES}, m AS (SELECT *, (value - min(value) OVER p) / nullif(max(value) OVER p - min(value) OVER p, 0) AS mv,
  (k - min(k) OVER p) / nullif(max(k) OVER p - min(k) OVER p, 0) AS mk FROM frames WINDOW p AS (PARTITION BY episode_id))
SELECT episode_id, frame_idx, round(0.8 * mv + 0.2 * mk, 6) AS blend FROM m""")
def minmax_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = Window.partitionBy("episode_id")
    blend = 0.8 * series.minmax(F.col("value"), part) + 0.2 * series.minmax(F.col("k").cast("double"), part)
    return frames(spark, sf_dir).select("episode_id", "frame_idx", F.round(blend, 6).alias("blend"))


@query(f"""WITH {FRAMES}, known AS (SELECT episode_id, frame_idx AS at, state FROM frames WHERE state IS NOT NULL),
l AS (SELECT f.episode_id, f.frame_idx, arg_max(k.state, k.at) AS left_state FROM frames f JOIN known k ON f.episode_id = k.episode_id AND k.at <= f.frame_idx + 2 GROUP BY 1, 2),
r AS (SELECT f.episode_id, f.frame_idx, arg_min(k.state, k.at) AS right_state FROM frames f JOIN known k ON f.episode_id = k.episode_id AND k.at >= f.frame_idx - 2 GROUP BY 1, 2)
SELECT f.episode_id, f.frame_idx, left_state, right_state FROM frames f LEFT JOIN l USING (episode_id, frame_idx) LEFT JOIN r USING (episode_id, frame_idx)""")
def closest_state_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last state up to two frames ahead, and the first from two frames back."""
    back = episode().rowsBetween(Window.unboundedPreceding, 2)
    ahead = episode().rowsBetween(-2, Window.unboundedFollowing)
    return frames(spark, sf_dir).select(
        "episode_id",
        "frame_idx",
        F.last("state", ignorenulls=True).over(back).alias("left_state"),
        F.first("state", ignorenulls=True).over(ahead).alias("right_state"),
    )


@query(f"""WITH {FRAMES}, anchors AS (SELECT episode_id, frame_idx AS anchor FROM frames WHERE object = 'purchase'),
cands AS (SELECT episode_id, frame_idx AS cand FROM frames WHERE object = 'signup'),
pairs AS (SELECT a.episode_id, anchor, cand, abs(anchor - cand) AS d, cand >= anchor AS ahead FROM anchors a JOIN cands c ON a.episode_id = c.episode_id),
sided AS (SELECT *, row_number() OVER (PARTITION BY episode_id, anchor, ahead ORDER BY d) AS side FROM pairs),
ranked AS (SELECT *, row_number() OVER (PARTITION BY episode_id, anchor ORDER BY CASE WHEN side = 1 THEN 0 ELSE 1 END, d, cand) AS r FROM sided)
SELECT episode_id, anchor, cand, d::INTEGER AS d FROM ranked WHERE r <= 4""")
def nearest_before_after_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = frames(spark, sf_dir)
    anchors = f.filter("object = 'purchase'").select("episode_id", F.col("frame_idx").alias("anchor"))
    cands = f.filter("object = 'signup'").select("episode_id", F.col("frame_idx").alias("cand"))
    return nearest.before_after_k(anchors, cands, "episode_id", "anchor", "cand", 4)
