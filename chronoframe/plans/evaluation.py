"""Queries on metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronoframe.operators import intervals, metrics, predictors, series
from chronoframe.plans.registry import query
from chronoframe.plans.views import episode, FRAMES, frames

E = "PARTITION BY episode_id ORDER BY frame_idx"
#: Tolerances in frames, and temporal-IoU thresholds of the average precision.
TOLERANCES, OVERLAPS = [0, 1, 2, 4, 8], [0.2, 0.3, 0.4, 0.5, 0.6]
COUNTS = f"""{FRAMES}, was AS (SELECT *, coalesce(lag(gripper <= 0) OVER ({E}), false) AS was FROM frames),
began AS (SELECT *, last_value(CASE WHEN gripper <= 0 AND NOT was THEN frame_idx END IGNORE NULLS) OVER ({E}) AS began FROM was),
preds AS (SELECT episode_id, frame_idx FROM began WHERE gripper > 0 AND was AND frame_idx - began > 1),
truths AS (SELECT episode_id, frame_idx FROM frames WHERE object = 'purchase'),
near AS (SELECT p.episode_id, p.frame_idx, min(abs(p.frame_idx - t.frame_idx)) AS gap FROM preds p LEFT JOIN truths t USING (episode_id) GROUP BY 1, 2),
hits AS (SELECT episode_id, tol AS tolerance, sum(coalesce(gap <= tol, false)::INTEGER)::BIGINT AS tp, count(*) AS n_pred FROM near, (SELECT unnest({TOLERANCES}) AS tol) GROUP BY 1, 2),
gts AS (SELECT episode_id, count(*) AS n_gt FROM truths GROUP BY 1),
counts AS (SELECT episode_id, tolerance, tp, n_pred - tp AS fp, greatest(coalesce(n_gt, 0) - tp, 0) AS fn, n_pred FROM hits LEFT JOIN gts USING (episode_id))"""
RATES = """round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS "precision", round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall,
round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1"""


def counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = frames(spark, sf_dir)
    preds = predictors.gripper_releases(f, "episode_id", "frame_idx", "gripper", 1)
    truths = f.filter("object = 'purchase'").select("episode_id", "frame_idx")
    return metrics.keystate_counts(preds, truths, "episode_id", TOLERANCES)


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


@query(f"WITH {COUNTS} SELECT episode_id, tolerance, tp, fp, fn, n_pred, {RATES} FROM counts")
def keystate_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.with_rates(counts(spark, sf_dir)), "precision", "recall", "f1")


@query(f"""WITH {COUNTS}, total AS (SELECT tolerance, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn FROM counts GROUP BY 1)
SELECT tolerance, tp, fp, fn, {RATES}, round(coalesce(tp / nullif(tp + fp + fn, 0), 0), 6) AS accuracy FROM total""")
def running_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.running(counts(spark, sf_dir)), "precision", "recall", "f1", "accuracy")


@query(f"""WITH {FRAMES}, l AS (SELECT episode_id, object, lag(object) OVER ({E}) AS pred FROM frames)
SELECT episode_id, avg((pred = object)::INTEGER) AS accuracy, count(*) AS n FROM l WHERE pred IS NOT NULL GROUP BY 1""")
def strict_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of frames whose label the frame before predicts."""
    rows = frames(spark, sf_dir).withColumn("pred", F.lag("object").over(episode())).filter("pred is not null")
    return rows.groupBy("episode_id").agg(F.avg((F.col("pred") == F.col("object")).cast("int")).alias("accuracy"), F.count("*").alias("n"))


SEGMENTS = f"""{FRAMES}, gts AS (SELECT episode_id AS video, frame_idx AS t_start, (SELECT min(p.frame_idx) FROM frames p WHERE p.episode_id = f.episode_id AND p.object = 'purchase' AND p.frame_idx > f.frame_idx) AS t_end
  FROM frames f WHERE object = 'signup'),
flagged AS (SELECT *, value > 40 AS flag FROM frames), changed AS (SELECT *, CASE WHEN flag = lag(flag) OVER ({E}) THEN 0 ELSE 1 END AS c FROM flagged),
runs AS (SELECT *, sum(c) OVER ({E}) AS island FROM changed),
preds AS (SELECT episode_id AS video, min(frame_idx) AS p_start, max(frame_idx) + 1 AS p_end, avg(value) AS score FROM runs WHERE flag GROUP BY episode_id, island)"""


def segments(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Truths: from a signup to the next purchase. Predictions: runs of hot frames with their mean value."""
    f = frames(spark, sf_dir)
    later = F.min(F.when(F.col("object") == "purchase", F.col("frame_idx"))).over(episode().rowsBetween(1, Window.unboundedFollowing))
    truths = f.withColumn("t_end", later).filter("object = 'signup' and t_end is not null").select(F.col("episode_id").alias("video"), F.col("frame_idx").alias("t_start"), "t_end")
    f = f.withColumn("run", F.sum((F.col("value") <= 40).cast("int")).over(series.upto(episode())))
    runs = f.filter("value > 40").groupBy(F.col("episode_id").alias("video"), "run")
    preds = runs.agg(F.min("frame_idx").alias("t_start"), (F.max("frame_idx") + 1).alias("t_end"), F.avg("value").alias("score")).drop("run")
    return truths, preds


@query(f"""WITH {SEGMENTS}, o AS (SELECT g.video, t_start, t_end, p_start, p_end, greatest(least(t_end, p_end) - greatest(t_start, p_start), 0) AS both FROM gts g JOIN preds p ON g.video = p.video WHERE t_end IS NOT NULL)
SELECT video, t_start, t_end, p_start, p_end, round(both_ / (t_end - t_start + p_end - p_start - both_), 6) AS tiou FROM (SELECT * EXCLUDE ("both"), "both" AS both_ FROM o) WHERE both_ > 0""".replace("AS both FROM", 'AS "both" FROM'))
def segment_tiou(spark: SparkSession, sf_dir: str) -> DataFrame:
    truths, preds = segments(spark, sf_dir)
    preds = preds.select("video", F.col("t_start").alias("p_start"), F.col("t_end").alias("p_end"))
    pairs = intervals.overlap_join(truths, preds, ["video"], ("t_start", "t_end"), ("p_start", "p_end"))
    pairs = pairs.withColumn("tiou", metrics.segment_iou(F.col("t_start"), F.col("t_end"), F.col("p_start"), F.col("p_end")))
    return pairs.filter("tiou > 0").withColumn("tiou", F.round("tiou", 6))


@query()
def average_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    truths, preds = segments(spark, sf_dir)
    hits = metrics.locked_hits(truths, preds, OVERLAPS)
    return metrics.average_precision(hits, truths.count()).withColumn("ap", F.round("ap", 6))
