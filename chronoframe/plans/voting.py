"""Queries on votes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoframe.operators import voting
from chronoframe.plans.registry import query
from chronoframe.plans.views import FRAMES, frames, table

#: Detector streams: each event type is one detector's, three objects an episode.
STREAM = {"click": "gripper_close", "view": "object_movement", "purchase": "object_state", "signup": "gripper_position", "error": "scene_graph"}
_CASES = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in STREAM.items())
_WEIGHTS = " ".join(f"WHEN '{k}' THEN {v}" for k, v in voting.WEIGHTS.items())

SCORES = f"""{FRAMES}, ks AS (SELECT DISTINCT episode_id, 'o' || (k % 3) AS object, CASE object {_CASES} END AS predictor, frame_idx FROM frames),
w AS (SELECT *, (CASE predictor {_WEIGHTS} END)::DOUBLE AS weight FROM ks),
totals AS (SELECT episode_id, object, sum(weight) AS total FROM (SELECT DISTINCT episode_id, object, predictor, weight FROM w) GROUP BY 1, 2),
pairs AS (SELECT a.episode_id, a.object, a.predictor, a.frame_idx, b.predictor AS other, b.weight AS ow, b.frame_idx AS x, abs(a.frame_idx - b.frame_idx) AS d
  FROM w a JOIN w b ON a.episode_id = b.episode_id AND a.object = b.object AND a.predictor <> b.predictor),
near AS (SELECT episode_id, object, predictor, frame_idx, other, ow, min(d) AS d, arg_min(x, d * 100000 + x) AS x,
  bool_or(other = 'object_state' AND x >= frame_idx AND x - frame_idx < 20) AS later FROM pairs GROUP BY 1, 2, 3, 4, 5, 6),
agreed AS (SELECT episode_id, object, predictor, frame_idx, sum(ow) AS w, sum(CASE WHEN d < 4 THEN x END) AS s, count(CASE WHEN d < 4 THEN x END) AS n
  FROM near WHERE d < 4 OR later GROUP BY 1, 2, 3, 4),
scored AS (SELECT w.episode_id, w.object, w.predictor, w.frame_idx, floor((w.frame_idx + coalesce(s, 0)) / (1 + coalesce(n, 0)))::INTEGER AS voted_frame,
  (w.weight + coalesce(a.w, 0)) / total AS score FROM w LEFT JOIN agreed a USING (episode_id, object, predictor, frame_idx) JOIN totals USING (episode_id, object))"""


def keystates(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.create_map(*(F.lit(x) for pair in STREAM.items() for x in pair))
    f = frames(spark, sf_dir)
    return f.select("episode_id", F.concat(F.lit("o"), F.col("k") % 3).alias("object"), F.element_at(names, F.col("object")).alias("predictor"), "frame_idx")


@query(f"WITH {SCORES} SELECT episode_id, object, predictor, frame_idx, voted_frame, round(score, 6) AS score FROM scored")
def vote_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return voting.vote_scores(keystates(spark, sf_dir), "episode_id", 4).withColumn("score", F.round("score", 6))


GROUPS = f"""{SCORES}, best AS (SELECT episode_id, object, voted_frame, max(score) AS score FROM scored GROUP BY 1, 2, 3),
cut AS (SELECT *, CASE WHEN voted_frame - lag(voted_frame) OVER (PARTITION BY episode_id, object ORDER BY voted_frame) > 4 THEN 1 ELSE 0 END AS c FROM best),
grouped AS (SELECT *, sum(c) OVER (PARTITION BY episode_id, object ORDER BY voted_frame) AS g FROM cut),
ranked AS (SELECT *, row_number() OVER (PARTITION BY episode_id, object, g ORDER BY round(score, 9) DESC, voted_frame) AS r, count(*) OVER (PARTITION BY episode_id, object, g) AS n FROM grouped),
groups AS (SELECT episode_id, object, voted_frame AS frame_idx, round(round(score, 9) + 0.01 * n - 0.1, 9) AS score FROM ranked WHERE r = 1)"""


@query(f"""WITH RECURSIVE {GROUPS}, ordered AS (SELECT *, row_number() OVER (PARTITION BY episode_id ORDER BY frame_idx, object, score) AS rn FROM groups WHERE score >= 0),
walk AS (
  SELECT episode_id, rn, 0 AS chain, object, frame_idx, score FROM ordered WHERE rn = 1
  UNION ALL
  SELECT o.episode_id, o.rn, CASE WHEN o.frame_idx - w.frame_idx <= 3 THEN w.chain ELSE w.chain + 1 END,
    CASE WHEN o.frame_idx - w.frame_idx <= 3 AND o.score <= w.score THEN w.object ELSE o.object END,
    CASE WHEN o.frame_idx - w.frame_idx <= 3 AND o.score <= w.score THEN w.frame_idx ELSE o.frame_idx END,
    CASE WHEN o.frame_idx - w.frame_idx <= 3 AND o.score <= w.score THEN w.score ELSE o.score END
  FROM walk w JOIN ordered o ON o.episode_id = w.episode_id AND o.rn = w.rn + 1),
final AS (SELECT *, row_number() OVER (PARTITION BY episode_id, chain ORDER BY rn DESC) AS r FROM walk)
SELECT episode_id, object, frame_idx, round(score, 6) AS score FROM final WHERE r = 1 AND score > 0.15""")
def vote_combine(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = voting.vote_scores(keystates(spark, sf_dir), "episode_id", 4)
    return voting.combined(scored, "episode_id").withColumn("score", F.round("score", 6))


@query(f"""WITH {FRAMES}, reasons AS (SELECT episode_id, frame_idx AS at, 'k=' || k AS reason FROM frames WHERE object = 'signup'),
asked AS (SELECT DISTINCT episode_id, frame_idx FROM frames WHERE object = 'purchase'),
near AS (SELECT a.episode_id, a.frame_idx, r.reason, abs(a.frame_idx - r.at) AS d, row_number() OVER (PARTITION BY a.episode_id, a.frame_idx ORDER BY abs(a.frame_idx - r.at), r.at) AS n
  FROM asked a JOIN reasons r ON a.episode_id = r.episode_id AND abs(a.frame_idx - r.at) <= 4)
SELECT a.episode_id, a.frame_idx, coalesce(d, -1)::INTEGER AS gap, coalesce(reason, 'none') AS reason FROM asked a LEFT JOIN near n ON a.episode_id = n.episode_id AND a.frame_idx = n.frame_idx AND n.n = 1""")
def reason_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = frames(spark, sf_dir)
    asked = f.filter("object = 'purchase'").select("episode_id", "frame_idx")
    reasons = f.filter("object = 'signup'").select("episode_id", F.col("frame_idx").alias("at"), F.concat(F.lit("k="), "k").alias("reason"))
    found = voting.matched_reasons(asked, reasons, ["episode_id"], 4, "none")
    return found.withColumn("gap", F.coalesce("gap", F.lit(-1)))


@query("""WITH v AS (SELECT l_suppkey, l_returnflag, count(*) AS votes FROM lineitem GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY votes DESC, l_returnflag) AS r FROM v) SELECT l_suppkey, l_returnflag, votes FROM r WHERE r = 1""")
def majority_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return voting.majority(table(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_returnflag")


@query("""WITH v AS (SELECT l_suppkey, l_returnflag, round(sum(l_quantity), 6) AS votes FROM lineitem GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY votes DESC, l_returnflag) AS r FROM v) SELECT l_suppkey, l_returnflag, votes FROM r WHERE r = 1""")
def weighted_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return voting.majority(table(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_returnflag", F.col("l_quantity"))
