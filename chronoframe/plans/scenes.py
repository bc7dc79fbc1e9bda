"""Queries on scene graphs and objects over time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronoframe.functions.boxes import direction_words
from chronoframe.operators import detections as dt
from chronoframe.operators import graphs, intervals
from chronoframe.plans.geometry import DETS, GROUP, detections
from chronoframe.plans.registry import query
from chronoframe.plans.views import episode, FRAMES, frames

OVER = "(least(a.x2, b.x2) > greatest(a.x1, b.x1) AND least(a.y2, b.y2) > greatest(a.y1, b.y1))"
EDGES = f"""{DETS}, ranked AS (SELECT *, row_number() OVER (PARTITION BY episode_id, g, object ORDER BY score DESC, event_id) AS r FROM dets),
nodes AS (SELECT *, (x1 + x2) / 2 AS cx, (y1 + y2) / 2 AS cy FROM ranked WHERE r = 1),
pairs AS (SELECT a.episode_id, a.g, b.object AS "start", a.object AS "end", {OVER} AS over_,
  sqrt(((a.cx - b.cx) / 150) ** 2 + ((a.cy - b.cy) / 150) ** 2) AS len, (a.cx - b.cx) / 150 AS dx, (a.cy - b.cy) / 150 AS dy
  FROM nodes a JOIN nodes b ON a.episode_id = b.episode_id AND a.g = b.g AND a.object <> b.object),
units AS (SELECT *, dx / nullif(len, 0) AS nx, dy / nullif(len, 0) AS ny, CASE WHEN over_ THEN 0 ELSE len END AS dist FROM pairs),
typed AS (SELECT episode_id, g, "start", "end", dist, CASE WHEN dist < 0.01 AND over_ THEN 'touching' WHEN dist >= 0.17 THEN NULL
  WHEN ny > 0.85 THEN 'behind of' WHEN ny < -0.85 THEN 'in front of' WHEN nx < -0.85 THEN 'right of' WHEN nx > 0.85 THEN 'left of'
  ELSE coalesce(nullif(concat_ws(' and ', CASE WHEN ny > 0.62 THEN 'behind of' WHEN ny < -0.62 THEN 'in front of' END, CASE WHEN -nx > 0.62 THEN 'right of' WHEN -nx < -0.62 THEN 'left of' END), ''), 'close to') END AS edge_type FROM units),
edges AS (SELECT * FROM typed WHERE edge_type IS NOT NULL)"""


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = dt.best_of(detections(spark, sf_dir), [*GROUP, "object"], "score", "event_id")
    return graphs.edges(nodes, GROUP, "object", 150.0)


@query(f'WITH {EDGES} SELECT episode_id, g, "start", "end", edge_type, round(dist, 6)::DOUBLE AS dist FROM edges')
def sg_edges_2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edges(spark, sf_dir).withColumn("dist", F.round("dist", 6))


@query(f"""WITH {EDGES}, c AS (SELECT episode_id, "start", "end", edge_type, count(*) AS n, min(g) AS first FROM edges GROUP BY 1, 2, 3, 4),
r AS (SELECT *, row_number() OVER (PARTITION BY episode_id, "start", "end" ORDER BY n DESC, first, edge_type) AS r FROM c WHERE n >= 2)
SELECT episode_id, "start", "end", edge_type, n FROM r WHERE r = 1""")
def sg_majority_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.majority_edges(edges(spark, sf_dir), ["episode_id"], "g", 2)


@query(f"""WITH {EDGES}, bounds AS (SELECT episode_id, min(g) AS lo, max(g) AS hi FROM edges GROUP BY 1),
c AS (SELECT episode_id, g + o AS g, "start", "end", edge_type, count(*) AS n FROM edges, (SELECT unnest(range(-2, 3)) AS o) GROUP BY 1, 2, 3, 4, 5)
SELECT c.episode_id, c.g::INTEGER AS g, "start", "end", edge_type, n FROM c JOIN bounds USING (episode_id) WHERE g BETWEEN lo AND hi AND n >= 2""")
def sg_denoise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.denoised(edges(spark, sf_dir), ["episode_id"], "g", 2, 2)


CHANGES = f"""{EDGES}, bounds AS (SELECT episode_id, min(g) AS lo, max(g) AS hi FROM edges GROUP BY 1),
now AS (SELECT episode_id, g, "start", "end", edge_type FROM edges), ahead AS (SELECT episode_id, g - 1 AS g, "start", "end", edge_type FROM edges),
changes AS (SELECT c.* FROM (SELECT *, 'removed' AS change FROM (SELECT * FROM now EXCEPT SELECT * FROM ahead) UNION ALL SELECT *, 'added' FROM (SELECT * FROM ahead EXCEPT SELECT * FROM now)) c
  JOIN bounds USING (episode_id) WHERE g >= lo AND g < hi)"""


@query(f"""WITH {CHANGES} SELECT episode_id, g::INTEGER AS g, "start", "end", edge_type, change FROM changes""")
def sg_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.differences(edges(spark, sf_dir), ["episode_id"], "g")


@query(f"""WITH {CHANGES}, seen AS (SELECT DISTINCT episode_id, "start" AS object, g FROM changes WHERE "start" <> 'view'),
cut AS (SELECT *, CASE WHEN g - lag(g) OVER (PARTITION BY episode_id, object ORDER BY g) > 1 THEN 1 ELSE 0 END AS c FROM seen),
runs AS (SELECT *, sum(c) OVER (PARTITION BY episode_id, object ORDER BY g) AS run FROM cut)
SELECT episode_id, object, max(g)::INTEGER AS frame_idx, count(*) AS n FROM runs GROUP BY episode_id, object, run""")
def sg_change_keystates(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = graphs.differences(edges(spark, sf_dir), ["episode_id"], "g")
    return graphs.change_keystates(changes, ["episode_id"], "g", F.col("start") != "view", 1)


@query(f"""WITH {EDGES} SELECT episode_id, g, string_agg(DISTINCT "start" || CASE WHEN edge_type IN ('inside', 'touching') THEN ' is ' ELSE ' ' END || edge_type || ' ' || "end", '; '
  ORDER BY "start" || CASE WHEN edge_type IN ('inside', 'touching') THEN ' is ' ELSE ' ' END || edge_type || ' ' || "end") AS text FROM edges WHERE "start" < "end" GROUP BY 1, 2""")
def sg_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The relations of each group as text, each pair once."""
    words = graphs.sentence(F.col("start"), F.col("edge_type"), F.col("end"))
    found = edges(spark, sf_dir).filter("start < end").groupBy(*GROUP).agg(F.array_sort(F.collect_set(words)).alias("all"))
    return found.select(*GROUP, F.array_join("all", "; ").alias("text"))


@query(f"""WITH {DETS}, groups AS (SELECT episode_id, count(DISTINCT g) AS n FROM dets GROUP BY 1)
SELECT d.episode_id, object, count(DISTINCT g) / any_value(n) AS visible FROM dets d JOIN groups USING (episode_id) GROUP BY 1, 2 HAVING count(DISTINCT g) / any_value(n) > 0.6""")
def visible_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = detections(spark, sf_dir)
    groups = d.groupBy("episode_id").agg(F.countDistinct("g").alias("n"))
    seen = d.groupBy("episode_id", "object").agg(F.countDistinct("g").alias("m")).join(groups, "episode_id")
    share = F.col("m") / F.col("n")
    return seen.filter(share > 0.6).select("episode_id", "object", share.alias("visible"))


@query(f"""WITH {FRAMES} SELECT episode_id, object, avg((k < 50)::INTEGER) AS missing, avg(least(value / 100, 1.0)) AS mean_score
FROM frames GROUP BY 1, 2 HAVING avg((k < 50)::INTEGER) <= 0.5 AND avg(least(value / 100, 1.0)) >= 0.2""")
def clean_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An object's value counts as missing where k is under 50."""
    rows = frames(spark, sf_dir).select("episode_id", "object", F.when(F.col("k") >= 50, F.col("value")).alias("v"), F.least(F.col("value") / 100, F.lit(1.0)).alias("score"))
    kept = dt.clean_objects(rows, ["episode_id", "object"], "v", "score")
    return kept.select("episode_id", "object", "missing", "mean_score")


@query(f"""WITH {FRAMES}, s AS (SELECT episode_id, object, avg(value) - stddev_pop(value) AS c, avg(least(value / 100, 1.0)) AS conf FROM frames GROUP BY 1, 2)
SELECT episode_id, object, CASE WHEN c < 0 THEN conf - 0.25 ELSE conf END AS confidence FROM s""")
def consistency_penalty(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = frames(spark, sf_dir).groupBy("episode_id", "object").agg(
        (F.avg("value") - F.stddev_pop("value")).alias("c"), F.avg(F.least(F.col("value") / 100, F.lit(1.0))).alias("conf")
    )
    return stats.select("episode_id", "object", F.when(F.col("c") < 0, F.col("conf") - 0.25).otherwise(F.col("conf")).alias("confidence"))


@query(f"""WITH {FRAMES}, z AS (SELECT *, coalesce((value - avg(value) OVER p) / nullif(stddev_pop(value) OVER p, 0), 0) AS z FROM frames WHERE value > 1 WINDOW p AS (PARTITION BY episode_id, object))
SELECT episode_id, object, avg(value) AS mean_value, count(*) AS n FROM z WHERE abs(z) <= 2.5 GROUP BY 1, 2""")
def trimmed_mean_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dt.trimmed_mean(frames(spark, sf_dir), ["episode_id", "object"], "value", 1.0, 2.5)


SHORT = f"""{FRAMES}, ends AS (SELECT episode_id, frame_idx AS s, lead(frame_idx) OVER (PARTITION BY episode_id ORDER BY frame_idx) AS e FROM frames WHERE object = 'purchase'),
facts AS (SELECT i.episode_id, i.s, i.e, f.object, abs(arg_max(f.value, f.frame_idx) - arg_min(f.value, f.frame_idx)) AS move, count(*) AS n, max(f.k) AS size
  FROM ends i JOIN frames f ON i.episode_id = f.episode_id AND f.frame_idx BETWEEN i.s AND i.e WHERE i.e IS NOT NULL GROUP BY 1, 2, 3, 4),
scored AS (SELECT *, round(coalesce(move / nullif(max(move) OVER (PARTITION BY episode_id, s), 0), 0) + size / 100.0 + CASE WHEN n >= 2 THEN 0.4 ELSE 0 END + CASE WHEN object = 'error' THEN 0.8 ELSE 0 END, 6) AS score FROM facts),
ranked AS (SELECT *, row_number() OVER (PARTITION BY episode_id, s ORDER BY score DESC, object) AS r FROM scored)"""


@query(f"""WITH {SHORT} SELECT episode_id, s AS "start", e AS "end", object, score FROM ranked WHERE r = 1""")
def short_horizon_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The object of each interval with the best sum of movement, size, relation and state evidence."""
    f = frames(spark, sf_dir)
    ends = f.filter("object = 'purchase'").select("episode_id", F.col("frame_idx").alias("start"), F.lead("frame_idx").over(episode()).alias("end")).filter("end is not null")
    inside = intervals.overlap_join(ends, f.select("episode_id", "frame_idx", "object", "value", "k"), ["episode_id"], ("start", "end"), ("frame_idx", "frame_idx"))
    facts = inside.groupBy("episode_id", "start", "end", "object").agg(
        F.abs(F.max_by("value", "frame_idx") - F.min_by("value", "frame_idx")).alias("move"), F.count("*").alias("n"), F.max("k").alias("size")
    )
    part = Window.partitionBy("episode_id", "start")
    evidence = (
        F.coalesce(F.try_divide(F.col("move"), F.max("move").over(part)), F.lit(0.0))
        + F.col("size") / 100
        + F.when(F.col("n") >= 2, 0.4).otherwise(0.0)
        + F.when(F.col("object") == "error", 0.8).otherwise(0.0)
    )
    scored = facts.withColumn("score", F.round(evidence, 6))
    return dt.best_of(scored, ["episode_id", "start"], "score", "object").select("episode_id", "start", "end", "object", "score")


@query(f"""WITH {FRAMES}, m AS (SELECT episode_id, frame_idx, object, (value - lag(value) OVER w) / 100 AS dx, (k - lag(k) OVER w) / 100.0 AS dy FROM frames WINDOW w AS (PARTITION BY episode_id, object ORDER BY frame_idx))
SELECT episode_id, frame_idx, CASE WHEN coalesce(concat_ws(' and ', CASE WHEN dx > 0.13 THEN 'to the right' WHEN dx < -0.13 THEN 'to the left' END, CASE WHEN dy > 0.221 THEN 'forward' WHEN dy < -0.221 THEN 'backward' END), '') = '' THEN object || ' did not move'
  ELSE object || ' moved ' || concat_ws(' and ', CASE WHEN dx > 0.13 THEN 'to the right' WHEN dx < -0.13 THEN 'to the left' END, CASE WHEN dy > 0.221 THEN 'forward' WHEN dy < -0.221 THEN 'backward' END) END AS phrase FROM m WHERE dx IS NOT NULL""")
def movement_phrase(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("episode_id", "object").orderBy("frame_idx")
    moved = frames(spark, sf_dir).select(
        "episode_id", "frame_idx", "object", ((F.col("value") - F.lag("value").over(w)) / 100).alias("dx"), ((F.col("k") - F.lag("k").over(w)) / 100).alias("dy")
    ).filter("dx is not null")
    # The second component must be 1.7 times as far.
    words = direction_words([(F.col("dx"), "to the right", "to the left"), (F.col("dy") * (0.13 / 0.221), "forward", "backward")], 0.13)
    return moved.select("episode_id", "frame_idx", F.when(words == "", F.concat("object", F.lit(" did not move"))).otherwise(F.concat_ws(" ", "object", F.lit("moved"), words)).alias("phrase"))


@query(f"""WITH {FRAMES}, u AS (SELECT event_id, (value - 50) / sqrt((value - 50) ** 2 + (k - 50) ** 2 + 1) AS x, (k - 50) / sqrt((value - 50) ** 2 + (k - 50) ** 2 + 1) AS y FROM frames)
SELECT event_id, coalesce(nullif(concat_ws(' and ', CASE WHEN y > 0.62 THEN 'above' WHEN y < -0.62 THEN 'below' END, CASE WHEN x > 0.62 THEN 'right of' WHEN x < -0.62 THEN 'left of' END), ''), 'close to') AS relation FROM u""")
def extended_relation(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = F.col("value") - 50, F.col("k") - 50
    length = F.sqrt(x * x + y * y + 1)
    words = direction_words([(y / length, "above", "below"), (x / length, "right of", "left of")], 0.62, " and ", "close to")
    return frames(spark, sf_dir).select("event_id", words.alias("relation"))
