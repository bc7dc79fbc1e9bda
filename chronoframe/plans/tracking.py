"""Queries on votes over frames, key frames by goals, and movements by position."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoframe.operators import buffered, jumps, keyframes
from chronoframe.operators import consensus as cs
from chronoframe.plans.registry import query
from chronoframe.plans.views import BOXES, FRAMES, boxes, frames, table

EVERY, VOTES, LEAST, MISSED = 8, 5, 2, 1


@query(f"""WITH {FRAMES}, ends AS (SELECT episode_id, (max(frame_idx) - {VOTES - 1}) // {EVERY} AS end_ FROM frames GROUP BY 1 HAVING max(frame_idx) >= {VOTES - 1}),
c AS (SELECT episode_id, frame_idx // {EVERY} AS vote, object FROM frames WHERE frame_idx % {EVERY} < {VOTES} GROUP BY 1, 2, 3 HAVING count(DISTINCT frame_idx) >= {LEAST}),
v AS (SELECT c.*, end_, coalesce((vote - lag(vote) OVER w > {MISSED + 1})::INTEGER, 1) AS new_ FROM c JOIN ends USING (episode_id) WHERE vote <= end_ WINDOW w AS (PARTITION BY episode_id, object ORDER BY vote)),
l AS (SELECT *, sum(new_) OVER (PARTITION BY episode_id, object ORDER BY vote) AS life FROM v),
ids AS (SELECT episode_id, object, life, end_, min(vote) AS from_, max(vote) AS to_, {buffered.FIRST_ID - 1} + row_number() OVER (PARTITION BY episode_id ORDER BY min(vote), object) AS id FROM l GROUP BY 1, 2, 3, 4),
alive AS (SELECT *, unnest(range(from_, least(to_ + {MISSED}, end_) + 1)) AS at FROM ids)
SELECT a.episode_id, a.at AS vote, a.object, a.id, row_number() OVER (PARTITION BY a.episode_id, a.at ORDER BY a.id) AS slot, a.at - (SELECT max(vote) FROM l WHERE l.episode_id = a.episode_id AND l.object = a.object AND l.vote <= a.at) AS missed FROM alive a""")
def voted_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The objects alive after each vote over five of every eight frames, with their ids and slots."""
    return buffered.voted_objects(frames(spark, sf_dir), "episode_id", "frame_idx", "object", EVERY, VOTES, LEAST, MISSED)


_BOTH = "(greatest(least(a.x2, b.x2) - greatest(a.x1, b.x1), 0) * greatest(least(a.y2, b.y2) - greatest(a.y1, b.y1), 0))"


@query(f"""WITH RECURSIVE {BOXES}, segs AS (SELECT episode_id, (frame_idx // 16)::INTEGER AS w, (frame_idx // 4)::INTEGER AS f, event_id, score, x1 / 4 AS x1, y1 / 4 AS y1, x1 / 4 + 20 + value / 10 AS x2, y1 / 4 + 15 AS y2 FROM boxes),
pairs AS (SELECT a.episode_id, a.w, a.event_id, b.event_id AS other, a.score, b.score AS other_score, {_BOTH} / ((a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) - {_BOTH}) AS iou
  FROM segs a JOIN segs b ON a.episode_id = b.episode_id AND a.w = b.w AND a.f <> b.f),
nodes AS (SELECT episode_id, w, event_id, round((2 * sum(iou) - 1) / 1e-9)::BIGINT AS weight, list(other) AS others, count(*) AS n, (any_value(score) + sum(other_score)) / (1 + count(*)) AS m FROM pairs WHERE iou > 0.5 GROUP BY 1, 2, 3),
ranked AS (SELECT *, row_number() OVER (PARTITION BY episode_id, w ORDER BY event_id) AS r, count(*) OVER (PARTITION BY episode_id, w) AS n_all FROM nodes WHERE weight > 0),
sets AS (SELECT DISTINCT episode_id, w, 0::BIGINT AS r, n_all, 0::BIGINT AS total, []::BIGINT[] AS chosen FROM ranked
  UNION ALL SELECT s.episode_id, s.w, k.r, s.n_all, s.total + CASE WHEN t.taken THEN k.weight ELSE 0 END, CASE WHEN t.taken THEN list_append(s.chosen, k.event_id) ELSE s.chosen END
  FROM sets s JOIN ranked k ON k.episode_id = s.episode_id AND k.w = s.w AND k.r = s.r + 1, (SELECT unnest([true, false]) AS taken) t WHERE NOT t.taken OR NOT list_has_any(s.chosen, k.others)),
best AS (SELECT episode_id, w, first(chosen ORDER BY total DESC, chosen) AS chosen FROM sets WHERE r = n_all GROUP BY 1, 2)
SELECT n.episode_id, n.w AS "window", n.event_id, n.n AS n_matching, round(m - greatest(0, (0.5 - n.n / 3) * 0.2), 6) AS score FROM best b JOIN nodes n ON n.episode_id = b.episode_id AND n.w = b.w AND list_contains(b.chosen, n.event_id)""")
def segment_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The segments that stand for windows of four pictures with four boxes each."""
    x, y, idx = F.col("x1") / 4, F.col("y1") / 4, F.col("frame_idx")
    found = boxes(spark, sf_dir).select(
        "episode_id", F.floor(idx / 16).cast("int").alias("window"), F.floor(idx / 4).cast("int").alias("f"), "event_id", "score",
        x.alias("x1"), y.alias("y1"), (x + 20 + F.col("value") / 10).alias("x2"), (y + 15).alias("y2"),
    )
    kept = cs.consensus(found, ["episode_id", "window"], "f", "event_id", "score", 4)
    return kept.withColumn("score", F.round("score", 6))


@query()
def key_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Key frames of episodes of a hundred neighbouring embeddings, by goals."""
    e = table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 100).alias("episode"), (F.col("vec_id") % 100).alias("frame"), "embedding")
    return keyframes.key_frames(e, "episode", "frame", "embedding").withColumn("distance", F.round("distance", 6))


TRACK = f"""{BOXES}, t AS (SELECT episode_id, object, frame_idx, row_number() OVER w - 1 AS i, (x1 + x2) / 2 AS x, (y1 + y2) / 2 AS y, (x2 - x1) * (y2 - y1) AS area, x1, y1, x2, y2 FROM boxes WINDOW w AS (PARTITION BY episode_id, object ORDER BY frame_idx)),
d AS (SELECT *, coalesce(abs(lead(area) OVER w / area - 1) > {jumps.CHANGE}, false) OR area < {jumps.SHARE} * avg(area) OVER (PARTITION BY episode_id, object) AS doubtful FROM t WINDOW w AS (PARTITION BY episode_id, object ORDER BY i)),
k AS (SELECT *, last_value(CASE WHEN NOT doubtful THEN i END IGNORE NULLS) OVER (PARTITION BY episode_id, object ORDER BY i) AS bi, first_value(CASE WHEN NOT doubtful THEN i END IGNORE NULLS) OVER (PARTITION BY episode_id, object ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ai FROM d),
p AS (SELECT k.*, coalesce(b.x, a.x) + (coalesce(a.x, b.x) - coalesce(b.x, a.x)) * coalesce((k.i - bi) / nullif(ai - bi, 0), 0) AS px, coalesce(b.y, a.y) + (coalesce(a.y, b.y) - coalesce(b.y, a.y)) * coalesce((k.i - bi) / nullif(ai - bi, 0), 0) AS py
  FROM k LEFT JOIN t b ON b.episode_id = k.episode_id AND b.object = k.object AND b.i = k.bi LEFT JOIN t a ON a.episode_id = k.episode_id AND a.object = k.object AND a.i = k.ai),
s AS (SELECT *, coalesce((lag(px) OVER w + px + lead(px) OVER w) / 3, px) AS sx, coalesce((lag(py) OVER w + py + lead(py) OVER w) / 3, py) AS sy FROM p WINDOW w AS (PARTITION BY episode_id, object ORDER BY i)),
g AS (SELECT *, CASE WHEN sqrt((lead(sx) OVER w - sx) ** 2 + (lead(sy) OVER w - sy) ** 2) < {jumps.REST * 100} THEN i END AS still FROM s WHERE sx IS NOT NULL WINDOW w AS (PARTITION BY episode_id, object ORDER BY i)),
r AS (SELECT *, coalesce(first_value(still IGNORE NULLS) OVER (PARTITION BY episode_id, object ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), max(i) OVER (PARTITION BY episode_id, object)) AS rest FROM g),
both_ AS (SELECT a.*, b.sx AS rx, b.sy AS ry, b.frame_idx AS rest_frame, greatest(least(a.x2, b.x2) - greatest(a.x1, b.x1), 0) * greatest(least(a.y2, b.y2) - greatest(a.y1, b.y1), 0) AS both, b.area AS r_area FROM r a JOIN r b ON a.episode_id = b.episode_id AND a.object = b.object AND b.i = a.rest),
walk AS (SELECT episode_id, object, i, sx AS lx, sy AS ly, -1::BIGINT AS until, NULL::INTEGER AS found FROM both_ WHERE i = 0
  UNION ALL SELECT episode_id, object, i, CASE WHEN jump THEN rx ELSE lx END, CASE WHEN jump THEN ry ELSE ly END, CASE WHEN jump AND NOT same THEN rest ELSE until END, CASE WHEN jump AND NOT same THEN rest_frame END
  FROM (SELECT b.*, w.lx, w.ly, w.until, w.until < b.i AND (b.sx - w.lx) ** 2 + (b.sy - w.ly) ** 2 > ({jumps.JUMP} * 100.0) ** 2 AS jump, coalesce(b.both / nullif(b.area + b.r_area - b.both, 0) > {jumps.SAME}, false) AS same
    FROM walk w JOIN both_ b ON b.episode_id = w.episode_id AND b.object = w.object AND b.i = w.i + 1)),
found AS (SELECT episode_id, object, found AS frame_idx FROM walk WHERE found IS NOT NULL),
flow AS (SELECT episode_id, object, frame_idx, score FROM boxes WHERE value > 100)"""


@query(f"""WITH RECURSIVE {TRACK}, c AS (SELECT f.*, o.frame_idx AS fl, o.score, min(o.frame_idx - f.frame_idx) OVER (PARTITION BY f.episode_id, f.object, f.frame_idx) AS gap,
  row_number() OVER (PARTITION BY f.episode_id, f.object, f.frame_idx ORDER BY abs(o.frame_idx - f.frame_idx), o.frame_idx) AS r FROM found f LEFT JOIN flow o ON o.episode_id = f.episode_id AND o.object = f.object),
n AS (SELECT episode_id, object, frame_idx, CASE WHEN gap < {jumps.NEAR} THEN fl END AS fl, score FROM c WHERE r = 1)
SELECT episode_id, object, coalesce((fl + frame_idx) // 2, frame_idx)::BIGINT AS frame_idx, round(CASE WHEN fl IS NULL THEN {jumps.ALONE} ELSE score + {jumps.MATCHED} * row_number() OVER (PARTITION BY episode_id, object, fl ORDER BY frame_idx) END, 6) AS score FROM n
UNION ALL SELECT episode_id, object, frame_idx::BIGINT, round(score, 6) FROM flow f WHERE NOT EXISTS (SELECT 1 FROM found o WHERE o.episode_id = f.episode_id AND o.object = f.object)""")
def position_movements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Movement keystates of each object from its boxes' places, merged with those of large values."""
    b = boxes(spark, sf_dir)
    x, y = (F.col("x1") + F.col("x2")) / 2, (F.col("y1") + F.col("y2")) / 2
    track = b.select("episode_id", "object", "frame_idx", x.alias("x"), y.alias("y"), ((F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))).alias("area"), "x1", "y1", "x2", "y2")
    found = jumps.position_jumps(track, ["episode_id", "object"], "frame_idx", "x", "y", "area", F.lit(100.0))
    flow = b.filter("value > 100").select("episode_id", "object", "frame_idx", "score")
    return jumps.merged_keystates(found, flow, ["episode_id", "object"], "frame_idx", "score").withColumn("score", F.round("score", 6))
