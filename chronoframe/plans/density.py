"""Queries on density clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronoframe.operators.density import density_clusters
from chronoframe.operators.fixed import fixed_boxes
from chronoframe.plans.registry import query, tidy
from chronoframe.plans.views import BOXES, boxes, table


def _members(keys: str, axes: str, eps: float) -> str:
    """CTEs from t (keys, u, axes, least) to members (keys, u, cluster), by all pairs."""
    same = lambda a, b: " AND ".join(f"{a}.{k} = {b}.{k}" for k in keys.split(", "))
    of = lambda a: ", ".join(f"{a}.{k}" for k in keys.split(", "))
    gap = " + ".join(f"(a.{c} - b.{c}) * (a.{c} - b.{c})" for c in axes.split(", "))
    return f"""near AS (SELECT {of("a")}, a.u, b.u AS v, a.least FROM t a JOIN t b ON {same("a", "b")} AND sqrt({gap}) <= {eps}),
cores AS (SELECT {keys}, u FROM near GROUP BY {keys}, u HAVING count(*) >= any_value(least)),
links AS (SELECT n.* FROM near n JOIN cores c ON {same("n", "c")} AND n.u = c.u JOIN cores d ON {same("n", "d")} AND n.v = d.u),
reached AS (SELECT {keys}, u, u AS v FROM cores UNION SELECT {of("r")}, r.u, l.v FROM reached r JOIN links l ON {same("r", "l")} AND r.v = l.u),
named AS (SELECT {keys}, u, min(v) AS cluster FROM reached GROUP BY {keys}, u),
members AS (SELECT * FROM named UNION ALL SELECT {of("n")}, n.u, min(d.cluster) FROM near n JOIN named d ON {same("n", "d")} AND n.v = d.u
  WHERE NOT EXISTS (SELECT 1 FROM cores c WHERE {same("n", "c")} AND n.u = c.u) GROUP BY {of("n")}, n.u)"""


_BOX = "{'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2, 'score': score}"
_BOTH = "(greatest(least(b.x2, m.x2) - greatest(b.x1, m.x1), 0) * greatest(least(b.y2, m.y2) - greatest(b.y1, m.y1), 0))"


@query(f"""WITH RECURSIVE {BOXES}, a AS (SELECT *, (x2 - x1) * (y2 - y1) AS size FROM boxes), s AS (SELECT * FROM a WHERE size < 80),
shape AS (SELECT episode_id, object, min(size) FILTER (WHERE size < 80) AS lo, max(size) FILTER (WHERE size < 80) AS hi, avg(size) FILTER (WHERE size < 80) AS mean, stddev_pop(size) FILTER (WHERE size < 80) AS sd,
  arg_min({_BOX}, frame_idx) FILTER (WHERE size < 80) AS head FROM a GROUP BY 1, 2),
usual AS (SELECT s.* FROM s JOIN shape USING (episode_id, object) WHERE lo < hi AND abs(size - mean) < 2.5 * sd),
counted AS (SELECT episode_id, object, count(*) AS n, arg_min({_BOX}, frame_idx) AS kept FROM usual GROUP BY 1, 2),
t AS (SELECT u.episode_id, u.object, v.try, u.frame_idx AS u, u.x1, u.y1, u.x2, u.y2, u.score, (x1 + x2) / 2 AS mx, (y1 + y2) / 2 AS my, CASE v.try WHEN 0 THEN greatest(2, least(n // 6, 10)) ELSE greatest(2, n // 7) END AS least
  FROM usual u JOIN counted USING (episode_id, object), (VALUES (0), (1)) v(try)), {_members("episode_id, object, try", "mx, my", 8.0)},
every AS (SELECT episode_id, object, try, cluster, trunc(round(avg(x1), 6)) AS x1, trunc(round(avg(y1), 6)) AS y1, trunc(round(avg(x2), 6)) AS x2, trunc(round(avg(y2), 6)) AS y2, avg(score) AS score, count(*) AS n FROM members JOIN t USING (episode_id, object, try, u) GROUP BY 1, 2, 3, 4),
means AS (SELECT * FROM (SELECT *, min(try) OVER (PARTITION BY episode_id, object) AS used FROM every) WHERE try = used),
worths AS (SELECT *, round(score + n / max(n) OVER (PARTITION BY episode_id, object), 9) AS worth FROM means),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY episode_id, object ORDER BY worth DESC, cluster) AS r FROM worths) WHERE r = 1),
wide AS (SELECT b.episode_id, b.object, min(m.x1) AS x1, min(m.y1) AS y1, max(m.x2) AS x2, max(m.y2) AS y2 FROM best b JOIN means m ON b.episode_id = m.episode_id AND b.object = m.object
  WHERE b.object = 'view' AND {_BOTH} / nullif((b.x2 - b.x1) * (b.y2 - b.y1) + (m.x2 - m.x1) * (m.y2 - m.y1) - {_BOTH}, 0) > 0.15 GROUP BY 1, 2),
ends AS (SELECT b.episode_id, b.object, {{'x1': least(b.x1, w.x1), 'y1': least(b.y1, w.y1), 'x2': greatest(b.x2, w.x2), 'y2': greatest(b.y2, w.y2), 'score': b.score}} AS b FROM best b LEFT JOIN wide w USING (episode_id, object)),
f AS (SELECT s.episode_id, s.object, coalesce(CASE WHEN lo = hi THEN head END, ends.b, kept, {{'x1': 0.0, 'y1': 0.0, 'x2': 0.0, 'y2': 0.0, 'score': 0.0}}) AS b FROM shape s LEFT JOIN counted USING (episode_id, object) LEFT JOIN ends USING (episode_id, object))
SELECT episode_id, object, b.x1 AS x1, b.y1 AS y1, floor(b.x2 * 10000 + 0.500001) / 10000 AS x2, b.y2 AS y2, floor(b.score * 10000 + 0.500001) / 10000 AS score FROM f""")
def fixed_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One box for each object of an episode, as if none moved (a picture of 100 pixels and an extent of 200); views are drawers."""
    found = fixed_boxes(boxes(spark, sf_dir), ["episode_id", "object"], "frame_idx", "score", 200.0, 100.0, F.col("object") == "view")
    return found.withColumns({"x2": tidy("x2"), "score": tidy("score")})


@query(f"""WITH RECURSIVE v AS (SELECT label, vec_id AS u, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z FROM embeddings),
l AS (SELECT *, sqrt(x * x + y * y + z * z) AS d FROM v), t AS (SELECT label, u, x / d AS x, y / d AS y, z / d AS z, 4 AS least FROM l WHERE d > 0), {_members("label", "x, y, z", 0.35)},
sizes AS (SELECT label, cluster, count(*) AS n FROM members GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY n DESC, cluster)::INTEGER AS place FROM sizes) SELECT * FROM r WHERE place <= 3""")
def normal_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three largest clusters of the directions (of three components) of each label's vectors: a scene's planes by their normals."""
    x = [F.get("embedding", k).cast("double") for k in range(3)]
    length = F.sqrt(x[0] * x[0] + x[1] * x[1] + x[2] * x[2])
    units = table(spark, sf_dir, "embeddings").select("label", "vec_id", *(F.try_divide(v, length).alias(n) for v, n in zip(x, "xyz", strict=True)))
    sizes = density_clusters(units, ["label"], "vec_id", ["x", "y", "z"], 0.35, 4).filter("cluster >= 0").groupBy("label", "cluster").agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy("label").orderBy(F.desc("n"), "cluster"))
    return sizes.withColumn("place", place).filter("place <= 3")
