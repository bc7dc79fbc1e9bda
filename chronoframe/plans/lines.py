"""Queries on line segments: a detection's diagonal stands for a line."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronoframe.functions import lines as ln
from chronoframe.functions.boxes import angle_between, line_polar, wrapped
from chronoframe.operators import detections as dt
from chronoframe.operators.groups import clusters
from chronoframe.plans.geometry import DETS, GROUP, detections
from chronoframe.plans.registry import query


def _line(prefix: str = "") -> ln.Line:
    return tuple(F.col(f"{prefix}{c}") for c in ("x1", "y1", "x2", "y2"))


def _length(p: str) -> str:
    return f"sqrt(({p}x2 - {p}x1) ** 2 + ({p}y2 - {p}y1) ** 2)"


def _gap(x: str, y: str, p: str) -> str:
    u = f"greatest(0.0, least(1.0, (({x} - {p}x1) * ({p}x2 - {p}x1) + ({y} - {p}y1) * ({p}y2 - {p}y1)) / nullif(({p}x2 - {p}x1) ** 2 + ({p}y2 - {p}y1) ** 2, 0)))"
    return f"sqrt(({x} - {p}x1 - {u} * ({p}x2 - {p}x1)) ** 2 + ({y} - {p}y1 - {u} * ({p}y2 - {p}y1)) ** 2)"


def _near(a: str, b: str) -> str:
    return f"least({_gap(f'{a}x1', f'{a}y1', b)}, {_gap(f'{a}x2', f'{a}y2', b)}, {_gap(f'{b}x1', f'{b}y1', a)}, {_gap(f'{b}x2', f'{b}y2', a)})"


def _turn(a: str, b: str) -> str:
    return f"abs(atan2({a}y2 - {a}y1, {a}x2 - {a}x1) - atan2({b}y2 - {b}y1, {b}x2 - {b}x1))"


def _score(length_a: str, length_b: str, turn: str, near: str) -> str:
    return f"CASE WHEN {near} > 20 THEN 0 ELSE 0.1 * (1 - abs({length_a} - {length_b}) / 1000) + 0.6 * (1 - (CASE WHEN {turn} > pi() THEN 2 * pi() - {turn} ELSE {turn} END) / pi()) + 0.3 * (1 - {near} / 40) END"


@query(f"""WITH {DETS}, p AS (SELECT *, y2 - y1 AS a, x1 - x2 AS b, (y2 - y1) * x1 + (x1 - x2) * y1 AS c, {_length('')} AS len FROM dets),
m AS (SELECT *, ((50 - (x1 + x2) / 2) * (-(y2 - y1) / len) + (50 - (y1 + y2) / 2) * ((x2 - x1) / len)) AS far FROM p)
SELECT event_id, round(len, 6) AS length, round(atan2(y2 - y1, x2 - x1), 6) AS angle, round(abs(c) / sqrt(a * a + b * b), 6) AS r, round(atan2(b, a), 6) AS theta,
round(x1 - (y2 - y1) / len * far, 6) AS mx, round(y1 + (x2 - x1) / len * far, 6) AS my, round(atan2(sin(k), cos(k)), 6) AS wrapped, round(acos((x2 - x1) / len), 6) AS to_x FROM m""")
def line_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length, direction, normal form, the line moved through (50, 50), an angle brought home, the angle to the x axis."""
    a = _line()
    r, theta = line_polar(*a)
    moved = ln.moved_through(a, F.lit(50.0), F.lit(50.0))
    to_x = angle_between([a[2] - a[0], a[3] - a[1]], [F.lit(1.0), F.lit(0.0)])
    found = {"length": ln.length(a), "angle": ln.orientation(a), "r": r, "theta": theta, "mx": moved[0], "my": moved[1], "wrapped": wrapped(F.col("x1")), "to_x": to_x}
    return detections(spark, sf_dir).select("event_id", *(F.round(c, 6).alias(n) for n, c in found.items()))


COMPARED = f"""pairs AS (SELECT a.event_id, b.event_id AS other, {_length('a.')} AS la, {_length('b.')} AS lb, {_turn('a.', 'b.')} AS turn, {_near('a.', 'b.')} AS near,
  greatest(0, least(a.x2, b.x2) + 2 - greatest(a.x1, b.x1) + 2) AS ox, greatest(0, least(a.y2, b.y2) + 2 - greatest(a.y1, b.y1) + 2) AS oy
  FROM dets a JOIN dets b ON a.episode_id = b.episode_id AND a.g = b.g AND a.event_id < b.event_id)"""


@query(f"""WITH {DETS}, {COMPARED} SELECT event_id, other, round({_score('la', 'lb', 'turn', 'near')}, 6) AS agreement, round(near, 6) AS proximity, round((ox + oy) / (2 * greatest(la, lb)), 6) AS overlap FROM pairs WHERE near <= 30""")
def line_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = detections(spark, sf_dir).select(*GROUP, "event_id", "x1", "y1", "x2", "y2")
    pairs = d.join(d.select(*GROUP, *(F.col(c).alias(f"r_{c}") for c in ("event_id", "x1", "y1", "x2", "y2"))), GROUP).filter("event_id < r_event_id")
    a, b = _line(), _line("r_")
    near = pairs.withColumn("near", ln.proximity(a, b)).filter("near <= 30")
    return near.select(
        "event_id", F.col("r_event_id").alias("other"), F.round(ln.agreement(a, b, 1000.0, 40.0), 6).alias("agreement"), F.round("near", 6).alias("proximity"),
        F.round(ln.overlap_share(a, b, 2.0), 6).alias("overlap"),
    )


@query(f"""WITH {DETS}, ranked AS (SELECT *, row_number() OVER (PARTITION BY episode_id, g ORDER BY score DESC, event_id) AS r FROM dets),
hulls AS (SELECT episode_id, g, unnest([[x1, y1, x2, y1], [x2, y1, x2, y2], [x2, y2, x1, y2], [x1, y2, x1, y1]]) AS e FROM ranked WHERE r = 1),
edges AS (SELECT episode_id, g, e[1] AS x1, e[2] AS y1, e[3] AS x2, e[4] AS y2 FROM hulls),
pairs AS (SELECT a.episode_id, a.g, a.event_id, {_length('a.')} AS la, {_length('b.')} AS lb, {_turn('a.', 'b.')} AS turn, {_near('a.', 'b.')} AS near FROM ranked a JOIN edges b ON a.episode_id = b.episode_id AND a.g = b.g WHERE a.r > 1),
best AS (SELECT episode_id, g, event_id, round(max({_score('la', 'lb', 'turn', 'near')}), 6) AS score FROM pairs GROUP BY 1, 2, 3)
SELECT episode_id, g, event_id, score, row_number() OVER (PARTITION BY episode_id, g ORDER BY score DESC, event_id)::INTEGER AS rank FROM best""")
def line_hull_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines by their best match with an edge of the outline of their group's best detection."""
    d = detections(spark, sf_dir).select(*GROUP, "event_id", "score", "x1", "y1", "x2", "y2")
    best = dt.best_of(d, GROUP, "score", "event_id").select(*GROUP, F.col("event_id").alias("hull"), *(F.col(c).alias(f"h_{c}") for c in ("x1", "y1", "x2", "y2")))
    x1, y1, x2, y2 = _line("h_")
    match = ln.hull_match(_line(), [(x1, y1), (x2, y1), (x2, y2), (x1, y2)])
    scored = d.drop("score").join(best, GROUP).filter("event_id <> hull").select(*GROUP, "event_id", F.round(match, 6).alias("score"))
    rank = F.row_number().over(Window.partitionBy(*GROUP).orderBy(F.desc("score"), "event_id"))
    return scored.withColumn("rank", rank)


@query(f"""WITH {DETS}, c AS (SELECT episode_id, g, event_id, (x1 + x2) / 2 AS x, (y1 + y2) / 2 AS y FROM dets),
m AS (SELECT *, avg(x) OVER (PARTITION BY episode_id, g) AS mx, avg(y) OVER (PARTITION BY episode_id, g) AS my FROM c)
SELECT event_id, row_number() OVER (PARTITION BY episode_id, g ORDER BY round(atan2(y - my, x - mx), 6), event_id)::INTEGER AS turn FROM m""")
def clockwise_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Centres of a group in the order of their angles about their mean."""
    c = detections(spark, sf_dir).select(*GROUP, "event_id", ((F.col("x1") + F.col("x2")) / 2).alias("x"), ((F.col("y1") + F.col("y2")) / 2).alias("y"))
    whole = Window.partitionBy(*GROUP)
    angle = F.atan2(F.col("y") - F.avg("y").over(whole), F.col("x") - F.avg("x").over(whole))
    turned = c.withColumn("angle", F.round(angle, 6))
    return turned.select("event_id", F.row_number().over(whole.orderBy("angle", "event_id")).alias("turn"))


POLAR = """polar AS (SELECT episode_id, g, event_id, x1, y1, x2, y2, abs((y2 - y1) * x1 + (x1 - x2) * y1) / sqrt((y2 - y1) ** 2 + (x1 - x2) ** 2) / 200 AS r, atan2(x1 - x2, y2 - y1) / pi() AS t FROM dets),
near AS (SELECT a.episode_id, a.g, a.event_id AS a, b.event_id AS b FROM polar a JOIN polar b ON a.episode_id = b.episode_id AND a.g = b.g AND a.event_id <> b.event_id AND sqrt((a.r - b.r) ** 2 + (a.t - b.t) ** 2) <= 0.05),
reached AS (SELECT episode_id, g, event_id AS a, event_id AS b FROM polar UNION SELECT r.episode_id, r.g, r.a, n.b FROM reached r JOIN near n ON r.b = n.a),
labels AS (SELECT a AS event_id, min(b) AS cluster, count(*) AS n FROM reached GROUP BY 1)"""


def clustered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(group, event_id, the line, cluster): lines alike in normal form (distance over 200 pixels, angle over pi)."""
    d = detections(spark, sf_dir).select(*GROUP, "event_id", "x1", "y1", "x2", "y2")
    r, theta = line_polar(*_line())
    return clusters(d.withColumns({"r": r / 200, "t": theta / np.pi}), GROUP, "event_id", ["r", "t"], 0.05, 2)


@query(f"WITH RECURSIVE {DETS}, {POLAR} SELECT event_id, CASE WHEN n > 1 THEN cluster ELSE -1 END AS cluster FROM labels")
def line_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Density clusters of a group's lines, two at least; -1 for those alone."""
    return clustered(spark, sf_dir).select("event_id", "cluster")


@query(f"""WITH RECURSIVE {DETS}, {POLAR}, ends AS (SELECT p.episode_id, p.g, l.cluster, unnest([p.x1, p.x2]) AS x, unnest([p.y1, p.y2]) AS y FROM polar p JOIN labels l ON p.event_id = l.event_id WHERE l.n > 1),
fits AS (SELECT episode_id, g, cluster, regr_slope(y, x) AS slope, regr_intercept(y, x) AS icept FROM ends GROUP BY 1, 2, 3),
ranked AS (SELECT *, row_number() OVER (PARTITION BY episode_id, g ORDER BY round(abs(atan(slope)), 6), cluster) AS r FROM fits WHERE slope IS NOT NULL)
SELECT episode_id, g, cluster, round(slope, 6) AS slope, round(icept, 4) AS intercept FROM ranked WHERE r = 1""")
def flattest_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the lines fitted to the ends of each cluster's segments, the one nearest to the horizontal."""
    return dt.flattest(clustered(spark, sf_dir).filter("cluster >= 0"), GROUP, "cluster").select(*GROUP, "cluster", F.round("slope", 6).alias("slope"), F.round("intercept", 4).alias("intercept"))


@query(f"""WITH {DETS}, c AS (SELECT episode_id, g, event_id, (x1 + x2) / 2 AS x, (y1 + y2) / 2 AS y FROM dets), l AS (SELECT *, 0 AS x1, 0 AS y1, 100 AS x2, 100 AS y2 FROM c),
near AS (SELECT * FROM l WHERE {_gap('x', 'y', '')} < 8)
SELECT a.episode_id, a.g, round(max(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2)), 6) AS extent, count(DISTINCT a.event_id) AS n FROM near a JOIN near b ON a.episode_id = b.episode_id AND a.g = b.g GROUP BY 1, 2""")
def points_near_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Centres near the diagonal of the picture, and the greatest distance between two of a group."""
    c = detections(spark, sf_dir).select(*GROUP, "event_id", ((F.col("x1") + F.col("x2")) / 2).alias("x"), ((F.col("y1") + F.col("y2")) / 2).alias("y"))
    diagonal = tuple(F.lit(v) for v in (0.0, 0.0, 100.0, 100.0))
    near = c.filter(ln.point_gap(F.col("x"), F.col("y"), diagonal) < 8)
    return dt.extents(near, GROUP, "event_id").select(*GROUP, F.round("extent", 6).alias("extent"), "n")
