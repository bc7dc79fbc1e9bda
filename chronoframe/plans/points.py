"""Queries on points of space: (k, event_id % 100, value) of a row stands for one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoframe.functions import points as pt
from chronoframe.functions.boxes import camera_point, plane_foot
from chronoframe.operators import clouds, hulls, robust
from chronoframe.operators import detections as dt
from chronoframe.operators.tables import dealt, tasks_for
from chronoframe.plans.geometry import GROUP
from chronoframe.plans.registry import query, tidy
from chronoframe.plans.views import FRAMES, frames, table

SPACE = f"""{FRAMES}, space AS (SELECT event_id, episode_id, (frame_idx // 10)::INTEGER AS g, object, k / 100.0 AS x, (event_id % 100) / 100.0 AS y, value / 100 AS z FROM frames)"""


def space(spark: SparkSession, sf_dir: str, spread: bool = False) -> DataFrame:
    return frames(spark, sf_dir, spread).select(
        "event_id", "episode_id", F.floor(F.col("frame_idx") / 10).cast("int").alias("g"), "object",
        (F.col("k") / 100).alias("x"), ((F.col("event_id") % 100) / 100).alias("y"), (F.col("value") / 100).alias("z"),
    )


PLANE = (0.2, 1.0, -0.4, 0.5)
_FOOT = "(px * 0.2 + py - pz * 0.4 + 0.5) / (0.2 * 0.2 + 1 + 0.4 * 0.4)"


@query(f"""WITH {SPACE}, c AS (SELECT event_id, (x * 100 - 50) * z / 80 AS px, (y * 100 - 50) * z / 60 AS py, z AS pz FROM space)
SELECT event_id, px, py, px - 0.2 * {_FOOT} AS fx, py - {_FOOT} AS fy, pz + 0.4 * {_FOOT} AS fz FROM c""")
def camera_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels with depth in the camera's space, and the foot of each on a plane."""
    s = space(spark, sf_dir)
    p = camera_point(F.col("x") * 100, F.col("y") * 100, F.col("z"), 80.0, 60.0, 50.0, 50.0)
    foot = plane_foot(p, PLANE)
    return s.select("event_id", *(c.alias(n) for n, c in zip(("px", "py", "fx", "fy", "fz"), (*p[:2], *foot), strict=True)))


@query(f"""WITH {SPACE}, a AS (SELECT *, radians(x * 100) AS t, radians(y * 100) AS r FROM space), b AS (SELECT *, y * cos(t) - z * sin(t) AS ty, y * sin(t) + z * cos(t) AS tz FROM a)
SELECT event_id, round(x * cos(r) + tz * sin(r) + 1, 6) AS wx, round(ty + 2, 6) AS wy, round(tz * cos(r) - x * sin(r) + 3, 6) AS wz,
(floor((degrees(acos(greatest(-1, least(1, y / nullif(sqrt(x * x + y * y + z * z), 0)))))) * 10000 + 0.500001) / 10000) AS up FROM b""")
def world_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points seen by a tilted and turned camera in the world; the angle of each, taken as a normal, to the vertical."""
    s = space(spark, sf_dir)
    p = (F.col("x"), F.col("y"), F.col("z"))
    found = pt.world_point(p, F.col("y") * 100, F.col("x") * 100, (1.0, 2.0, 3.0))
    return s.select("event_id", *(F.round(c, 6).alias(n) for n, c in zip(("wx", "wy", "wz"), found, strict=True)), F.round(pt.up_angle(p), 4).alias("up"))


@query(f"""WITH {SPACE}, c AS (SELECT *, radians(x * 100) AS t FROM space), m AS (SELECT event_id, 2 * (z * cos(t) + 2 * sin(t)) + 0.5 AS ax, 2 * y + 0.25 AS ay, 2 * (2 * cos(t) - z * sin(t)) - 1 AS az FROM c)
SELECT event_id, round(ax, 6) AS ax, round(ay, 6) AS ay, round(az, 6) AS az, round((ax * 50 + az * 3 + 5) / (0.1 * az + 9), 6) AS sx, round((ay * 50 + 2) / (0.1 * az + 9), 6) AS sy FROM m""")
def screen_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points turned by a yaw, scaled and shifted through one matrix, then seen through a projection."""
    matrix = pt.rigid_matrix(2.0, pt.yaw_matrix(F.radians(F.col("x") * 100)), [F.lit(0.5), F.lit(0.25), F.lit(-1.0)])
    moved = space(spark, sf_dir).select("event_id", pt.applied(matrix, F.array(F.col("z"), F.col("y"), F.lit(2.0), F.lit(1.0))).alias("m"))
    view = F.array(*(F.array(*map(F.lit, row)) for row in ((50.0, 0.0, 3.0, 5.0), (0.0, 50.0, 0.0, 2.0), (0.0, 0.0, 1.0, 0.0), (0.0, 0.0, 0.1, 9.0))))
    sx, sy = pt.on_screen(view, F.col("m"))
    return moved.select("event_id", *(F.round(F.col("m")[k], 6).alias(n) for k, n in enumerate(("ax", "ay", "az"))), F.round(sx, 6).alias("sx"), F.round(sy, 6).alias("sy"))


def hull_sql(rows: str, keys: str) -> str:
    """CTE ``faces`` of whole points (keys, object, event_id, hx, hy, hz) in ``rows``: all planes through three points of a cloud that has points on one side only."""
    on = lambda a, b: " AND ".join(f"{a}.{k} = {b}.{k}" for k in (*keys.split(", "), "object"))
    own = ", ".join(f"p.{k}" for k in (*keys.split(", "), "object"))
    return f"""planes AS (SELECT {own}, p.hx, p.hy, p.hz, (q.hy - p.hy) * (r.hz - p.hz) - (q.hz - p.hz) * (r.hy - p.hy) AS nx, (q.hz - p.hz) * (r.hx - p.hx) - (q.hx - p.hx) * (r.hz - p.hz) AS ny,
  (q.hx - p.hx) * (r.hy - p.hy) - (q.hy - p.hy) * (r.hx - p.hx) AS nz FROM {rows} p JOIN {rows} q ON {on("p", "q")} AND p.event_id < q.event_id JOIN {rows} r ON {on("p", "r")} AND q.event_id < r.event_id),
sides AS (SELECT {own}, p.hx, p.hy, p.hz, nx, ny, nz, min(nx * (s.hx - p.hx) + ny * (s.hy - p.hy) + nz * (s.hz - p.hz)) AS lo, max(nx * (s.hx - p.hx) + ny * (s.hy - p.hy) + nz * (s.hz - p.hz)) AS hi
  FROM planes p JOIN {rows} s ON {on("p", "s")} GROUP BY ALL),
faces AS (SELECT *, CASE WHEN hi <= 0 THEN 1 ELSE -1 END AS sign FROM sides WHERE lo < hi AND (lo >= 0 OR hi <= 0))"""


WHOLE = f"{SPACE}, whole AS (SELECT *, (x * 100)::DECIMAL(9, 0)::BIGINT AS hx, (y * 100)::DECIMAL(9, 0)::BIGINT AS hy, (z * 10000)::DECIMAL(12, 0)::BIGINT AS hz FROM space)"
HELD = """held AS (SELECT q.event_id, f.object AS a, bool_and(sign * (nx * (q.hx - f.hx) + ny * (q.hy - f.hy) + nz * (q.hz - f.hz)) <= 0) AS held FROM whole q JOIN faces f ON {on} AND f.object <> q.object GROUP BY 1, 2)"""
GAPS = """gaps AS (SELECT p.episode_id, p.g, p.object AS a, q.object AS b, p.event_id, min(sqrt((p.x - q.x) ** 2 + (p.y - q.y) ** 2 + (p.z - q.z) ** 2)) AS gap
  FROM space p JOIN space q ON p.episode_id = q.episode_id AND p.g = q.g AND p.object <> q.object GROUP BY 1, 2, 3, 4, 5),
way AS (SELECT episode_id, g, a, b, sum(gap) AS s, count(*) AS n, min(gap) AS gap FROM gaps GROUP BY 1, 2, 3, 4),
clouds AS (SELECT w.episode_id, w.g, w.a, w.b, (w.s + v.s) / (w.n + v.n) AS mean_gap, w.gap FROM way w JOIN way v ON w.episode_id = v.episode_id AND w.g = v.g AND w.a = v.b AND w.b = v.a)"""


@query(f"WITH {SPACE}, {GAPS} SELECT episode_id, g, a, b, round(mean_gap, 6) AS mean_gap, round(gap, 6) AS gap FROM clouds")
def cloud_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = space(spark, sf_dir, spread=True)
    return clouds.cloud_gaps(s, GROUP, "object", tasks_for(table(spark, sf_dir, "events"))).withColumns({c: F.round(c, 6) for c in ("mean_gap", "gap")})


@query(f"""WITH {WHOLE}, {hull_sql("whole", "episode_id")}, {HELD.format(on="q.episode_id = f.episode_id")},
names AS (SELECT DISTINCT episode_id, object FROM whole), n AS (SELECT episode_id, object, count(*) AS n FROM whole GROUP BY 1, 2)
SELECT n.episode_id, m.object AS a, n.object AS b, coalesce(sum(held::INTEGER), 0)::BIGINT AS n_inside, any_value(n.n) AS n FROM n JOIN names m ON n.episode_id = m.episode_id AND n.object <> m.object
JOIN whole w ON w.episode_id = n.episode_id AND w.object = n.object LEFT JOIN held h ON h.event_id = w.event_id AND h.a = m.object GROUP BY 1, 2, 3""")
def hull_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many points of each object's cloud of an episode lie in the convex hull of each other one's; none in that of a flat cloud."""
    s = space(spark, sf_dir)
    names = s.select("episode_id", F.col("object").alias("a")).distinct()
    faces = hulls.hulls(s, ["episode_id", "object"]).withColumnRenamed("object", "a")
    pairs = s.withColumnRenamed("object", "b").join(names.join(faces, ["episode_id", "a"], "left"), "episode_id").filter("a <> b")
    held = hulls.inside(F.col("faces"), [F.col(c) for c in clouds.AXES])
    return pairs.groupBy("episode_id", "a", "b").agg(F.sum(held.cast("long")).alias("n_inside"), F.count("*").alias("n"))


@query(f"""WITH {WHOLE}, {hull_sql("whole", "episode_id, g")}, {HELD.format(on="q.episode_id = f.episode_id AND q.g = f.g")}, {GAPS}, shape AS (SELECT episode_id, g, object, avg(x) AS mx, avg(y) AS my, avg(z) AS mz, min(x) AS lx, max(x) AS hx, min(z) AS lz, max(z) AS hz FROM space GROUP BY 1, 2, 3),
shares AS (SELECT q.episode_id, q.g, s.object AS a, q.object AS b, avg(coalesce(held, false)::INTEGER) AS inside,
  avg((q.x > lx AND q.x < hx AND q.z > lz AND q.z < hz)::INTEGER) AS over_, avg((q.y > my)::INTEGER) AS above FROM space q JOIN shape s ON q.episode_id = s.episode_id AND q.g = s.g AND q.object <> s.object
  LEFT JOIN held h ON h.event_id = q.event_id AND h.a = s.object GROUP BY 1, 2, 3, 4),
v AS (SELECT c.*, h.inside, h.over_, h.above, u.above AS below, t.mx - s.mx AS vx, t.my - s.my AS vy, t.mz - s.mz AS vz FROM clouds c JOIN shares h ON c.episode_id = h.episode_id AND c.g = h.g AND c.a = h.a AND c.b = h.b
  JOIN shares u ON c.episode_id = u.episode_id AND c.g = u.g AND c.a = u.b AND c.b = u.a
  JOIN shape s ON s.episode_id = c.episode_id AND s.g = c.g AND s.object = c.a JOIN shape t ON t.episode_id = c.episode_id AND t.g = c.g AND t.object = c.b),
n AS (SELECT *, vx / nullif(sqrt(vx * vx + vy * vy + vz * vz), 0) AS nx, vy / nullif(sqrt(vx * vx + vy * vy + vz * vz), 0) AS ny, vz / nullif(sqrt(vx * vx + vy * vy + vz * vz), 0) AS nz FROM v),
typed AS (SELECT *, CASE WHEN gap < 0.2 AND inside > 0.3 THEN 'inside' WHEN gap < 0.2 AND over_ > 0.5 AND above > 0.5 THEN 'on top of' WHEN gap < 0.2 AND over_ > 0.5 AND below > 0.5 THEN 'under' WHEN gap >= 0.5 THEN NULL WHEN nz > 0.9 THEN 'in front of'
  WHEN nx > 0.85 THEN 'right of' WHEN nx < -0.85 THEN 'left of' WHEN ny > 0.85 THEN 'above' WHEN ny < -0.85 THEN 'below'
  ELSE coalesce(nullif(concat_ws(' and ', CASE WHEN ny > 0.62 THEN 'above' WHEN ny < -0.62 THEN 'below' END, CASE WHEN nx > 0.62 THEN 'right of' WHEN nx < -0.62 THEN 'left of' END,
    CASE WHEN nz > 0.62 THEN 'in front of' WHEN nz < -0.62 THEN 'behind of' END), ''), 'close to') END AS edge_type FROM n),
told AS (SELECT episode_id, g, CASE WHEN edge_type = 'under' THEN a ELSE b END AS "start", CASE WHEN edge_type = 'under' THEN b ELSE a END AS "end", edge_type, gap FROM typed WHERE edge_type IS NOT NULL)
SELECT episode_id, g, "start", "end", CASE WHEN bool_or(edge_type = 'under') THEN 'on top of' ELSE any_value(edge_type) END AS edge_type, round(max(gap), 6) AS dist FROM told GROUP BY 1, 2, 3, 4""")
def sg_edges_3d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relations between the clouds of a group's objects."""
    s = space(spark, sf_dir, spread=True)
    return clouds.edges_3d(s, GROUP, "object", 0.2, 0.5, tasks_for(table(spark, sf_dir, "events"))).withColumn("dist", F.round("dist", 6))


@query(f"""WITH {SPACE}, n AS (SELECT episode_id, (x * 100)::INTEGER % 10 AS cell, degrees(acos(greatest(-1, least(1, y / nullif(sqrt(x * x + y * y + z * z), 0))))) < 40 AS ok FROM space)
SELECT episode_id, cell, coalesce(bool_or(ok), false) AS valid FROM n GROUP BY 1, 2""")
def valid_normals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells whose normal is within 40 degrees of the vertical in any frame."""
    s = space(spark, sf_dir).select("episode_id", F.round(F.col("x") * 100).cast("int").alias("k"), (pt.up_angle((F.col("x"), F.col("y"), F.col("z"))) < 40).alias("ok"))
    return s.groupBy("episode_id", (F.col("k") % 10).alias("cell")).agg(F.coalesce(F.max("ok"), F.lit(False)).alias("valid"))


@query(f"""WITH {FRAMES}, c AS (SELECT episode_id, k % 4 AS cell, value FROM frames),
z AS (SELECT *, coalesce((value - avg(value) OVER p) / nullif(stddev_pop(value) OVER p, 0), 0) AS z FROM c WINDOW p AS (PARTITION BY episode_id, cell))
SELECT episode_id, cell, (floor((avg(value)) * 10000 + 0.500001) / 10000) AS mean_value, count(*) AS n FROM z WHERE abs(z) <= 1.2 GROUP BY 1, 2""")
def trimmed_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean of each cell of a transform over its estimates, without those more than 1.2 deviations away."""
    c = frames(spark, sf_dir).select("episode_id", (F.col("k") % 4).alias("cell"), "value")
    return dt.trimmed_mean(c, ["episode_id", "cell"], "value", float("-inf"), 1.2).withColumn("mean_value", tidy("mean_value"))


@query()
def floor_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plane that most points of an episode agree with, and the upright frame on it where it is a floor. Draws go by a hash that SQL lacks."""
    found = robust.robust_planes(space(spark, sf_dir, spread=True), ["episode_id"], 0.05).withColumn("rotation", robust.upright_rotation())
    cells = [F.round(F.get(F.get("rotation", F.lit(i)), F.lit(j)), 6).alias(f"r{i}{j}") for i in range(3) for j in range(3)]
    return found.select("episode_id", *(F.round(c, 6).alias(c) for c in ("nx", "ny", "nz", "d")), "inliers", "n", *cells)


@query()
def trend_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The line that most values of an object agree with over an episode's frames. Draws go by a hash that SQL lacks."""
    f = frames(spark, sf_dir, spread=True).select("episode_id", "object", "frame_idx", "value")
    return robust.robust_lines(dealt(f, ["episode_id", "object"]), ["episode_id", "object"], "frame_idx", "value").select("episode_id", "object", F.round("slope", 6).alias("slope"), F.round("intercept", 6).alias("intercept"), "inliers", "n")
