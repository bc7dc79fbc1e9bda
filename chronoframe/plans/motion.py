"""Queries on movements, gripper relations and their texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronoframe.operators import detections as dt
from chronoframe.operators import graphs, motion, predictors
from chronoframe.plans.detection import TOUCH, distances
from chronoframe.plans.geometry import DETS, GROUP, detections
from chronoframe.plans.registry import query, tidy
from chronoframe.plans.scenes import CHANGES, EDGES, edges
from chronoframe.plans.views import BOXES, episode, FRAMES, boxes, frames, per_object

NODES = f"""{DETS}, ranked AS (SELECT *, row_number() OVER (PARTITION BY episode_id, g, object ORDER BY score DESC, event_id) AS r FROM dets),
nodes AS (SELECT episode_id, g, object, (x1 + x2) / 2 AS cx, (y1 + y2) / 2 AS cy, x1, y1, x2, y2 FROM ranked WHERE r = 1)"""


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = dt.best_of(detections(spark, sf_dir), [*GROUP, "object"], "score", "event_id")
    return best.select(*GROUP, "object", ((F.col("x1") + F.col("x2")) / 2).alias("cx"), ((F.col("y1") + F.col("y2")) / 2).alias("cy"), "x1", "y1", "x2", "y2")


@query(f"""WITH {NODES}, n AS (SELECT episode_id, count(DISTINCT g) AS graphs FROM nodes GROUP BY 1)
SELECT episode_id, object, (floor((avg(cx)) * 10000 + 0.500001) / 10000) AS cx, (floor((avg(cy)) * 10000 + 0.500001) / 10000) AS cy, count(DISTINCT g) / any_value(graphs) > 0.5 AS visible FROM nodes JOIN n USING (episode_id) GROUP BY 1, 2""")
def sg_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of an episode's average graph."""
    found = motion.averaged_nodes(nodes(spark, sf_dir), ["episode_id"], "g", "object", ["cx", "cy"])
    return found.withColumns({c: tidy(c) for c in ("cx", "cy")})


@query(f"""WITH {EDGES}, n AS (SELECT episode_id, least(count(DISTINCT g) // 2, 2) AS least_ FROM edges GROUP BY 1),
c AS (SELECT episode_id, "start", "end", edge_type, count(*) AS n, min(g) AS first FROM edges GROUP BY 1, 2, 3, 4),
r AS (SELECT c.*, row_number() OVER (PARTITION BY c.episode_id, "start", "end" ORDER BY c.n DESC, first, edge_type) AS r FROM c JOIN n ON c.episode_id = n.episode_id WHERE c.n >= least_)
SELECT episode_id, "start", "end", edge_type, n FROM r WHERE r = 1""")
def sg_average_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of an episode's average graph: the most frequent relation of each pair, seen in two graphs (or half of them, if that is less)."""
    return graphs.average_edges(edges(spark, sf_dir), ["episode_id"], "g")


HALVES = f"""{NODES}, mid AS (SELECT episode_id, (min(g) + max(g)) / 2 AS m FROM nodes GROUP BY 1),
a AS (SELECT episode_id, object, avg(cx) AS cx, avg(cy) AS cy FROM nodes JOIN mid USING (episode_id) WHERE g <= m GROUP BY 1, 2),
b AS (SELECT episode_id, object, avg(cx) AS cx, avg(cy) AS cy FROM nodes JOIN mid USING (episode_id) WHERE g > m GROUP BY 1, 2)"""


@query(f"WITH {HALVES} SELECT a.episode_id, a.object, (floor((coalesce(b.cx - a.cx, 0)) * 10000 + 0.500001) / 10000) AS cx, (floor((coalesce(b.cy - a.cy, 0)) * 10000 + 0.500001) / 10000) AS cy FROM a LEFT JOIN b ON a.episode_id = b.episode_id AND a.object = b.object")
def sg_averaged_movement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the average graph of an episode's first half to that of its second."""
    n = nodes(spark, sf_dir)
    whole = Window.partitionBy("episode_id")
    n = n.withColumn("m", (F.min("g").over(whole) + F.max("g").over(whole)) / 2)
    average = lambda rows: motion.averaged_nodes(rows, ["episode_id"], "g", "object", ["cx", "cy"])
    found = motion.movement_between(average(n.filter("g <= m")), average(n.filter("g > m")), ["episode_id"], "object", ["cx", "cy"])
    return found.withColumns({c: tidy(c) for c in ("cx", "cy")})


FLOW = f"""{FRAMES}, v AS (SELECT episode_id, (frame_idx // 10)::INTEGER AS g, object, (value - 50) / 4 AS dx, k / 3.0 - 15 AS dy FROM frames),
z AS (SELECT *, greatest(coalesce(abs((dx - avg(dx) OVER p) / nullif(stddev_pop(dx) OVER p, 0)), 0), coalesce(abs((dy - avg(dy) OVER p) / nullif(stddev_pop(dy) OVER p, 0)), 0)) AS off FROM v WINDOW p AS (PARTITION BY episode_id, g, object)),
flow AS (SELECT episode_id, g, object, floor(avg(dx) * 10000 + 0.500001) / 10000 AS dx, floor(avg(dy) * 10000 + 0.500001) / 10000 AS dy FROM z WHERE off <= 2.0000001 GROUP BY 1, 2, 3)"""


def flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = frames(spark, sf_dir).select("episode_id", F.floor(F.col("frame_idx") / 10).cast("int").alias("g"), "object", ((F.col("value") - 50) / 4).alias("dx"), (F.col("k") / 3 - 15).alias("dy"))
    return motion.trimmed_vectors(v, [*GROUP, "object"], ["dx", "dy"], 2.0000001).withColumns({c: tidy(c) for c in ("dx", "dy")})


@query(f"WITH {FLOW} SELECT episode_id, g, object, dx, dy FROM flow")
def flow_movement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean movement of an object's points without outliers."""
    return flow(spark, sf_dir)


@query(f"""WITH {FLOW}, r AS (SELECT *, row_number() OVER (PARTITION BY episode_id, object ORDER BY round(sqrt(dx * dx + dy * dy), 9) DESC, g) AS r FROM flow)
SELECT episode_id, object, dx, dy FROM r WHERE r = 1""")
def largest_movements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return motion.largest(flow(spark, sf_dir), ["episode_id", "object"], "g", ["dx", "dy"])


@query(f"""WITH {FLOW}, s AS (SELECT episode_id, object, round(sum(sqrt(dx * dx + dy * dy)), 6) AS total FROM flow GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY episode_id ORDER BY total DESC, object) AS r FROM s) SELECT episode_id, object, total FROM r WHERE r = 1""")
def moved_object(spark: SparkSession, sf_dir: str) -> DataFrame:
    return motion.most_moved(flow(spark, sf_dir), ["episode_id"], "object", ["dx", "dy"])


WORDS = """(CASE WHEN dx > 6 THEN object || '(right,' || trunc(dx)::INTEGER || '),' WHEN dx < -6 THEN object || '(left,' || trunc(dx)::INTEGER || '),' ELSE '' END ||
 CASE WHEN dy <= -6 THEN object || '(up,' || trunc(dy)::INTEGER || '),' WHEN dy > 6 THEN object || '(down,' || trunc(dy)::INTEGER || '),' ELSE '' END)"""


@query(f"WITH {FLOW} SELECT episode_id, g, 'Object Movements:' || chr(10) || ' {{' || string_agg({WORDS}, '' ORDER BY object) || '}}' AS text FROM flow GROUP BY 1, 2")
def movement_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = motion.directions(F.col("dx"), F.col("dy"), 6.0)
    return motion.movement_texts(flow(spark, sf_dir), GROUP, "object", moved)


@query(f"WITH {TOUCH} SELECT episode_id, frame_idx, object AS \"start\", 'robot' AS \"end\", 'inside' AS edge_type, distance AS dist FROM distances WHERE distance < 0.02")
def gripper_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return motion.gripper_edges(distances(spark, sf_dir), ["episode_id", "frame_idx"], "object", "distance")


@query(f"""WITH {TOUCH} SELECT episode_id, frame_idx, coalesce(min(object) FILTER (WHERE distance < 0.02), 'nothing') AS held, bool_or(distance < 0.8) AS near FROM distances GROUP BY 1, 2""")
def held_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the gripper holds in each frame, and whether anything is near."""
    return motion.held(distances(spark, sf_dir), ["episode_id", "frame_idx"], "object", "distance")


@query(f"""WITH {TOUCH} SELECT episode_id, frame_idx, 'Distances to Robot Gripper:' || chr(10) || '{{' || string_agg(object || ': ' || (floor(distance * 10 + 0.5) / 10)::DECIMAL(12, 1)::VARCHAR || ',', '' ORDER BY object) || '}}' AS text FROM distances GROUP BY 1, 2""")
def gripper_distance_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return motion.distance_texts(distances(spark, sf_dir), ["episode_id", "frame_idx"], "object", "distance")


@query(f"""WITH {TOUCH}, back AS (SELECT *, dense_rank() OVER (PARTITION BY episode_id ORDER BY frame_idx DESC) AS b, row_number() OVER (PARTITION BY episode_id, frame_idx ORDER BY distance, object) AS r FROM distances),
chosen AS (SELECT episode_id, list(object) FILTER (WHERE r <= 2) AS objects, avg(distance) FILTER (WHERE r = 2) AS second FROM back WHERE b <= 2 GROUP BY 1)
SELECT d.episode_id, object, frame_idx, round(distance, 6) AS distance FROM distances d JOIN chosen c ON d.episode_id = c.episode_id WHERE distance < greatest(second, 30) OR list_contains(objects, object)""")
def close_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return motion.close_objects(distances(spark, sf_dir), "episode_id", "frame_idx", "object", "distance").withColumn("distance", F.round("distance", 6))


@query(f"""WITH {FRAMES} SELECT event_id, value < 0.85 * avg(value) OVER p AS occluded, value > 1.1 * avg(value) OVER p AS noise FROM frames WINDOW p AS (PARTITION BY episode_id, object)""")
def occlusion_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return motion.occlusion(frames(spark, sf_dir), ["episode_id", "object"], "value").select("event_id", "occluded", "noise")


@query(f"""WITH {NODES} SELECT episode_id, g, string_agg(object, ',' ORDER BY object) AS observed, string_agg(object || '=' || trunc(cx)::INTEGER || ':' || trunc(cy)::INTEGER, ';' ORDER BY object) AS positions FROM nodes GROUP BY 1, 2""")
def object_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names and places of a graph's nodes."""
    places = nodes(spark, sf_dir).groupBy(*GROUP).agg(F.array_sort(F.collect_list(F.struct("object", F.struct("cx", "cy").alias("at")))).alias("all"))
    at = F.map_from_entries("all")
    shown = F.transform(F.map_keys(at), lambda n: F.concat(n, F.lit("="), F.element_at(at, n).cx.cast("int").cast("string"), F.lit(":"), F.element_at(at, n).cy.cast("int").cast("string")))
    return places.select(*GROUP, F.array_join(F.map_keys(at), ",").alias("observed"), F.array_join(shown, ";").alias("positions"))


@query(f"""WITH {NODES}, graphs AS (SELECT DISTINCT episode_id, g FROM nodes), names AS (SELECT DISTINCT episode_id, object FROM nodes),
grid AS (SELECT a.episode_id, a.g, b.object, n.cx, n.cy FROM graphs a JOIN names b ON a.episode_id = b.episode_id LEFT JOIN nodes n ON n.episode_id = a.episode_id AND n.g = a.g AND n.object = b.object),
kept AS (SELECT episode_id, g, object, last_value(cx IGNORE NULLS) OVER w AS cx, last_value(cy IGNORE NULLS) OVER w AS cy, cx IS NOT NULL AS visible FROM grid
  WINDOW w AS (PARTITION BY episode_id, object ORDER BY g ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT * FROM kept WHERE cx IS NOT NULL""")
def carried_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return motion.carried_nodes(nodes(spark, sf_dir), "episode_id", "g", "object", ["cx", "cy"])


INTERVALS = f"""{BOXES}, ends AS (SELECT episode_id, frame_idx AS s, lead(frame_idx) OVER (PARTITION BY episode_id ORDER BY frame_idx) AS e FROM boxes WHERE object = 'purchase'),
moves AS (SELECT i.episode_id, i.s, i.e, f.object, arg_max((x1 + x2) / 2, frame_idx) - arg_min((x1 + x2) / 2, frame_idx) AS dx, arg_max((y1 + y2) / 2, frame_idx) - arg_min((y1 + y2) / 2, frame_idx) AS dy
  FROM ends i JOIN boxes f ON i.episode_id = f.episode_id AND f.frame_idx BETWEEN i.s AND i.e WHERE i.e IS NOT NULL GROUP BY 1, 2, 3, 4),
told AS (SELECT *, concat_ws(' and ', CASE WHEN dx > 13 THEN 'to the right' WHEN dx < -13 THEN 'to the left' END, CASE WHEN dy / 1.7 > 13 THEN 'forward' WHEN dy / 1.7 < -13 THEN 'backward' END) AS w FROM moves)"""


@query(f"""WITH {INTERVALS} SELECT episode_id, s AS "start", e AS "end", object, (floor((dx) * 10000 + 0.500001) / 10000) AS dx, (floor((dy) * 10000 + 0.500001) / 10000) AS dy, CASE WHEN w = '' THEN object || ' did not move' ELSE object || ' moved ' || w END AS phrase FROM told""")
def interval_movements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How each object's box moves from one purchase to the next, and what that is called."""
    b = boxes(spark, sf_dir)
    ends = b.filter("object = 'purchase'").select("episode_id", F.col("frame_idx").alias("start"), F.lead("frame_idx").over(episode()).alias("end")).filter("end is not null")
    places = b.select("episode_id", "frame_idx", "object", ((F.col("x1") + F.col("x2")) / 2).alias("x"), ((F.col("y1") + F.col("y2")) / 2).alias("y"))
    found = motion.interval_moves(ends, places, "episode_id", "frame_idx", "object", "x", "y")
    phrase = motion.moved_phrase(F.col("object"), F.col("dx"), F.col("dy"), 13.0)
    return found.select("episode_id", "start", "end", "object", tidy("dx").alias("dx"), tidy("dy").alias("dy"), phrase.alias("phrase"))


@query(f"""WITH {FRAMES}, m AS (SELECT episode_id, frame_idx, object, abs(value - lag(value) OVER (PARTITION BY episode_id ORDER BY frame_idx)) > 30 AS moved FROM frames),
ahead AS (SELECT *, min(CASE WHEN NOT moved THEN frame_idx END) OVER (PARTITION BY episode_id ORDER BY frame_idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS still FROM m)
SELECT episode_id, frame_idx, coalesce(still, frame_idx)::INTEGER AS settled FROM ahead WHERE object = 'purchase'""")
def settled_keystates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases moved on to the first frame at which the value rests."""
    f = frames(spark, sf_dir).withColumn("move", F.abs(F.col("value") - F.lag("value").over(episode())))
    return motion.settled(f.filter("object = 'purchase'").select("episode_id", "frame_idx"), f, "episode_id", "frame_idx", "move", 30.0)


SAID = """"start" || CASE WHEN edge_type IN ('inside', 'touching') THEN ' is ' ELSE ' ' END || edge_type || ' ' || "end" """


@query(f"""WITH {CHANGES}, seen AS (SELECT DISTINCT episode_id, "start" AS object, g FROM changes WHERE "start" <> 'view'),
cut AS (SELECT *, CASE WHEN g - lag(g) OVER (PARTITION BY episode_id, object ORDER BY g) > 1 THEN 1 ELSE 0 END AS c FROM seen),
runs AS (SELECT *, sum(c) OVER (PARTITION BY episode_id, object ORDER BY g) AS run FROM cut),
ks AS (SELECT episode_id, object, max(g)::INTEGER AS f FROM runs GROUP BY episode_id, object, run),
near AS (SELECT k.episode_id, k.object, k.f, e.g > k.f AS final, {SAID} AS w, count(*) AS n FROM ks k JOIN edges e ON e.episode_id = k.episode_id AND e."start" = k.object AND e.g > k.f - 4 AND e.g <= k.f + 4 GROUP BY 1, 2, 3, 4, 5)
SELECT episode_id, object, f AS frame_idx, 'Object relation changes: ' || chr(10) || 'Initial object relations: ' || coalesce(string_agg(w || ',', '' ORDER BY w) FILTER (WHERE n >= 2 AND NOT final), '')
  || chr(10) || 'Final object relations: ' || coalesce(string_agg(w || ',', '' ORDER BY w) FILTER (WHERE n >= 2 AND final), '') || chr(10) AS reason FROM near GROUP BY 1, 2, 3""")
def relation_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What changed at the scene graph's keystates, as text."""
    found = edges(spark, sf_dir)
    ks = graphs.change_keystates(graphs.differences(found, ["episode_id"], "g"), ["episode_id"], "g", F.col("start") != "view", 1)
    return motion.relation_reasons(ks, found, "episode_id", "g", 4, graphs.sentence(F.col("start"), F.col("edge_type"), F.col("end")))


@query(f"""WITH {FRAMES}, c AS (SELECT *, lag(state) OVER (PARTITION BY episode_id ORDER BY frame_idx) AS before, lag(value) OVER (PARTITION BY episode_id ORDER BY frame_idx) AS was FROM frames)
SELECT episode_id, frame_idx, 'object_state' AS predictor, 'State changes: ' || object || ' changed from ' || before || ' to ' || state || chr(10) AS reason FROM c WHERE before <> state
UNION ALL SELECT episode_id, frame_idx, 'gripper_position', 'Gripper proximity: The robot gripper was close to the ' || object FROM c WHERE k < 20
UNION ALL SELECT episode_id, frame_idx, 'object_movement', 'Object movements: The ' || object || ' moved.' FROM c WHERE abs(value - was) > 60""")
def reason_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reasons of three detectors as text."""
    f = frames(spark, sf_dir).withColumn("before", F.lag("state").over(episode())).withColumn("was", F.lag("value").over(episode()))
    kinds = {
        "object_state": (F.col("before") != F.col("state"), predictors.state_reason(F.col("object"), F.col("before"), F.col("state"))),
        "gripper_position": (F.col("k") < 20, predictors.proximity_reason(F.col("object"))),
        "object_movement": (F.abs(F.col("value") - F.col("was")) > 60, predictors.movement_reason(F.col("object"))),
    }
    told = F.explode(F.array(*(F.when(when, F.struct(F.lit(name).alias("predictor"), text.alias("reason"))) for name, (when, text) in kinds.items()))).alias("r")
    return f.select("episode_id", "frame_idx", told).filter("r is not null").select("episode_id", "frame_idx", "r.predictor", "r.reason")


@query(f"""WITH {FRAMES}, d AS (SELECT event_id, (k - lag(k) OVER (PARTITION BY episode_id ORDER BY frame_idx)) / 20.0 AS yaw FROM frames),
w AS (SELECT event_id, atan2(sin(yaw), cos(yaw)) AS y FROM d WHERE yaw IS NOT NULL)
SELECT event_id, CASE WHEN y < -1 THEN 'Gripper rotated right by ' || floor(abs(degrees(y)))::INTEGER || ' degrees' WHEN y > 1 THEN 'Gripper rotated left by ' || floor(abs(degrees(y)))::INTEGER || ' degrees' ELSE 'No rotation' END AS text FROM w""")
def rotation_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes of an angle (k over 20, in radians) as text."""
    turned = frames(spark, sf_dir).select("event_id", ((F.col("k") - F.lag("k").over(episode())) / 20).alias("yaw")).filter("yaw is not null")
    return turned.select("event_id", motion.turned_text(F.col("yaw")).alias("text"))


@query(f"""WITH {EDGES} SELECT episode_id, g, string_agg("start" || ' is ' || edge_type || ' ' || "end" || '.', ' ' ORDER BY "start", "end") AS text FROM edges WHERE "start" < "end" GROUP BY 1, 2""")
def relation_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The relations of each graph as sentences, each pair once."""
    once = motion.without_robot(edges(spark, sf_dir)).filter("start < end")
    said = F.concat("start", F.lit(" is "), "edge_type", F.lit(" "), "end", F.lit("."))
    listed = once.groupBy(*GROUP).agg(F.array_sort(F.collect_list(F.struct("start", "end", said.alias("w")))).alias("all"))
    return listed.select(*GROUP, F.array_join(F.transform("all", lambda a: a.w), " ").alias("text"))


@query(f"""WITH {NODES}, u AS (SELECT DISTINCT episode_id, g, object FROM nodes), graphs AS (SELECT DISTINCT episode_id, g FROM u),
pairs AS (SELECT episode_id, g, lead(g) OVER (PARTITION BY episode_id ORDER BY g) AS next FROM graphs),
e AS (SELECT p.episode_id, p.g, object FROM pairs p JOIN u ON u.episode_id = p.episode_id AND u.g = p.g WHERE next IS NOT NULL),
f AS (SELECT p.episode_id, p.g, object FROM pairs p JOIN u ON u.episode_id = p.episode_id AND u.g = p.next)
SELECT * FROM (SELECT * FROM e EXCEPT SELECT * FROM f) UNION ALL SELECT * FROM (SELECT * FROM f EXCEPT SELECT * FROM e)""")
def sg_node_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes that only one of two neighbouring graphs of an episode has, under the earlier graph's number."""
    return graphs.node_changes(nodes(spark, sf_dir), "episode_id", "g", "object")
