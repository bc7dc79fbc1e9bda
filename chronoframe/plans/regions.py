"""Queries on boxes, masks and proposals of a picture."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoframe.functions import boxes as bx
from chronoframe.functions import masks
from chronoframe.operators import detections as dt
from chronoframe.operators import nearest, neighbours
from chronoframe.plans.geometry import AREA, DETS, encoded, GROUP, IOU, RLE, detections
from chronoframe.plans.registry import query, tidy
from chronoframe.plans.views import BOXES, FRAMES, boxes, frames

CROP, WHOLE = (0.0, 0.0, 60.0, 60.0), (0.0, 0.0, 150.0, 150.0)
_SIDES = " OR ".join(f"(abs({s} - {c}) <= 20 AND NOT abs({s} - {w}) <= 20)" for s, c, w in zip(("x1", "y1", "x2", "y2"), CROP, WHOLE, strict=True))


@query(f"""WITH {BOXES} SELECT event_id, x2 - x1 AS w, y2 - y1 AS h, x1 + 5 AS ux1, y1 + 7 AS uy1, x2 + 5 AS ux2, y2 + 7 AS uy2, greatest(x1 - 3, 0) AS px1, least(y2 + 3, 90) AS py2, ({_SIDES}) AS near_edge,
round((x1 + x2) / 2, 6) AS cx, trunc(x2)::INTEGER - trunc(x1)::INTEGER + 1 AS cut_w, trunc(y2)::INTEGER - trunc(y1)::INTEGER + 1 AS cut_h FROM boxes""")
def box_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes as place and size and back, moved out of a crop, with a margin, near the crop's edge, and the cells they cut from a grid."""
    b = bx.box()
    size = bx.to_xywh(b)
    again = bx.from_xywh(size)
    out = bx.shifted(again, F.lit(5.0), F.lit(7.0))
    wide = bx.padded(b, 3.0, F.lit(150.0), F.lit(90.0))
    fixed = lambda values: tuple(map(F.lit, values))
    cells = bx.cells_of(b)
    return boxes(spark, sf_dir).select(
        "event_id", size[2].alias("w"), size[3].alias("h"), *(c.alias(n) for c, n in zip(out, ("ux1", "uy1", "ux2", "uy2"), strict=True)), wide[0].alias("px1"), wide[3].alias("py2"),
        bx.near_crop_edge(b, fixed(CROP), fixed(WHOLE)).alias("near_edge"), F.round(bx.centre(b)[0], 6).alias("cx"), cells[0].alias("cut_w"), cells[1].alias("cut_h"),
    )


@query("""WITH l AS (SELECT unnest([1, 2]) AS layer), n AS (SELECT layer, 2 ** layer AS n, floor(0.34 * 80 * 2 / (2 ** layer)) AS shared FROM l),
s AS (SELECT *, ceil((shared * (n - 1) + 120) / n) AS w, ceil((shared * (n - 1) + 80) / n) AS h FROM n),
t AS (SELECT layer, i * (w - shared) AS x, j * (h - shared) AS y, w, h FROM s, (SELECT unnest(range(4)) AS i), (SELECT unnest(range(4)) AS j) WHERE i < n AND j < n)
SELECT 0::INTEGER AS layer, 0::INTEGER AS x1, 0::INTEGER AS y1, 120::INTEGER AS x2, 80::INTEGER AS y2
UNION ALL SELECT layer::INTEGER, x::INTEGER, y::INTEGER, least(x + w, 120)::INTEGER, least(y + h, 80)::INTEGER FROM t""")
def crop_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping tiles of a picture on two layers."""
    return spark.createDataFrame(masks.crop_boxes(120, 80, 2, 0.34), "layer int, x1 int, y1 int, x2 int, y2 int")


@query(f"""WITH {RLE}, m AS (SELECT episode_id, min(frame_idx // 8) FILTER (WHERE bit) AS x1, min(frame_idx % 8) FILTER (WHERE bit) AS y1, max(frame_idx // 8) FILTER (WHERE bit) AS x2, max(frame_idx % 8) FILTER (WHERE bit) AS y2,
  string_agg(bit::INTEGER::VARCHAR, '' ORDER BY frame_idx) AS bits FROM bits GROUP BY 1)
SELECT episode_id, coalesce(x1, 0)::BIGINT AS x1, coalesce(y1, 0)::BIGINT AS y1, coalesce(x2, 0)::BIGINT AS x2, coalesce(y2, 0)::BIGINT AS y2, bits FROM m""")
def mask_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The box around a run-length mask of 8 rows, column after column, from its runs; and its pixels."""
    found = encoded(spark, sf_dir).select("episode_id", masks.rle_box(F.col("counts"), 8).alias("b"), F.array_join(masks.rle_decoded(F.col("counts")).cast("array<string>"), "").alias("bits"))
    return found.select("episode_id", *(F.col("b")[n].alias(n) for n in ("x1", "y1", "x2", "y2")), "bits")


@query(f"""WITH {FRAMES} SELECT episode_id, object, count(*) FILTER (WHERE value > 60) / nullif(count(*) FILTER (WHERE value > 20), 0) AS stability FROM frames GROUP BY 1, 2""")
def mask_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels above the higher limit for each above the lower one."""
    return masks.stability(frames(spark, sf_dir), ["episode_id", "object"], "value", 40.0, 20.0)


@query(f"WITH {FRAMES} SELECT episode_id, k % 10 AS cell, avg((value > 40)::INTEGER) > 0.6 AS agreed FROM frames GROUP BY 1, 2")
def mask_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels that most of an episode's masks hold."""
    f = frames(spark, sf_dir).withColumn("cell", F.col("k") % 10)
    return masks.agreement(f, ["episode_id", "cell"], F.col("value") > 40, 0.6)


@query(f"""WITH {FRAMES}, p AS (SELECT DISTINCT episode_id, object, k FROM frames), s AS (SELECT episode_id, object, count(*) AS n FROM p GROUP BY 1, 2),
i AS (SELECT a.episode_id, a.object AS a, b.object AS b, count(*) AS both_ FROM p a JOIN p b ON a.episode_id = b.episode_id AND a.k = b.k AND a.object < b.object GROUP BY 1, 2, 3)
SELECT x.episode_id, x.object AS a, y.object AS b, coalesce(both_, 0) / (x.n + y.n - coalesce(both_, 0)) AS iou FROM s x JOIN s y ON x.episode_id = y.episode_id AND x.object < y.object
LEFT JOIN i ON i.episode_id = x.episode_id AND i.a = x.object AND i.b = y.object""")
def mask_iou(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlap of the masks of an episode's objects (the distinct k of each)."""
    sets = frames(spark, sf_dir).groupBy("episode_id", "object").agg(F.collect_set("k").alias("m"))
    pairs = sets.withColumnRenamed("object", "a").join(sets.select("episode_id", F.col("object").alias("b"), F.col("m").alias("r")), "episode_id").filter("a < b")
    return pairs.select("episode_id", "a", "b", masks.set_iou(F.col("m"), F.col("r")).alias("iou"))


PIXELS = f"""{FRAMES}, pixels AS (SELECT DISTINCT episode_id, object, k AS x, (event_id % 100)::INTEGER AS y FROM frames)"""


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames(spark, sf_dir).select("episode_id", "object", F.col("k").alias("x"), (F.col("event_id") % 100).cast("int").alias("y")).distinct()


@query(f"""WITH {PIXELS} SELECT DISTINCT a.episode_id, a.object AS a, b.object AS b FROM pixels a JOIN pixels b ON a.episode_id = b.episode_id AND a.object < b.object AND abs(a.x - b.x) <= 4 AND abs(a.y - b.y) <= 4""")
def mask_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects whose masks meet when both are widened by two pixels."""
    return nearest.contacts(pixels(spark, sf_dir), "episode_id", "object", 4)


@query(f"""WITH {PIXELS} SELECT a.episode_id, a.object AS a, b.object AS b, round(min(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2)), 6) AS gap FROM pixels a JOIN pixels b ON a.episode_id = b.episode_id AND a.object < b.object GROUP BY 1, 2, 3""")
def mask_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The least distance between the pixels of two objects."""
    p = pixels(spark, sf_dir)
    return neighbours.least_gaps(p, ["episode_id"], "object", ("x", "y")).filter("a < b").withColumn("gap", F.round("gap", 6))


@query(f"""WITH {PIXELS}, d AS (SELECT *, row_number() OVER (PARTITION BY episode_id, object ORDER BY (x - 50) ** 2 + (y - 50) ** 2, x, y) AS r FROM pixels) SELECT episode_id, object, x, y FROM d WHERE r = 1""")
def closest_pixel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pixel of each mask that is nearest to (50, 50)."""
    return nearest.closest(pixels(spark, sf_dir), ["episode_id", "object"], F.lit(50), F.lit(50))


CELLS = f"""{FRAMES}, cells AS (SELECT DISTINCT episode_id, (event_id % 10)::INTEGER AS y, (k // 10)::INTEGER AS x FROM frames WHERE value > 30),
reached AS (SELECT episode_id, x, y, x AS u, y AS v FROM cells UNION SELECT r.episode_id, r.x, r.y, c.x, c.y FROM reached r JOIN cells c ON r.episode_id = c.episode_id AND abs(r.u - c.x) <= 1 AND abs(r.v - c.y) <= 1),
parts AS (SELECT episode_id, x, y, min(v * 10 + u) AS part, count(*) AS n FROM reached GROUP BY 1, 2, 3),
most AS (SELECT *, max(n) OVER (PARTITION BY episode_id) AS top, min(CASE WHEN n >= 3 THEN 1 ELSE 2 END) OVER (PARTITION BY episode_id) AS small FROM parts),
first AS (SELECT *, min(CASE WHEN n = top THEN part END) OVER (PARTITION BY episode_id) AS best FROM most)"""


@query(f"WITH RECURSIVE {CELLS} SELECT episode_id, y * 10 + x AS cell, part, n >= 3 OR (small = 2 AND part = best) AS kept FROM first")
def mask_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of a 10 by 10 mask that hang together, by their first cell, and which of them are no small islands."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        mask = np.zeros((10, 10), bool)
        mask[pdf.y, pdf.x] = True
        label, kept = masks.components(mask), masks.without_small_regions(mask, 3)
        cell = np.flatnonzero(mask.ravel())
        own = label.ravel()[cell]
        first = pd.Series(cell).groupby(own).transform("min")
        return pd.DataFrame({"episode_id": pdf.episode_id.iloc[0], "cell": cell.astype(np.int32), "part": first.to_numpy(np.int32), "kept": kept.ravel()[cell]})

    f = frames(spark, sf_dir).filter("value > 30").select("episode_id", (F.col("event_id") % 10).cast("int").alias("y"), F.floor(F.col("k") / 10).cast("int").alias("x")).distinct()
    return f.groupBy("episode_id").applyInPandas(run, "episode_id long, cell int, part int, kept boolean")


GREEDY = """walk AS (
  SELECT episode_id, g, rn, [{{'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}}] AS kept, true AS stays, event_id, score FROM ordered WHERE rn = 1
  UNION ALL
  SELECT o.episode_id, o.g, o.rn, CASE WHEN {free} THEN list_append(w.kept, {{'x1': o.x1, 'y1': o.y1, 'x2': o.x2, 'y2': o.y2}}) ELSE w.kept END, {free}, o.event_id, o.score
  FROM walk w JOIN ordered o ON o.episode_id = w.episode_id AND o.g = w.g AND o.rn = w.rn + 1)"""
_BOTH = "(greatest(least(b.x2, o.x2) - greatest(b.x1, o.x1), 0) * greatest(least(b.y2, o.y2) - greatest(b.y1, o.y1), 0))"
_SIZE = "((b.x2 - b.x1) * (b.y2 - b.y1) + (o.x2 - o.x1) * (o.y2 - o.y1))"


def _greedy(threshold: float) -> str:
    return GREEDY.format(free=f"len(list_filter(w.kept, lambda b: {_BOTH} / ({_SIZE} - {_BOTH}) > {threshold})) = 0")


@query(f"""WITH RECURSIVE {DETS}, ordered AS (SELECT *, row_number() OVER (PARTITION BY episode_id, g ORDER BY score DESC, event_id) AS rn FROM dets), {_greedy(0.2)}
SELECT episode_id, g, event_id, score FROM walk WHERE stays""")
def nms_per_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dt.nms(detections(spark, sf_dir), GROUP, "event_id", 0.2).select(*GROUP, "event_id", "score")


@query(f"""WITH RECURSIVE {DETS}, ordered AS (SELECT *, row_number() OVER (PARTITION BY episode_id, g ORDER BY event_id) AS rn FROM dets), {_greedy(0.3)},
led AS (SELECT d.* FROM dets d JOIN walk w ON d.event_id = w.event_id WHERE w.stays),
pairs AS (SELECT a.episode_id, a.g, a.event_id AS leader, b.event_id, ({IOU}) / ({AREA.format("a")} + {AREA.format("b")} - ({IOU})) AS iou FROM led a JOIN dets b ON a.episode_id = b.episode_id AND a.g = b.g)
SELECT episode_id, g, leader, event_id FROM pairs WHERE iou > 0.3""")
def proposal_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proposals gathered under those that come first and overlap them."""
    return dt.proposal_groups(detections(spark, sf_dir), GROUP, "event_id", 0.3)


@query(f"""WITH {DETS}, pts AS (SELECT episode_id, g, (x1 + x2) / 2 AS x, (y1 + y2) / 2 AS y, score AS affinity FROM dets),
s AS (SELECT d.episode_id, d.g, d.event_id, d.score, {AREA.format('d')} AS size, sum(CASE WHEN p.x BETWEEN d.x1 AND d.x2 AND p.y BETWEEN d.y1 AND d.y2 AND p.affinity >= 0.2 THEN p.affinity ELSE 0 END) AS total
  FROM dets d JOIN pts p ON d.episode_id = p.episode_id AND d.g = p.g GROUP BY 1, 2, 3, 4, 5)
SELECT episode_id, g, event_id, round((2 * coalesce(total / nullif(size, 0), 0) + score) / 3, 6) AS dense FROM s""")
def dense_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections scored by the dense affinity in their boxes."""
    d = detections(spark, sf_dir)
    points = d.select(*GROUP, ((F.col("x1") + F.col("x2")) / 2).alias("x"), ((F.col("y1") + F.col("y2")) / 2).alias("y"), F.col("score").alias("affinity"))
    return dt.dense_scores(d, points, GROUP, "event_id").withColumn("dense", F.round("dense", 6))


@query(f"""WITH {DETS}, best AS (SELECT *, row_number() OVER (PARTITION BY episode_id, g, object ORDER BY score DESC, event_id) AS r FROM dets), n AS (SELECT * FROM best WHERE r = 1),
p AS (SELECT a.episode_id, a.g, a.object AS ours, b.object AS news, coalesce(({IOU}) / nullif({AREA.format("a")} + {AREA.format("b")} - ({IOU}), 0), 0) AS iou FROM n a JOIN n b ON a.episode_id = b.episode_id AND a.g + 1 = b.g),
q AS (SELECT *, row_number() OVER (PARTITION BY episode_id, g, ours ORDER BY round(iou, 9) DESC, news) AS r1, row_number() OVER (PARTITION BY episode_id, g, news ORDER BY round(iou, 9) DESC, ours) AS r2 FROM p WHERE iou > 0.1),
m AS (SELECT episode_id, g, ours, news FROM q WHERE r1 = 1 AND r2 = 1)
SELECT episode_id, g, ours, news, 'matched' AS outcome FROM m
UNION ALL SELECT n.episode_id, n.g, n.object, NULL, 'unmatched' FROM n WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.episode_id = n.episode_id AND m.g = n.g AND m.ours = n.object)
UNION ALL SELECT n.episode_id, n.g - 1, NULL, n.object, 'new' FROM n WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.episode_id = n.episode_id AND m.g = n.g - 1 AND m.news = n.object)""")
def segment_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of each group matched with those of the next."""
    best = dt.best_of(detections(spark, sf_dir), [*GROUP, "object"], "score", "event_id")
    return dt.mutual_matches(best, best.withColumn("g", F.col("g") - 1), GROUP, "object", 0.1)


@query(f"""WITH {DETS} SELECT DISTINCT a.episode_id, a.g, a.event_id FROM dets a JOIN dets b ON a.episode_id = b.episode_id AND a.g = b.g
WHERE {AREA.format('b')} > {AREA.format('a')} AND ({IOU}) / nullif({AREA.format('a')}, 0) > 0.8""")
def contained_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections that lie in a larger one of their group."""
    return dt.contained(detections(spark, sf_dir), GROUP, "event_id").select(*GROUP, "event_id")


@query(f"""WITH {DETS}, m AS (SELECT object, avg(score) AS m FROM dets GROUP BY 1) SELECT event_id, round((score + m) / 2, 6) AS score FROM dets JOIN m USING (object)""")
def blended_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A detection's score and its class's (the mean over all) in equal parts."""
    d = detections(spark, sf_dir)
    classes = d.groupBy("object").agg(F.avg("score").alias("class_score"))
    return d.join(F.broadcast(classes), "object").select("event_id", F.round((F.col("score") + F.col("class_score")) / 2, 6).alias("score"))


@query(f"""WITH {DETS}, a AS (SELECT *, {AREA.format('dets')} AS size FROM dets),
s AS (SELECT episode_id, g, max(score) FILTER (WHERE object = 'view') AS top, arg_min(size, event_id) FILTER (WHERE object = 'view') AS first FROM a GROUP BY 1, 2),
o AS (SELECT *, row_number() OVER (PARTITION BY episode_id, g ORDER BY score DESC, event_id) AS r FROM a WHERE object <> 'view' AND size > 60)
SELECT s.episode_id, s.g, CASE WHEN first > 20 THEN top ELSE 0 END AS surface_score, o.object AS "other" FROM s LEFT JOIN o ON o.episode_id = s.episode_id AND o.g = s.g AND o.r = 1""")
def surface_object(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a frame shows its surface, and what else might be it (a picture of 100 pixels)."""
    return dt.surface_choice(detections(spark, sf_dir), GROUP, "object", "view", 100.0)


@query(f"""WITH {DETS}, r AS (SELECT *, row_number() OVER (PARTITION BY episode_id, g, object ORDER BY score DESC, event_id) AS r FROM dets), n AS (SELECT episode_id, count(DISTINCT g) AS frames_ FROM dets GROUP BY 1)
SELECT r.episode_id, object, floor((avg(score) * 0.5 + avg({AREA.format('r')}) / 2000 * 0.5 + count(*) / any_value(frames_) * 0.1) * 10000 + 0.500001) / 10000 AS score FROM r JOIN n ON r.episode_id = n.episode_id WHERE r = 1 GROUP BY 1, 2""")
def surface_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well each class serves as an episode's surface."""
    best = dt.best_of(detections(spark, sf_dir), [*GROUP, "object"], "score", "event_id")
    return dt.surface_prompts(best, ["episode_id"], "g", "object", 2000.0).withColumn("score", tidy("score"))


@query(f"""WITH {DETS}, s AS (SELECT *, {AREA.format('dets')} AS size FROM dets), m AS (SELECT *, max(size) OVER (PARTITION BY episode_id, g) AS most FROM s),
r AS (SELECT *, row_number() OVER (PARTITION BY episode_id, g ORDER BY round(score + 0.5 * coalesce(size / nullif(most, 0), 0), 9) DESC, event_id) AS r FROM m)
SELECT episode_id, (floor((avg(x1)) * 10000 + 0.500001) / 10000) AS x1, (floor((avg(y1)) * 10000 + 0.500001) / 10000) AS y1, (floor((avg(x2)) * 10000 + 0.500001) / 10000) AS x2, (floor((avg(y2)) * 10000 + 0.500001) / 10000) AS y2 FROM r WHERE r = 1 GROUP BY 1 HAVING avg(most) >= 50""")
def surface_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean box of an episode's surface, by score and size (a picture of 100 pixels)."""
    return dt.surface_boxes(detections(spark, sf_dir), ["episode_id"], "g", 100.0).withColumns({c: tidy(c) for c in ("x1", "y1", "x2", "y2")})


@query()
def class_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes that appear together, gathered greedily (one row for each class of a group)."""
    d = detections(spark, sf_dir)
    pairs = dt.conditional(dt.cooccurrence(d, GROUP, "object"), d, GROUP, "object")
    # A vocabulary's pairs are few.
    found = dt.final_groups([(r.a, r.b, r.p) for r in pairs.collect()], 0.6)
    return spark.createDataFrame([(k, c) for k, group in enumerate(found) for c in group], "number int, object string")
