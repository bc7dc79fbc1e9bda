"""Queries on boxes and masks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronoframe.functions import boxes as bx
from chronoframe.functions import masks, rle
from chronoframe.operators import detections as dt
from chronoframe.plans.registry import query
from chronoframe.plans.views import BOXES, FRAMES, boxes, frames

GROUP = ["episode_id", "g"]
DETS = f"""{BOXES}, dets AS (SELECT *, (frame_idx // 10)::INTEGER AS g FROM boxes)"""
IOU = """greatest(least(a.x2, b.x2) - greatest(a.x1, b.x1), 0) * greatest(least(a.y2, b.y2) - greatest(a.y1, b.y1), 0)"""
AREA = "(greatest({0}.x2 - {0}.x1, 0) * greatest({0}.y2 - {0}.y1, 0))"
PAIRS = f"""pairs AS (SELECT a.episode_id, a.g, a.event_id, a.object, b.event_id AS other, b.object AS other_object, b.score AS other_score,
  coalesce(({IOU}) / nullif({AREA.format("a")} + {AREA.format("b")} - ({IOU}), 0), 0) AS iou FROM dets a JOIN dets b ON a.episode_id = b.episode_id AND a.g = b.g)"""


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes in groups of ten frames, as if each group were one frame with many detections."""
    return boxes(spark, sf_dir).withColumn("g", F.floor(F.col("frame_idx") / 10).cast("int")).select(
        *GROUP, "event_id", "frame_idx", "object", "x1", "y1", "x2", "y2", "score"
    )


@query(f"""WITH {DETS}, {PAIRS}, r AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY round(iou, 9) DESC, other) AS r FROM pairs WHERE object <> other_object)
SELECT episode_id, g, event_id, other AS "match", round(iou, 6) AS iou FROM r WHERE r = 1""")
def iou_best_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = detections(spark, sf_dir)
    return dt.best_match(d, d, GROUP, "event_id", F.col("object") != F.col("r_object")).withColumn("iou", F.round("iou", 6))


@query(f"""WITH {DETS}, {PAIRS}, boosted AS (SELECT event_id, max(CASE WHEN other <> event_id THEN struct_pack(i := round(iou, 9), n := -other) END) AS b FROM pairs GROUP BY event_id)
SELECT d.event_id, round(CASE WHEN b.i >= 0.5 THEN d.score + 0.2 * o.score ELSE d.score END, 6) AS score FROM dets d JOIN boosted ON d.event_id = boosted.event_id LEFT JOIN dets o ON o.event_id = -b.n""")
def objectness_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A detection that overlaps a proposal by half or more gains a fifth of the best one's score."""
    d = detections(spark, sf_dir)
    pairs = dt.overlaps(d, d, GROUP)
    best = F.max(F.when(F.col("r_event_id") != F.col("event_id"), F.struct(F.round("iou", 9).alias("i"), (-F.col("r_event_id")).alias("n"), F.col("r_score").alias("s"))))
    found = pairs.groupBy("event_id", "score").agg(best.alias("b"))
    return found.select("event_id", F.round(F.when(F.col("b.i") >= 0.5, F.col("score") + 0.2 * F.col("b.s")).otherwise(F.col("score")), 6).alias("score"))


@query(f"""WITH {DETS}, {PAIRS}, best AS (SELECT *, row_number() OVER (PARTITION BY episode_id, g, object ORDER BY score DESC, event_id) AS r FROM dets),
hit AS (SELECT DISTINCT p.event_id, p.object FROM pairs p JOIN best b ON p.other = b.event_id AND b.r = 1 WHERE p.object <> p.other_object AND p.iou > 0.2)
SELECT object, count(*) AS n FROM hit GROUP BY object""")
def high_overlap_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = detections(spark, sf_dir)
    best = dt.best_of(d, [*GROUP, "object"], "score", "event_id")
    hit = dt.overlaps(d, best, GROUP).filter("object <> r_object and iou > 0.2").select("event_id", "object").distinct()
    return hit.groupBy("object").agg(F.count("*").alias("n"))


@query(f"""WITH {DETS}, {PAIRS} SELECT d.event_id, d.episode_id, d.g FROM dets d
WHERE NOT EXISTS (SELECT 1 FROM pairs p WHERE p.event_id = d.event_id AND p.other <> d.event_id AND p.iou >= 0.1)""")
def undetected_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = detections(spark, sf_dir)
    return dt.undetected(d, d, GROUP, "event_id", 0.1).select("event_id", *GROUP)


@query(f"""WITH {DETS}, r AS (SELECT *, row_number() OVER (PARTITION BY episode_id, g, object ORDER BY score DESC, event_id) AS r FROM dets)
SELECT episode_id, g, object, event_id, score FROM r WHERE r = 1""")
def best_per_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dt.best_of(detections(spark, sf_dir), [*GROUP, "object"], "score", "event_id").select(*GROUP, "object", "event_id", "score")


@query(f"""WITH {DETS}, best AS (SELECT episode_id, g, object, max(score) AS best FROM dets GROUP BY 1, 2, 3),
means AS (SELECT object, sum(best) / (SELECT count(*) FROM (SELECT DISTINCT episode_id, g FROM dets)) AS m FROM best GROUP BY object),
lim AS (SELECT least(min(m) - 0.07, 0.35) AS l FROM (SELECT m FROM means ORDER BY m DESC LIMIT 5))
SELECT object, m AS mean_score FROM means, lim WHERE m > l""")
def class_confidence_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dt.class_gate(detections(spark, sf_dir), GROUP, "object", "score")


@query(f"""WITH {DETS}, sums AS (SELECT episode_id, object, round(sum(score) / 20, 6) AS s FROM dets GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER w AS rank, max(s) OVER (PARTITION BY episode_id) AS top FROM sums WINDOW w AS (PARTITION BY episode_id ORDER BY s DESC, object))
SELECT episode_id, object, s AS total, rank::INTEGER AS rank FROM r WHERE rank <= 3 AND s >= top - 0.5""")
def synonyms_top3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three best classes of an episode, as far as they are within half of the best."""
    sums = detections(spark, sf_dir).groupBy("episode_id", "object").agg(F.round(F.sum("score") / 20, 6).alias("total"))
    top = dt.top_k(sums, ["episode_id"], "total", 3, "object")
    best = F.max("total").over(Window.partitionBy("episode_id"))
    return top.withColumn("best", best).filter("total >= best - 0.5").select("episode_id", "object", "total", F.col("rank").cast("int").alias("rank"))


SEEN = f"""{DETS}, seen AS (SELECT DISTINCT episode_id, g, object FROM dets),
co AS (SELECT a.object AS a, b.object AS b, count(*) AS n FROM seen a JOIN seen b ON a.episode_id = b.episode_id AND a.g = b.g AND a.object <> b.object GROUP BY 1, 2)"""


@query(f"WITH {SEEN} SELECT a, b, n FROM co")
def cooccurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dt.cooccurrence(detections(spark, sf_dir), GROUP, "object")


@query(f"WITH {SEEN}, ap AS (SELECT object AS a, count(*) AS n_a FROM seen GROUP BY 1) SELECT co.a, b, n / n_a AS p FROM co JOIN ap ON co.a = ap.a")
def cooccurrence_prob(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = detections(spark, sf_dir)
    return dt.conditional(dt.cooccurrence(d, GROUP, "object"), d, GROUP, "object")


H = [0.9, 0.1, 5.0, -0.05, 1.1, 3.0, 0.0001, 0.0002, 1.0]


def _corner(x: str, y: str, row: int) -> str:
    return f"({H[3 * row]} * {x} + {H[3 * row + 1]} * {y} + {H[3 * row + 2]}) / ({H[6]} * {x} + {H[7]} * {y} + {H[8]})"


_ALL = [[_corner(x, y, r) for x in ("x1", "x2") for y in ("y1", "y2")] for r in (0, 1)]


@query(f"""WITH {BOXES} SELECT event_id, trunc(least({", ".join(_ALL[0])}))::INTEGER AS tx1, trunc(least({", ".join(_ALL[1])}))::INTEGER AS ty1,
trunc(greatest({", ".join(_ALL[0])}))::INTEGER AS tx2, trunc(greatest({", ".join(_ALL[1])}))::INTEGER AS ty2 FROM boxes""")
def homography_bbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bx.transformed(bx.box(), H)
    return boxes(spark, sf_dir).select("event_id", *(c.alias(n) for c, n in zip(found, ("tx1", "ty1", "tx2", "ty2"), strict=True)))


@query(f"""WITH {BOXES}, s AS (SELECT *, min(x1) OVER p AS sx1, min(y1) OVER p AS sy1, max(x2) OVER p AS sx2, max(y2) OVER p AS sy2 FROM boxes WINDOW p AS (PARTITION BY episode_id)),
c AS (SELECT event_id, ((x1 + x2) / 2 - sx1) / (sx2 - sx1) AS u, ((y1 + y2) / 2 - sy1) / (sy2 - sy1) AS v FROM s)
SELECT event_id, (CASE WHEN v < 1/3 THEN 'back' WHEN v > 2/3 THEN 'front' ELSE 'middle' END) || ' ' || (CASE WHEN u < 1/3 THEN 'left' WHEN u > 2/3 THEN 'right' ELSE 'center' END) AS place FROM c""")
def position_on_surface(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = Window.partitionBy("episode_id")
    b = boxes(spark, sf_dir).select("event_id", "episode_id", "x1", "y1", "x2", "y2")
    surface = tuple(f(c).over(part) for f, c in ((F.min, "x1"), (F.min, "y1"), (F.max, "x2"), (F.max, "y2")))
    b = b.withColumns(dict(zip(("sx1", "sy1", "sx2", "sy2"), surface, strict=True)))
    return b.select("event_id", bx.grid_cell(bx.box(), bx.box("s")).alias("place"))


@query("SELECT (k // 10)::INTEGER AS cell_x, floor(value / 50)::INTEGER AS cell_y, count(*) AS n FROM (SELECT json_extract_string(props, '$.k')::INTEGER AS k, value FROM events) GROUP BY 1, 2")
def occupancy_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = frames(spark, sf_dir).select(F.floor(F.col("k") / 10).cast("int").alias("cell_x"), F.floor(F.col("value") / 50).cast("int").alias("cell_y"))
    return cells.groupBy("cell_x", "cell_y").agg(F.count("*").alias("n"))


RLE = f"""{BOXES}, bits AS (SELECT episode_id, frame_idx, gripper < 0 AS bit FROM boxes),
changed AS (SELECT *, CASE WHEN bit = lag(bit) OVER (PARTITION BY episode_id ORDER BY frame_idx) THEN 0 ELSE 1 END AS c FROM bits),
runs AS (SELECT *, sum(c) OVER (PARTITION BY episode_id ORDER BY frame_idx) AS island FROM changed),
counts AS (SELECT episode_id, island, bit, count(*) AS n FROM runs GROUP BY 1, 2, 3),
rle AS (SELECT episode_id, CASE WHEN arg_min(bit, island) THEN '0,' ELSE '' END || string_agg(n::VARCHAR, ',' ORDER BY island) AS counts, coalesce(sum(n) FILTER (WHERE bit), 0)::BIGINT AS area FROM counts GROUP BY episode_id)"""


def encoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    bits = frames(spark, sf_dir).select("episode_id", "frame_idx", (F.col("gripper") < 0).alias("bit"))
    return masks.rle_encoded(bits, ["episode_id"], "frame_idx", "bit")


@query(f"WITH {RLE} SELECT episode_id, counts FROM rle")
def rle_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(spark, sf_dir).select("episode_id", F.array_join(F.col("counts").cast("array<string>"), ",").alias("counts"))


LISTS = f"""{RLE}, lists AS (SELECT episode_id, list_transform(string_split(counts, ','), lambda n: n::BIGINT) AS c FROM rle)"""
_SIZE = " + ".join(f"(d < -{1 << rle.BITS * n - 1} OR d >= {1 << rle.BITS * n - 1})::INTEGER" for n in range(1, 6))


@query(f"""WITH {LISTS}, diffs AS (SELECT episode_id, i, CASE WHEN i > 3 THEN c[i] - c[i - 2] ELSE c[i] END AS d FROM lists, LATERAL (SELECT unnest(range(1, len(c) + 1)) AS i) t),
sized AS (SELECT *, {_SIZE} + 1 AS size FROM diffs),
chars AS (SELECT episode_id, i, list_aggregate(list_transform(range(0, size), lambda k: chr((((d >> (k * {rle.BITS})::INTEGER) & 31) + CASE WHEN k < size - 1 THEN {rle.MORE} ELSE 0 END + {rle.FIRST})::INTEGER)), 'string_agg', '') AS t FROM sized)
SELECT episode_id, string_agg(t, '' ORDER BY i) AS text, (SELECT array_to_string(c, ',') FROM lists l WHERE l.episode_id = chars.episode_id) AS counts FROM chars GROUP BY 1""")
def compressed_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each episode's mask as compressed text, and the run lengths read back from it."""
    texts = encoded(spark, sf_dir).select("episode_id", rle.compressed(F.col("counts")).alias("text"))
    back = rle.decompressed(texts, ["episode_id"], "text")
    return texts.join(back, "episode_id").select("episode_id", "text", F.array_join(F.col("counts").cast("array<string>"), ",").alias("counts"))


@query(f"""WITH {FRAMES}, m AS (SELECT episode_id, frame_idx AS p, (gripper < 0)::INTEGER AS bit FROM frames), n AS (SELECT episode_id, (max(p) // 5 + 1)::INTEGER AS w FROM m GROUP BY 1),
cells AS (SELECT episode_id, w, unnest(range(0, (w + 4) * 9)) AS q FROM n),
bits AS (SELECT c.episode_id, q, coalesce(m.bit, 0) AS bit FROM cells c LEFT JOIN m ON m.episode_id = c.episode_id AND q % 9 BETWEEN 2 AND 6 AND q // 9 >= 1 AND m.p = (q // 9 - 1) * 5 + q % 9 - 2),
i AS (SELECT *, sum(c) OVER (PARTITION BY episode_id ORDER BY q) AS island FROM (SELECT *, CASE WHEN bit = lag(bit) OVER (PARTITION BY episode_id ORDER BY q) THEN 0 ELSE 1 END AS c FROM bits)),
r AS (SELECT episode_id, island, count(*) AS n FROM i GROUP BY 1, 2)
SELECT episode_id, string_agg(n::VARCHAR, ',' ORDER BY island) AS counts FROM r GROUP BY 1""")
def uncropped_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each episode's mask as a crop of five rows, in a picture with a margin of two rows and one column before it and two rows and three columns after it."""
    e = encoded(spark, sf_dir)
    w = F.ceil(F.aggregate("counts", F.lit(0).cast("long"), lambda s, n: s + n) / 5)
    one, two, seven = F.lit(1), F.lit(2), F.lit(7)
    whole = rle.uncropped(e, ["episode_id"], "counts", (one, two, one + w, seven), w + 4, F.lit(9))
    return whole.select("episode_id", F.array_join(F.col("counts").cast("array<string>"), ",").alias("counts"))


@query(f"WITH {RLE} SELECT episode_id, area FROM rle")
def rle_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(spark, sf_dir).select("episode_id", masks.rle_area(F.col("counts")).alias("area"))


@query("WITH g AS (SELECT l, i, j FROM (SELECT unnest(range(3)) AS l), (SELECT unnest(range(8)) AS i), (SELECT unnest(range(8)) AS j)) SELECT l::INTEGER AS layer, round((i + 0.5) / (8 // (2 ** l)), 6)::DOUBLE AS x, round((j + 0.5) / (8 // (2 ** l)), 6)::DOUBLE AS y FROM g WHERE i < 8 // (2 ** l) AND j < 8 // (2 ** l)")
def point_grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return masks.point_grids(spark, 8, 3, 2).select("layer", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))
