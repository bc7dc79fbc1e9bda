"""Operators on detections: best boxes, overlaps, suppression, gates, co-occurrence."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoframe.functions.boxes import area, box, inside_share, iou
from chronoframe.operators.groups import listed, marks
from chronoframe.operators.hulls import extreme_points

CORNERS = ("x1", "y1", "x2", "y2")


def best_of(df: DataFrame, keys: list[str], score: str, *ties: str) -> DataFrame:
    """The row with the highest score of each key; the first by ``ties``."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(score), *ties))
    return df.withColumn("rank_", rank).filter("rank_ = 1").drop("rank_")


def top_k(df: DataFrame, keys: list[str], score: str, k: int, *ties: str) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(score), *ties))
    return df.withColumn("rank", rank).filter(F.col("rank") <= k)


def overlaps(left: DataFrame, right: DataFrame, group: list[str]) -> DataFrame:
    """Pairs within a group with their IoU; both sides have id and box columns, the right ones prefixed by r_."""
    other = right.select(*group, *(F.col(c).alias(f"r_{c}") for c in right.columns if c not in group))
    pairs = left.join(other, group)
    return pairs.withColumn("iou", F.coalesce(iou(box(), box("r_")), F.lit(0.0)))


def best_match(left: DataFrame, right: DataFrame, group: list[str], id_: str, differ: Column | None = None) -> DataFrame:
    """Each left row's right row with the greatest IoU (the smaller id on ties)."""
    pairs = overlaps(left, right, group)
    if differ is not None:
        pairs = pairs.filter(differ)
    best = pairs.groupBy(*group, id_).agg(F.max(F.struct(F.round("iou", 9).alias("iou"), (-F.col(f"r_{id_}")).alias("n_"))).alias("b_"))
    return best.select(*group, id_, (-F.col("b_.n_")).alias("match"), F.col("b_.iou").alias("iou"))


def undetected(proposals: DataFrame, detections: DataFrame, group: list[str], id_: str, most: float) -> DataFrame:
    """Proposals that no other detection of their group overlaps by ``most`` or more."""
    pairs = overlaps(proposals, detections, group).filter((F.col(f"r_{id_}") != F.col(id_)) & (F.col("iou") >= most))
    return proposals.join(pairs.select(id_).distinct(), id_, "left_anti")


def class_gate(df: DataFrame, frame: list[str], class_: str, score: str, margin: float = 0.07, cap: float = 0.35) -> DataFrame:
    """Classes whose mean best score a frame exceeds min(fifth best class's - margin, cap)."""
    best = df.groupBy(*frame, class_).agg(F.max(score).alias("best"))
    frames = df.select(*frame).distinct().count()
    means = best.groupBy(class_).agg((F.sum("best") / F.lit(frames)).alias("mean_score"))
    # Classes are a vocabulary: one row each.
    ranked = [r[0] for r in means.orderBy(F.desc("mean_score")).select("mean_score").take(5)]
    limit = min(ranked[-1] - margin, cap) if ranked else cap
    return means.filter(F.col("mean_score") > limit)


def cooccurrence(df: DataFrame, group: list[str], class_: str) -> DataFrame:
    """(a, b, n): groups in which both classes appear, for each ordered pair."""
    seen = df.select(*group, class_).distinct()
    other = seen.withColumnRenamed(class_, "b")
    pairs = seen.withColumnRenamed(class_, "a").join(other, group).filter("a <> b")
    return pairs.groupBy("a", "b").agg(F.count("*").alias("n"))


def conditional(pairs: DataFrame, df: DataFrame, group: list[str], class_: str) -> DataFrame:
    """(a, b, p): share of a's groups in which b appears too."""
    appears = df.select(*group, F.col(class_).alias("a")).distinct().groupBy("a").agg(F.count("*").alias("n_a"))
    return pairs.join(appears, "a").select("a", "b", (F.col("n") / F.col("n_a")).alias("p"))


def final_groups(probabilities: list[tuple[str, str, float]], least: float = 0.6) -> list[list[str]]:
    """Greedy groups of classes from (a, b, p): the class with the largest sum takes its partners above ``least``, then both go. A vocabulary's pairs are few."""
    rows: dict[str, dict[str, float]] = {}
    for a, b, p in probabilities:
        rows.setdefault(a, {})[b] = p
    groups = []
    while rows:
        key = max(sorted(rows), key=lambda a: sum(rows[a].values()))
        group = [key, *sorted(b for b, p in rows[key].items() if p > least)]
        groups.append(group)
        rows = {a: {b: p for b, p in r.items() if b not in group} for a, r in rows.items() if a not in group}
    return groups


def kept_by_nms(boxes: np.ndarray, threshold: float) -> np.ndarray:
    """1 for boxes (groups, rows in order, x1 y1 x2 y2) that no kept one before overlaps by more than the threshold, else 0; an undefined IoU keeps."""
    x1, y1, x2, y2 = np.moveaxis(boxes, 2, 0)
    size = np.maximum(x2 - x1, 0) * np.maximum(y2 - y1, 0)
    kept = np.ones(size.shape, bool)
    with np.errstate(invalid="ignore", divide="ignore"):
        for i in range(1, size.shape[1]):
            k, own = np.s_[:, :i], np.s_[:, i, None]
            both = np.maximum(np.minimum(x2[own], x2[k]) - np.maximum(x1[own], x1[k]), 0) * np.maximum(np.minimum(y2[own], y2[k]) - np.maximum(y1[own], y1[k]), 0)
            union = size[own] + size[k] - both
            kept[:, i] = ~(kept[k] & (union > 0) & (both / union > threshold)).any(axis=1)
    return kept


def _suppressed(df: DataFrame, group: list[str], id_: str, threshold: float) -> DataFrame:
    """(group, rows_, kept_): the rows of each group, best score first (the smaller id on ties, undefined scores last), and 1 for each that suppression keeps."""
    undefined = F.lit(float("inf"))
    order = F.coalesce(F.nanvl(-F.col("score").cast("double"), undefined) + 0.0, undefined)
    rows = listed(df, group, [order, F.col(id_)], {"id_": F.col(id_), **{c: F.col(c) for c in (*CORNERS, "score")}})
    return rows.withColumn("kept_", marks(lambda b: kept_by_nms(b, threshold), [F.col("rows_")[c].cast("array<double>") for c in CORNERS]))


def nms(df: DataFrame, group: list[str], id_: str, threshold: float) -> DataFrame:
    """Greedy non-maximum suppression in each group (a frame's detections, which are few)."""
    kept = _suppressed(df, group, id_, threshold).select(*group, F.explode(F.arrays_zip("rows_", "kept_")).alias("k_")).filter("k_.kept_ = 1")
    return kept.select(*group, F.col("k_.rows_.id_").alias(id_), *(F.col(f"k_.rows_.{c}").alias(c) for c in (*CORNERS, "score")))


def clean_objects(df: DataFrame, keys: list[str], value: str, score: str, least: float = 0.2) -> DataFrame:
    """Objects that are seen in half of their frames or more, with a mean score of ``least`` or more."""
    stats = df.groupBy(*keys).agg(F.avg(F.col(value).isNull().cast("int")).alias("missing"), F.avg(score).alias("mean_score"))
    return stats.filter((F.col("missing") <= 0.5) & (F.col("mean_score") >= least))


def trimmed_mean(df: DataFrame, keys: list[str], value: str, least: float, z: float) -> DataFrame:
    """Mean without values of ``least`` or less and those more than z deviations away."""
    part = Window.partitionBy(*keys)
    some = df.filter(F.col(value) > least)
    score = F.try_divide(F.col(value) - F.avg(value).over(part), F.stddev_pop(value).over(part))
    some = some.withColumn("z_", F.coalesce(score, F.lit(0.0))).filter(F.abs("z_") <= z)
    return some.groupBy(*keys).agg(F.avg(value).alias("mean_value"), F.count("*").alias("n"))


def box_area() -> Column:
    return area(box())


def flattest(lines: DataFrame, group: list[str], cluster: str) -> DataFrame:
    """(group, cluster, slope, intercept): of the least-squares lines through all ends of each cluster's segments the one nearest to the horizontal."""
    ends = lines.select(*group, cluster, F.explode(F.array(F.struct(F.col("x1").alias("x"), F.col("y1").alias("y")), F.struct(F.col("x2").alias("x"), F.col("y2").alias("y")))).alias("p"))
    fits = ends.groupBy(*group, cluster).agg(F.regr_slope("p.y", "p.x").alias("slope"), F.regr_intercept("p.y", "p.x").alias("intercept"))
    steep = F.round(F.abs(F.atan("slope")), 6)
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(steep, cluster))
    return fits.filter("slope is not null").withColumn("rank_", rank).filter("rank_ = 1").drop("rank_")


def extents(points: DataFrame, group: list[str], id_: str) -> DataFrame:
    """(group, extent, n): the greatest distance between two points (x, y) of a group, and their number."""
    # The two points that are farthest apart are corners of the group's hull.
    corners = extreme_points(points, group, ("x", "y"))
    other = corners.select(*group, F.col("x").alias("r_x"), F.col("y").alias("r_y"))
    gap = F.sqrt((F.col("x") - F.col("r_x")) ** 2 + (F.col("y") - F.col("r_y")) ** 2)
    counts = points.groupBy(*group).agg(F.countDistinct(id_).alias("n"))
    return corners.join(other, group).groupBy(*group).agg(F.max(gap).alias("extent")).join(counts, group)


def contained(df: DataFrame, group: list[str], id_: str, share: float = 0.8) -> DataFrame:
    """Rows whose box lies by more than ``share`` in a larger one of their group."""
    other = df.select(*group, *(F.col(c).alias(f"r_{c}") for c in (id_, "x1", "y1", "x2", "y2")))
    inside = inside_share(box(), box("r_")) > share
    pairs = df.join(other, group).filter((area(box("r_")) > area(box())) & inside)
    return pairs.select(*group, id_).distinct()


def proposal_groups(df: DataFrame, group: list[str], id_: str, threshold: float = 0.5) -> DataFrame:
    """(group, leader, id): going by id, a row that no leader so far overlaps by more than ``threshold`` leads all rows that it overlaps so."""
    found = _suppressed(df.dropna(subset=group).withColumn("score", -F.col(id_).cast("double")), group, id_, threshold)
    led = found.select(*group, "rows_", F.explode(F.arrays_zip("rows_", "kept_")).alias("z_")).filter("z_.kept_ = 1")
    pairs = led.select(*group, F.col("z_.rows_").alias("l_"), F.explode("rows_").alias("m_"))
    share = F.coalesce(iou(box("l_."), box("m_.")), F.lit(0.0))
    return pairs.filter(share > threshold).select(*group, F.col("l_.id_").alias("leader"), F.col("m_.id_").alias(id_))


def dense_scores(df: DataFrame, points: DataFrame, group: list[str], id_: str, weights: tuple[float, float] = (2.0, 1.0), least: float = 0.2) -> DataFrame:
    """(group, id, dense): a box's score mixed with the affinity (x, y, affinity) of the points in it, from ``least`` on, by its area."""
    inside = (F.col("p.x") >= F.col("x1")) & (F.col("p.x") <= F.col("x2")) & (F.col("p.y") >= F.col("y1")) & (F.col("p.y") <= F.col("y2")) & (F.col("p.affinity") >= least)
    rows = df.join(points.select(*group, F.struct("x", "y", "affinity").alias("p")), group)
    total = rows.groupBy(*group, id_, "score", "x1", "y1", "x2", "y2").agg(F.sum(F.when(inside, F.col("p.affinity")).otherwise(0.0)).alias("sum_"))
    dense = F.coalesce(F.try_divide(F.col("sum_"), area(box())), F.lit(0.0))
    return total.select(*group, id_, ((dense * weights[0] + F.col("score") * weights[1]) / sum(weights)).alias("dense"))


def mutual_matches(ours: DataFrame, news: DataFrame, group: list[str], name: str, threshold: float = 0.5) -> DataFrame:
    """(group, ours, news, outcome): segments of both sides matched where each is the other's best above ``threshold``; the rest are unmatched or new."""
    pairs = overlaps(ours.select(*group, name, "x1", "y1", "x2", "y2"), news.select(*group, name, "x1", "y1", "x2", "y2"), group).filter(F.col("iou") > threshold)
    score = F.round("iou", 9)
    first = F.row_number().over(Window.partitionBy(*group, name).orderBy(score.desc(), f"r_{name}"))
    second = F.row_number().over(Window.partitionBy(*group, f"r_{name}").orderBy(score.desc(), name))
    matched = pairs.withColumn("a_", first).withColumn("b_", second).filter("a_ = 1 and b_ = 1").select(*group, F.col(name).alias("ours"), F.col(f"r_{name}").alias("news"))
    lost = ours.select(*group, F.col(name).alias("ours")).join(matched, [*group, "ours"], "left_anti").withColumn("news", F.lit(None).cast("string")).withColumn("outcome", F.lit("unmatched"))
    new = news.select(*group, F.col(name).alias("news")).join(matched, [*group, "news"], "left_anti").withColumn("ours", F.lit(None).cast("string")).withColumn("outcome", F.lit("new"))
    columns = [*group, "ours", "news", "outcome"]
    return matched.withColumn("outcome", F.lit("matched")).select(*columns).unionByName(lost.select(*columns)).unionByName(new.select(*columns))


def surface_choice(df: DataFrame, group: list[str], class_: str, surface: str, whole: float, large: float = 0.2, larger: float = 0.6) -> DataFrame:
    """(group, surface_score, other): the surface class's best score where its first box covers ``large`` of the picture, else 0; the best other class that covers ``larger``."""
    size = area(box())
    first = F.min_by(F.struct(size.alias("size")), F.when(F.col(class_) == surface, F.col("event_id")))
    stats = df.groupBy(*group).agg(
        F.max(F.when(F.col(class_) == surface, F.col("score"))).alias("top_"),
        first.alias("first_"),
        F.max(F.when((F.col(class_) != surface) & (size > larger * whole), F.struct("score", (-F.col("event_id")).alias("n"), F.col(class_).alias("c")))).alias("other_"),
    )
    covered = F.coalesce(F.col("first_.size") > large * whole, F.lit(False)) & F.col("top_").isNotNull()
    return stats.select(*group, F.when(covered, F.col("top_")).otherwise(0.0).alias("surface_score"), F.col("other_.c").alias("other"))


def surface_prompts(best: DataFrame, part: list[str], frame: str, class_: str, whole: float, weights: tuple[float, float, float] = (0.5, 0.5, 0.1)) -> DataFrame:
    """(part, class, score): mean score, mean covered share and share of frames with a detection, weighed; from the best boxes of each frame and class."""
    frames = best.groupBy(*part).agg(F.countDistinct(frame).alias("frames_"))
    stats = best.groupBy(*part, class_).agg(F.avg("score").alias("s_"), F.avg(area(box())).alias("a_"), F.count("*").alias("n_")).join(frames, part)
    score = F.col("s_") * weights[0] + F.col("a_") / whole * weights[1] + F.col("n_") / F.col("frames_") * weights[2]
    return stats.select(*part, class_, score.alias("score"))


def surface_boxes(df: DataFrame, part: list[str], frame: str, whole: float) -> DataFrame:
    """(part, x1..y2): the mean of the boxes that are best in their frame by score and half of the relative area; none where the largest boxes cover less than half of the picture."""
    size = area(box())
    inner = Window.partitionBy(*part, frame)
    sized = df.withColumn("size_", size).withColumn("most_", F.max(size).over(inner))
    value = F.round(F.col("score") + 0.5 * F.coalesce(F.try_divide(F.col("size_"), F.col("most_")), F.lit(0.0)), 9)
    best = sized.withColumn("value_", value)
    best = best.withColumn("rank_", F.row_number().over(inner.orderBy(F.desc("value_"), "event_id"))).filter("rank_ = 1")
    found = best.groupBy(*part).agg(*(F.avg(c).alias(c) for c in ("x1", "y1", "x2", "y2")), F.avg("most_").alias("cover_"))
    return found.filter(F.col("cover_") >= 0.5 * whole).drop("cover_")
