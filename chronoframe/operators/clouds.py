"""Relations of objects whose points in space are known.

A group of at most FEW points is worked on as one row of its clouds, without joins.
Larger groups are spread over tasks by clouds and cells. Rows whose group or name is null are left out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoframe.functions.boxes import direction_words, norm
from chronoframe.operators.hulls import faces_of, hulls, inside
from chronoframe.operators.neighbours import nearest_gaps
from chronoframe.operators.tables import Tables

AXES = ("x", "y", "z")
#: Points of a group whose clouds are compared point by point in one row.
FEW = 64


def by_size(points: DataFrame, group: list[str], name: str, tasks: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Points of the groups that hold FEW at most, and those of all others; these are written, so that their many steps don't find them anew."""
    for c in (*group, name):
        points = points.filter(F.col(c).isNotNull())
    sized = points.select(*group, name, *AXES, F.count("*").over(Window.partitionBy(*group)).alias("n_"))
    many = Tables(points.sparkSession, shuffled=True).keep(sized.filter(F.col("n_") > FEW).drop("n_"), "many")
    return sized.filter(F.col("n_") <= FEW).drop("n_"), many.repartition(tasks, *group) if tasks else many


def paired(clouds: DataFrame, group: list[str], name: str) -> DataFrame:
    """(group, a_, b_): each ordered pair of a group's rows, which are few, as structs."""
    listed = clouds.groupBy(*group).agg(F.collect_list(F.struct(*(c for c in clouds.columns if c not in group))).alias("all_"))
    pairs = listed.select(*group, "all_", F.explode("all_").alias("a_")).select(*group, "a_", F.explode("all_").alias("b_"))
    return pairs.filter(F.col("a_")[name] != F.col("b_")[name])


def _few_gaps(pairs: DataFrame) -> DataFrame:
    """``pairs`` with mean_gap and gap, found by their ``points_``; those with a cloud without a point are left out."""

    def nearest(own: Column, other: Column) -> Column:
        squared = lambda p, q: sum(((p[c] - q[c]) * (p[c] - q[c]) for c in AXES), F.lit(0.0))
        return F.transform(own, lambda p: F.sqrt(F.array_min(F.transform(other, lambda q: squared(p, q)))))

    known = [F.filter(F.col(f"{s}_.points_"), lambda p: p.x.isNotNull() & p.y.isNotNull() & p.z.isNotNull()) for s in ("a", "b")]
    pairs = pairs.withColumn("p_", known[0]).withColumn("q_", known[1]).filter((F.size("p_") > 0) & (F.size("q_") > 0))
    pairs = pairs.withColumn("way_", nearest(F.col("p_"), F.col("q_"))).withColumn("back_", nearest(F.col("q_"), F.col("p_")))
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda s, v: s + v)
    mean = (total("way_") + total("back_")) / (F.size("way_") + F.size("back_"))
    return pairs.withColumn("mean_gap", mean).withColumn("gap", F.array_min("way_")).drop("p_", "q_", "way_", "back_")


def _points(name: str = "points_") -> Column:
    return F.collect_list(F.struct(*AXES)).alias(name)


def cloud_gaps(points: DataFrame, group: list[str], name: str, tasks: int | None = None) -> DataFrame:
    """(group, a, b, mean_gap, gap) for each ordered pair of a group's clouds: from each point of either to the nearest of the other, mean and least."""
    few, many = by_size(points, group, name, tasks)
    near = _few_gaps(paired(few.groupBy(*group, name).agg(_points()), group, name))
    near = near.select(*group, *(F.col(f"{c}_")[name].alias(c) for c in ("a", "b")), "mean_gap", "gap")
    return near.unionByName(_spread_gaps(many, group, name, tasks))


def _spread_gaps(points: DataFrame, group: list[str], name: str, tasks: int | None = None) -> DataFrame:
    """``cloud_gaps`` of groups of any size."""
    nearest = nearest_gaps(points, group, name, tasks=tasks)
    one_way = nearest.groupBy(*group, "a", "b").agg(F.sum(F.col("gap") * F.col("w")).alias("sum_"), F.sum("w").alias("n_"), F.min("gap").alias("gap"))
    back = one_way.select(*group, F.col("a").alias("b"), F.col("b").alias("a"), F.col("sum_").alias("r_sum"), F.col("n_").alias("r_n"))
    both = one_way.join(back, [*group, "a", "b"])
    return both.select(*group, "a", "b", ((F.col("sum_") + F.col("r_sum")) / (F.col("n_") + F.col("r_n"))).alias("mean_gap"), "gap")


def shape(points: DataFrame, group: list[str], name: str) -> DataFrame:
    """(group, name, mean and extent on each axis) of every cloud."""
    return points.groupBy(*group, name).agg(*_shape())


def _shape() -> list[Column]:
    return [f(c).alias(f"{n}_{c}") for c in AXES for f, n in ((F.avg, "mean"), (F.min, "low"), (F.max, "high"))]


def shares(points: DataFrame, shapes: DataFrame, faces: DataFrame, group: list[str], name: str) -> DataFrame:
    """(group, a, b, inside, over, above): shares of b's points in the hull of a, in its extent on x and z (its edges left out), and above its mean height.

    ``faces`` are the clouds' hulls; a flat cloud has none, and nothing is inside it.
    """
    other = shapes.join(faces, [*group, name], "left").withColumnRenamed(name, "a")
    pairs = points.withColumnRenamed(name, "b").join(other, group).filter("a <> b")
    x, z = ((F.col(c) > F.col(f"low_{c}")) & (F.col(c) < F.col(f"high_{c}")) for c in ("x", "z"))
    share = lambda c: F.avg(c.cast("int"))
    held = inside(F.col("faces"), [F.col(c) for c in AXES])
    return pairs.groupBy(*group, "a", "b").agg(share(held).alias("inside"), share(x & z).alias("over"), share(F.col("y") > F.col("mean_y")).alias("above"))


def relation_3d(contact: float, close: float) -> Column:
    """The relation of b to a from gap, shares and the unit vector (nx, ny, nz) from a to b; null where they are apart.

    In contact: ``inside`` with more than 30 % of b in a, else with more than half of b over a's ground ``on top of`` where more
    than half of b is above a's middle, or ``under`` where more than half of a is above b's: then a is on top of b. Close: height
    beyond 0.85, replaced by side beyond 0.85, replaced by front beyond 0.9, else the words of what exceeds 0.62, else ``close to``.
    """
    nx, ny, nz = F.col("nx"), F.col("ny"), F.col("nz")
    words = direction_words([(ny, "above", "below"), (nx, "right of", "left of"), (nz, "in front of", "behind of")], 0.62, " and ", "close to")
    return (
        F.when((F.col("gap") < contact) & (F.col("inside") > 0.3), "inside")
        .when((F.col("gap") < contact) & (F.col("over") > 0.5) & (F.col("above") > 0.5), "on top of")
        .when((F.col("gap") < contact) & (F.col("over") > 0.5) & (F.col("below") > 0.5), "under")
        .when(F.col("gap") >= close, None)
        .when(nz > 0.9, "in front of")
        .when(nx > 0.85, "right of")
        .when(nx < -0.85, "left of")
        .when(ny > 0.85, "above")
        .when(ny < -0.85, "below")
        .otherwise(words)
    )


def _few_pairs(points: DataFrame, group: list[str], name: str, tasks: int | None = None) -> DataFrame:
    """What ``_spread_pairs`` gives, for groups of few points."""
    clouds = points.groupBy(*group, name).agg(_points(), *_shape()).withColumn("faces_", faces_of(F.col("points_"), AXES))
    # Spark forgets how rows lie when Python has seen them: the clouds, with their points, are shuffled once.
    pairs = _few_gaps(paired(clouds.repartition(tasks, *group) if tasks else clouds, group, name))

    def share(points: Column, test: Callable[[Column], Column]) -> Column:
        told = F.filter(F.transform(points, test), lambda t: t.isNotNull())
        return F.try_divide(F.size(F.filter(told, lambda t: t)).cast("double"), F.size(told))

    a, b = F.col("a_"), F.col("b_")
    between = lambda p, c: (p[c] > a[f"low_{c}"]) & (p[c] < a[f"high_{c}"])
    return pairs.select(
        *group, a[name].alias("a"), b[name].alias("b"), "gap",
        share(b.points_, lambda p: inside(a.faces_, [p[c] for c in AXES])).alias("inside"),
        share(b.points_, lambda p: between(p, "x") & between(p, "z")).alias("over"),
        share(b.points_, lambda p: p.y > a.mean_y).alias("above"),
        share(a.points_, lambda p: p.y > b.mean_y).alias("below"),
        *((b[f"mean_{c}"] - a[f"mean_{c}"]).alias(f"way_{c}") for c in AXES),
    )


def _spread_pairs(points: DataFrame, group: list[str], name: str, tasks: int | None = None) -> DataFrame:
    """(group, a, b, gap, inside, over, above, below, way_x, way_y, way_z) of each ordered pair of a group's clouds; the way is that from a's middle to b's."""
    shapes = shape(points, group, name)
    a = shapes.select(*group, F.col(name).alias("a"), *(F.col(f"mean_{c}").alias(f"a_{c}") for c in AXES))
    b = shapes.select(*group, F.col(name).alias("b"), *(F.col(f"mean_{c}").alias(f"b_{c}") for c in AXES))
    pair = [*group, "a", "b"]
    told = shares(points, shapes, hulls(points, [*group, name]), group, name)
    below = told.select(*group, F.col("a").alias("b"), F.col("b").alias("a"), F.col("above").alias("below"))
    found = _spread_gaps(points, group, name, tasks).join(told, pair).join(below, pair).join(a, [*group, "a"]).join(b, [*group, "b"])
    return found.select(*pair, "gap", "inside", "over", "above", "below", *((F.col(f"b_{c}") - F.col(f"a_{c}")).alias(f"way_{c}") for c in AXES))


def edges_3d(points: DataFrame, group: list[str], name: str, contact: float, close: float, tasks: int | None = None) -> DataFrame:
    """(group, start, end, edge_type, dist): one edge at most for each ordered pair of a group's clouds.

    Each ordered pair tells the edge from b (start) to a; where it is ``under``, that from a to b instead, which goes before
    what the pair of b and a tells.
    """
    few, many = by_size(points, group, name, tasks)
    near, spread = _few_pairs(few, group, name, tasks), _spread_pairs(many, group, name, tasks)
    # Each is told for itself, for groups of few points still lie together.
    return _told(near, group, contact, close).unionByName(_told(spread, group, contact, close))


def _told(found: DataFrame, group: list[str], contact: float, close: float) -> DataFrame:
    way = [F.col(f"way_{c}") for c in AXES]
    size = norm(*way)
    found = found.withColumns({n: F.try_divide(w, size) for n, w in zip(("nx", "ny", "nz"), way, strict=True)})
    found = found.withColumn("edge_type", relation_3d(contact, close)).filter("edge_type is not null")
    under = F.col("edge_type") == "under"
    edges = found.select(
        *group, F.when(under, F.col("a")).otherwise(F.col("b")).alias("start"), F.when(under, F.col("b")).otherwise(F.col("a")).alias("end"),
        F.when(under, "on top of").otherwise(F.col("edge_type")).alias("edge_type"), F.col("gap").alias("dist"), under.alias("under"),
    )
    return edges.groupBy(*group, "start", "end").agg(F.max_by("edge_type", "under").alias("edge_type"), F.max("dist").alias("dist"))
