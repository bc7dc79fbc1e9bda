"""Fits that survive outliers: minimal sets drawn by hash, all tried on all rows, and a least-squares fit to the rows that agree with the best.

*Draws.* A group's sample are the rows with the smallest hashes of their values (SAMPLE at most, each task sends no more); minimal sets are
numbered places in it. So a fit is the same for every partitioning and order of the rows, and for every run.
*Trial.* The drawn models are one short array beside the rows; each row counts for the models that it agrees with, and counts are added up before
they are shuffled.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoframe.functions.boxes import norm

SAMPLE, TRIES = 256, 100


def _models(points: DataFrame, group: list[str], axes: tuple[str, ...], size: int, tries: int, model: Callable[..., Column]) -> DataFrame:
    """(group, models): the models of ``tries`` minimal sets of ``size`` rows each; sets that give none (null) are left out."""
    by_hash = Window.partitionBy(*group).orderBy(F.xxhash64(*axes), *axes)
    ranked = points.select(*group, *axes, F.row_number().over(by_hash).alias("rank_")).filter(F.col("rank_") <= SAMPLE)
    sample = ranked.groupBy(*group).agg(F.sort_array(F.collect_list(F.struct("rank_", *axes))).alias("sample_"))
    pick = lambda h, k: F.get(F.col("sample_"), F.pmod(F.xxhash64(h, F.lit(k)), F.size("sample_")).cast("int"))
    drawn = F.transform(F.sequence(F.lit(0), F.lit(tries - 1)), lambda h: F.struct(*(pick(h, k).alias(f"p{k}") for k in range(size))))
    made = F.filter(F.transform("drawn_", lambda s: model(*(s[f"p{k}"] for k in range(size)))), lambda m: m.isNotNull())
    return sample.withColumn("drawn_", drawn).select(*group, made.alias("models")).filter(F.size("models") > 0)


def _agreeing(points: DataFrame, models: DataFrame, group: list[str], gap: Callable[[Column], Column], threshold: Column) -> DataFrame:
    """Rows that agree with their group's best model: most rows within ``threshold``, then drawn first."""
    rows = points.withColumn("threshold_", threshold)
    tried = rows.join(models, group).select("*", F.posexplode("models").alias("h_", "m_")).filter(gap(F.col("m_")) <= F.col("threshold_"))
    # A model goes with its number, so that no model is made twice.
    counts = tried.groupBy(*group, "h_", "m_").agg(F.count("*").alias("n_"))
    best = counts.groupBy(*group).agg(F.max(F.struct("n_", (-F.col("h_")).alias("h_"), "m_")).alias("b_"))
    chosen = best.select(*group, "b_.m_")
    return rows.join(chosen, group).filter(gap(F.col("m_")) <= F.col("threshold_")).drop("threshold_")


def _sound(points: DataFrame, group: list[str], axes: tuple[str, ...]) -> DataFrame:
    for c in axes:
        points = points.filter(F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c).cast("double")) < float("inf")))
    return points.select(*group, *(F.col(c).cast("double").alias(c) for c in axes))


def robust_lines(points: DataFrame, group: list[str], x: str, y: str, threshold: float | None = None, tries: int = TRIES) -> DataFrame:
    """(group, slope, intercept, inliers, n) of the line y = slope x + intercept of each group.

    Without a threshold rows agree within the median distance of y from its median. A group whose x are all equal has no line; null and
    non-finite points and null groups are left out.
    """
    rows = _sound(points, group, (x, y))
    line = lambda p, q: F.when(p[x] != q[x], F.struct(((q[y] - p[y]) / (q[x] - p[x])).alias("a"), (p[y] - (q[y] - p[y]) / (q[x] - p[x]) * p[x]).alias("b")))
    models = _models(rows, group, (x, y), 2, tries, line)
    if threshold is None:
        middle = rows.groupBy(*group).agg(F.median(y).alias("middle_"))
        spread = rows.join(middle, group).groupBy(*group).agg(F.median(F.abs(F.col(y) - F.col("middle_"))).alias("spread_"))
        told = rows.join(spread, group)
    else:
        told = rows.withColumn("spread_", F.lit(float(threshold)))
    near = _agreeing(told, models, group, lambda m: F.abs(F.col(y) - m.a * F.col(x) - m.b), F.col("spread_"))
    fits = near.groupBy(*group).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.count("*").alias("inliers"))
    return fits.join(rows.groupBy(*group).agg(F.count("*").alias("n")), group)


def robust_planes(points: DataFrame, group: list[str], threshold: float, axes: tuple[str, str, str] = ("x", "y", "z"), tries: int = TRIES) -> DataFrame:
    """(group, nx, ny, nz, d, inliers, n) of the plane n * p = d of each group, of unit normal that points up (ny, else nx, else nz positive).

    The plane is refitted by least squares along the axis on which the agreeing rows' spread has the greatest determinant. A group whose drawn points
    are all in one line has no plane; null and non-finite points and null groups are left out.
    """
    x, y, z = axes
    rows = _sound(points, group, axes)

    def plane(p: Column, q: Column, r: Column) -> Column:
        (ax, ay, az), (bx, by, bz) = ([e[c] - p[c] for c in axes] for e in (q, r))
        n = [ay * bz - az * by, az * bx - ax * bz, ax * by - ay * bx]
        size = norm(*n)
        unit = [c / size for c in n]
        return F.when(size > 1e-12, F.struct(*(c.alias(k) for c, k in zip(unit, "abc", strict=True)), sum((c * p[k] for c, k in zip(unit[1:], axes[1:], strict=True)), unit[0] * p[x]).alias("d")))

    models = _models(rows, group, axes, 3, tries, plane)
    near = _agreeing(rows, models, group, lambda m: F.abs(m.a * F.col(x) + m.b * F.col(y) + m.c * F.col(z) - m.d), F.lit(float(threshold)))
    spread = {f"{a}{b}": F.covar_pop(a, b) for i, a in enumerate(axes) for b in axes[i:]}
    sums = near.groupBy(*group).agg(*(F.avg(c).alias(f"m_{c}") for c in axes), *(v.alias(f"s_{k}") for k, v in spread.items()), F.count("*").alias("inliers"))
    xx, xy, xz, yy, yz, zz = (F.col(f"s_{k}") for k in spread)
    dx, dy, dz = yy * zz - yz * yz, xx * zz - xz * xz, xx * yy - xy * xy
    p, q, r = xz * yz - xy * zz, xy * yz - xz * yy, xy * xz - yz * xx
    ways = [F.array(dx, p, q), F.array(p, dy, r), F.array(q, r, dz)]
    way = F.when((dx >= dy) & (dx >= dz), ways[0]).when(dy >= dz, ways[1]).otherwise(ways[2])
    fits = sums.withColumn("w_", way).withColumn("size_", norm(*(F.get("w_", F.lit(k)) for k in range(3)))).filter("size_ > 0")
    lead = F.coalesce(*(F.nullif(F.get("w_", F.lit(k)), F.lit(0.0)) for k in (1, 0, 2)))
    fits = fits.withColumns({c: F.get("w_", F.lit(k)) / F.col("size_") * F.signum(lead) for k, c in enumerate(("nx", "ny", "nz"))})
    d = sum((F.col(n) * F.col(f"m_{c}") for n, c in zip(("ny", "nz"), (y, z), strict=True)), F.col("nx") * F.col(f"m_{x}"))
    return fits.select(*group, "nx", "ny", "nz", d.alias("d"), "inliers").join(rows.groupBy(*group).agg(F.count("*").alias("n")), group)


def upright_rotation(least: float = 0.3) -> Column:
    """For a row of ``robust_planes``: rows of the rotation into a frame whose y is the plane's normal and whose z lies in it; null where ``least`` of the points or fewer agree.

    x is the normal times (0, 0, -1), or (0, 1, 0) to either side where the normal is along z; the frame is right-handed.
    """
    nx, ny, nz = (F.col(c) for c in ("nx", "ny", "nz"))
    flat = norm(nx, ny)
    # (nx, ny, nz) x (0, 0, -1) = (-ny, nx, 0).
    x = [F.when(flat > 1e-9, -ny / flat).otherwise(0.0), F.when(flat > 1e-9, nx / flat).otherwise(F.signum(nz)), F.lit(0.0)]
    z = [x[1] * nz - x[2] * ny, x[2] * nx - x[0] * nz, x[0] * ny - x[1] * nx]
    return F.when(F.col("inliers") > least * F.col("n"), F.array(F.array(*x), F.array(nx, ny, nz), F.array(*z)))


def robust_means(rows: DataFrame, group: list[str], values: list[str], threshold: float, least: int = 4, tries: int = TRIES) -> DataFrame:
    """(group, values, inliers, n): the mean of the rows whose absolute differences from the best drawn row sum to ``threshold`` at most.

    For transforms each value is a cell of the matrix. Groups in which fewer than ``least`` rows agree are left out.
    """
    names = tuple(values)
    kept = _sound(rows, group, names)
    models = _models(kept, group, names, 1, tries, lambda p: p)
    gap = lambda m: sum((F.abs(F.col(c) - m[c]) for c in names[1:]), F.abs(F.col(names[0]) - m[names[0]]))
    near = _agreeing(kept, models, group, gap, F.lit(float(threshold)))
    means = near.groupBy(*group).agg(*(F.avg(c).alias(c) for c in names), F.count("*").alias("inliers")).filter(F.col("inliers") >= least)
    return means.join(kept.groupBy(*group).agg(F.count("*").alias("n")), group)
