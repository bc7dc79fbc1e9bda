"""Change-point detectors: from an ordered series of a part to (part, object, frame_idx, score) keystates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from chronoframe.operators import series
from chronoframe.operators.intervals import overlap_join


def gripper_releases(df: DataFrame, part: str, order: str, state: str, dwell: int, offset: int = 0) -> DataFrame:
    """Frames at which a gripper opens that was closed (state <= 0) for more than ``dwell`` frames; open before the first frame."""
    w = Window.partitionBy(part).orderBy(order)
    closed = F.col(state) <= 0
    was = F.coalesce(F.lag(closed).over(w), F.lit(False))
    marked = df.withColumn("was_", was).withColumn("closed_", closed)
    began = F.last(F.when(F.col("closed_") & ~F.col("was_"), F.col(order)), ignorenulls=True).over(series.upto(w))
    found = marked.withColumn("began_", began).filter(~F.col("closed_") & F.col("was_") & (F.col(order) - F.col("began_") > dwell))
    return found.select(part, (F.col(order) + offset).cast("int").alias("frame_idx"))


def for_each_object(keystates: DataFrame, objects: DataFrame, part: str, score: float) -> DataFrame:
    """The same keystates for every object of their part."""
    return keystates.join(objects.select(part, "object").distinct(), part).select(part, "object", "frame_idx", F.lit(score).alias("score"))


def runs_of(df: DataFrame, flag: Column, keys: list[str], order: str, least: int) -> DataFrame:
    """(keys, start, end) of the runs of rows with the flag, ``least`` rows long at least."""
    w = Window.partitionBy(*keys).orderBy(order)
    marked = series.with_islands(df.withColumn("flag_", F.coalesce(flag, F.lit(False))), F.col("flag_"), w, "island_")
    runs = marked.filter("flag_").groupBy(*keys, "island_").agg(F.min(order).alias("start"), F.max(order).alias("end"), F.count("*").alias("n_"))
    return runs.filter(F.col("n_") >= least).drop("island_", "n_")


def movement_runs(df: DataFrame, keys: list[str], order: str, movement: str, share: float, extent: Column, least: int = 2) -> DataFrame:
    """Runs of movement above min(Q3 + 3 IQR, share of the extent); the keystate is the run's end, its score the run's span over 8."""
    part = Window.partitionBy(*keys)
    quartile = lambda q: F.percentile(movement, F.lit(q)).over(part)
    marked = df.withColumn("limit_", F.least(quartile(0.75) + 3 * (quartile(0.75) - quartile(0.25)), extent * share))
    runs = runs_of(marked, F.col(movement) > F.col("limit_"), keys, order, least)
    return runs.select(*keys, "start", F.col("end").alias("frame_idx"), ((F.col("end") - F.col("start")) / 8).alias("score"))


def contact_runs(df: DataFrame, keys: list[str], order: str, distance: str, gap: int = 5) -> DataFrame:
    """Ends of contact: distance, averaged over three rows, under min(20, 2 max(5th smallest, 3)); gaps shorter than ``gap`` are filled."""
    w = Window.partitionBy(*keys).orderBy(order)
    smooth = df.withColumn("d_", F.avg(distance).over(w.rowsBetween(-2, 0)))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("d_").asc_nulls_last()))
    fifth = F.max(F.when(F.col("rank_") <= 5, F.col("d_"))).over(Window.partitionBy(*keys))
    smooth = smooth.withColumn("rank_", rank).withColumn("fifth_", fifth)
    smooth = smooth.withColumn("near_", F.col("d_") < F.least(F.lit(20.0), 2 * F.greatest(F.col("fifth_"), F.lit(3.0)))).drop("rank_")
    filled = series.fill_false_runs(smooth, "near_", gap, keys, w, "touch_")
    runs = runs_of(filled, F.col("touch_"), keys, order, 1)
    return runs.withColumn("score", F.least((F.col("end") - F.col("start") + 1) / 8, F.lit(1.0)))


def monotone_segments(df: DataFrame, part: str, order: str, signal: str, drop: float, least: int, offset: int) -> DataFrame:
    """A segment ends where the signal falls by more than ``drop``; segments of ``least`` rows or more give a keystate after their end."""
    w = Window.partitionBy(part).orderBy(order)
    fell = F.when(F.col(signal) - F.lag(signal).over(w) < -drop, 1).otherwise(0)
    cut = df.withColumn("fell_", fell).withColumn("segment", F.sum("fell_").over(series.upto(w)))
    spans = cut.groupBy(part, "segment").agg(F.min(order).alias("start"), F.max(order).alias("end"), F.count("*").alias("n_"))
    return spans.filter(F.col("n_") >= least).select(part, "start", "end", (F.col("end") + offset).alias("frame_idx"))


def visible_sessions(df: DataFrame, part: str, order: str, visible: Column, window: int, misses: int, least: int) -> DataFrame:
    """Stretches in which at most ``misses`` of the last ``window`` frames are not visible, with ``least`` visible ones at least."""
    w = Window.partitionBy(part).orderBy(order)
    seen = F.sum(visible.cast("int")).over(w.rowsBetween(1 - window, 0))
    marked = df.withColumn("visible_", visible).withColumn("ok_", seen >= window - misses)
    marked = series.with_islands(marked, F.col("ok_"), w, "island_").filter("ok_")
    spans = marked.groupBy(part, "island_").agg(
        F.min(order).alias("start"), F.max(order).alias("end"), F.sum(F.col("visible_").cast("int")).alias("n_visible")
    )
    return spans.filter(F.col("n_visible") >= least).drop("island_")


def state_changes(df: DataFrame, w: WindowSpec, keys: list[str], order: str, state: str, persist: int) -> DataFrame:
    """Changes of the last known state that hold for ``persist`` more rows.

    A change across a stretch of unknown states of length n scores max(15 / (n + 1), 1) and is put n // 3 earlier;
    any other scores 1.
    """
    before = F.last(state, ignorenulls=True).over(series.earlier(w))
    seen = F.last(F.when(F.col(state).isNotNull(), F.col(order)), ignorenulls=True).over(series.earlier(w))
    ahead = w.rowsBetween(0, persist)
    holds = (F.count(F.when(F.col(state).isNull(), 1)).over(ahead) == 0) & (F.min(state).over(ahead) == F.max(state).over(ahead))
    marked = df.withColumn("old", before).withColumn("hidden_", F.col(order) - seen - 1).withColumn("holds_", holds & (F.count("*").over(ahead) == persist + 1))
    found = marked.filter(F.col("holds_") & (F.col("old") != F.col(state)))
    score = F.when(F.col("hidden_") == 0, 1.0).otherwise(F.greatest(F.lit(15.0) / (F.col("hidden_") + 1), F.lit(1.0)))
    return found.select(*keys, (F.col(order) - F.floor(F.col("hidden_") / 3)).cast("int").alias("frame_idx"), "old", F.col(state).alias("new"), score.alias("score"))


def boundary_states(intervals: DataFrame, states: DataFrame, part: str, start: str, end: str, order: str, state: str) -> DataFrame:
    """First and last known state within each interval (ends included)."""
    inside = overlap_join(intervals, states.filter(F.col(state).isNotNull()), [part], (start, end), (order, order))
    return inside.groupBy(part, start, end).agg(F.min_by(state, order).alias("first_state"), F.max_by(state, order).alias("last_state"))


def state_reason(name: Column, before: Column, after: Column) -> Column:
    return F.concat(F.lit("State changes: "), name, F.lit(" changed from "), before, F.lit(" to "), after, F.lit("\n"))


def proximity_reason(name: Column) -> Column:
    return F.concat(F.lit("Gripper proximity: The robot gripper was close to the "), name)


def movement_reason(name: Column) -> Column:
    return F.concat(F.lit("Object movements: The "), name, F.lit(" moved."))
