"""Votes of several detectors on keystates: scoring, grouping, suppression, reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoframe.operators import nearest, series

#: Weights of the detectors.
WEIGHTS = {"object_movement": 0.9, "scene_graph": 0.7, "gripper_close": 0.6, "gripper_position": 0.8, "object_state": 1.4}
STATE = "object_state"
#: A state change this many frames later still agrees.
STATE_REACH = 20


def weight_of(predictor: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for pair in WEIGHTS.items() for x in pair)), predictor), F.lit(0.0))


def vote_scores(keystates: DataFrame, part: str, tolerance: int) -> DataFrame:
    """(part, object, predictor, frame_idx, voted_frame, score) for keystates (part, object, predictor, frame_idx).

    A keystate gets its own detector's weight and that of each other detector of its object with a keystate less than
    ``tolerance`` away, whose nearest one (the earlier on ties) joins the pool; the state detector also agrees, without joining, if
    it is that far but has one less than STATE_REACH frames later. The voted frame is the pool's mean, cut; the
    score is the weight as a share of that of all detectors of the object.
    """
    near_ahead = Window.partitionBy(part, "object").orderBy("frame_idx").rangeBetween(0, STATE_REACH - 1)
    keystates = keystates.select(part, "object", "predictor", "frame_idx").distinct()
    keystates = keystates.withColumn("later_", F.max((F.col("predictor") == STATE).cast("int")).over(near_ahead) == 1)
    totals = keystates.select(part, "object", "predictor").distinct().groupBy(part, "object").agg(F.sum(weight_of(F.col("predictor"))).alias("total_"))
    others = keystates.select(part, "object", F.col("predictor").alias("other_"), F.col("frame_idx").alias("x_"))
    pairs = nearest.banded(keystates.drop("later_"), [part, "object"], "frame_idx", tolerance - 1, others, "x_")
    pairs = pairs.filter(F.col("predictor") != F.col("other_"))
    gap = F.abs(F.col("frame_idx") - F.col("x_"))
    votes = pairs.groupBy(part, "object", "predictor", "frame_idx", "other_").agg(F.min(F.struct(gap.alias("gap"), "x_")).alias("near_"))
    agreed = votes.groupBy(part, "object", "predictor", "frame_idx").agg(
        F.sum(weight_of(F.col("other_"))).alias("w_"), F.sum("near_.x_").alias("sum_"), F.count("*").alias("n_"), F.max(F.col("other_") == STATE).alias("state_")
    )
    scored = keystates.join(agreed, [part, "object", "predictor", "frame_idx"], "left").join(totals, [part, "object"])
    mean = (F.col("frame_idx") + F.coalesce("sum_", F.lit(0))) / (1 + F.coalesce("n_", F.lit(0)))
    late = F.col("later_") & (F.col("predictor") != STATE) & ~F.coalesce("state_", F.lit(False))
    others_ = F.coalesce("w_", F.lit(0.0)) + F.when(late, WEIGHTS[STATE]).otherwise(0.0)
    score = (weight_of(F.col("predictor")) + others_) / F.col("total_")
    return scored.select(part, "object", "predictor", "frame_idx", F.floor(mean).cast("int").alias("voted_frame"), score.alias("score"))


def grouped_votes(scored: DataFrame, part: str, gap: int = 4) -> DataFrame:
    """One keystate for each stretch of voted frames of an object: its best frame, its best score with 0.01 for each frame less 0.1."""
    best = scored.groupBy(part, "object", "voted_frame").agg(F.max("score").alias("score"))
    w = Window.partitionBy(part, "object").orderBy("voted_frame")
    cut = F.when(F.col("voted_frame") - F.lag("voted_frame").over(w) > gap, 1).otherwise(0)
    best = best.withColumn("cut_", cut).withColumn("group_", F.sum("cut_").over(series.upto(w)))
    groups = best.groupBy(part, "object", "group_").agg(
        F.max(F.struct(F.round("score", 9).alias("score"), (-F.col("voted_frame")).alias("at"))).alias("top_"), F.count("*").alias("n_")
    )
    return groups.select(part, "object", (-F.col("top_.at")).alias("frame_idx"), F.round(F.col("top_.score") + 0.01 * F.col("n_") - 0.1, 9).alias("score"))


def suppressed(keystates: DataFrame, part: str, distance: int) -> DataFrame:
    """Greedy suppression along time, across objects: while the next keystate is within ``distance`` of the best so far the better one stays.

    A gap above ``distance`` cuts the part's keystates into chains that don't touch each other. The anchor
    moves with the best, so each chain is folded in its order.
    """
    w = Window.partitionBy(part).orderBy("frame_idx", "object", "score")
    cut = F.when(F.col("frame_idx") - F.lag("frame_idx").over(w) > distance, 1).otherwise(0)
    chains = keystates.withColumn("cut_", cut).withColumn("chain_", F.sum("cut_").over(series.upto(w)))
    ordered = chains.groupBy(part, "chain_").agg(F.sort_array(F.collect_list(F.struct("frame_idx", F.col("object"), "score"))).alias("all_"))
    item = "struct<frame_idx: int, object: string, score: double>"
    start = F.struct(F.expr(f"cast(array() as array<{item}>)").alias("done"), F.expr(f"cast(null as {item})").alias("best"))

    def step(state: Column, x: Column) -> Column:
        near = state.best.isNotNull() & (x.frame_idx - state.best.frame_idx <= distance)
        better = F.when(x.score > state.best.score, x).otherwise(state.best)
        done = F.when(near | state.best.isNull(), state.done).otherwise(F.concat(state.done, F.array(state.best)))
        return F.struct(done.alias("done"), F.when(near, better).otherwise(x).alias("best"))

    typed = ordered.select(part, F.col("all_").cast(f"array<{item}>").alias("all_"))
    kept = typed.select(part, F.explode(F.aggregate("all_", start, step, lambda s: F.concat(s.done, F.array(s.best)))).alias("k"))
    return kept.select(part, "k.object", "k.frame_idx", "k.score")


def combined(scored: DataFrame, part: str, distance: int = 3, least: float = 0.15) -> DataFrame:
    """Voted keystates grouped by object, suppressed across objects, above the least score."""
    groups = grouped_votes(scored, part).filter("score >= 0")
    return suppressed(groups, part, distance).filter(F.col("score") > least)


def matched_reasons(keystates: DataFrame, reasons: DataFrame, keys: list[str], reach: int, otherwise: str) -> DataFrame:
    """Each keystate with the nearest reason of its keys within ``reach``, a placeholder if there is none."""
    found = nearest.nearest_within(keystates, reasons, keys, "frame_idx", "at", reach, ["reason"])
    return found.withColumn("reason", F.coalesce("reason", F.lit(otherwise)))


def majority(df: DataFrame, keys: list[str], value: str, weight: Column | None = None) -> DataFrame:
    """(keys, value, votes) of the value with most votes (or weight); the smallest value on ties; nulls don't vote."""
    votes = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg((F.count("*") if weight is None else F.round(F.sum(weight), 6)).alias("votes"))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("votes"), value))
    return votes.withColumn("rank_", rank).filter("rank_ = 1").drop("rank_")


def gated(df: DataFrame, score: str, tasks: str, least: float) -> DataFrame:
    """Adds ``kept``: a score above ``least`` and tasks; the others' score becomes -1."""
    kept = F.coalesce((F.col(score) > least) & (F.size(tasks) > 0), F.lit(False))
    return df.withColumn("kept", kept).withColumn(score, F.when(F.col("kept"), F.col(score)).otherwise(-1.0))


def clean_tracks(df: DataFrame, part: str, track: str, class_: str, score: str, place: str, often: int, reach: int) -> DataFrame:
    """(part, track, class, kept): of a class's tracks the best by mean plus half of the sum of its scores stays, with those whose
    places come within ``reach`` of its own and those seen more than ``often`` times."""
    votes = df.groupBy(part, track, class_).agg(F.avg(score).alias("m_"), F.sum(score).alias("s_"), F.count("*").alias("n_"), F.min(place).alias("lo_"), F.max(place).alias("hi_"))
    w = Window.partitionBy(part, class_).orderBy(F.round(F.col("m_") + 0.5 * F.col("s_"), 9).desc(), track)
    best = votes.withColumn("rank_", F.row_number().over(w)).withColumn("lo_1", F.first("lo_").over(w)).withColumn("hi_1", F.first("hi_").over(w))
    touches = (F.col("lo_") <= F.col("hi_1") + reach) & (F.col("hi_") >= F.col("lo_1") - reach)
    return best.select(part, track, class_, ((F.col("rank_") == 1) | (F.col("n_") > often) | touches).alias("kept"))


def class_scores(df: DataFrame, part: str, track: str, class_: str, score: str) -> DataFrame:
    """(part, class, score): 0.9 times the sum of its tracks' mean scores, 0.1 times how far more than half of their votes are for it, on average."""
    whole = df.groupBy(part, track).agg(F.count("*").alias("all_"))
    votes = df.groupBy(part, track, class_).agg(F.avg(score).alias("m_"), F.count("*").alias("n_")).join(whole, [part, track])
    consistent = (F.col("n_") / F.col("all_") - 0.5) / 0.5
    return votes.groupBy(part, class_).agg((0.9 * F.sum("m_") + 0.1 * F.sum(consistent) / F.count("*")).alias("score"))
