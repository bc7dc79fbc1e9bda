"""Votes over short buffers of frames, and the numbered objects that they keep alive: the batch twin of ``streaming.votes``."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Numbers below are colours of older masks.
FIRST_ID = 256


def voted_objects(frames: DataFrame, part: str, order: str, name: str, every: int, votes: int, least: int, most_missed: int) -> DataFrame:
    """(part, vote, name, id, slot, missed): the objects alive after each vote.

    Vote v looks at the frames from v * ``every`` on, ``votes`` of them, and takes place where a frame at their end or later is there. An object that
    ``least`` of them show is voted in. It stays alive for ``most_missed`` votes without it; if it
    comes back later it is a new one. Ids count up from FIRST_ID in each part, by first vote, then name, and are never given twice; slots
    number the objects that are alive, without gaps.
    """
    buffered = frames.filter((F.col(order) % every) < votes).select(part, F.floor(F.col(order) / every).cast("long").alias("vote"), name, order)
    shown = buffered.groupBy(part, "vote", name).agg(F.countDistinct(order).alias("n_")).filter(F.col("n_") >= least)
    ends = frames.groupBy(part).agg(F.floor((F.max(order) - (votes - 1)) / every).cast("long").alias("end_"))
    own = Window.partitionBy(part, name).orderBy("vote")
    gap = F.col("vote") - F.lag("vote").over(own)
    known = shown.join(ends, part).filter("vote <= end_").withColumn("new_", F.coalesce((gap > most_missed + 1).cast("int"), F.lit(1)))
    known = known.withColumn("life_", F.sum("new_").over(own))
    lives = known.groupBy(part, name, "life_", "end_").agg(F.min("vote").alias("from_"), F.max("vote").alias("to_"), F.collect_set("vote").alias("seen_"))
    lives = lives.withColumn("id", F.row_number().over(Window.partitionBy(part).orderBy("from_", name)) + F.lit(FIRST_ID - 1))
    until = F.least(F.col("to_") + most_missed, F.col("end_"))
    alive = lives.select(part, name, F.col("id").cast("long").alias("id"), "seen_", F.explode(F.sequence("from_", until)).alias("vote"))
    missed = F.col("vote") - F.array_max(F.filter("seen_", lambda v: v <= F.col("vote")))
    slot = F.row_number().over(Window.partitionBy(part, "vote").orderBy("id"))
    return alive.select(part, "vote", name, "id", slot.cast("long").alias("slot"), missed.cast("long").alias("missed"))
