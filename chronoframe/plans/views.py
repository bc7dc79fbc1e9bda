"""Views of the events table in the shape of episodes, in Spark and as SQL for the oracles.

An episode is a user's events in order of (ts, event_id); an object is an event type; a box, a score and a
gripper state are derived from a row's own columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

from chronoframe.operators.tables import dealt

OBJECTS = ("click", "error", "purchase", "signup", "view")


def episode() -> WindowSpec:
    """An episode's frames in order (made when asked for, as a window needs a session)."""
    return Window.partitionBy("episode_id").orderBy("frame_idx")


def per_object() -> WindowSpec:
    """The same for each object of an episode."""
    return Window.partitionBy("episode_id", "object").orderBy("frame_idx")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frames(spark: SparkSession, sf_dir: str, spread: bool = False) -> DataFrame:
    """(episode_id, frame_idx, event_id, ts, object, value, k, gripper, state); where ``spread``, tasks hold equally many rows at every size, each episode whole."""
    events, user = table(spark, sf_dir, "events"), "user_id"
    if spread:
        # Under its last name, so that Spark knows later steps by episodes to be dealt rightly.
        events, user = dealt(events.withColumnRenamed(user, "episode_id"), ["episode_id"]), "episode_id"
    order = Window.partitionBy(user).orderBy("ts", "event_id")
    return events.select(
        F.col(user).alias("episode_id"),
        (F.row_number().over(order) - 1).alias("frame_idx"),
        "event_id",
        "ts",
        F.col("event_type").alias("object"),
        "value",
        F.get_json_object("props", "$.k").cast("int").alias("k"),
        F.when(F.col("event_type").isin("click", "purchase"), -1).otherwise(1).alias("gripper"),
        F.when(F.col("event_type") != "error", F.col("event_type")).alias("state"),
    )


def boxes(spark: SparkSession, sf_dir: str, spread: bool = False) -> DataFrame:
    """Frames with their box (x1, y1, x2, y2) and score."""
    k, y = F.col("k").cast("double"), (F.col("event_id") % 100).cast("double")
    return frames(spark, sf_dir, spread).select(
        "*",
        k.alias("x1"),
        y.alias("y1"),
        (k + 1 + F.col("value") / 10).alias("x2"),
        (y + 1 + (F.col("episode_id") % 10)).alias("y2"),
        F.least(F.col("value") / 100, F.lit(1.0)).alias("score"),
    )


FRAMES = """frames AS (
  SELECT user_id AS episode_id, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1)::INTEGER AS frame_idx, event_id, ts,
         event_type AS object, value, json_extract_string(props, '$.k')::INTEGER AS k,
         CASE WHEN event_type IN ('click', 'purchase') THEN -1 ELSE 1 END AS gripper,
         CASE WHEN event_type <> 'error' THEN event_type END AS state
  FROM events)"""

BOXES = f"""{FRAMES}, boxes AS (
  SELECT *, k::DOUBLE AS x1, (event_id % 100)::DOUBLE AS y1, k + 1 + value / 10 AS x2, (event_id % 100) + 1 + (episode_id % 10)::DOUBLE AS y2,
         least(value / 100, 1.0) AS score FROM frames)"""
