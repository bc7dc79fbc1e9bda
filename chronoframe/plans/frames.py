"""Queries on frames: views, sampling, dense grids, chunks, resuming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronoframe.operators import grids
from chronoframe.plans.registry import query
from chronoframe.plans.views import FRAMES, frames, table


@query(f"WITH {FRAMES} SELECT episode_id, frame_idx, event_id, object, value, k, gripper, state FROM frames")
def frames_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames(spark, sf_dir).drop("ts")


@query(f"""WITH {FRAMES}, sizes AS (SELECT episode_id, count(*) AS n FROM frames GROUP BY episode_id),
wanted AS (SELECT DISTINCT episode_id, floor(i * (n - 1) / 15.0)::INTEGER AS frame_idx FROM sizes, (SELECT unnest(range(16)) AS i))
SELECT f.episode_id, f.frame_idx, f.event_id FROM frames f JOIN wanted w ON f.episode_id = w.episode_id AND f.frame_idx = w.frame_idx""")
def sample_linspace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grids.linspace_sample(frames(spark, sf_dir), "episode_id", "frame_idx", 16).select("episode_id", "frame_idx", "event_id")


@query(f"WITH {FRAMES} SELECT episode_id, frame_idx, event_id FROM frames WHERE frame_idx % 20 < 4")
def detection_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames(spark, sf_dir).filter(grids.scheduled(F.col("frame_idx"), 20, 4)).select("episode_id", "frame_idx", "event_id")


@query(f"""WITH {FRAMES}, objects AS (SELECT DISTINCT episode_id, object FROM frames)
SELECT f.episode_id, o.object, f.frame_idx, CASE WHEN f.object = o.object THEN f.value END AS value, f.object = o.object AS seen
FROM frames f JOIN objects o ON f.episode_id = o.episode_id""")
def dense_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grids.dense(frames(spark, sf_dir), "episode_id", "frame_idx", "object", ["value"]).select("episode_id", "object", "frame_idx", "value", "seen")


@query("SELECT o_orderkey, o_orderstatus FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l_returnflag = 'R')")
def resume_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return grids.not_done(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), done, ["o_orderkey"])


@query(f"""WITH {FRAMES}, sized AS (SELECT *, count(*) OVER (PARTITION BY episode_id) AS n FROM frames),
chunked AS (SELECT *, CASE WHEN n > 50 THEN frame_idx // 40 ELSE 0 END AS chunk FROM sized)
SELECT episode_id, event_id, chunk::INTEGER AS chunk, (frame_idx - min(frame_idx) OVER (PARTITION BY episode_id, chunk))::INTEGER AS frame_in_chunk FROM chunked""")
def chunk_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grids.chunks(frames(spark, sf_dir), "episode_id", "frame_idx", 50, 40).select("episode_id", "event_id", "chunk", "frame_in_chunk")


@query(f"""WITH {FRAMES}, last AS (SELECT episode_id, max(frame_idx) AS t FROM frames GROUP BY episode_id)
SELECT f.episode_id, frame_idx, event_id, floor(frame_idx / 16)::INTEGER AS batch, frame_idx = t AS is_end FROM frames f JOIN last USING (episode_id)
WHERE frame_idx % 4 = 0 OR frame_idx = t""")
def frame_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fourth frame and the last, in batches of 16 frames."""
    last = F.max("frame_idx").over(Window.partitionBy("episode_id"))
    found = frames(spark, sf_dir).withColumn("is_end", F.col("frame_idx") == last).filter((F.col("frame_idx") % 4 == 0) | F.col("is_end"))
    return found.select("episode_id", "frame_idx", "event_id", grids.batch_of(F.col("frame_idx"), 16).alias("batch"), "is_end")


@query(f"""WITH {FRAMES}, nested AS (SELECT episode_id, list(struct_pack(o := object, v := value) ORDER BY frame_idx) AS steps FROM frames GROUP BY episode_id)
SELECT episode_id, array_to_string(list_transform(steps, lambda s: s.o), ',') AS objects, len(steps)::INTEGER AS n_steps,
       round(list_sum(list_transform(steps, lambda s: s.v)), 4) AS total FROM nested""")
def stack_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists of steps as arrays of their fields."""
    stacked = grids.stacked(frames(spark, sf_dir), ["episode_id"], "frame_idx", ["object", "value"])
    total = F.round(F.aggregate("value", F.lit(0.0), lambda a, v: a + v), 4)
    return stacked.select("episode_id", F.array_join("object", ",").alias("objects"), F.size("object").alias("n_steps"), total.alias("total"))
