"""The streaming edition: events as they arrive, with watermarks and keyed state.

Late rows beyond the watermark are dropped by Spark and counted in the query's progress. The windows are
the same functions that serve batch tables.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from chronoframe.operators import sessions

#: A track that has been idle for so long in event time is closed and forgotten.
IDLE_MS = 30 * 24 * 3_600_000
TRACK_SCHEMA = "episode_id long, object string, start long, end long, n long, closed boolean"


def read(spark: SparkSession, path: str, schema: StructType | str, files_at_once: int = 100) -> DataFrame:
    """A stream of Parquet files of the given schema, oldest first."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(path)


def tumbling(events: DataFrame, size: str, keys: list[str], lateness: str) -> DataFrame:
    return sessions.tumbling(events.withWatermark("ts", lateness), size, keys)


def sliding(events: DataFrame, size: str, step: str, lateness: str) -> DataFrame:
    return sessions.sliding(events.withWatermark("ts", lateness), size, step)


def by_gap(events: DataFrame, key: str, gap: str, lateness: str) -> DataFrame:
    return sessions.by_gap(events.withWatermark("ts", lateness), key, gap)


def once_each(events: DataFrame, keys: list[str], lateness: str) -> DataFrame:
    """Events without repeats that arrive within the watermark."""
    return events.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(keys)


def _advance(most_missed: int, idle_ms: int):
    columns = ["episode_id", "object", "start", "end", "n", "closed"]

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        """One key's frames of this batch in order; the state is the open track only."""
        if state.hasTimedOut:
            idle = tuple(state.get)
            state.remove()
            yield pd.DataFrame([(*key, *idle, True)], columns=columns)
            return
        open_ = list(state.get) if state.exists else None
        rows = []
        frames = pd.concat(list(batches)).sort_values("frame_idx")
        latest = int(frames.ts.max().timestamp() * 1000)
        for frame in frames.frame_idx.tolist():
            if open_ is not None and frame - open_[1] <= most_missed:
                open_[1], open_[2] = max(open_[1], frame), open_[2] + 1
                continue
            if open_ is not None:
                rows.append((*key, *open_, True))
            open_ = [frame, frame, 1]
        rows.append((*key, *open_, False))
        state.update(tuple(open_))
        state.setTimeoutTimestamp(max(latest, state.getCurrentWatermarkMs()) + idle_ms)
        yield pd.DataFrame(rows, columns=columns)

    return run


def tracks(frames: DataFrame, most_missed: int, lateness: str, idle_ms: int = IDLE_MS) -> DataFrame:
    """Tracks of (episode_id, object, frame_idx, ts) as they grow, in update mode.

    A track is closed when its object comes again after more than ``most_missed`` frames, or when the
    watermark passes its last frame by ``idle_ms``; then its state goes, so that idle objects cost nothing.
    State is three numbers for each object; frames of an object must arrive in order from batch to batch. A track is
    told by its start, and its last row is its final one.
    """
    keyed = frames.select("episode_id", "object", F.col("frame_idx").cast("long").alias("frame_idx"), "ts").withWatermark("ts", lateness)
    return keyed.groupBy("episode_id", "object").applyInPandasWithState(
        _advance(most_missed, idle_ms), TRACK_SCHEMA, "start long, end long, n long", "update", GroupStateTimeout.EventTimeTimeout
    )


def drain(result: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Runs an append-mode stream over all that is there into Parquet files, once; a restart goes on where it stopped."""
    query = result.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def drain_updates(result: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """The same for an update-mode stream: each batch has a folder of its own, so a batch that is run again writes over itself."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    query = result.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def latest_tracks(updates: DataFrame) -> DataFrame:
    """The last state of each track among all updates, numbered from 0 for each object."""
    last = updates.groupBy("episode_id", "object", "start").agg(F.max(F.struct("n", "end", "closed")).alias("s"))
    number = F.row_number().over(Window.partitionBy("episode_id", "object").orderBy("start")) - 1
    return last.select("episode_id", "object", number.alias("track"), "start", "s.end", "s.n", "s.closed")
