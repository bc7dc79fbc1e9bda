"""The semi-online tracker's state: a buffer of frames, a vote when it is full, and numbered objects, in keyed state with timers.

Needs the RocksDB state store (``spark.sql.streaming.stateStore.providerClass``), as every arbitrary state processor of Spark does.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from chronoframe.operators.buffered import FIRST_ID

SCHEMA = "episode_id long, vote long, object string, id long, slot long, missed long"


class _Voter(StatefulProcessor):
    """State of an episode: the frames of the open vote (list), the objects alive (map), the next vote and the next id (value)."""

    def __init__(self, every: int, votes: int, least: int, most_missed: int, idle_ms: int):
        self.every, self.votes, self.least, self.most_missed, self.idle_ms = every, votes, least, most_missed, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.buffer = handle.getListState("buffer", "frame_idx long, object string")
        self.alive = handle.getMapState("alive", "object string", "id long, last long")
        self.next = handle.getValueState("next", "vote long, id long")

    def _vote(self, vote: int, shown: set[tuple[int, str]], alive: dict[str, list[int]], new_id: int) -> int:
        """Objects that come, stay and go at a vote; the next free id."""
        begin, counts = vote * self.every, defaultdict(int)
        for frame, name in shown:
            counts[name] += begin <= frame < begin + self.votes
        for name in sorted(n for n, k in counts.items() if k >= self.least):
            if name not in alive:
                alive[name], new_id = [new_id, vote], new_id + 1
            alive[name][1] = vote
        for name in [n for n, (_, last) in alive.items() if vote - last > self.most_missed]:
            del alive[name]
        return new_id

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        frames = pd.concat(list(rows)).sort_values("frame_idx")
        vote, new_id = self.next.get() if self.next.exists() else (0, FIRST_ID)
        shown = {(f, n) for f, n in self.buffer.get()} if self.buffer.exists() else set()
        alive = {k[0]: list(v) for k, v in self.alive.iterator()} if self.alive.exists() else {}
        before, out = set(alive), []
        for frame, names in frames.groupby("frame_idx", sort=True).object:
            if frame >= vote * self.every:
                shown.update((int(frame), n) for n in names if n is not None)
            while frame >= vote * self.every + self.votes - 1:
                new_id = self._vote(vote, shown, alive, new_id)
                known = sorted(alive.items(), key=lambda item: item[1][0])
                out += [(key[0], vote, n, i, slot, vote - last) for slot, (n, (i, last)) in enumerate(known, 1)]
                vote += 1
                shown = {s for s in shown if s[0] >= vote * self.every}
        self.next.update((vote, new_id))
        self.buffer.clear()
        if shown:
            self.buffer.put(sorted(s for s in shown if s[0] % self.every < self.votes))
        for name in before - set(alive):
            self.alive.removeKey((name,))
        for name, value in alive.items():
            self.alive.updateValue((name,), tuple(value))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        latest = int(frames.ts.max().timestamp() * 1000)
        self.handle.registerTimer(max(latest, timerValues.getCurrentWatermarkInMs()) + self.idle_ms)
        yield pd.DataFrame(out, columns=["episode_id", "vote", "object", "id", "slot", "missed"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        """An episode without frames for so long ends: all that is kept of it goes."""
        for state in (self.buffer, self.alive, self.next):
            state.clear()
        yield pd.DataFrame([], columns=["episode_id", "vote", "object", "id", "slot", "missed"])

    def close(self) -> None:
        pass


def voted_objects(frames: DataFrame, every: int, votes: int, least: int, most_missed: int, lateness: str, idle_ms: int) -> DataFrame:
    """``buffered.voted_objects`` of a stream of (episode_id, object, frame_idx, ts), in append mode: each vote's rows once, when its last frame has come.

    An episode's frames must come in order from batch to batch; a frame of a vote that has taken place is passed over. State is
    one vote's frames and the objects alive; it goes ``idle_ms`` of event time after the last frame, after which the episode would begin anew.
    A null object shows nothing.
    """
    keyed = frames.select("episode_id", "object", F.col("frame_idx").cast("long").alias("frame_idx"), "ts").withWatermark("ts", lateness)
    return keyed.groupBy("episode_id").transformWithStateInPandas(_Voter(every, votes, least, most_missed, idle_ms), SCHEMA, "append", "eventTime")
