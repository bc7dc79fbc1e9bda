"""Vote buffers as a stream and in batch, and exact consensus."""

from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from chronoframe.operators import buffered, consensus, sessions
from chronoframe.plans import tracking, views
from chronoframe.streaming import events as streams
from chronoframe.streaming import votes


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def plain(frames: list[tuple], every: int, n: int, least: int, most_missed: int) -> list[tuple]:
    """frames: (episode, frame, object); what is alive after each vote, vote by vote."""
    out = []
    for e in {f[0] for f in frames}:
        own = [f for f in frames if f[0] == e]
        alive, new_id, vote = {}, 256, 0
        while vote * every + n - 1 <= max(f[1] for f in own):
            shown = Counter(o for _, o in {(f[1], f[2]) for f in own if vote * every <= f[1] < vote * every + n and f[2] is not None})
            for o in sorted(o for o, k in shown.items() if k >= least):
                if o not in alive:
                    alive[o], new_id = [new_id, vote], new_id + 1
                alive[o][1] = vote
            alive = {o: v for o, v in alive.items() if vote - v[1] <= most_missed}
            for slot, (o, (i, last)) in enumerate(sorted(alive.items(), key=lambda x: x[1][0]), 1):
                out.append((e, vote, o, i, slot, vote - last))
            vote += 1
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset(key)


@pytest.mark.parametrize("most_missed", [0, 1, 3])
def test_batch_equals_plain(spark, most_missed):
    chosen = random.Random(most_missed)
    frames = [(e, f, chosen.choice("abcde")) for e in range(4) for f in range(90) if chosen.random() < 0.7]
    frames += [(9, 2, "a"), (9, 300, "b"), (9, 301, "b"), (9, 305, "c"), (5, 0, "x")] + frames[:40]
    df = spark.createDataFrame(frames, "e long, f long, o string").repartition(3)
    assert rows(buffered.voted_objects(df, "e", "f", "o", 6, 4, 2, most_missed)) == plain(frames, 6, 4, 2, most_missed)


def test_stream_equals_batch_after_a_restart(spark, small, tmp_path, rocks):
    frames = sessions.in_utc(views.frames(spark, small)).cache()
    ordered = frames.select("*", F.ntile(4).over(views.Window.orderBy("ts", "event_id")).alias("quarter"))
    source = f"{tmp_path}/in"

    def arrive(*quarters: int) -> None:
        for k in quarters:
            ordered.filter(F.col("quarter") == k).drop("quarter").coalesce(1).write.mode("append").parquet(source)

    def run() -> None:
        result = votes.voted_objects(streams.read(spark, source, frames.schema, 1), tracking.EVERY, tracking.VOTES, tracking.LEAST, tracking.MISSED, "0 seconds", 10**12)
        streams.drain(result, f"{tmp_path}/out", f"{tmp_path}/at")

    arrive(1, 2)
    run()
    first = spark.read.parquet(f"{tmp_path}/out").count()
    arrive(3, 4)
    run()
    found = spark.read.parquet(f"{tmp_path}/out")
    told = buffered.voted_objects(frames, "episode_id", "frame_idx", "object", tracking.EVERY, tracking.VOTES, tracking.LEAST, tracking.MISSED)
    assert rows(found.select(told.columns)) == rows(told) and 0 < first < found.count()


def test_idle_episodes_are_forgotten(spark, tmp_path, rocks):
    schema = "episode_id long, object string, frame_idx long, ts timestamp"
    source = f"{tmp_path}/in"
    frame = lambda e, f, day: (e, "a", f, day)

    def arrive(*frames: tuple) -> None:
        df = spark.createDataFrame([(e, o, f, d) for e, o, f, d in frames], "episode_id long, object string, frame_idx long, d string")
        df.withColumn("ts", F.to_timestamp("d")).drop("d").coalesce(1).write.mode("append").parquet(source)
        streams.drain(votes.voted_objects(streams.read(spark, source, schema, 1), 2, 2, 1, 5, "0 seconds", 3_600_000), f"{tmp_path}/out", f"{tmp_path}/at")

    arrive(frame(1, 0, "2024-01-01"), frame(1, 1, "2024-01-01"), frame(2, 0, "2024-01-01"))
    arrive(frame(3, 0, "2024-02-01"))
    arrive(frame(3, 1, "2024-02-02"))
    # Episode 2 begins anew: the frame that its buffer held is gone, and so is its vote.
    arrive(frame(2, 1, "2024-02-03"), frame(1, 2, "2024-02-03"), frame(1, 3, "2024-02-03"))
    found = {(r.episode_id, r.vote): (r.id, r.missed) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert found == {(1, 0): (256, 0), (3, 0): (256, 0), (2, 0): (256, 0), (1, 1): (256, 0)}


def enumerated(weights: list[int], adjacent: list[int]) -> int:
    best = (0, 0)
    n = len(weights)
    for chosen in range(1 << n):
        if all(not (chosen >> i & 1) or (weights[i] > 0 and not adjacent[i] & chosen) for i in range(n)):
            best = max(best, (sum(w for i, w in enumerate(weights) if chosen >> i & 1), sum(1 << (n - 1 - i) for i in range(n) if chosen >> i & 1)))
    return sum(1 << (n - 1 - i) for i in range(n) if best[1] >> i & 1)


def graph(n: int, edges: set[tuple[int, int]]) -> list[int]:
    return [sum(1 << b if a == i else 1 << a for a, b in edges if i in (a, b)) for i in range(n)]


@pytest.mark.parametrize("seed", range(40))
def test_heaviest_set_equals_enumeration(seed):
    chosen = random.Random(seed)
    n = chosen.randrange(1, 14)
    edges = {(a, b) for a in range(n) for b in range(a + 1, n) if chosen.random() < chosen.choice([0.1, 0.3, 0.7])}
    weights = [chosen.randrange(-2, 6) for _ in range(n)]
    assert consensus.heaviest(weights, graph(n, edges)) == enumerated(weights, graph(n, edges))


def test_heaviest_set_of_large_components():
    n = 600
    chain = consensus.heaviest([1 + i % 3 for i in range(n)], graph(n, {(i, i + 1) for i in range(n - 1)}))
    take, leave = 0, 0
    for i in range(n):
        take, leave = leave + 1 + i % 3, max(take, leave)
    assert sum(1 + i % 3 for i in range(n) if chain >> i & 1) == max(take, leave)
    cliques = {(a, b) for k in range(0, 200, 20) for a in range(k, k + 20) for b in range(a + 1, k + 20)} | {(k, k + 20) for k in range(0, 180, 20)}
    found = consensus.heaviest([1] * 200, graph(200, cliques))
    assert bin(found).count("1") == 10


def test_consensus_of_one_window(spark):
    same = [(1, f, 10 * f + k, 0.9 - k / 10, 100.0 * k, 0.0, 100.0 * k + 10, 10.0) for f in range(4) for k in range(2)]
    alone = [(1, 0, 99, 0.9, 500.0, 0.0, 510.0, 10.0), (2, 0, 98, 0.9, 0.0, 0.0, 1.0, 1.0), (1, 0, None, 0.9, 0.0, 0.0, 10.0, 10.0)]
    df = spark.createDataFrame(same + alone, "w long, f int, id long, score double, x1 double, y1 double, x2 double, y2 double")
    found = rows(consensus.consensus(df, ["w"], "f", "id", "score", 4))
    assert [(r[0], r[1], r[2], round(r[3], 6)) for r in found] == [(1, 0, 3, 0.9), (1, 1, 3, 0.8)]
    assert rows(consensus.consensus(df.limit(0), ["w"], "f", "id", "score", 4)) == []
