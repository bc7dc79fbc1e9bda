"""Sources and sinks on small files; streams against their batch twins."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from chronoframe.operators import sessions
from chronoframe.plans import views
from chronoframe.sources import files
from chronoframe.streaming import events as streams


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture(scope="module")
def arriving(spark, small, tmp_path_factory):
    """The frames in four files by time, and a stream over them one at a time."""
    path = str(tmp_path_factory.mktemp("arriving"))
    frames = sessions.in_utc(views.frames(spark, small)).cache()
    ordered = frames.select(F.expr("*"), F.ntile(4).over(views.Window.orderBy("ts", "event_id")).alias("quarter"))
    for k in range(1, 5):
        ordered.filter(F.col("quarter") == k).drop("quarter").coalesce(1).write.mode("append").parquet(path)
    return frames, lambda: streams.read(spark, path, frames.schema, 1)


def test_tumbling_stream_equals_batch(spark, arriving, tmp_path):
    frames, stream = arriving
    result = streams.tumbling(stream(), "1 hour", ["object"], "0 seconds")
    streams.drain_updates(result, f"{tmp_path}/out", f"{tmp_path}/at")
    seen = spark.read.parquet(f"{tmp_path}/out").groupBy("start", "object").agg(F.max("n").alias("n"))
    assert rows(seen) == rows(sessions.tumbling(frames, "1 hour", ["object"]).select("start", "object", "n"))


def test_append_stream_goes_on_after_a_restart(spark, arriving, tmp_path):
    frames, stream = arriving
    result = lambda: streams.once_each(stream().unionByName(stream()), ["event_id"], "1000 days")
    streams.drain(result(), f"{tmp_path}/out", f"{tmp_path}/at")
    streams.drain(result(), f"{tmp_path}/out", f"{tmp_path}/at")
    assert rows(spark.read.parquet(f"{tmp_path}/out").select("event_id")) == rows(frames.select("event_id"))


def test_tracks_equal_batch(spark, arriving, tmp_path):
    frames, stream = arriving
    streams.drain_updates(streams.tracks(stream(), 10, "0 seconds", 10**12), f"{tmp_path}/out", f"{tmp_path}/at")
    found = streams.latest_tracks(spark.read.parquet(f"{tmp_path}/out").drop("batch")).drop("closed")
    told = sessions.tracks(frames, ["episode_id", "object"], "frame_idx", 10)
    assert rows(found) == rows(told.select("episode_id", "object", "track", "start", "end", "n"))


def test_idle_tracks_are_closed_and_forgotten(spark, arriving, tmp_path):
    frames, stream = arriving
    streams.drain_updates(streams.tracks(stream(), 10_000, "0 seconds", 60_000), f"{tmp_path}/out", f"{tmp_path}/at")
    found = streams.latest_tracks(spark.read.parquet(f"{tmp_path}/out").drop("batch"))
    assert found.agg(F.sum("n")).first()[0] == frames.count()
    assert found.filter("closed").count() > 0
    assert found.count() > frames.select("episode_id", "object").distinct().count()


def test_text_files(spark, tmp_path):
    (tmp_path / "classes.txt").write_text("1:cup,mug\n2:bowl\n")
    (tmp_path / "objects.txt").write_text("drawer:red\nblock\n\n")
    assert [r.name for r in files.vocabulary(spark, f"{tmp_path}/classes.txt").collect()]
    assert rows(files.predefined_objects(spark, f"{tmp_path}/objects.txt")) == [("block", None), ("drawer", "red")]


def test_frames_in_numeric_order(spark, tmp_path):
    for name in ("im_2.jpg", "im_10.jpg", "skip.png"):
        folder = tmp_path / "traj7" / "images0"
        folder.mkdir(parents=True, exist_ok=True)
        (folder / name).write_bytes(b"x")
    found = files.frame_files(spark, str(tmp_path)).orderBy("frame_no").collect()
    assert [(r.episode, r.frame_no, bytes(r.content)) for r in found] == [("traj7", 2, b"x"), ("traj7", 10, b"x")]


def test_first_given(spark):
    empty, some = spark.createDataFrame([], "task string"), spark.createDataFrame([("push",), ("pull",)], "task string")
    assert rows(files.first_given(empty, some)) == [("pull",), ("push",)]
    assert rows(files.first_given(empty, empty)) == [("Undefined",)]


def test_fields_and_paraphrases(spark):
    nested = spark.createDataFrame([(1, (2,))], "id int, o struct<a: int>")
    assert files.with_fields(nested, "o", ["b"]).select("o.*").columns == ["a", "b"]
    labels = spark.createDataFrame([(1, "push"), (2, "None"), (3, "lift"), (4, None)], "id int, label string")
    told = spark.createDataFrame([("push", "shove"), ("None", "x")], "label string, paraphrase string")
    assert rows(files.paraphrased(labels, told)) == [(1, "shove"), (2, "None"), (3, "lift"), (4, None)]


def test_sinks_and_resuming(spark, tmp_path):
    frames = spark.createDataFrame([(e, i) for e in (1, 2) for i in range(10)], "episode_id long, frame_idx long")
    segments = spark.createDataFrame([(1, 0, 3, "a"), (1, 3, 5, "b"), (2, 8, 20, "c")], "episode_id long, start long, end long, label string")
    assert rows(files.remaining(frames, spark, f"{tmp_path}/seg", ["episode_id"])) == rows(frames)
    files.save_segments(frames, segments.filter("episode_id = 1"), "episode_id", "frame_idx", f"{tmp_path}/seg")
    kept = spark.read.parquet(f"{tmp_path}/seg")
    assert kept.count() == 5 and kept.filter("label = 'b'").count() == 2
    left = files.remaining(frames, spark, f"{tmp_path}/seg", ["episode_id"])
    assert {r.episode_id for r in left.collect()} == {2}
    labels = spark.createDataFrame([(1, ["x"]), (2, [])], "id int, labels array<string>")
    files.save_labels(labels, f"{tmp_path}/labels", "id")
    assert all(len(r.labels) == 3 for r in spark.read.parquet(f"{tmp_path}/labels").collect())


def test_stride(spark):
    df = spark.createDataFrame([(1, i) for i in range(7)], "e int, i int")
    assert [r.i for r in files.strided(df, "e", "i", 3).orderBy("i").collect()] == [0, 3, 6]
