"""Placed lines and the quarantine of bad records."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from chronoframe.sources import records

SCHEMA = "episode long, steps array<struct<x: double>>"


@pytest.fixture
def shard(tmp_path):
    good = [json.dumps({"episode": k, "steps": [{"x": k / 2}] * (1 + k % 3)}).encode() for k in range(200)]
    bad = [b'{"episode": 7, "steps": [', b"\xff\xfe{}", b"", b'{"episode": "seven", "steps": []}', b'{"episode": 8, "steps": []}', b'{"steps": [{"x": 1}]}', b"[1, 2"]
    lines = good[:50] + bad[:3] + good[50:120] + bad[3:] + good[120:]
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "one.jsonl").write_bytes(b"\n".join(lines[:100]) + b"\n")
    (tmp_path / "two.jsonl").write_bytes(b"\r\n".join(lines[100:]))
    (tmp_path / "_skipped").write_bytes(b"no record\n")
    return tmp_path, lines


@pytest.mark.parametrize("split", [1, 13, 500, 1 << 20])
def test_every_line_once_whatever_the_split(spark, shard, split):
    path, lines = shard
    if split == 1:
        path, lines = path / "a", lines[:8]
        (path / "one.jsonl").write_bytes(b"\n".join(lines))
    found = records.placed_lines(spark, str(path), split).collect()
    assert sorted(bytes(r.line) for r in found) == sorted(lines)
    for r in found:
        with open(r.file, "rb") as file:
            file.seek(r.at)
            assert file.readline().rstrip(b"\r\n") == bytes(r.line)


def test_bad_records_are_set_aside_and_none_is_lost(spark, shard, tmp_path):
    path, lines = shard
    rules = {"no episode": F.col("record.episode").isNull(), "no steps": F.size("record.steps") < 1}
    found = records.routed(records.placed_lines(spark, f"file://{path}", 700), "line", SCHEMA, rules)
    records.write_routed(found, f"{tmp_path}/out")
    good, bad = records.sound(spark, f"{tmp_path}/out"), records.quarantine(spark, f"{tmp_path}/out")
    assert sorted(r.episode for r in good.collect()) == list(range(200))
    assert good.count() + bad.count() == len(lines)
    assert sorted(r.reason for r in bad.collect()) == ["empty", "no episode", "no steps", "not JSON", "not JSON", "not UTF-8", "not of the schema"]
    records.write_routed(found.limit(0), f"{tmp_path}/nothing")
    assert records.quarantine(spark, f"{tmp_path}/nothing").count() == 0
    assert bad.columns == ["file", "at", "line", "reason"]


def test_text_lines_nulls_and_nothing(spark, tmp_path):
    df = spark.createDataFrame([(None,), ("  ",), ('{"episode": 1}',)], "t string")
    assert [r.reason for r in records.routed(df, "t", SCHEMA).collect()] == ["empty", "empty", None]
    (tmp_path / "none").mkdir()
    assert records.placed_lines(spark, f"{tmp_path}/none").count() == 0
    with pytest.raises(Exception, match="split"):
        records.placed_lines(spark, str(tmp_path), 0).count()
