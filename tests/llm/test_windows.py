"""Removal of repeated windows against a plain version."""

from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from chronoframe.llm import queries, windows
from tests.llm.conftest import prose


def plain(rows: list[tuple], width: int = 13) -> list[tuple]:
    """rows: (key, text); (key, text left, words, removed) sorted."""
    split = [(key, re.findall("[^\x20\x09-\x0d]+", text or ""), text is None) for key, text in rows]
    rank = lambda key: (key is not None, key or 0)
    first: dict[tuple, tuple] = {}
    for key, words, _ in split:
        for i in range(len(words) - width + 1):
            whole = tuple(words[i : i + width])
            first[whole] = min(first.get(whole, rank(key)), rank(key))
    out = []
    for key, words, null in split:
        gone = set()
        for i in range(len(words) - width + 1):
            if first[tuple(words[i : i + width])] < rank(key):
                gone.update(range(i, i + width))
        left = " ".join(w for i, w in enumerate(words) if i not in gone)
        out.append((key, None if null else left, len(words), len(gone)))
    return sorted(out, key=repr)


def found(df) -> list[tuple]:
    return sorted((tuple(r) for r in df.select("doc_id", "text", "n_words", "n_removed").collect()), key=repr)


def shared(seed: int) -> list[tuple]:
    chosen = random.Random(seed)
    passages = [prose(n, 500 + n).split() for n in (12, 13, 14, 30, 60)]
    rows = []
    for i in range(120):
        words = prose(chosen.randrange(0, 80), i).split()
        for _ in range(chosen.randrange(3)):
            at = chosen.randrange(len(words) + 1)
            words[at:at] = chosen.choice(passages)
        rows.append((chosen.randrange(100), chosen.choice([" ", "\n", "  ", "\t"]).join(words)))
    hot = " ".join(passages[3])
    return rows + [(1000 + i, hot) for i in range(60)]


@pytest.mark.parametrize("bits", [2, 5, 12])
def test_equals_plain_version(spark, bits):
    rows = shared(bits)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert found(windows.dedup_windows(df, part_bits=bits)) == plain(rows)


def test_few_different_words(spark):
    chosen = random.Random(3)
    rows = [(i, " ".join(chosen.choice("ab") for _ in range(chosen.randrange(60)))) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert found(windows.dedup_windows(df, width=4, part_bits=3)) == plain(rows, 4)


def test_awkward(spark, awkward):
    df = awkward.withColumns({"part_": F.lit("x"), "row": F.lit(1), "n_words": F.lit("y")})
    cut = windows.dedup_windows(df)
    assert found(cut) == plain([(r.doc_id, r.text) for r in awkward.collect()])
    assert set(cut.columns) == set(df.columns) | {"n_removed"}
    assert {tuple(r) for r in cut.select("doc_id", "part_", "row", F.to_json("ids")).collect()} == {tuple(r) for r in df.select("doc_id", "part_", "row", F.to_json("ids")).collect()}


def test_null_and_repeated_keys_and_no_rows(spark, nothing):
    rows = [(None, prose(40, 1)), (None, prose(40, 1)), (3, prose(40, 1)), (3, prose(40, 1) + " x"), (4, "a " + prose(40, 1)), (-5, prose(40, 1)), (6, None), (7, " \x0b\x0c\x1f ")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(windows.dedup_windows(df)) == plain(rows)
    assert found(windows.dedup_windows(nothing)) == []
    with pytest.raises(TypeError):
        windows.dedup_windows(df.withColumn("doc_id", F.lit("a")))


def test_sketches_never_count_too_little():
    chosen = np.random.default_rng(1)
    hashes = chosen.integers(0, 1 << 63, (2, 5000), dtype=np.uint64) * np.uint64(2)
    twice = hashes[:, :700]
    for bits in (8, 14, 20):
        parts = [np.concatenate([hashes[:, k::3], twice[:, (k + 1) % 3 :: 3]], axis=1) for k in range(3)]
        for row in range(2):
            tables = []
            for k, h in enumerate(parts):
                cells, count = np.unique(windows._cells(h[row], bits), return_counts=True)
                tables.append((0, k, windows._packed(cells), windows._packed(cells[count > 1])))
            hot = windows._merged(windows._table(tables, windows._SKETCH)).to_pylist()
            full = {k: set(windows._unpacked(r["cells"]).tolist()) for r in hot for k in [r["part_"]]}
            for k, h in enumerate(parts):
                both = set(windows._cells(twice[row], bits).tolist()) & set(windows._cells(h[row], bits).tolist())
                assert both <= full.get(k, set())


def test_words_meet_between_texts():
    held, starts, ends, bounds = windows.words(pa.array(["ab", "cd e", "", "\n", "f"]))
    assert [bytes(held[a:b]).decode() for a, b in zip(starts, ends, strict=True)] == ["ab", "cd", "e", "f"]
    assert bounds.tolist() == [0, 1, 3, 3, 3, 4]


def test_query(spark, small):
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    told = {r.doc_id: (r.n_words, r.n_removed) for r in queries.QUERIES["op12_substring_dedup"](spark, small).collect()}
    assert told == {k: (n, m) for k, _, n, m in plain(rows)}
