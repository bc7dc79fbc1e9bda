"""Line dedup and the two joins against brute force on small fixtures."""

from __future__ import annotations

import random
import re
from collections import defaultdict
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoframe.llm import embeddedup, linededup, ngramjoin, queries
from chronoframe.llm.common import Scratch, checkpoint_root, passing
from chronoframe.llm.tiles import tiled
from tests.llm.conftest import prose


def shingles(text: str | None) -> frozenset:
    words = re.findall(r"[^\W_]+", (text or "").lower())
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def classes(keys: list, links: set[tuple]) -> dict:
    label = {k: k for k in keys}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    return label


def brute_near(texts: dict[int, str | None], threshold: float = 0.8) -> dict[int, tuple[int, int]]:
    sets = {k: shingles(t) for k, t in texts.items()}
    links = {(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]) - 1e-9}
    label, n = classes(list(texts), links), defaultdict(int)
    for a, b in links:
        n[a] += 1
        n[b] += 1
    return {k: (label[k], n[k]) for k in texts}


def near_copies() -> dict[int, str | None]:
    chosen = random.Random(5)
    texts, n = {}, 0
    for group in range(25):
        base = prose(120, 100 + group).split()
        for _ in range(chosen.randrange(1, 9)):
            copy = list(base)
            for _ in range(chosen.randrange(0, 4)):
                copy[chosen.randrange(len(copy))] = "changed"
            texts[n], n = " ".join(copy), n + 1
            if chosen.random() < 0.3:
                base = copy
    texts |= {n: None, n + 1: "", n + 2: "one", n + 3: "One!", n + 4: "one two three four", n + 5: "?!"}
    return texts


def test_ngram_join_equals_brute_force(spark):
    texts = near_copies()
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    found = {r.doc_id: (r.class_id, r.n_links) for r in ngramjoin.near_duplicates(docs).collect()}
    assert found == brute_near(texts)


def test_ngram_join_in_many_tiles(spark, monkeypatch):
    monkeypatch.setattr(ngramjoin, "TILE", 4)
    texts = near_copies()
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r.doc_id: (r.class_id, r.n_links) for r in ngramjoin.near_duplicates(docs).collect()} == brute_near(texts)


def test_one_of_each_keeps_the_first(spark, awkward, nothing):
    texts = near_copies()
    docs = spark.createDataFrame([(k, t, "x") for k, t in texts.items()], "doc_id long, text string, hi string")
    kept = {r.doc_id for r in ngramjoin.one_of_each(docs).collect()}
    assert kept == {k for k, (c, _) in brute_near(texts).items() if k == c}
    assert ngramjoin.one_of_each(awkward).columns == awkward.columns
    assert ngramjoin.one_of_each(nothing).count() == 0


def test_prefixes_are_shortened_until_the_recall():
    for n in (1, 3, 4, 6, 11, 40, 150, 5000):
        least, last = ngramjoin.least_similarity(n, 0.8), ngramjoin.last_depth(min(n, 201), 0.8)
        possible = [o / (n + m - o) for m in range(1, 2 * n + 2) for o in range(1, min(n, m) + 1) if 0.8 <= o / (n + m - o) + 1e-9 < 1] if n <= 150 else [0.8]
        assert least == (min(possible) if possible else 1.0)
        assert last == ngramjoin.DEPTH + 1 if not possible else 1 - (1 - least**last) ** ngramjoin.TREES >= ngramjoin.RECALL
    assert ngramjoin.last_depth(6, 0.8) > ngramjoin.last_depth(201, 0.8)


def test_forest_matches_at_full_depth_first_and_then_shortens(spark, monkeypatch):
    """Close copies are together after the first level; of what shorter prefixes are asked for only the others are left."""
    asked = []
    plain = ngramjoin.tiled
    monkeypatch.setattr(ngramjoin, "tiled", lambda rows, sizes, keys, *more: (asked.append((keys[0], sizes.count())), plain(rows, sizes, keys, *more))[1])
    base = [prose(200, 500 + g).split() for g in range(6)]
    texts = {10 * g + i: " ".join([*b[: 200 - i], *(["x"] * i)]) for g, b in enumerate(base) for i in range(8)}
    far = prose(60, 900).split()
    texts |= {100: " ".join(far), 101: " ".join([*far[:14], "x", *far[15:44], "y", *far[45:]])}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    found = {r.doc_id: (r.class_id, r.n_links) for r in ngramjoin.near_duplicates(docs).collect()}
    levels = [n for name, n in asked if name == "tree"]
    assert len(levels) == 3 and levels[0] > 0 and levels[1] < levels[0] and levels[2] < levels[0]
    assert found == brute_near(texts)


def test_repeated_and_null_keys(spark):
    same, other, third = prose(40, 1), prose(40, 2), prose(40, 3)
    rows = [(1, same), (5, other), (5, same), (5, same), (7, third), (9, third + " more"), (5, third), (None, same), (None, None), (8, None), (8, None)]
    docs = spark.createDataFrame([(k, t, i, "x") for i, (k, t) in enumerate(rows)], "doc_id long, text string, t1 int, row string").repartition(3)
    kept = sorted(((r.doc_id, r.text) for r in ngramjoin.one_of_each(docs).collect()), key=repr)
    assert kept == sorted([(1, same), (5, other), (5, third), (8, None), (None, same), (None, None)], key=repr)
    found = sorted(((r.doc_id, r.class_id, r.n_links) for r in ngramjoin.near_duplicates(docs).collect()), key=repr)
    linked = [(1, 1, 2), (5, 1, 2), (5, 1, 2), (5, 5, 0), (5, 5, 2), (7, 5, 2), (9, 5, 2), (8, 8, 0), (8, 8, 0), (None, None, 0), (None, None, 0)]
    assert found == sorted(linked, key=repr)


def test_tiles_cover_every_pair_once(spark):
    rows = spark.createDataFrame([(1, i) for i in range(23)], "g int, id long")
    sizes = spark.createDataFrame([(1, 23)], "g int, n long")
    groups = defaultdict(list)
    for r in tiled(rows, sizes, ["g"], "id", 5, 23).collect():
        groups[r.tile, r.other].append((r.id, r.left))
    met = defaultdict(int)
    for (tile, other), members in groups.items():
        for a, left in members:
            for b, other_left in members:
                if a < b and (tile == other or left != other_left):
                    met[a, b] += 1
    assert met == {(a, b): 1 for a in range(23) for b in range(a + 1, 23)}


def lines_fixture() -> dict[int, str | None]:
    shared = [prose(12, s) for s in range(6)]
    own = lambda s: "\n".join(prose(9, 1000 + 10 * s + i) for i in range(4))
    block = "\n".join(shared)
    return {
        0: f"{own(0)}\n{block}\n{own(1)}",
        1: f"{block}\n{own(2)}",
        2: own(3) + "\n" + "\n".join(shared[2:5]),
        3: own(4) + "\n" + shared[0],  # too short a run
        4: block,
        5: f"{own(5)}\n\n  {shared[1]}  \n\n{shared[2]}\n{shared[3]}\n{own(6)}",
        6: None, 7: "", 8: "\n", 9: block + "\n" + block, 10: own(0),
    }


def test_line_dedup_equals_sql(spark):
    texts = lines_fixture()
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    found = {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in linededup.dedup_lines(docs).collect()}
    documents = docs.toPandas()  # noqa: F841
    con = duckdb.connect()
    told = {r[0]: (r[1], r[2], r[3]) for r in con.execute(f"SELECT doc_id, text, n_lines, n_removed FROM ({linededup.ORACLE})").fetchall()}
    assert found == told
    assert found[0][0] == texts[0]
    assert found[4][0] == "" and found[6][0] is None
    assert found[3][0] == texts[3] and found[3][2] == 0
    assert found[2][2] == 3


def test_line_dedup_has_no_python(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    plan = linededup.dedup_lines(docs)._jdf.queryExecution().toString()
    plan += linededup.dedup_passages(docs)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_line_dedup_of_repeated_and_null_keys(spark):
    block, other = lines_fixture()[4], prose(50, 5)
    rows = [(1, block), (1, block), (1, block), (2, other), (2, f"{other}\n{block}"), (None, block), (None, other), (None, None), (3, None)]
    docs = spark.createDataFrame([(k, t, i, "x") for i, (k, t) in enumerate(rows)], "doc_id long, text string, n_lines int, spans string").repartition(3)
    found = sorted(((r.doc_id, r.text, r.n_removed) for r in linededup.dedup_lines(docs).collect()), key=repr)
    want = [(1, "", 6), (1, "", 6), (1, "", 6), (2, "", 1), (2, "", 7), (None, block, 0), (None, other, 0), (None, None, 0), (3, None, 0)]
    assert found == sorted(want, key=repr)
    left = linededup.dedup_passages(docs).collect()
    assert len(left) == len(rows) and {r.text for r in left if r.doc_id is None} == {block, other, None}
    assert {r.text for r in left if r.doc_id == 1} == {block}


def test_line_dedup_selects_fewer_rows_than_lines(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    lines = linededup.unit_lines(docs, F.struct("doc_id"))
    assert 0 < linededup.fingerprints(lines, 30).count() < lines.count()


def test_scratch_tables_go(spark, small):
    """What a run has written for itself is gone when its result is there, but for what the result is read from."""
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    with passing():
        kept = Scratch(spark).keep(linededup.dedup_lines(ngramjoin.one_of_each(docs)), "kept")
        root = Path(kept.inputFiles()[0].removeprefix("file://")).parents[2]
        names = {p.name for table in root.glob("tables-*") for p in table.iterdir()}
        assert "kept" in names and not names & {"signed", "standing", "tries", "sets", "verified", "minima", "covering", "hits"}
    assert not Path(kept.inputFiles()[0].removeprefix("file://")).exists()


def test_a_cluster_needs_a_shared_folder():
    class Cluster:
        class conf:
            get = staticmethod(lambda name, default: default)

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        checkpoint_root(Cluster)


def test_line_dedup_awkward(awkward, nothing):
    cut = linededup.dedup_lines(awkward)
    assert cut.columns == [*awkward.columns, "n_lines", "n_removed"]
    assert cut.count() == awkward.count()
    assert linededup.dedup_lines(nothing).count() == 0


def test_passage_in_the_middle_of_lines_goes(spark):
    passage = prose(60, 77)
    ends = [[prose(40, 10 * d + side) for side in (1, 2)] for d in range(3)]
    texts = {d: f"{a} {passage} {b}" for d, (a, b) in enumerate(ends)}
    texts[2] = f"{ends[2][0]} {passage}\n{ends[2][1]}"
    texts |= {3: texts[1], 4: texts[0] + "\n" + texts[0], 5: None, 6: "", 7: prose(90, 99), 8: lines_fixture()[0], 9: lines_fixture()[1]}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    found = {r.doc_id: (r.text, r.n_removed) for r in linededup.dedup_passages(docs).collect()}
    for d in (0, 5, 6, 7, 8):
        assert found[d] == (texts[d], 0)
    middle = " ".join(passage.split()[20:40])
    for d in (1, 2, 3):
        (a, b), left = ends[1 if d == 3 else d], found[d][0]
        assert left.startswith(a) and left.endswith(b) and middle not in left and ("\n" in left) == (d == 2)
    assert found[3] == found[1] and found[4][0].strip() == ""
    assert "\n".join(prose(12, s) for s in range(6)) not in found[9][0] and found[9][0].endswith(texts[9].split("\n")[-1])


def test_passages_awkward(awkward, nothing):
    cut = linededup.dedup_passages(awkward)
    assert cut.columns == [*awkward.columns, "n_removed"]
    assert cut.count() == awkward.count()
    assert linededup.dedup_passages(nothing).count() == 0


def test_one_of_equal_wordless_texts_stays(spark):
    texts = ["", "", None, None, "?!", "?!", "👩 !", "", "👩 !", "?"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert {r.doc_id for r in ngramjoin.one_of_each(docs).collect()} == {0, 2, 4, 6, 9}


def vectors() -> list[tuple]:
    rng = np.random.default_rng(11)
    rows, n = [], 0
    for _ in range(40):
        base = rng.normal(size=64)
        for _ in range(int(rng.integers(1, 6))):
            v = base + rng.normal(size=64) * rng.choice([0.0, 0.05, 0.12, 0.2])
            rows.append((n, [float(np.float32(x)) for x in v], int(rng.integers(0, 2))))
            n += 1
    same = [float(np.float32(x)) for x in rng.normal(size=64)]
    odd = [(None, 1), ([0.0] * 64, 1), ([float("nan"), *same[1:]], 1), ([None, *same[1:]], 1), ([float("inf"), *same[1:]], 1), ([], 1), (same, None), (same, 1), (same, 1), (same, 0), ([-x for x in same], 1)]
    return rows + [(n + k, v, label) for k, (v, label) in enumerate(odd)]


def brute_vectors(rows: list[tuple]) -> dict:
    able = {}
    for key, v, label in rows:
        x = np.array([np.nan if c is None else c for c in v or []], np.float64)
        if label is not None and len(x) and np.isfinite(x).all() and x.any():
            able[key] = (label, x)
    links = {
        (a, b)
        for a, (la, x) in able.items()
        for b, (lb, y) in able.items()
        if a < b and la == lb and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.98
    }
    label, n = classes([r[0] for r in rows], links), defaultdict(int)
    for a, b in links:
        n[a] += 1
        n[b] += 1
    return {r[0]: (n[r[0]], label[r[0]], label[r[0]] == r[0]) for r in rows}


@pytest.mark.parametrize("tile", [1024, 3])
def test_embedding_dedup_equals_brute_force(spark, monkeypatch, tile):
    monkeypatch.setattr(embeddedup, "TILE", tile)
    monkeypatch.setattr(embeddedup, "SPLIT", 4 * tile)
    rows = vectors()
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)
    found = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embeddedup.near_duplicates(table).collect()}
    assert found == brute_vectors(rows)


def crowded_vectors() -> list[tuple]:
    """Vectors of one label, near each other in some blocks and not in others, so that cells overflow on every level."""
    rng = np.random.default_rng(5)
    centre, rows = rng.normal(size=64), []
    for k in range(260):
        v = centre + rng.normal(size=64) * (0.03 if k % 9 == 0 else 0.25)
        if k % 4 == 0:
            v[:24] = centre[:24]
        rows.append((k, [float(np.float32(x)) for x in v], 1))
    return rows


def test_overfull_cells_are_cut_by_further_dimensions(spark, monkeypatch):
    monkeypatch.setattr(embeddedup, "SPLIT", 4)
    rows = crowded_vectors()
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)
    found = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embeddedup.near_duplicates(table).collect()}
    want = brute_vectors(rows)
    assert found == want and sum(n for n, _, _ in want.values()) > 100


def test_embedding_dedup_of_repeated_and_null_keys(spark):
    rng = np.random.default_rng(3)
    a, b = ([float(np.float32(x)) for x in rng.normal(size=64)] for _ in range(2))
    rows = [(1, a), (1, a), (1, b), (4, b), (None, a), (None, None), (7, None), (7, None)]
    table = spark.createDataFrame([(k, v, 1, "x", 2) for k, v in rows], "vec_id long, embedding array<float>, label int, node string, copies int")
    found = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in embeddedup.near_duplicates(table).collect()), key=repr)
    want = [(1, 1, 1, True), (1, 1, 1, True), (1, 1, 1, True), (4, 1, 1, False), (7, 0, 7, True), (7, 0, 7, True), (None, 0, None, True), (None, 0, None, True)]
    assert found == sorted(want, key=repr)


def test_embedding_dedup_of_nothing(spark):
    assert embeddedup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_queries_on_the_smallest_tables(spark, small):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    found = {r.doc_id: (r.class_id, r.n_links) for r in queries.op9_ngram_join(spark, small).collect()}
    assert found == brute_near(texts)
