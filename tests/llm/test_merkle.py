"""The Merkle manifest against a plain version, and against its SQL."""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from chronoframe.llm import merkle, queries


def h(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def told(*fields) -> str:
    return h(*("-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields))


def climb(nodes: list[str]) -> tuple[str, list[list[tuple[str, str]]]]:
    """The root, and what stands left and right of each leaf's way up."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, i in enumerate(at):
            first = i // 3 * 3
            paths[k].append(("".join(nodes[first:i]), "".join(nodes[i + 1 : first + 3])))
        nodes, at = [h(*nodes[i : i + 3]) for i in range(0, len(nodes), 3)], [i // 3 for i in at]
    return nodes[0], paths


def plain(rows) -> list[tuple]:
    """rows: (doc_id, source, lang, n_chars, text)."""
    groups, trees, out = defaultdict(list), {}, []
    for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, told(*r))):
        groups[r[1]].append(r)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    for source in order:
        trees[source] = climb([told(*r) for r in groups[source]])
    root, tops = climb([trees[s][0] for s in order])
    for source, top in zip(order, tops, strict=True):
        for r, path in zip(groups[source], trees[source][1], strict=True):
            cut = r[4].replace("\n", "") if r[4] is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 else r[4]
            node = told(*r[:4], cut)
            for left, right in path + top:
                node = h(left, node, right)
            out.append((r[0], told(*r), trees[source][0], root, h(*(x for pair in path + top for x in pair)), node, node == root))
    return sorted(out, key=repr)


def found(df) -> list[tuple]:
    return sorted((tuple(r) for r in df.collect()), key=repr)


SCHEMA = "doc_id long, source string, lang string, n_chars int, text string"


@pytest.mark.parametrize("levels", [1, 2, merkle.LEVELS])
def test_equals_plain_version(spark, levels):
    rows = [(i, None if i % 11 == 0 else "hot" if i % 3 else f"é{i % 7}", "en", i, f"line {i}\nnext") for i in range(150)]
    rows += [(900, "alone", None, None, None), (901, "", "", 0, ""), (None, "hot", "en", 1, "a\nb"), (5, "hot", "en", 5, "line 5\nnext"), (902, "日本", "ja", 3, "一\n二\n" * 2000)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert found(merkle.tamper_check(docs, levels)) == plain(rows)


def test_single_rows_and_no_rows(spark):
    one = [(7, None, None, None, "x\ny")]
    assert found(merkle.tamper_check(spark.createDataFrame(one, SCHEMA))) == plain(one)
    assert found(merkle.tamper_check(spark.createDataFrame([], SCHEMA))) == []


def test_awkward(awkward):
    docs = awkward.withColumns({"g": F.lit(1), "leaf": F.lit("x"), "rank": F.lit(2)})
    rows = [tuple(r) for r in awkward.select(*merkle.FIELDS).collect()]
    assert found(merkle.tamper_check(docs)) == plain(rows)


def test_proofs_stand_alone(spark):
    rows = [(i, f"s{i % 4}", None, None, f"t{i}") for i in range(40)]
    told_ = merkle.manifest(spark.createDataFrame(rows, SCHEMA), merkle.leaf_hash(F.col("text")), levels=2)
    for r in told_.collect():
        node = r.leaf
        for step in r.path:
            node = h(step.left, node, step.right)
        assert node == r.root


def test_matches_sql(spark, small):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{small}/documents.parquet'")
    df = queries.QUERIES["op11_merkle_manifest"](spark, small)
    sql = con.execute(merkle.ORACLE)
    columns = [d[0] for d in sql.description]
    assert found(df.select(*columns)) == sorted(sql.fetchall(), key=repr)
