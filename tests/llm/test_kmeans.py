"""Exponion clustering against Lloyd's rounds in plain Python, and against its SQL."""

from __future__ import annotations

import hashlib
import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoframe.llm import kmeans, queries


def plain(rows: list[tuple], k: int, dims: int, rounds: int) -> list[tuple]:
    """rows: (vec_id, components)."""
    kept = []
    for key, x in rows:
        if x is not None and len(x) == dims and all(v is not None and math.isfinite(v) and abs(v) < 131072 for v in x):
            kept.append((key, [math.floor(1024 * v) for v in x]))
    named = sorted((hashlib.sha256(f"3:{'' if key is None else key}".encode()).hexdigest(), v) for key, v in kept)
    centroids = [list(v) for _, v in named[:k]]

    def assigned() -> list[tuple[int, int]]:
        return [min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centroids)) for _, v in kept]

    for _ in range(rounds):
        near = assigned()
        for j in range(len(centroids)):
            own = [v for (_, v), (_, n) in zip(kept, near, strict=True) if n == j]
            if own:
                centroids[j] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    near = assigned()
    total = sum(d for d, _ in near)
    return sorted(
        ((key, j, d, sum(e for e, n in near if n == j), total, hashlib.sha256(",".join(map(str, centroids[j])).encode()).hexdigest()) for (key, _), (d, j) in zip(kept, near, strict=True)),
        key=repr,
    )


def found(df) -> list[tuple]:
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize(("n", "k", "dims", "rounds", "grid"), [(300, 8, 4, 10, True), (200, 5, 3, 4, False), (60, 1, 2, 3, True), (3, 8, 2, 2, False)])
def test_equals_plain_version(spark, n, k, dims, rounds, grid):
    chosen = random.Random(n)
    # On the grid many distances are equal, and many vectors too.
    value = (lambda: float(chosen.randrange(-2, 3))) if grid else (lambda: chosen.gauss(0, 3))
    rows = [(i % (n - 5) if n > 10 else i, [value() for _ in range(dims)]) for i in range(n)]
    rows += [(None, [0.5] * dims), (9001, None), (9002, []), (9003, [1.0] * (dims + 1)), (9004, [float("nan")] * dims), (9005, [None] * dims), (9006, [float("inf")] * dims), (9007, [131072.0] * dims)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"own": F.lit("x"), "v": F.lit(1), "cluster": F.lit(2)}).repartition(3)
    assert found(kmeans.cluster(df, k=k, dims=dims, rounds=rounds)) == plain(rows, k, dims, rounds)


def test_large_components_and_no_rows(spark):
    rows = [(i, [(-1) ** i * (131071.9 - i), float(i)]) for i in range(20)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert found(kmeans.cluster(df, k=3, dims=2, rounds=3)) == plain(rows, 3, 2, 3)
    assert found(kmeans.cluster(df.limit(0))) == []


def test_search_is_exact_and_takes_few_distances():
    chosen = np.random.default_rng(1)
    middles = chosen.integers(-50_000, 50_000, (40, 8))
    v = (middles[chosen.integers(0, 40, 4000)] + chosen.integers(-300, 300, (4000, 8))).astype(np.int64)
    at, own, upper, lower, taken = v[:40].copy(), np.zeros(4000, np.int64), np.full(4000, np.inf), np.zeros(4000), []
    c = kmeans.Centroids(at, np.zeros(40))
    for _ in range(6):
        own, upper, lower, n = kmeans.search(v, own, upper, lower, c)
        squares = ((v[:, None] - c.at[None]) ** 2).sum(2)
        assert (own == squares.argmin(1)).all()
        others = np.where(np.arange(40) == own[:, None], np.iinfo(np.int64).max, squares).min(1)
        assert (upper >= np.sqrt(squares.min(1))).all() and (lower <= np.sqrt(others)).all()
        taken.append(n)
        moved = np.array([v[own == j].sum(0) // max(1, (own == j).sum()) if (own == j).any() else c.at[j] for j in range(40)])
        c = kmeans.Centroids(moved, np.sqrt(((moved - c.at) ** 2).sum(1)) * (1 + 1e-9))
    assert sum(taken[1:]) < 0.2 * 5 * 4000 * 40


def test_matches_sql(spark, small):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{small}/embeddings.parquet'")
    df = queries.QUERIES["op13_exponion_clusters"](spark, small)
    sql = con.execute(kmeans.ORACLE)
    columns = [d[0] for d in sql.description]
    assert found(df.select(*columns)) == sorted(sql.fetchall(), key=repr)
