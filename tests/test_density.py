"""Density clusters and components against plain versions."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoframe.operators.density import density_clusters
from chronoframe.operators.groups import density_labels
from chronoframe.operators.tables import Tables, components


def told(points: dict, eps: float, least: int) -> dict:
    """Smallest core id of each id's cluster, from all pairs."""
    ids = sorted(points)
    if not ids:
        return {}
    at = np.array([points[i] for i in ids], float)
    label = density_labels(at, eps, least)
    dense = (np.sqrt(((at[:, None] - at[None]) ** 2).sum(axis=2)) <= eps).sum(axis=1) >= least
    first = {k: min(i for i, own, d in zip(ids, label, dense, strict=True) if own == k and d) for k in set(label.tolist()) if k >= 0}
    return {i: first.get(k, -1) for i, k in zip(ids, label.tolist(), strict=True)}


@pytest.mark.parametrize(("dims", "eps", "least"), [(1, 0.4, 4), (2, 1.0, 5), (2, 0.3, 2), (2, 2.5, 12), (3, 1.5, 6)])
def test_clusters_equal_all_pairs(spark, dims, eps, least):
    chosen = random.Random(dims * 10 + least)
    rows, at = [], {}
    for g in range(3):
        middles = [[chosen.uniform(-9, 9) for _ in range(dims)] for _ in range(4)]
        for i in range(220):
            middle = chosen.choice(middles)
            p = [m + chosen.gauss(0, 1.2) for m in middle] if i % 5 else [float(round(m)) for m in middle]
            p = p if i % 7 else [chosen.uniform(-12, 12) for _ in range(dims)]
            rows.append((g, 1000 * g + (i * 37) % 1000, *p))
            at.setdefault(g, {})[1000 * g + (i * 37) % 1000] = p
    axes = [f"v{k}" for k in range(dims)]
    df = spark.createDataFrame(rows, f"g0 int, u long, {', '.join(a + ' double' for a in axes)}").repartition(3)
    found = {r.u: r.cluster for r in density_clusters(df, ["g0"], "u", axes, eps, least).collect()}
    assert found == {i: c for g in at for i, c in told(at[g], eps, least).items()}
    assert len(set(found.values())) > 3


def test_least_of_each_group_and_odd_rows(spark):
    rows = [(1, k, 0.1 * k, 0.0, 3) for k in range(4)] + [(2, 10 + k, 0.1 * k, 0.0, 9) for k in range(4)]
    odd = [(1, 50, None, 0.0, 3), (1, 51, float("nan"), 0.0, 3), (1, 52, float("inf"), 0.0, 3), (None, 53, 0.0, 0.0, 3), (1, None, 0.0, 0.0, 3), (3, 60, 0.0, -0.0, 2), (3, 61, -0.0, 0.0, 2), (1, 70, 0.0, 0.0, None)]
    df = spark.createDataFrame([*rows, *odd], "g int, id long, x double, y double, need int")
    found = sorted(((r.g or 0, r.id if r.id is not None else -5, r.cluster) for r in density_clusters(df, ["g"], "id", ["x", "y"], 0.15, "need").collect()))
    # Of four in a row the outer two are no cores.
    assert found == sorted([(1, k, 1) for k in range(4)] + [(2, 10 + k, -1) for k in range(4)]
                           + [(1, 50, -1), (1, 51, -1), (1, 52, -1), (0, 53, -1), (1, -5, -1), (3, 60, 60), (3, 61, 60), (1, 70, -1)])
    empty = density_clusters(df.limit(0), ["g"], "id", ["x", "y"], 1.0, 2)
    assert empty.count() == 0 and empty.columns == [*df.columns, "cluster"]
    with pytest.raises(ValueError):
        density_clusters(df.withColumn("cluster", F.lit(1)), ["g"], "id", ["x", "y"], 1.0, 2)


def test_one_group_of_200_000_points(spark):
    """Two crowded blobs, a chain between that links them, equal points and a far outlier: no square of anything."""
    n = 200_000
    blob = F.when(F.col("id") % 2 == 0, 0.0).otherwise(50.0)
    unit = lambda seed: (F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(10**6)) / 1e6)
    crowd = spark.range(n).select("id", (blob + unit(1) * 4).alias("x"), (unit(2) * 4).alias("y"))
    same = spark.range(n, n + 50_000).select("id", F.lit(2.0).alias("x"), F.lit(2.0).alias("y"))
    chain = spark.range(500).select((F.col("id") + 300_000).alias("id"), (F.col("id") * 0.1 + 2).alias("x"), F.lit(2.0).alias("y"))
    alone = spark.createDataFrame([(400_000, 500.0, 500.0)], "id long, x double, y double")
    df = crowd.unionByName(same).unionByName(chain).unionByName(alone).withColumn("g", F.lit(1))
    counts = {r[0]: r[1] for r in density_clusters(df, ["g"], "id", ["x", "y"], 0.25, 5).groupBy("cluster").count().collect()}
    assert counts == {0: n + 50_500, -1: 1}
    apart = density_clusters(df.filter("id < 300000"), ["g"], "id", ["x", "y"], 0.25, 5).groupBy("cluster").count().collect()
    assert sorted(r[1] for r in apart) == [n // 2, n // 2 + 50_000]


def test_components_of_chains_and_hubs(spark):
    edges = [(1, k, k + 1) for k in range(60)] + [(2, 500, k) for k in range(501, 900)] + [(2, 3, 4), (2, 4, 3), (2, 7, 7)]
    found = components(spark.createDataFrame(edges, "k int, u long, v long").repartition(3), ["k"], Tables(spark), "t")
    assert found.groupBy("k", "component").count().orderBy("k", "component").collect() == [(1, 0, 61), (2, 3, 2), (2, 500, 400)]
