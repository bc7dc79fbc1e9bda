"""Centroid clustering in whole numbers, with the exponion search.

*Bounds.* Each vector carries its cluster, an upper bound on the distance to that cluster's centroid and a lower bound on the
distance to every other. When centroids move, the bounds give way by as much as they moved; while the upper bound stays
below the lower one, the vector's cluster is certain without a look at it.
*Search.* Where it isn't, the distance to the own centroid is taken anew; if that doesn't settle it, the vector's two nearest centroids lie in the ball
around its own centroid of radius twice that distance plus the gap to that centroid's nearest neighbour.
The other centroids are sorted by their distance from each one, so those in the ball are the head of a list. The radius is inclusive,
and rounding always widens it: a centroid that ties is in, and of equal distances the smaller number wins.
*Rounds.* Distances are exact integers; bounds are doubles on the safe side. A round is one pass over the written
vectors with their bounds, and sums of the vectors that changed clusters only: a row for each cluster and task is shuffled. The driver
holds the centroids and nothing else.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoframe.llm.common import Scratch, passing

SCALE = 1024
#: Greatest size of a component in whole numbers: the squared distance of 64 such components fits a long.
MOST = 1 << 27
#: Vectors searched at once inside a task.
SLICE = 8192
_WIDER, _NARROWER = 1 + 1e-9, 1 - 1e-9


@dataclass
class Centroids:
    """``at`` (k, dims) whole numbers, and how far each has ``moved`` since the bounds were taken."""

    at: np.ndarray
    moved: np.ndarray

    def __post_init__(self) -> None:
        gaps = np.sqrt(((self.at[:, None] - self.at[None]) ** 2).sum(2, dtype=np.int64).astype(np.float64))
        np.fill_diagonal(gaps, -1)
        #: For each centroid all others by their distance from it, itself first.
        self.order = np.argsort(gaps, axis=1, kind="stable")
        self.gaps = np.take_along_axis(gaps, self.order, axis=1)
        #: The furthest move of any other centroid.
        most = np.sort(self.moved)[-2:]
        alone = (self.moved == most[-1]) & (most[0] < most[-1]) if len(most) > 1 else np.ones(len(self.moved), bool)
        self.passed = np.where(alone, most[0] if len(most) > 1 else 0.0, most[-1] if len(most) else 0.0)


def _squared(v: np.ndarray, centroid: np.ndarray) -> np.ndarray:
    d = v - centroid
    return np.einsum("ij,ij->i", d, d)


def search(v: np.ndarray, own: np.ndarray, upper: np.ndarray, lower: np.ndarray, c: Centroids) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """New cluster and bounds of each vector, and the number of distances taken."""
    own, upper, lower = own.copy(), (upper + c.moved[own]) * _WIDER, lower - c.passed[own] * _WIDER
    taken = 0
    todo = np.flatnonzero(upper >= lower)
    for a in np.unique(own[todo]).tolist():
        rows = todo[own[todo] == a]
        exact = _squared(v[rows], c.at[a])
        taken += len(rows)
        upper[rows] = np.sqrt(exact.astype(np.float64)) * _WIDER
        open_ = upper[rows] >= lower[rows]
        rows, best = rows[open_], exact[open_]
        if not len(rows):
            continue
        gap = c.gaps[a, 1] if len(c.at) > 1 else 0.0
        radius = (2 * upper[rows] + gap) * _WIDER + 1e-9
        inside = np.searchsorted(c.gaps[a], radius, side="right")
        number, second = np.full(len(rows), a), np.full(len(rows), np.iinfo(np.int64).max)
        for place in range(1, int(inside.max())):
            near = np.flatnonzero(inside > place)
            j = int(c.order[a, place])
            d = _squared(v[rows[near]], c.at[j])
            taken += len(near)
            wins = (d < best[near]) | ((d == best[near]) & (j < number[near]))
            won, lost = near[wins], near[~wins]
            second[won] = best[won]
            best[won], number[won] = d[wins], j
            second[lost] = np.minimum(second[lost], d[~wins])
        own[rows], upper[rows] = number, np.sqrt(best.astype(np.float64)) * _WIDER
        lower[rows] = np.sqrt(second.astype(np.float64)) * _NARROWER
        lower[rows[second == np.iinfo(np.int64).max]] = np.inf
    return own, upper, lower, taken


def whole(embedding: str, dims: int) -> tuple[Column, Column]:
    """The vector in whole numbers, and whether it has ``dims`` components, none null, non-finite or beyond MOST."""
    numbers = F.transform(embedding, lambda x: F.floor(x.cast("double") * SCALE))
    sound = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < MOST // SCALE))
    good = (F.size(embedding) == dims) & F.coalesce(sound, F.lit(False))
    return numbers, F.coalesce(good, F.lit(False))


def _stepped(state: DataFrame, c: Centroids) -> DataFrame:
    """One round's search: ``was`` is the cluster before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), SLICE):
                part = batch.slice(at, SLICE)
                v = part.column("v").flatten().to_numpy().reshape(len(part), -1).astype(np.int64)
                was = part.column("own").to_numpy()
                own, upper, lower, _ = search(v, was, part.column("upper").to_numpy(), part.column("lower").to_numpy(), c)
                columns = {"id": part.column("id"), "v": part.column("v"), "was": pa.array(was), "own": pa.array(own.astype(np.int32)), "upper": pa.array(upper), "lower": pa.array(lower)}
                yield pa.RecordBatch.from_arrays([columns[n] for n in schema.names], names=schema.names)

    schema = state.schema
    return state.mapInArrow(run, schema)


def _changes(state: DataFrame, k: int, dims: int, first: bool) -> dict[int, tuple[int, list[int]]]:
    """By cluster: vectors gained less vectors lost, and their sum. A task adds up what it reads."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for batch in batches:
            v = batch.column("v").flatten().to_numpy().reshape(len(batch), -1).astype(np.int64)
            for column, sign in (("own", 1),) if first else (("own", 1), ("was", -1)):
                j = batch.column(column).to_numpy()
                np.add.at(n, j, sign)
                np.add.at(total, j, sign * v)
        some = np.flatnonzero(n.astype(bool) | total.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(n[some]), pa.array(total[some].tolist(), pa.list_(pa.int64()))], names=["j", "n", "total"])

    rows = state if first else state.filter("own <> was")
    parts = rows.select("own", "was", "v").mapInArrow(run, "j int, n long, total array<long>").select("j", "n", F.posexplode("total").alias("i", "x"))
    out: dict[int, tuple[int, list[int]]] = {}
    for r in parts.groupBy("j", "i").agg(F.sum("n"), F.sum("x")).collect():
        out.setdefault(r[0], (r[2], [0] * dims))[1][r[1]] = r[3]
    return out


def cluster(vectors: DataFrame, key: str = "vec_id", embedding: str = "embedding", k: int = 8, dims: int = 64, rounds: int = 10, seed: str = "3") -> DataFrame:
    """(key, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector.

    A vector is whole numbers floor(1024 x). It is left out where it has not just ``dims`` components, or one that is null, not finite, or of
    131,072 or more, whose squares a long can't hold. Centroids start as the ``k`` vectors (all, where there are fewer) whose text
    `seed:key` has the smallest SHA-256 (equal keys: by the vector); each of ``rounds`` rounds assigns every vector to its nearest centroid (of
    equal ones the smaller number) and replaces every centroid that has vectors by floor(sum / count); then vectors are assigned once more. A sum of distances beyond a long
    is null. Rows that repeat a key are vectors of their own, a null key's text is empty; an empty table gives an empty result.
    """
    last = Scratch(vectors.sparkSession)
    with passing():
        scratch = Scratch(vectors.sparkSession)
        numbers, good = whole(embedding, dims)
        kept = vectors.filter(good).select(F.col(key).alias("id"), numbers.cast("array<int>").alias("v"))
        start = {"was": F.lit(0), "own": F.lit(0), "upper": F.lit(float("inf")), "lower": F.lit(0.0)}
        state = scratch.keep(kept.withColumns(start), "round-0")
        name = F.coalesce(F.col("id").cast("string"), F.lit(""))
        seeds = state.select(F.sha2(F.concat(F.lit(f"{seed}:"), name), 256).alias("h"), "v").orderBy("h", "v").limit(k).collect()
        c = Centroids(np.array([r.v for r in seeds], np.int64).reshape(len(seeds), dims), np.zeros(len(seeds)))
        counts, sums = [0] * len(seeds), [[0] * dims for _ in seeds]
        for turn in range(1, rounds + 2 if seeds else 1):
            state = scratch.keep(_stepped(state, c), f"round-{turn}")
            scratch.drop(f"round-{turn - 1}")
            if turn > rounds:
                break
            for j, (n, change) in _changes(state, len(seeds), dims, turn == 1).items():
                counts[j] += n
                sums[j] = [a + b for a, b in zip(sums[j], change, strict=True)]
            moved = np.array([[s // n for s in total] if n else old for n, total, old in zip(counts, sums, c.at.tolist(), strict=True)], np.int64)
            c = Centroids(moved, np.sqrt(_squared(moved, c.at).astype(np.float64)) * _WIDER)
        # k rows and no more: the centroids by their number.
        centroids = [(j, hashlib.sha256(",".join(map(str, v)).encode()).hexdigest(), v) for j, v in enumerate(c.at.tolist())]
        table = vectors.sparkSession.createDataFrame(centroids, "own int, centroid_sha256 string, centroid array<long>")
        apart = F.aggregate(F.zip_with("v", "centroid", lambda x, y: (x - y) * (x - y)), F.lit(0).cast("long"), lambda a, b: a + b)
        done = scratch.keep(state.join(F.broadcast(table), "own").select("id", F.col("own").alias("cluster"), apart.alias("distance"), "centroid_sha256"), "done")
        inertia = done.groupBy("cluster").agg(F.try_sum("distance").alias("cluster_inertia"), F.sum(F.col("distance").cast("decimal(38,0)")).alias("total"))
        told = {r[0]: (r[1], int(r[2])) for r in inertia.collect()}
        total = sum(n for _, n in told.values())
        rows = [(j, n, total if total < 1 << 63 else None) for j, (n, _) in told.items()]
        spread = vectors.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long")
        out = done.join(F.broadcast(spread), "cluster")
        return last.keep(out.select(F.col("id").alias(key), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"), "clusters")


def _oracle(k: int = 8, rounds: int = 10) -> str:
    steps = []
    for turn in range(rounds + 1):
        steps.append(
            f"a{turn} AS MATERIALIZED (SELECT row_, vec_id, v, arg_min(j, (d, j)) AS j, min(d) AS d FROM (SELECT w.row_, w.vec_id, w.v, c.j, "
            f"list_sum(list_transform(list_zip(w.v, c.c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM whole w CROSS JOIN c{turn} c) GROUP BY row_, vec_id, v)"
        )
        if turn < rounds:
            steps.append(
                f"m{turn} AS MATERIALIZED (SELECT j, list(s ORDER BY i) AS c FROM (SELECT j, i, CASE WHEN sum(x) % count(*) < 0 THEN sum(x) // count(*) - 1 ELSE sum(x) // count(*) END::BIGINT AS s FROM "
                f"(SELECT j, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM a{turn}) GROUP BY j, i) GROUP BY j), "
                f"c{turn + 1} AS MATERIALIZED (SELECT c.j, coalesce(m.c, c.c) AS c FROM c{turn} c LEFT JOIN m{turn} m ON m.j = c.j)"
            )
    return f"""
WITH whole AS MATERIALIZED (
  SELECT row_number() OVER () AS row_, vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * {SCALE})::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x) AND abs(x::DOUBLE) < {MOST // SCALE})) = 64),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, v) - 1 AS j, v AS c FROM (SELECT sha256('3:' || vec_id::VARCHAR) AS h, v FROM whole ORDER BY h, v LIMIT {k})),
{(", " + chr(10)).join(steps)}
SELECT a.vec_id, a.j::INTEGER AS cluster, a.d AS distance, sum(a.d) OVER (PARTITION BY a.j)::BIGINT AS cluster_inertia, sum(a.d) OVER ()::BIGINT AS inertia,
       sha256(array_to_string(c.c, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} c ON c.j = a.j
"""


ORACLE = _oracle()
