"""Near duplicates among embeddings by a subspace pigeonhole join.

Unit vectors with cosine c are sqrt(2 - 2c) apart. After a rotation, the same for all, a vector is cut into BLOCKS
blocks of few dimensions. If two vectors are within the budget as wholes, then in at least one block they are
within that block's share of the squared budget. So each block is range-joined by itself, on the block's few
numbers alone:

1. The first GRID dimensions are cut into cells wider than the radius, and a vector goes to its own cell and to each
   neighbouring cell, in forward direction only, from which it is less than the radius away. A cell of more than SPLIT
   vectors is cut in the same way by the block's next GRID dimensions, and so on while there are any.
2. Within a cell those vectors go on that have another within the block's budget.
3. Only these are joined with their vectors, and verified by the exact cosine. A pair belongs to the first block that
   is within its budget, and there to the one cell in which either of them is at home on every level.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoframe.llm.common import Scratch, hot_aware_join, mix, passing
from chronoframe.llm.graph import connected_components
from chronoframe.llm.tiles import forest, grouped, tiled

COSINE = 0.98
BLOCKS, GRID = 8, 3
#: Width of a cell in radii of a block.
WIDTH = 3.0
#: Vectors that a cell may hold before it is cut by further dimensions of its block: where looking through a cell costs
#: more than dealing its vectors again. The same number of block's rows, and TILE vectors, are one side of a comparison.
SPLIT, TILE = 4096, 1024
#: Added to squared budgets: far above the rounding of double (single) precision, far below the distances that matter.
SLACK, COARSE = 1e-9, 1e-6
SEED = 20240601
#: Neighbours in forward direction: the first step that is not zero goes up.
FORWARD = [d for d in product((-1, 0, 1), repeat=GRID) if any(d) and next(x for x in d if x) > 0]


def rotation(width: int) -> np.ndarray:
    """An orthogonal matrix that depends on the width alone."""
    q, r = np.linalg.qr(np.random.default_rng(SEED).normal(size=(width, width)))
    return q * np.sign(np.diag(r))


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length one in double precision (through their largest component, so that nothing over- or underflows)."""
    v = vectors.astype(np.float64)
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def blocks_of(width: int) -> list[np.ndarray]:
    return np.array_split(np.arange(width), min(BLOCKS, width))


def budgets(width: int, cosine: float) -> list[float]:
    """Squared distance of each block: its share of the dimensions of the whole budget."""
    return [(2 - 2 * cosine) * len(b) / width + SLACK for b in blocks_of(width)]


def cells(grid: np.ndarray, radius: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, cell coordinates, whether at home) of the places that each row of up to GRID coordinates goes to."""
    grid = np.concatenate((grid, np.zeros((len(grid), GRID - grid.shape[1]))), axis=1)
    width = WIDTH * radius
    home = np.floor(grid / width).astype(np.int64)
    inside = grid - home * width
    yield np.arange(len(grid)), home, np.ones(len(grid), bool)
    for step in FORWARD:
        near = np.ones(len(grid), bool)
        for k, s in enumerate(step):
            if s:
                near &= inside[:, k] <= radius if s < 0 else inside[:, k] >= width - radius
        rows = np.flatnonzero(near)
        yield rows, home[rows] + np.array(step), np.zeros(len(rows), bool)


def _named(seed: int, columns: list[np.ndarray]) -> np.ndarray:
    """A 64-bit name of the places that the columns tell."""
    h = np.full(len(columns[0]), np.uint64(seed))
    for c in columns:
        h = mix(h + mix(c.astype(np.int64).view(np.uint64) + np.uint64(seed)))
    return h.view(np.int64)


#: A vector in a cell: the cell's name (128 bits), how often it was cut, the levels on which the vector is at home (bits), its block's numbers.
PLACE = "id long, h1 long, h2 long, level int, home int, width int, block int, numbers binary"


def _places(ids: np.ndarray, above: list[np.ndarray], level: int, home: np.ndarray, width: int, block: int, numbers: np.ndarray, cosine: float) -> Iterator[pa.RecordBatch]:
    """The places of the next level of vectors whose cells ``above`` tells; dimensions from GRID * level on."""
    radius = (budgets(width, cosine)[block] + COARSE) ** 0.5
    for rows, cell, own in cells(numbers[:, GRID * level : GRID * (level + 1)].astype(np.float64), radius):
        if not len(rows):
            continue
        told = [*(c[rows] for c in above), *(cell[:, k] for k in range(GRID))]
        names = (_named(seed, [np.full(len(rows), 1000 * width + 10 * block + level), *told]) for seed in (17, 90001))
        size = 4 * numbers.shape[1]
        raw = np.ascontiguousarray(numbers[rows]).tobytes()
        yield pa.record_batch(
            [
                pa.array(ids[rows]), *map(pa.array, names), *(pa.array(np.full(len(rows), v, np.int32)) for v in (level,)),
                pa.array((home[rows] | (own.astype(np.int32) << level)).astype(np.int32)), *(pa.array(np.full(len(rows), v, np.int32)) for v in (width, block)),
                pa.array([raw[k * size : (k + 1) * size] for k in range(len(rows))], pa.binary()),
            ],
            names=["id", "h1", "h2", "level", "home", "width", "block", "numbers"],
        )


def _dealt(cosine: float) -> Callable:
    """The first level, from (id, label, vector)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, label = batch.column("id").to_numpy(), batch.column("label").to_numpy()
            raw = batch.column("vector").to_pylist()
            size = np.array([len(v) for v in raw])
            for width in np.unique(size):
                rows = np.flatnonzero(size == width)
                v = unit(np.frombuffer(b"".join(raw[r] for r in rows), np.float64).reshape(len(rows), -1))
                turned = v @ rotation_of(v.shape[1])
                for b, columns in enumerate(blocks_of(v.shape[1])):
                    numbers = turned[:, columns].astype(np.float32)
                    yield from _places(ids[rows], [label[rows]], 0, np.zeros(len(rows), np.int32), v.shape[1], b, numbers, cosine)

    return run


def _cut(cosine: float) -> Callable:
    """The next level of the places that come in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, h1, h2, level, home, width, block = (batch.column(k).to_numpy() for k in range(7))
            raw = batch.column("numbers").to_pylist()
            for kind in np.unique(np.stack((level, width, block), axis=1), axis=0) if len(ids) else []:
                rows = np.flatnonzero((level == kind[0]) & (width == kind[1]) & (block == kind[2]))
                numbers = np.frombuffer(b"".join(raw[r] for r in rows), np.float32).reshape(len(rows), -1)
                yield from _places(ids[rows], [h1[rows], h2[rows]], int(kind[0]) + 1, home[rows], int(kind[1]), int(kind[2]), numbers, cosine)

    return run


def _meet(home: np.ndarray, level: int) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """Whether two vectors of a cell belong to it as a pair: on every level one of them is at home."""
    all_ = (2 << level) - 1
    return lambda rows, others: (home[rows][:, None] | home[others][None, :]) == all_


def _near_in_block(cosine: float) -> Callable:
    """Rows of a cell that have another within the block's budget."""

    def run(group: dict[str, np.ndarray], cross: bool) -> Iterator[tuple]:
        x = np.frombuffer(b"".join(group["numbers"]), np.float32).reshape(len(group["id"]), -1)
        home, all_ = group["home"], (2 << int(group["level"][0])) - 1
        budget = budgets(int(group["width"][0]), cosine)[int(group["block"][0])] + COARSE
        # Squared distances as one product: (x, |x|^2, 1) with (-2 y, 1, |y|^2).
        square, one = (x * x).sum(axis=1, keepdims=True), np.ones((len(x), 1), np.float32)
        first, second = np.hstack((x, square, one)), np.hstack((-2 * x, one, square))
        sides = (np.flatnonzero(group["left"]), np.flatnonzero(~group["left"])) if cross else (np.arange(len(x)),) * 2
        some = np.zeros(len(x), bool)
        for at in range(0, len(sides[0]), 256):
            rows = sides[0][at : at + 256]
            a, b = np.nonzero(first[rows] @ second[sides[1]].T <= budget)
            a, b = rows[a], sides[1][b]
            pair = (a != b) & ((home[a] | home[b]) == all_)
            some[a[pair]] = some[b[pair]] = True
        some = np.flatnonzero(some)
        if len(some):
            yield tuple(group[c][some] for c in ("id", "h1", "h2", "level", "home", "block"))

    return run


def _verified(cosine: float) -> Callable:
    def run(group: dict[str, np.ndarray], cross: bool) -> Iterator[tuple]:
        raw = np.frombuffer(b"".join(group["vector"]), np.float64).reshape(len(group["id"]), -1)
        v, block, copies = unit(raw), int(group["block"][0]), group["copies"]
        meet = _meet(group["home"], int(group["level"][0]))
        columns, budget = blocks_of(v.shape[1]), budgets(v.shape[1], cosine)
        turned = v @ rotation_of(v.shape[1])
        links = np.zeros(len(v), np.int64)

        def near(rows: np.ndarray, others: np.ndarray) -> np.ndarray:
            hit = v[rows] @ v[others].T >= cosine - 1e-12
            hit &= meet(rows, others)
            r, c = np.nonzero(hit)
            if len(r):
                a, b = rows[r], others[c]
                # Exact: the borderline is settled by the cosine of the vectors as they are.
                dot = (raw[a] * raw[b]).sum(axis=1) / np.sqrt((raw[a] ** 2).sum(axis=1) * (raw[b] ** 2).sum(axis=1))
                ok = (a != b) & ((dot >= cosine) | ~np.isfinite(dot))
                # A pair belongs to the first block that is within its budget.
                for k in range(block):
                    gap = turned[a][:, columns[k]] - turned[b][:, columns[k]]
                    ok &= (gap * gap).sum(axis=1) > budget[k]
                gap = turned[a][:, columns[block]] - turned[b][:, columns[block]]
                ok &= (gap * gap).sum(axis=1) <= budget[block]
                hit[r[~ok], c[~ok]] = False
            links[rows] += hit @ copies[others]
            if rows is not others:
                links[others] += copies[rows] @ hit
            return hit

        a, b = forest(len(v), group["left"] if cross else None, near, 256)
        yield group["id"][a], group["id"][b], np.zeros(len(a), np.int64)
        some = np.flatnonzero(links)
        yield group["id"][some], group["id"][some], links[some]

    return run


_ROTATIONS: dict[int, np.ndarray] = {}


def rotation_of(width: int) -> np.ndarray:
    if width not in _ROTATIONS:
        _ROTATIONS[width] = rotation(width)
    return _ROTATIONS[width]


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors as bytes of doubles; null for those that link with nothing."""
    for batch in batches:
        out = []
        for v in batch.column("embedding").to_pylist():
            x = np.array([np.nan if c is None else c for c in v], np.float64) if v else np.zeros(0)
            out.append((x + 0.0).tobytes() if len(x) and np.isfinite(x).all() and x.any() else None)
        yield pa.record_batch([batch.column("vec_id"), batch.column("label"), pa.array(out, pa.binary())], names=["vec_id", "label", "vector"])


def _vector_hash() -> list[Column]:
    """128 bits of label and vector, as two columns."""
    return [F.xxhash64("label", "vector").alias("v1"), F.xxhash64(F.lit("second"), "label", "vector").alias("v2")]


def candidates(classes: DataFrame, cosine: float, scratch: Scratch) -> DataFrame:
    """(id, h1, h2, level, home, block): places of vectors of ``classes`` (id, label, vector) in which another is within the block's budget."""
    cell = ["h1", "h2"]
    places = scratch.keep(classes.mapInArrow(_dealt(cosine), PLACE), "places-0")
    deepest = F.ceil(F.ceil(F.col("width") / F.lit(float(BLOCKS))) / F.lit(float(GRID))) - 1
    found, level = None, 0
    while True:
        sizes = places.groupBy(*cell).agg(F.count("*").alias("n"), F.max("home").alias("h"), F.max("width").alias("width")).filter(f"n > 1 and h >= {1 << level}")
        sizes = scratch.keep(sizes.withColumn("whole", (F.col("n") <= SPLIT) | (F.lit(level) >= deepest)), f"sizes-{level}")
        total = places.count()
        met = tiled(places, sizes.filter("whole"), cell, "id", SPLIT, total)
        payload = {"numbers": "binary", "home": "int", "level": "int", "width": "int", "block": "int", "h1": "long", "h2": "long"}
        near = grouped(met, [*cell, "tile", "other"], payload, _near_in_block(cosine), "id long, h1 long, h2 long, level long, home long, block long")
        near = scratch.keep(near.distinct(), f"near-{level}")
        found = near if found is None else found.unionByName(near)
        wide = sizes.filter("not whole").select(*cell, "n")
        if wide.isEmpty():
            return found
        level += 1
        crowded = hot_aware_join(places, wide, cell, "n", total).select(*places.columns)
        places = scratch.keep(crowded.mapInArrow(_cut(cosine), PLACE), f"places-{level}")


def near_duplicates(rows: DataFrame, cosine: float = COSINE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of ``rows`` (vec_id, embedding, label).

    Vectors link if their labels are equal and not null, they have the same dimensions, and their cosine in double
    precision is ``cosine`` or more. Null, empty and zero vectors, and those with null, infinite or undefined components,
    link with nothing. n_links counts the other vectors linked directly, equal ones included;
    component_id is the smallest vec_id that links lead to, the vector's own if none. Rows without a vec_id link with
    nothing, have a null component and are kept; rows that repeat one are vectors like any others. Other columns are not read.
    """
    last = Scratch(rows.sparkSession)
    with passing():
        packed, answer = _answered(rows, cosine, last)
    able = packed.filter("vector is not null and label is not null")
    told = hot_aware_join(able.select("vec_id", *_vector_hash()), answer, ["v1", "v2"], "copies", packed.count()).select("vec_id", "n_links", "component_id")
    nothing = F.lit(0).cast("long").alias("n_links")
    alone = packed.filter("vector is null or label is null").select("vec_id", nothing, F.col("vec_id").alias("component_id"))
    nobody = F.lit(None).cast("long")
    unnamed = rows.filter("vec_id is null").select(nobody.alias("vec_id"), nothing, nobody.alias("component_id"))
    return told.unionByName(alone).unionByName(unnamed).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def _answered(rows: DataFrame, cosine: float, last: Scratch) -> tuple[DataFrame, DataFrame]:
    """Written tables: the vectors as bytes, and what each different one's component and links are."""
    scratch = Scratch(rows.sparkSession)
    named = rows.filter("vec_id is not null").select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", F.col("label").cast("long").alias("label"))
    packed = last.keep(named.mapInArrow(_packed, "vec_id long, label long, vector binary"), "packed")
    able = packed.filter("vector is not null and label is not null")
    # Equal vectors under one label are one, and counted; numbered by where they are written.
    classes = able.groupBy("label", "vector").agg(F.min("vec_id").alias("first"), F.count("*").alias("copies"))
    classes = scratch.keep(classes.select(F.monotonically_increasing_id().alias("node"), *_vector_hash(), "label", "vector", "first", "copies"), "classes")

    named = classes.select(F.col("node").alias("id"), "label", "vector")
    near = scratch.keep(candidates(named, cosine, scratch), "near")
    cell = ["h1", "h2"]
    sizes = scratch.keep(near.groupBy(*cell).agg(F.count("*").alias("n")), "sizes")
    met = tiled(near, sizes, cell, "id", TILE, near.count()).join(classes.select(F.col("node").alias("id"), "vector", "copies"), "id")
    payload = {"vector": "binary", "home": "long", "level": "long", "block": "long", "copies": "long"}
    verified = scratch.keep(grouped(met, [*cell, "tile", "other"], payload, _verified(cosine), "a long, b long, n long"), "verified")

    linked = verified.filter("a = b").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    joined = connected_components(verified.filter("a <> b").select("a", "b"), scratch, "joined").withColumnRenamed("component", "root")
    joined = joined.join(classes.select("node", "first"), "node")
    roots = joined.groupBy("root").agg(F.min("first").alias("component_id"))
    linked = joined.join(roots, "root").select("node", "component_id").join(linked, "node", "left")
    answer = classes.select("node", "v1", "v2", "first", "copies").join(linked, "node", "left").select(
        "v1", "v2", "copies", F.coalesce("component_id", "first").alias("component_id"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links")
    )
    return packed, last.keep(answer, "answer")


ORACLE = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL),
able AS (SELECT * FROM v WHERE len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM able a JOIN able b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= {COSINE}),
reached AS (SELECT vec_id AS x, vec_id AS y FROM embeddings UNION SELECT r.x, l.y FROM reached r JOIN links l ON r.y = l.x),
classes AS (SELECT x, min(y) AS component_id FROM reached GROUP BY x),
counts AS (SELECT x, count(*) AS n FROM links GROUP BY x)
SELECT c.x AS vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, c.x = component_id AS kept FROM classes c LEFT JOIN counts ON c.x = counts.x
"""
