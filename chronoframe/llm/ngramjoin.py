"""Join of near duplicates by the Jaccard similarity of their word five-grams, through a MinHash LSH forest.

1. Every text becomes its set of shingles, a signature and a fingerprint of the set. Texts with equal
   sets are one class, for which its smallest key stands from here on.
2. The forest: each of TREES tries holds a stretch of every signature, as a table sorted by the stretches. Texts
   meet where they share a prefix of a tree. Matching begins at full depth; prefixes are then shortened by one value at
   a time, for each text until the chance to meet the least similar text that may still link with it reaches RECALL
   (``depth_for``: a text of few shingles can have no link right at the threshold and ends deeper). A prefix whose
   texts the full depth has all brought together is not matched again, and a text
   without company at the shortest prefix is done with at once. Texts that meet, and whose whole signatures don't
   rule the threshold out, are candidates.
3. Components of the candidates are verified exactly: all pairs in a component are compared by their
   sets, so that nothing found by a detour is lost. Components and buckets of any size are cut into tiles
   of bounded size, and each task sees two tiles at most; it sends on counts and a spanning forest, never
   all pairs.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoframe.llm.common import Scratch, code_points, hot_aware_join, kinds, mix, passing, run_hashes, text_hash, text_slices, word_runs
from chronoframe.llm.graph import connected_components
from chronoframe.llm.tiles import forest, grouped, tiled

SHINGLE, THRESHOLD = 5, 0.8
#: Trees of the forest, values in a tree's full stretch, and the recall wanted for the least similar pair that links.
TREES, DEPTH, RECALL = 20, 6, 0.9999
#: A pair whose signatures agree in less than this share of places is no candidate: at the threshold that has a chance of about 1e-9.
FLOOR = 0.55
#: Rows of one side in a comparison.
TILE = 1024
SIGNATURE = TREES * DEPTH
#: Sets of more shingles than this are taken to have links right at the threshold.
SMALL = 200


def least_similarity(n: int, threshold: float) -> float:
    """The smallest Jaccard similarity of ``threshold`` or more that a set of n can have with another set; 1 where there is none below."""
    if n > SMALL:
        return threshold
    least = 1.0
    for m in range(math.ceil(threshold * n - 1e-9), int(n / threshold + 1e-9) + 1):
        both = math.ceil(threshold * (n + m) / (1 + threshold) - 1e-9)
        if both <= min(n, m) and n + m > 2 * both:
            least = min(least, both / (n + m - both))
    return least


def depth_for(similarity: float) -> int:
    """The longest prefix at which a pair of this similarity meets in some tree with the wanted recall."""
    depth = DEPTH
    while depth > 1 and 1 - (1 - similarity**depth) ** TREES < RECALL:
        depth -= 1
    return depth


@lru_cache(maxsize=1024)
def last_depth(n: int, threshold: float) -> int:
    """Where the shortening ends for a set of n; DEPTH + 1 if none but equal sets can link with it."""
    least = least_similarity(n, threshold)
    return depth_for(least) if least < 1 else DEPTH + 1


_A = (mix(np.arange(1, SIGNATURE + 1, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_B = (mix(np.arange(1001, 1001 + SIGNATURE, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)


def shingle_sets(texts: list[str], size: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct 64-bit hashes of each text's shingles.

    Words are the runs of letters and digits of the lower-cased text. A text with fewer words than a
    shingle has one shingle of all its words; one without words has none.
    """
    codes, bounds = code_points([t.lower() for t in texts])
    kind = kinds(codes)
    starts, ends = word_runs((kind == 1) | (kind == 2))
    words = run_hashes(codes, starts, ends)
    limits = np.searchsorted(starts, bounds)
    joined = np.zeros(len(words), np.uint64)
    n = len(words)
    for k in range(size):
        joined[: n - k] = (joined[: n - k] + words[k:]) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(k)
    joined = mix(joined)
    out = []
    for at, to in zip(limits[:-1].tolist(), limits[1:].tolist(), strict=True):
        if to - at >= size:
            out.append(np.unique(joined[at : to - size + 1]))
        elif to > at:
            out.append(np.frombuffer(hashlib.blake2b(words[at:to].tobytes(), digest_size=8).digest(), np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signature(shingles: np.ndarray) -> np.ndarray:
    """MinHash values (uint32) of a non-empty set."""
    low = np.full(SIGNATURE, 0xFFFFFFFF, np.uint32)
    h = (shingles >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(h), 512):
        v = h[at : at + 512, None] * _A + _B
        v ^= v >> np.uint32(15)
        np.minimum(low, v.min(axis=0), out=low)
    return low


def digests(sets: list[np.ndarray]) -> list[pa.Array]:
    """A 128-bit fingerprint of each set, as two columns."""
    both = np.frombuffer(b"".join(hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets), np.int64).reshape(-1, 2)
    return [pa.array(both[:, k].copy()) for k in (0, 1)]


def _signed(docs: DataFrame, threshold: float) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_slices(batches):
            sets = shingle_sets(texts)
            size = [len(s) for s in sets]
            last = [last_depth(min(n, SMALL + 1), threshold) for n in size]
            yield pa.record_batch(
                [*(part.column(k) for k in range(3)), *digests(sets), pa.array(size, pa.int64()), pa.array(last, pa.int32()), pa.array([signature(s).tobytes() for s in sets], pa.binary())],
                names=["id", "t1", "t2", "hi", "lo", "shingles", "last", "sign"],
            )

    return docs.select("id", "t1", "t2", "text").mapInArrow(run, "id long, t1 long, t2 long, hi long, lo long, shingles long, last int, sign binary")


def _candidates(group: dict[str, np.ndarray], cross: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Spanning edges of the pairs of a bucket's tile whose signatures agree enough."""
    signs = np.frombuffer(b"".join(group["sign"]), np.uint32).reshape(-1, SIGNATURE)
    ids = group["id"]

    def near(rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
        if len(rows) * len(columns) < 4000:
            return (signs[rows][:, None, :] == signs[columns][None, :, :]).sum(axis=2) >= FLOOR * SIGNATURE
        same = np.zeros((len(rows), len(columns)), np.int32)
        for k in range(SIGNATURE):
            same += signs[rows, k][:, None] == signs[columns, k][None, :]
        return same >= FLOOR * SIGNATURE

    a, b = forest(len(ids), group["left"] if cross else None, near, 256)
    yield ids[a], ids[b]


def overlap(sets: list[np.ndarray], rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the rows' sets with the columns' sets."""
    if len(rows) * len(columns) <= 64:
        return np.array([[len(np.intersect1d(sets[r], sets[c], assume_unique=True)) for c in columns] for r in rows], np.int64).reshape(len(rows), len(columns))
    def flat(which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.concatenate([sets[i] for i in which]), np.repeat(np.arange(len(which)), [len(sets[i]) for i in which])

    (rv, ro), (cv, co) = flat(rows), flat(columns)
    shared = np.intersect1d(rv, cv)
    total = np.zeros((len(rows), len(columns)), np.float32)
    rk, ck = np.searchsorted(shared, rv), np.searchsorted(shared, cv)
    if not len(shared):
        return total.astype(np.int64)
    rin, cin = shared[np.minimum(rk, len(shared) - 1)] == rv, shared[np.minimum(ck, len(shared) - 1)] == cv
    rk, ro, ck, co = rk[rin], ro[rin], ck[cin], co[cin]
    order_r, order_c = np.argsort(rk, kind="stable"), np.argsort(ck, kind="stable")
    rk, ro, ck, co = rk[order_r], ro[order_r], ck[order_c], co[order_c]
    width = 4096
    for at in range(0, len(shared), width):
        r0, r1 = np.searchsorted(rk, [at, at + width])
        c0, c1 = np.searchsorted(ck, [at, at + width])
        n = min(width, len(shared) - at)
        x, y = np.zeros((len(rows), n), np.float32), np.zeros((len(columns), n), np.float32)
        x[ro[r0:r1], rk[r0:r1] - at] = 1
        y[co[c0:c1], ck[c0:c1] - at] = 1
        total += x @ y.T
    return np.rint(total).astype(np.int64)


def _verified(threshold: float) -> Callable:
    def run(group: dict[str, np.ndarray], cross: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(edge ends a, b of a spanning forest, ids, links of each id to rows of the tile pair by copies)."""
        sets = [np.frombuffer(s, np.uint64) for s in group["set"]]
        size, copies = np.array([len(s) for s in sets]), group["copies"]
        links = np.zeros(len(sets), np.int64)

        def near(rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
            both = overlap(sets, rows, columns)
            hit = both >= threshold * (size[rows][:, None] + size[columns][None, :] - both) - 1e-9
            apart = hit & (rows[:, None] != columns[None, :])
            links[rows] += apart @ copies[columns]
            if cross or rows is not columns:
                links[columns] += copies[rows] @ apart
            return hit

        a, b = forest(len(sets), group["left"] if cross else None, near, 256)
        return group["id"][a], group["id"][b], group["id"], links

    return run


def _prefix(depth: int) -> Column:
    return F.xxhash64(F.substring("stretch", 1, 4 * depth)).alias("prefix")


def forest_components(standing: DataFrame, threshold: float, scratch: Scratch) -> DataFrame:
    """(node, component) of the texts of ``standing`` (node, last, sign) that have candidates."""
    final = depth_for(threshold)
    stretch = F.expr(f"substring(sign, tree * {4 * DEPTH} + 1, {4 * DEPTH})")
    leaves = standing.filter(F.col("last") <= DEPTH).select("node", "last", "sign", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree"))
    leaves = leaves.select("node", "last", "tree", stretch.alias("stretch")).withColumn("prefix", _prefix(final))
    company = scratch.keep(leaves.groupBy("tree", "prefix").agg(F.count("*").alias("n")).filter("n > 1"), "company")
    total = company.agg(F.sum("n")).first()[0] or 0
    # The tries: their leaves in order, so that the texts of any prefix, of whatever depth, lie together.
    tries = hot_aware_join(leaves, company, ["tree", "prefix"], "n", total).select("tree", "stretch", "node", "last")
    tries = scratch.keep(tries.repartitionByRange("tree", "stretch", "node").sortWithinPartitions("tree", "stretch", "node"), "tries")
    nothing = scratch.spark.createDataFrame([], "node long, component long")
    united, found = nothing, nothing.toDF("a", "b")
    for depth in range(DEPTH, final - 1, -1):
        now = tries.filter(F.col("last") <= depth).select("tree", _prefix(depth), "node")
        known = now.join(united, "node", "left").withColumn("component", F.coalesce("component", "node"))
        buckets = known.groupBy("tree", "prefix").agg(
            F.count("*").alias("n"), F.min("component").alias("c0"), F.max("component").alias("c1"),
            F.min("node").alias("lo"), F.max("node").alias("hi"), F.bit_xor(F.xxhash64("node")).alias("mark"),
        )
        # Of several buckets with the same texts one is enough.
        apart = buckets.filter("c0 <> c1").groupBy("n", "lo", "hi", "mark").agg(F.min(F.struct("tree", "prefix")).alias("b"))
        crowded = scratch.keep(apart.select("b.tree", "b.prefix", "n"), "crowded")
        met = tiled(now, crowded, ["tree", "prefix"], "node", TILE, total).join(standing.select("node", "sign"), "node").withColumnRenamed("node", "id")
        edges = scratch.keep(grouped(met, ["tree", "prefix", "tile", "other"], {"sign": "binary"}, _candidates, "a long, b long"), f"edges-{depth}")
        found = found.unionByName(edges)
        if depth in (DEPTH, final):
            united = connected_components(found, scratch, f"rounds-{depth}")
            found = united.select(F.col("node").alias("a"), F.col("component").alias("b"))
    return united


def _classed(docs: DataFrame, key: str, threshold: float) -> DataFrame:
    """(id, t1, t2, root, class_id, n_links) of every row of ``docs`` with a key; root tells classes apart, null for texts without a word."""
    last = Scratch(docs.sparkSession)
    with passing():
        members, answer = _answered(docs, key, threshold, last)
    told = hot_aware_join(members.filter("shingles > 0"), answer, ["hi", "lo"], "copies", members.count())
    alone = members.filter("shingles = 0").select("*", F.lit(None).cast("long").alias("root"), F.col("id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    columns = ["id", "t1", "t2", "root", "class_id", "n_links"]
    return told.select(*columns).unionByName(alone.select(*columns))


def _answered(docs: DataFrame, key: str, threshold: float, last: Scratch) -> tuple[DataFrame, DataFrame]:
    """Written tables: the rows with their sets' fingerprints, and what each set's class is."""
    scratch = Scratch(docs.sparkSession)
    named = docs.filter(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), *text_hash(), "text")
    signed = scratch.keep(_signed(named, threshold), "signed")
    # A class for each set of shingles: its smallest key, its rows, one row's signature. Told by a fingerprint of the
    # set, not by the key, for repeated keys may have different texts; numbered by where it is written.
    classes = signed.filter("shingles > 0").groupBy("hi", "lo").agg(
        F.min("id").alias("id"), F.count("*").alias("copies"), F.min_by(F.struct("last", "sign"), "id").alias("s")
    )
    standing = scratch.keep(classes.select(F.monotonically_increasing_id().alias("node"), "hi", "lo", "id", "copies", "s.last", "s.sign"), "standing")
    candidates = forest_components(standing, threshold, scratch)

    # Exact verification within the candidates' components.
    suspects = scratch.keep(standing.select("node", "hi", "lo", "id", "copies").join(candidates, "node"), "suspects")
    # The suspects have no bound on their number, so the texts are always shuffled to them.
    texts = named.join(suspects.hint("merge"), "id").select("node", "component", "copies", "hi", "lo", "text")
    sets = texts.mapInArrow(_sets, "node long, component long, copies long, set binary").dropDuplicates(["node"])
    sets = scratch.keep(sets, "sets")
    sizes = scratch.keep(sets.groupBy("component").agg(F.count("*").alias("n")).filter("n > 1"), "sizes")
    pairs = tiled(sets, sizes, ["component"], "node", TILE, sets.count()).withColumnRenamed("node", "id")
    run = _verified(threshold)

    def out(group: dict[str, np.ndarray], cross: bool) -> Iterator[tuple]:
        a, b, ids, found = run(group, cross)
        yield a, b, np.zeros(len(a), np.int64)
        some = np.flatnonzero(found)
        yield ids[some], ids[some], found[some]

    verified = scratch.keep(grouped(pairs, ["component", "tile", "other"], {"copies": "long", "set": "binary"}, out, "a long, b long, n long"), "verified")
    linked = verified.filter("a = b").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    joined = connected_components(verified.filter("a <> b").select("a", "b"), scratch, "joined")
    least = joined.withColumnRenamed("component", "root").join(standing.select("node", "id"), "node")
    roots = least.groupBy("root").agg(F.min("id").alias("class_id"))
    linked = least.join(roots, "root").select("node", "root", "class_id").join(linked, "node", "left")
    answer = standing.select("node", "hi", "lo", "id", "copies").join(linked, "node", "left").select(
        "hi", "lo", "copies", F.coalesce("root", "node").alias("root"), F.coalesce("class_id", "id").alias("class_id"),
        (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
    )
    return last.keep(signed.select("id", "t1", "t2", "hi", "lo", "shingles"), "members"), last.keep(answer, "answer")


def near_duplicates(docs: DataFrame, key: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """(key, class_id, n_links) of every row of ``docs`` (key, text).

    n_links counts the other rows whose shingle set has a Jaccard similarity of ``threshold`` or more with
    the row's own, copies included; class_id is the smallest key that links lead to, the row's own if
    none. Texts without a word (null, empty) link with nothing, copies of each other included. Rows
    with a null key have no identity: they link with nothing and have a null class. Rows that repeat a key are copies
    or not like any others, with equal class for equal texts. Other columns are not read.
    """
    told = _classed(docs, key, threshold).select(F.col("id").alias(key), "class_id", "n_links")
    nobody = F.lit(None).cast("long")
    return told.unionByName(docs.filter(F.col(key).isNull()).select(nobody.alias(key), nobody.alias("class_id"), F.lit(0).cast("long").alias("n_links")))


def one_of_each(docs: DataFrame, key: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with one row of each class of near duplicates: that of the smallest key, then text hash.

    Of equal texts without a word (null and empty ones are two such texts) one stays too. Rows without a key
    stay. Of rows that repeat key and text one stays; of rows with one key and different texts each is judged by its
    text.
    """
    rows = _classed(docs.select(key, "text"), key, threshold)
    row = F.min(F.struct("id", "t1", "t2")).alias("first")
    firsts = rows.filter("root is not null").groupBy("root").agg(row).unionByName(rows.filter("root is null").groupBy(F.hash("t1", "t2").cast("long").alias("root"), "t1", "t2").agg(row).select("root", "first"))
    hashed = docs.select(F.struct("*").alias("row"), F.col(key).cast("long").alias("id"), *text_hash())
    # By key and hash, so that the rows of a common text don't meet in one task.
    chosen = hashed.join(firsts.select("first.*").hint("merge"), ["id", "t1", "t2"], "left_semi").dropDuplicates(["id", "t1", "t2"])
    return chosen.select("row.*").unionByName(docs.filter(F.col(key).isNull()))


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sets of the texts that have the fingerprints asked for (another text under the same key has not)."""
    for part, texts in text_slices(batches):
        sets = shingle_sets(texts)
        hi, lo = digests(sets)
        wanted = pc.and_(pc.equal(hi, part.column("hi")), pc.equal(lo, part.column("lo")))
        found = pa.record_batch([*(part.column(k) for k in range(3)), pa.array([s.tobytes() for s in sets], pa.binary())], names=["node", "component", "copies", "set"])
        yield found.filter(wanted)


ORACLE = f"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(lower(text), '[\\pL\\p{{Nd}}]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < {SHINGLE} THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + {SHINGLE - 1}], ' ') END AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {SHINGLE - 1}, 1) + 1)) AS i FROM words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
pairs AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (
  SELECT x, y FROM pairs JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE shared >= {THRESHOLD} * (p.n + q.n - shared) - 1e-9),
reached AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, l.y FROM reached r JOIN links l ON r.y = l.x),
classes AS (SELECT x, min(y) AS class_id FROM reached GROUP BY x),
counts AS (SELECT x, count(*) AS n FROM links GROUP BY x)
SELECT c.x AS doc_id, c.class_id, coalesce(n, 0)::BIGINT AS n_links FROM classes c LEFT JOIN counts ON c.x = counts.x
"""
