"""A content-addressed store of token ids.

Layout under one folder:

* ``chunks/``: (chunk binary(16), n_ids, data): every distinct chunk once. ``chunk`` is the BLAKE2b address of
  ``data``, the ids as little-endian unsigned 16- or 32-bit integers (``width`` bytes).
* ``recipes/``: (key, n_tokens, part_, local_, chunks, root): one row for each document, in ascending key order over the files.
  ``chunks`` lists its chunks' addresses with their ids counted; ``root`` is the Merkle root over them.
* ``manifest/``: (part_, n_docs, n_chunks, n_tokens, root): for each recipe file the Merkle root over its documents' roots.
* ``head/``: one row of the same: the parts' number, their sums, and the Merkle root over the parts' roots.

Reading starts with the recipes held against manifest and head, so that a lost or changed file is an error.

A rolling hash over the last WINDOW ids cuts a document's ids into chunks wherever its low bits are
all ones, so equal stretches of ids in different documents give equal chunks wherever they lie.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import OrderedDict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from chronoframe.llm.common import HOT_SHARE, Scratch, mix
from chronoframe.llm.wordbpe import END_ID, WORD_FILE, encoded

#: Ids that the rolling hash sees; mean, smallest and largest chunk in ids.
WINDOW, MEAN, LEAST, MOST = 16, 512, 128, 4096
#: Addresses that a task remembers having sent: what it sees again of these is not sent twice.
REMEMBERED = 50_000
WIDTHS = {2: np.dtype("<u2"), 4: np.dtype("<u4")}


def marks(ids: np.ndarray) -> np.ndarray:
    """Places after which a chunk may end. Several documents' ids may lie end to end: a window reaches back less than LEAST."""
    value = mix(ids.astype(np.uint64) + np.uint64(1))
    # Rolling sum over WINDOW ids of their mixed values, each turned by its age in the window.
    rolling = value.copy()
    for age in range(1, min(WINDOW, len(ids))):
        rolling[age:] += ((value << np.uint64(age)) | (value >> np.uint64(64 - age)))[:-age]
    return np.flatnonzero((mix(rolling) & np.uint64(MEAN - 1)) == MEAN - 1) + 1


def ends_of(places: list[int], n: int) -> list[int]:
    """Ends of the chunks of a document of n ids that has these marks."""
    out, at = [], 0
    for place in places:
        while place - at > MOST:
            at += MOST
            out.append(at)
        if place - at >= LEAST:
            at = place
            out.append(at)
    while n - at > MOST:
        at += MOST
        out.append(at)
    if n > at:
        out.append(n)
    return out


def cuts(ids: np.ndarray) -> list[int]:
    """Ends of the chunks of one document's ids."""
    return ends_of(marks(ids).tolist(), len(ids))


def address(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def merkle_root(leaves: list[bytes]) -> bytes:
    """Root of the binary hash tree over ``leaves``; an odd last node goes up alone; no leaves: the hash of nothing."""
    level = [hashlib.blake2b(b"\0" + leaf, digest_size=16).digest() for leaf in leaves] or [hashlib.blake2b(b"", digest_size=16).digest()]
    while len(level) > 1:
        level = [
            hashlib.blake2b(b"\1" + level[i] + level[i + 1], digest_size=16).digest() if i + 1 < len(level) else level[i]
            for i in range(0, len(level), 2)
        ]
    return level[0]


def write(docs: DataFrame, path: str, key: str = "doc_id", file: str = WORD_FILE, end: int = END_ID, width: int = 2) -> None:
    """Encodes every whole text of ``docs`` (key, text), ``end`` after each, and writes the store to ``path``.

    Ids that ``width`` bytes can't hold are an error. A null or empty text is one id. Null keys come first in the order. Rows that repeat a key lie next to
    each other, ordered by their root. An empty table gives an empty store. Other columns are not read.
    Texts are encoded once: chunks go by their address to the task that writes them, a chunk that
    a task has sent lately is not sent again, and recipes travel without data.
    """
    spark = docs.sparkSession
    kind = docs.schema[key].dataType.simpleString()
    dtype = WIDTHS[width]

    def chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: OrderedDict[bytes, None] = OrderedDict()
        for rows, ids, sizes in encoded(batches, file, end):
            if len(ids) and int(ids.max()) > np.iinfo(dtype).max:
                raise ValueError(f"id {int(ids.max())} does not fit {width} bytes")
            bounds = np.concatenate(([0], np.cumsum(sizes)))
            recipes, roots, new = [], [], []
            raw, places = ids.astype(dtype).tobytes(), marks(ids)
            upto = np.searchsorted(places, bounds, side="right").tolist()
            for k, (first, last) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
                recipe, at = [], 0
                for to in ends_of((places[upto[k] : upto[k + 1]] - first).tolist(), last - first):
                    data = raw[width * (first + at) : width * (first + to)]
                    chunk = address(data)
                    recipe.append({"chunk": chunk, "n_ids": to - at})
                    if chunk in sent:
                        sent.move_to_end(chunk)
                    else:
                        sent[chunk] = None
                        new.append((chunk, to - at, data))
                        if len(sent) > REMEMBERED:
                            sent.popitem(last=False)
                    at = to
                recipes.append(recipe)
                roots.append(merkle_root([r["chunk"] for r in recipe]))
            n, m = len(sizes), len(new)
            listed = pa.list_(pa.struct([("chunk", pa.binary()), ("n_ids", pa.int32())]))
            yield pa.record_batch(
                [
                    pa.concat_arrays([rows.column(0), pa.nulls(m, rows.column(0).type)]),
                    pa.array([*sizes.tolist(), *[None] * m], pa.int64()),
                    pa.array([*recipes, *[None] * m], listed),
                    pa.array([*roots, *[None] * m], pa.binary()),
                    pa.array([*[None] * n, *[c for c, _, _ in new]], pa.binary()),
                    pa.array([*[None] * n, *[k for _, k, _ in new]], pa.int32()),
                    pa.array([*[None] * n, *[d for _, _, d in new]], pa.binary()),
                ],
                names=[key, "n_tokens", "chunks", "root", "chunk", "n_ids", "data"],
            )

    schema = f"`{key}` {kind}, n_tokens long, chunks array<struct<chunk: binary, n_ids: int>>, root binary, chunk binary, n_ids int, data binary"
    rows = docs.select(key, "text").mapInArrow(chunked, schema)

    # Data by address; recipes, which have none, by what tells them apart, so that they spread. Of equal chunks one stays.
    placed = rows.withColumn("by_", F.when(F.col("chunk").isNull(), F.xxhash64(key, "root")).otherwise(F.xxhash64("chunk")))
    before = F.lag("chunk").over(Window.partitionBy("by_").orderBy("chunk"))
    placed = placed.withColumn("before_", before).filter("chunk is null or before_ is null or before_ <> chunk").drop("by_", "before_")
    placed.withColumn("kind", F.when(F.col("chunk").isNull(), "recipe").otherwise("chunk")).write.mode("overwrite").partitionBy("kind").option(
        "compression", "lz4"
    ).parquet(f"{path}/objects")

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before = TaskContext.get().partitionId(), 0
        for batch in batches:
            size = batch.column("n_tokens").to_numpy()
            ends = before + np.cumsum(size)
            yield pa.record_batch(
                [batch.column(0), batch.column(1), pa.array(np.full(len(batch), part, np.int32)), pa.array(ends - size), batch.column(2), batch.column(3)],
                names=[key, "n_tokens", "part_", "local_", "chunks", "root"],
            )
            before = int(ends[-1]) if len(ends) else before

    recipes = spark.read.schema(f"{schema}, kind string").parquet(f"{path}/objects").filter("kind = 'recipe'").select(key, "n_tokens", "chunks", "root")
    ordered = recipes.repartitionByRange(key, "root").sortWithinPartitions(key, "root")
    ordered.mapInArrow(numbered, f"`{key}` {kind}, n_tokens long, part_ int, local_ long, chunks array<struct<chunk: binary, n_ids: int>>, root binary").write.mode(
        "overwrite"
    ).parquet(f"{path}/recipes")
    parts = _parts(read_recipes(spark, path, key, kind))
    parts.coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest")
    _head(spark, spark.read.schema(parts.schema).parquet(f"{path}/manifest").collect()).coalesce(1).write.mode("overwrite").parquet(f"{path}/head")


PART = "part_ int, n_docs long, n_chunks long, n_tokens long, root binary"


def _parts(recipes: DataFrame) -> DataFrame:
    """The manifest's rows, from the recipes."""
    rows = recipes.select("part_", "local_", "n_tokens", "root", F.size("chunks").cast("long").alias("n_chunks"))
    return rows.groupBy("part_").applyInArrow(_manifest_row, PART)


def _manifest_row(table: pa.Table) -> pa.Table:
    table = table.sort_by("local_")
    root = merkle_root(table.column("root").to_pylist())
    chunks, tokens = (sum(table.column(c).to_pylist()) for c in ("n_chunks", "n_tokens"))
    return pa.table({"part_": pa.array([table.column("part_")[0].as_py()], pa.int32()), "n_docs": [len(table)], "n_chunks": [chunks], "n_tokens": [tokens], "root": pa.array([root], pa.binary())})


def _head(spark: SparkSession, parts: list[Row]) -> DataFrame:
    parts = sorted(parts, key=lambda p: p.part_)
    row = (len(parts), sum(p.n_docs for p in parts), sum(p.n_chunks for p in parts), sum(p.n_tokens for p in parts), bytearray(merkle_root([bytes(p.root) for p in parts])))
    return spark.createDataFrame([row], PART)


def verified(recipes: DataFrame, path: str) -> tuple[DataFrame, int]:
    """``recipes`` with their starts, and their chunks in all; DamagedStore unless they are those that manifest and head tell of.

    One row for each recipe file reaches the driver.
    """
    spark = recipes.sparkSession
    found = sorted(_parts(recipes).collect(), key=lambda p: p.part_)
    told = sorted(spark.read.schema(PART).parquet(f"{path}/manifest").collect(), key=lambda p: p.part_)
    if found != told or _head(spark, found).collect() != spark.read.schema(PART).parquet(f"{path}/head").collect():
        raise DamagedStore("the recipes are not those of the manifest")
    base, run = [], 0
    for p in found:
        base.append((p.part_, run))
        run += p.n_tokens
    bases = spark.createDataFrame(base, "part_ int, base_ long")
    placed = recipes.join(F.broadcast(bases), "part_").withColumn("start", F.col("base_") + F.col("local_")).drop("base_")
    return placed, sum(p.n_chunks for p in found)


def _fetched(wanted: DataFrame, chunks: DataFrame, total: int, scratch: Scratch) -> DataFrame:
    """``wanted`` (chunk, ...) with the columns of ``chunks``, null where a chunk is missing.

    Chunks that more than one in HOT_SHARE of all references name (at most HOT_SHARE of them, at most MOST ids each) are
    broadcast, the others shuffled.
    """
    counts = wanted.groupBy("chunk").agg(F.count("*").alias("n_")).filter(F.col("n_") > max(1, total // HOT_SHARE))
    hot = scratch.keep(counts.select("chunk"), "hot")
    near = wanted.join(F.broadcast(hot.join(chunks.join(F.broadcast(hot), "chunk", "left_semi"), "chunk", "left")), "chunk")
    return near.unionByName(wanted.join(F.broadcast(hot), "chunk", "left_anti").join(chunks, "chunk", "left"))


def read_recipes(spark: SparkSession, path: str, key: str = "doc_id", kind: str = "bigint") -> DataFrame:
    return spark.read.schema(f"`{key}` {kind}, n_tokens long, part_ int, local_ long, chunks array<struct<chunk: binary, n_ids: int>>, root binary").parquet(f"{path}/recipes")


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """(chunk, n_ids, data) of every distinct chunk."""
    return spark.read.schema("chunk binary, n_ids int, data binary, kind string").parquet(f"{path}/objects").filter("kind = 'chunk'").drop("kind")


class DamagedStore(ValueError):
    pass


def read(spark: SparkSession, path: str, key: str = "doc_id", kind: str = "bigint", width: int = 2) -> DataFrame:
    """(key, start, n_tokens, ids binary of little-endian uint32) of every document, from the files.

    ``start`` counts the ids of all documents before it. Every chunk's address and every document's
    Merkle root are computed again from the bytes that were read, and the roots of all from them; DamagedStore where they don't fit.
    """
    recipes, total = verified(read_recipes(spark, path, key, kind), path)
    wanted = recipes.select(key, "start", "n_tokens", "root", F.posexplode("chunks").alias("turn", "c")).select(key, "start", "n_tokens", "root", "turn", "c.chunk")
    found = _fetched(wanted, read_chunks(spark, path).drop("n_ids"), total, Scratch(spark)).select(key, "start", "n_tokens", "root", "turn", "chunk", "data")

    def restored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, leaves, parts = None, [], []

        def whole() -> pa.RecordBatch:
            if merkle_root(leaves) != head[3] or sum(map(len, parts)) != width * head[2]:
                raise DamagedStore(f"document {head[0]} does not fit its root")
            ids = np.frombuffer(b"".join(parts), WIDTHS[width]).astype("<u4").tobytes()
            columns = zip(head[:3], (out_type, pa.int64(), pa.int64()), strict=True)
            return pa.record_batch([*(pa.array([v], t) for v, t in columns), pa.array([ids], pa.binary())], names=[key, "start", "n_tokens", "ids"])

        out_type = None
        ready: list[pa.RecordBatch] = []
        for batch in batches:
            out_type = batch.column(0).type
            for *row, _, chunk, data in zip(*(batch.column(k).to_pylist() for k in range(7)), strict=True):
                if head is not None and row[1] != head[1]:
                    ready.append(whole())
                    leaves, parts = [], []
                head = row
                if data is None or address(data) != chunk:
                    raise DamagedStore(f"chunk {chunk.hex()} is missing or damaged")
                leaves.append(chunk)
                parts.append(data)
            if ready:
                yield pa.Table.from_batches(ready).combine_chunks().to_batches()[0]
                ready = []
        if head is not None:
            yield whole()

    # Every document has an id at least, so ``start`` tells documents apart.
    ordered = found.repartition("start").sortWithinPartitions("start", "turn")
    return ordered.mapInArrow(restored, f"`{key}` {kind}, start long, n_tokens long, ids binary")


def checksums(spark: SparkSession, path: str, key: str = "doc_id", kind: str = "bigint", width: int = 2) -> DataFrame:
    """(key, start, n_tokens, ids_crc32) of every document, from the files, without moving the ids.

    ids_crc32 is the unsigned crc32 of the document's ids as little-endian uint32. Each chunk's bytes are
    read where they lie, held against their address and summed up; only checksums are joined to the
    recipes and put together, for the crc32 of a whole follows from those of its parts. Every document's Merkle root is
    computed again from the addresses of the chunks that were read.
    """

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chunks, crcs = batch.column("chunk").to_pylist(), []
            for chunk, data in zip(chunks, batch.column("data").to_pylist(), strict=True):
                if address(data) != chunk:
                    raise DamagedStore(f"chunk {chunk.hex()} is damaged")
                crcs.append(zlib.crc32(np.frombuffer(data, WIDTHS[width]).astype("<u4").tobytes()))
            yield pa.record_batch([batch.column("chunk"), batch.column("n_ids"), pa.array(crcs, pa.int64())], names=["chunk", "size", "crc"])

    def combined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, leaves, parts = None, [], []
        ready: list[tuple] = []

        def whole() -> tuple:
            if merkle_root(leaves) != head[3] or sum(n for _, n in parts) != head[2]:
                raise DamagedStore(f"document {head[0]} does not fit its root")
            return (*head[:3], crc32_combined([(crc, 4 * n) for crc, n in parts]))

        def sent(out_type: pa.DataType) -> pa.RecordBatch:
            columns = zip(zip(*ready, strict=True), (out_type, pa.int64(), pa.int64(), pa.int64()), strict=True)
            return pa.record_batch([pa.array(c, t) for c, t in columns], names=[key, "start", "n_tokens", "ids_crc32"])

        for batch in batches:
            for *row, _, chunk, size, crc in zip(*(batch.column(k).to_pylist() for k in range(8)), strict=True):
                if head is not None and row[1] != head[1]:
                    ready.append(whole())
                    leaves, parts = [], []
                head = row
                if crc is None:
                    raise DamagedStore(f"chunk {chunk.hex()} is missing")
                leaves.append(chunk)
                parts.append((crc, size))
            if ready:
                yield sent(batch.column(0).type)
                ready = []
        if head is not None:
            ready.append(whole())
            yield sent(batch.column(0).type)

    recipes, total = verified(read_recipes(spark, path, key, kind), path)
    wanted = recipes.select(key, "start", "n_tokens", "root", F.posexplode("chunks").alias("turn", "c")).select(key, "start", "n_tokens", "root", "turn", "c.chunk")
    scratch = Scratch(spark)
    sums = scratch.keep(read_chunks(spark, path).mapInArrow(summed, "chunk binary, size int, crc long"), "sums")
    found = _fetched(wanted, sums, total, scratch).select(key, "start", "n_tokens", "root", "turn", "chunk", "size", "crc")
    ordered = found.repartition("start").sortWithinPartitions("start", "turn")
    return ordered.mapInArrow(combined, f"`{key}` {kind}, start long, n_tokens long, ids_crc32 long")


def _times(matrix: tuple[int, ...], vector: int) -> int:
    out, k = 0, 0
    while vector:
        if vector & 1:
            out ^= matrix[k]
        vector, k = vector >> 1, k + 1
    return out


@lru_cache(maxsize=64)
def _doubled(turns: int) -> tuple[int, ...]:
    """What 2 ** turns zero bits do to a crc32 register, as a matrix over the two-element field."""
    if not turns:
        return (0xEDB88320, *(1 << k for k in range(31)))
    half = _doubled(turns - 1)
    return tuple(_times(half, column) for column in half)


@lru_cache(maxsize=8192)
def _zeros(size: int) -> tuple[int, ...]:
    """What ``size`` zero bytes do to the register."""
    matrix = tuple(1 << k for k in range(32))
    bits, turn = 8 * size, 0
    while bits:
        if bits & 1:
            matrix = tuple(_times(_doubled(turn), column) for column in matrix)
        bits, turn = bits >> 1, turn + 1
    return matrix


def crc32_combined(parts: list[tuple[int, int]]) -> int:
    """crc32 of a whole from (crc32, length in bytes) of its parts: that of a then b is a's moved on by b's length, xor b's."""
    total = 0
    for crc, size in parts:
        total = _times(_zeros(size), total) ^ crc if total else crc
    return total
