"""Pieces that several operators of this subpackage share.

* ``Scratch``: written tables in the cluster's shared folder (lineage cuts).
* ``hot_aware_join``: a join against a unique side that survives hot keys.
* ``ordinal_starts``: two-pass prefix sums over partitions.
* batch helpers: bounded slices of Arrow text batches, code points, word hashes.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters handled at once inside a task: bounds the numpy temporaries (about 100 bytes a character).
SLICE_CHARS = 400_000
#: Texts handled at once at most: bounds the numpy tables with a row for each text.
SLICE_ROWS = 1000
#: A key is hot when it holds more than one row in HOT_SHARE; so there are at most HOT_SHARE hot keys.
HOT_SHARE = 1000


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder that the session names in spark.checkpoint.dir.

    Where none is named, a folder of this machine will do if all of Spark runs on it (a local master, as in
    tests); on a cluster that is an error, for executors would write to disks that others can't read.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("chronoframe.scratch", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        import tempfile

        root = "file://" + tempfile.mkdtemp(prefix="chronoframe-")
        spark.conf.set("chronoframe.scratch", root)
    return root.rstrip("/")


_SCOPES: list[list[Scratch]] = []


@contextmanager
def passing() -> Iterator[None]:
    """Removes, at its end, all scratch tables that were begun inside: for steps whose result has been written by then."""
    _SCOPES.append([])
    try:
        yield
    finally:
        for scratch in _SCOPES.pop():
            scratch.drop()


class Scratch:
    """Written tables of one query under the shared checkpoint folder.

    ``keep(df, name)`` runs ``df`` once, writes it as Parquet and returns a reader of the
    files: later jobs neither repeat the work nor depend on executors that may be lost. ``drop`` removes what
    nothing will read any more; the rest goes when the application ends.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{checkpoint_root(spark)}/tables-{uuid.uuid4().hex}"
        self._files(self.root, "mkdirs")
        self._files(self.root, "deleteOnExit")
        if _SCOPES:
            _SCOPES[-1].append(self)

    def _files(self, path: str, what: str, *more: bool) -> None:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        getattr(at.getFileSystem(self.spark._jsc.hadoopConfiguration()), what)(at, *more)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        """Removes the tables named, or all."""
        for path in map(self.path, names) if names else [self.root]:
            self._files(path, "delete", True)


def in_fold(key: Column, modulus: int, rest: int) -> Column:
    """True where crc32 of the key's decimal text leaves ``rest``; a null key is in no fold."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % modulus == rest, F.lit(False))


def text_hash() -> list[Column]:
    """128 bits of the text, as two columns: one seed is not the other's."""
    return [F.xxhash64("text").alias("t1"), F.xxhash64(F.lit("second"), "text").alias("t2")]


def bounded_sample(rows: DataFrame, label: str, key: list[str], most: int, total: int | None = None) -> DataFrame:
    """About ``most`` different rows of each label value and ``total`` together (all where there are fewer), chosen by a hash of ``key``.

    ``key`` names the columns that tell rows apart. The share is computed from the label counts (one aggregated
    row for each label), so the choice is repeatable, needs no sort, and is the same for every partitioning. Rows
    that repeat label and key are one. A label may get a few more rows than ``most``; it never gets more than
    twice as many but by a freak of the hash.
    """
    counts = {r[0]: r[1] for r in rows.groupBy(label).count().collect()}
    most = most if total is None else max(1, min(most, total // max(1, len(counts))))
    share = F.lit(0.0)
    for value, n in counts.items():
        share = F.when(F.col(label) == F.lit(value), F.lit(min(1.0, most / n))).otherwise(share)
    unit = F.pmod(F.xxhash64(*key, F.lit("bounded sample")), F.lit(1 << 24)) / F.lit(float(1 << 24))
    return rows.filter(unit < share).dropDuplicates([label, *key])


def sampled(docs: DataFrame, labels: DataFrame, key: str, label: str, most: int) -> DataFrame:
    """(text, label) of a bounded sample of the labelled keys; a key with one label twice counts once, null keys don't."""
    rows = labels.select(F.col(key).alias("key_"), F.col(label).cast("int").alias("label")).filter("label in (0, 1) and key_ is not null")
    chosen = F.broadcast(bounded_sample(rows, "label", ["key_"], most))
    return docs.select(F.col(key).alias("key_"), "text").join(chosen, "key_").dropDuplicates(["key_", "label", "text"]).select("text", "label")


def hot_aware_join(rows: DataFrame, unique: DataFrame, key: str | list[str], count: str, total: int, how: str = "inner", wide: bool = False) -> DataFrame:
    """Join (``how``: inner or left) of ``rows`` with ``unique`` (one row a key, ``count`` = its rows in ``rows``).

    Keys with more than ``total / HOT_SHARE`` rows number at most HOT_SHARE: they are broadcast
    and joined where their rows lie. The others, none of which can swamp a task, are shuffled; where ``wide``, however
    small ``unique`` may be, for what it holds has no bound.
    """
    most = max(1, total // HOT_SHARE)
    hot, cold = unique.filter(F.col(count) > most), unique.filter(F.col(count) <= most)
    keys = [key] if isinstance(key, str) else key
    cold = cold.hint("merge") if wide else cold
    near = rows.join(F.broadcast(hot), keys)
    far = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(cold, keys, how)
    return near.unionByName(far)


def ordinal_starts(kept: DataFrame, part: str, local: str, size: str, start: str) -> DataFrame:
    """Second pass of the prefix sums: adds to each row's ``local`` sum what all earlier partitions hold.

    ``kept`` is a written table whose rows carry their partition's number and the running sum
    within it. The totals are one row for each partition, so their cumulative sum is small.
    """
    totals = sorted((r[0], r[1]) for r in kept.groupBy(part).agg(F.sum(size)).collect())
    base, run = [], 0
    for number, total in totals:
        base.append((number, run))
        run += total
    bases = kept.sparkSession.createDataFrame(base, f"{part} int, base_ long")
    return kept.join(F.broadcast(bases), part).withColumn(start, F.col("base_") + F.col(local)).drop("base_")


def slices(texts: pa.Array, most: int = SLICE_CHARS) -> Iterator[tuple[int, int]]:
    """Bounds of consecutive runs of texts with about ``most`` bytes and SLICE_ROWS texts each at most (one text at least)."""
    n = len(texts)
    size = np.asarray(pc.fill_null(pc.binary_length(texts), 0), np.int64)
    ends = np.cumsum(size)
    at = 0
    while at < n:
        done = ends[at - 1] if at else 0
        to = min(max(at + 1, int(np.searchsorted(ends, done + most, side="right"))), at + SLICE_ROWS)
        yield at, to
        at = to


def text_slices(batches: Iterator[pa.RecordBatch], most: int = SLICE_CHARS) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of (any, text, ...) batches with their texts; a null text counts as empty."""
    for batch in batches:
        column = batch.column("text")
        for at, to in slices(column, most):
            part = batch.slice(at, to - at)
            yield part, [t or "" for t in part.column("text").to_pylist()]


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All texts' code points, each text followed by a line feed, and the bounds of the texts (len + 1)."""
    joined = "\n".join(texts) + "\n" if texts else ""
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    bounds = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=bounds[1:])
    return codes, bounds


def _letter_table() -> np.ndarray:
    table = np.zeros(0x110000, np.uint8)
    for c in range(0x30000):
        ch = chr(c)
        table[c] = 1 if ch.isalpha() else 2 if ch.isdigit() else 3 if ch.isspace() else 0
    table[0x30000:0x40000] = 1
    return table


_TABLES: dict[str, np.ndarray] = {}


def kinds(codes: np.ndarray) -> np.ndarray:
    """1 letter, 2 digit, 3 white space, 0 other."""
    if "kind" not in _TABLES:
        _TABLES["kind"] = _letter_table()
    return _TABLES["kind"][codes]


_MULT = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.cumprod(np.full(64, np.uint64(0x100000001B3), np.uint64), dtype=np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply)."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x7FB5D329728EA185)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def word_runs(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true values."""
    edge = np.diff(np.concatenate(([0], inside.view(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def run_hashes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the code points of each run (polynomial in the place within the run, then mixed)."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    length = ends - starts
    total = int(length.sum())
    first = np.cumsum(length) - length
    place = np.arange(total) - np.repeat(first, length)
    at = place + np.repeat(starts, length)
    turns = (place >> 6).astype(np.uint64)
    value = mix(codes[at].astype(np.uint64) * _MULT + turns) * _POWERS[place & 63]
    return mix(np.add.reduceat(value, first) + length.astype(np.uint64))
