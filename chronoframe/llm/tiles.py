"""Comparisons within groups of any size, cut into tiles so that no task holds more than two of them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoframe.llm.common import hot_aware_join


def tiled(rows: DataFrame, sizes: DataFrame, keys: list[str], id_: str, tile: int, total: int) -> DataFrame:
    """``rows`` of the groups in ``sizes`` (keys, n), dealt to pairs of tiles (tile <= other).

    A group of n rows has ceil(n / tile) tiles by a hash of ``id_``, and each row goes to the pairs
    that its tile is in: once in a group of one tile. ``left`` tells a pair's rows of its first tile. ``total`` are
    the rows in all: those of a large group are dealt where they lie.
    """
    count = F.ceil(F.col("n") / F.lit(float(tile))).cast("int")
    own = F.pmod(F.xxhash64(F.col(id_), F.lit("tile")), count).cast("int")
    dealt = hot_aware_join(rows, sizes.select(*keys, "n"), keys, "n", total).withColumn("own_", own).withColumn("met_", F.explode(F.sequence(F.lit(0), count - 1)))
    return dealt.withColumns(
        {"tile": F.least("own_", "met_"), "other": F.greatest("own_", "met_"), "left": F.col("own_") <= F.col("met_")}
    ).drop("own_", "met_", "n")


def grouped(
    rows: DataFrame, keys: list[str], payload: dict[str, str], run: Callable[[dict[str, np.ndarray], bool], Iterator[tuple]], schema: str
) -> DataFrame:
    """``run(group, cross)`` on each pair of tiles; group has id, left and the payload columns as arrays.

    Groups are found in sorted partitions as they stream by, which is much cheaper than a call of
    Spark's for each of very many small ones. ``run`` yields tuples of equally long integer arrays.
    """
    names = [f.strip().split(" ")[0] for f in schema.split(",")]
    chosen = list(dict.fromkeys([*keys, "id", "left", *payload]))

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        out: list[tuple] = []

        def flush() -> Iterator[pa.RecordBatch]:
            if out:
                yield pa.record_batch([pa.array(np.concatenate([np.asarray(o[k]) for o in out]), pa.int64()) for k in range(len(names))], names=names)
                out.clear()

        def work(table: pa.Table) -> None:
            group = {c: table.column(c).to_numpy() for c in ("id", "left", *payload)}
            cross = bool(table.column("tile")[0].as_py() != table.column("other")[0].as_py())
            out.extend(run(group, cross))

        for batch in batches:
            table = pa.Table.from_batches([batch])
            if held is not None:
                table = pa.concat_tables([held, table]).combine_chunks()
            if not len(table):
                continue
            change = np.zeros(len(table) - 1, bool)
            for k in keys:
                v = table.column(k).to_numpy()
                change |= v[1:] != v[:-1]
            bounds = np.concatenate(([0], np.flatnonzero(change) + 1, [len(table)])).tolist()
            for at, to in zip(bounds[:-2], bounds[1:-1], strict=True):
                if to - at > 1:
                    work(table.slice(at, to - at))
                    if len(out) > 2000:
                        yield from flush()
            held = table.slice(bounds[-2])
            yield from flush()
        if held is not None and len(held) > 1:
            work(held)
            yield from flush()

    return rows.select(*chosen).repartition(*keys).sortWithinPartitions(*keys).mapInArrow(stream, schema)


def forest(n: int, left: np.ndarray | None, near: Callable[[np.ndarray, np.ndarray], np.ndarray], block: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning edges of the graph whose adjacency ``near(rows, columns)`` tells block by block.

    Without ``left`` all pairs of the n rows are looked at (a block with itself gets the same array
    twice), with it the pairs of a left row and another.
    """
    if left is None:
        parts = [np.arange(at, min(n, at + block)) for at in range(0, n, block)]
        todo = [(a, b) for i, a in enumerate(parts) for b in parts[i:]]
    else:
        rows, columns = np.flatnonzero(left), np.flatnonzero(~left)
        todo = [(rows[i : i + block], columns[j : j + block]) for i in range(0, len(rows), block) for j in range(0, len(columns), block)]
    label = np.arange(n)
    ends: list[tuple[int, int]] = []
    for rows, columns in todo:
        hit = near(rows, columns)
        for r in np.flatnonzero(hit.any(axis=1)).tolist():
            row = rows[r]
            found = columns[hit[r]]
            found = found[label[found] != label[row]]
            while len(found):
                ends.append((int(row), int(found[0])))
                label[label == label[found[0]]] = label[row]
                found = found[label[found] != label[row]]
    a = np.array([e[0] for e in ends], np.int64)
    return a, np.array([e[1] for e in ends], np.int64)
