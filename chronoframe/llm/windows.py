"""Removal of repeated windows of words, with count-min sketches before the exact grouping.

A window is ``width`` consecutive words of a document. A word goes where a window that covers it has the same words as one
that starts in a document with a smaller key.

*Parts.* Texts are written once, bucketed by the part that they lie in (some thousand neighbouring rows), and never shuffled: what moves
between parts are sketches, hashes and answers, and every step reads a part's texts where they are.
*Sketches.* Each part counts its windows in a count-min sketch of two rows of cells. A sketch is kept sparse (the gaps between its cells, and the cells it
holds twice) and cut into blocks of neighbouring cells; equal blocks meet and are added up. The cells grow with the
text, the blocks with neither. Each part gets back which of its cells hold two or more in all. A window's estimate is its least count, never below
the true one: a window estimated once is in one document, and is done with.
*Exact grouping.* Each part sends every window estimated repeated once, as 128 bits, with the smallest key that has it there.
Blocks of these meet, and each part hears which of its windows start in an earlier document of another part. Within a part the same is plain.
A window that very many documents share is one entry a part.

Both exchanges are bounded: a group holds a block of cells or hashes, each part's entries once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronoframe.llm.common import SLICE_CHARS, Scratch, mix, passing, run_hashes, slices

WIDTH = 13
#: Rows of a part: two to this power at most.
PART_BITS = 12
#: Cells of a block: two to this power, more where there would be over 2 ** BLOCKS of them.
BLOCK_BITS, BLOCKS = 22, 17
ROWS = 2
_NULL = np.iinfo(np.int64).min
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_FACTORS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The texts' bytes, starts and ends of all words in them, and the first word of each text (len + 1)."""
    bounds = np.frombuffer(texts.buffers()[1], np.int32 if pa.types.is_string(texts.type) else np.int64)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    held = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]] if data is not None else np.zeros(0, np.uint8)
    bounds = bounds - bounds[0]
    inside = ~_SPACE[held]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    # Where two texts meet, a word of each.
    edges = bounds[(bounds > 0) & (bounds < len(held))]
    first[edges] = inside[edges]
    last[edges - 1] = inside[edges - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return held, starts, ends, np.searchsorted(starts, bounds)


def _places(bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The text of every window, and its first word's place among all words."""
    count = np.maximum(np.diff(bounds) - width + 1, 0)
    before = np.cumsum(count) - count
    return np.repeat(np.arange(len(count)), count), np.arange(int(count.sum())) - np.repeat(before - bounds[:-1], count)


def windows(texts: pa.Array, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """128 bits of every window, the text it is of, and its first word's place among all words."""
    held, starts, ends, bounds = words(texts)
    word = run_hashes(held, starts, ends)
    text, place = _places(bounds, width)
    out = np.zeros((2, len(place)), np.uint64)
    for k, factor in enumerate(_FACTORS):
        rolled = np.zeros(max(0, len(word) - width + 1), np.uint64)
        for i in range(width):
            rolled = rolled * factor + word[i : i + len(rolled)]
        out[k] = mix(rolled[place])
    return out, text, place


def _packed(ascending: np.ndarray) -> bytes:
    """Ascending whole numbers as gaps, of two bytes each where all fit."""
    gaps = np.diff(ascending.astype(np.int64), prepend=0)
    return b"2" + gaps.astype(np.uint16).tobytes() if not len(gaps) or gaps.max() < 1 << 16 else b"8" + gaps.astype(np.int64).tobytes()


def _unpacked(held: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(held, np.uint16 if held[:1] == b"2" else np.int64, offset=1), dtype=np.int64)


def _cells(hashes: np.ndarray, bits: int) -> np.ndarray:
    """The cell of each window in each row of the sketch."""
    return (hashes >> np.uint64(64 - bits)).astype(np.int64)


def _blocks(values: np.ndarray, shift: int) -> Iterator[tuple[int, int, int]]:
    """(block, from, to) of ascending values."""
    block = values >> shift
    at = np.flatnonzero(np.diff(block, prepend=-1))
    yield from zip(block[at].tolist(), at.tolist(), [*at[1:].tolist(), len(values)][: len(at)], strict=True)


def _of_part(texts: pa.ChunkedArray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """All windows of a part, and the row each is of; texts are taken in slices."""
    hashes, rows, at = [np.zeros((2, 0), np.uint64)], [np.zeros(0, np.int64)], 0
    for chunk in texts.chunks:
        for a, b in slices(chunk, SLICE_CHARS):
            h, text, _ = windows(chunk.slice(a, b - a), width)
            hashes.append(h)
            rows.append(text + at + a)
        at += len(chunk)
    return np.concatenate(hashes, axis=1), np.concatenate(rows)


def _distinct(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that sorts windows, and where in it new ones begin."""
    order = np.lexsort((hashes[1], hashes[0]))
    h = hashes[:, order]
    new = np.ones(len(order), bool)
    new[1:] = (h[:, 1:] != h[:, :-1]).any(axis=0)
    return order, np.flatnonzero(new)


def _keys(table: pa.Table) -> np.ndarray:
    return table.column("key_").to_numpy()


def _table(rows: list[tuple], schema: T.StructType) -> pa.Table:
    from pyspark.sql.pandas.types import to_arrow_schema

    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in schema]
    arrow = to_arrow_schema(schema)
    return pa.table([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)


def _schema(*names: str, numbers: tuple[str, ...] = ("block", "part_")) -> T.StructType:
    return T.StructType([T.StructField(n, T.LongType() if n in numbers else T.BinaryType()) for n in names])


_SKETCH = _schema("block", "part_", "cells", "twice")
_HOT = _schema("part_", "block", "cells")
_ASKED = _schema("block", "part_", "low", "high", "key", "place")
_TOLD = _schema("part_", "places")


def _sketches(bits: int, shift: int, width: int) -> Callable[[pa.Table], pa.Table]:
    def run(part: pa.Table) -> pa.Table:
        out, number = [], part.column("part_")[0].as_py()
        hashes, _ = _of_part(part.column("text_"), width)
        for row in range(ROWS):
            cells, count = np.unique(_cells(hashes[row], bits), return_counts=True)
            for block, a, b in _blocks(cells, shift):
                own = cells[a:b] - (block << shift)
                out.append((block * ROWS + row, number, _packed(own), _packed(own[count[a:b] > 1])))
        return _table(out, _SKETCH)

    return run


def _merged(sketches: pa.Table) -> pa.Table:
    """Which cells of each part hold two or more in all parts' sketches together."""
    cells = [_unpacked(c) for c in sketches.column("cells").to_pylist()]
    every = [*cells, *(_unpacked(c) for c in sketches.column("twice").to_pylist())]
    value, count = np.unique(np.concatenate(every), return_counts=True)
    full, block = value[count > 1], sketches.column("block")[0].as_py()
    parts = sketches.column("part_").to_pylist()
    out = [(p, block, _packed(c[np.isin(c, full, assume_unique=True)])) for p, c in zip(parts, cells, strict=True)]
    return _table([r for r in out if len(r[2]) > 1], _HOT)


def _questions(bits: int, shift: int, asked: int, width: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(hot: pa.Table, part: pa.Table) -> pa.Table:
        if not len(part):
            return _table([], _ASKED)
        number, keys = part.column("part_")[0].as_py(), _keys(part)
        hashes, rows = _of_part(part.column("text_"), width)
        order, new = _distinct(hashes)
        least = np.minimum.reduceat(keys[rows[order]], new) if len(new) else np.zeros(0, np.int64)
        once = hashes[:, order[new]]
        maybe = np.ones(len(new), bool)
        for row in range(ROWS):
            full = [_unpacked(c) + (b // ROWS << shift) for b, c in zip(hot.column("block").to_pylist(), hot.column("cells").to_pylist(), strict=True) if b % ROWS == row]
            maybe &= np.isin(_cells(once[row], bits), np.concatenate(full) if full else np.zeros(0, np.int64))
        chosen = np.flatnonzero(maybe)
        block = _cells(once[0, chosen], asked)
        out = []
        for b, a, z in _blocks(block, 0):
            at = chosen[a:z]
            out.append((b, number, once[0, at].tobytes(), once[1, at].tobytes(), least[at].astype(np.int64).tobytes(), at.astype(np.int64).tobytes()))
        return _table(out, _ASKED)

    return run


def _answers(questions: pa.Table) -> pa.Table:
    """The places of each part's windows that start in an earlier document of another part."""
    low, high, key, place = (
        [np.frombuffer(x, np.int64 if c in ("key", "place") else np.uint64) for x in questions.column(c).to_pylist()] for c in ("low", "high", "key", "place")
    )
    part = np.repeat(np.arange(len(low)), [len(x) for x in low])
    order, new = _distinct(np.stack([np.concatenate(low), np.concatenate(high)]))
    keys = np.concatenate(key)
    least = np.empty(len(order), np.int64)
    least[order] = np.repeat(np.minimum.reduceat(keys[order], new), np.diff(new, append=len(order)))
    later = np.flatnonzero(keys > least)
    places, numbers = np.concatenate(place), questions.column("part_").to_pylist()
    out, bounds = [], np.searchsorted(part[later], np.arange(len(low) + 1))
    for k, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
        if b > a:
            out.append((numbers[k], _packed(places[later[a:b]])))
    return _table(out, _TOLD)


def _cut(schema: T.StructType, width: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def run(told: pa.Table, part: pa.Table) -> pa.Table:
        if not len(part):
            return pa.table([pa.array([], f.type) for f in arrow], schema=arrow)
        keys = _keys(part)
        hashes, rows = _of_part(part.column("text_"), width)
        order, new = _distinct(hashes)
        gone = np.zeros(len(order), bool)
        if len(new):
            own = keys[rows[order]]
            size = np.diff(new, append=len(order))
            earlier = np.zeros(len(new), bool)
            for places in told.column("places").to_pylist():
                earlier[_unpacked(places)] = True
            gone[order] = (own > np.repeat(np.minimum.reduceat(own, new), size)) | np.repeat(earlier, size)
        texts, n_words, n_removed, done = [], [], [], 0
        for chunk in part.column("text_").chunks:
            for a, b in slices(chunk, SLICE_CHARS):
                held, starts, ends, bounds = words(chunk.slice(a, b - a))
                _, place = _places(bounds, width)
                hit = place[gone[done : done + len(place)]]
                done += len(place)
                edge = np.zeros(len(starts) + 1, np.int64)
                np.add.at(edge, hit, 1)
                np.add.at(edge, hit + width, -1)
                left = np.cumsum(edge[:-1]) == 0
                kept = np.concatenate(([0], np.cumsum(left)))[bounds]
                n_words.append(np.diff(bounds))
                n_removed.append(np.diff(bounds) - np.diff(kept))
                texts.append(_joined(held, starts[left], ends[left], kept))
        filled = {"text_": pa.concat_arrays(texts), "n_words": pa.array(np.concatenate(n_words)), "n_removed": pa.array(np.concatenate(n_removed))}
        return pa.table([filled[f.name] if f.name in filled else part.column(f.name) for f in arrow], schema=arrow)

    return run


def _joined(held: np.ndarray, starts: np.ndarray, ends: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Texts of words joined by one space: text k has words bounds[k] to bounds[k + 1]."""
    length = ends - starts + 1
    stop = np.concatenate(([0], np.cumsum(length)))
    total = int(stop[-1])
    out = np.full(total, 32, np.uint8)
    at = np.arange(total)
    source = at - np.repeat(stop[:-1] - starts, length)
    letter = at != np.repeat(stop[1:] - 1, length)
    out[letter] = held[source[letter]]
    # The space after a text's last word falls away.
    some = np.diff(bounds) > 0
    keep = np.ones(total, bool)
    keep[stop[bounds[1:][some]] - 1] = False
    sizes = np.concatenate(([0], np.cumsum(stop[bounds[1:]] - stop[bounds[:-1]] - some)))
    return pa.Array.from_buffers(pa.string(), len(bounds) - 1, [None, pa.py_buffer(sizes.astype(np.int32).tobytes()), pa.py_buffer(out[keep].tobytes())])


def _bucketed(rows: DataFrame, scratch: Scratch, name: str, number: int) -> DataFrame:
    """``rows`` written in buckets of ``part_``, so that grouping by it moves none of them."""
    table = f"{name}_{uuid4().hex}"
    rows.write.bucketBy(number, "part_").sortBy("part_").option("path", scratch.path(name)).format("parquet").saveAsTable(table)
    held = rows.sparkSession.table(table)
    held.schema  # noqa: B018  looked up now, for the entry of the catalogue goes; the files stay as long as the scratch folder does
    rows.sparkSession.sql(f"DROP TABLE {table}")
    return held


def dedup_windows(docs: DataFrame, key: str = "doc_id", width: int = WIDTH, part_bits: int = PART_BITS) -> DataFrame:
    """``docs`` with every repeated word removed from ``text``, and n_words and n_removed (of the input's words) added.

    Words are runs of bytes other than space and tab to carriage return; those kept are joined by one space. Windows are judged on the
    input. A null text has no words and stays null. ``key`` must be a whole number; null counts as the smallest, and
    rows of one key are one document: none of them is earlier than another. Columns n_words and n_removed of the input are replaced; all
    others are carried along.
    """
    if not isinstance(docs.schema[key].dataType, T.IntegralType):
        raise TypeError(f"column {key} must hold whole numbers")
    last = Scratch(docs.sparkSession)
    rest = [c for c in docs.columns if c not in ("text", "n_words", "n_removed")]
    with passing():
        scratch = Scratch(docs.sparkSession)
        rows = docs.select(
            F.struct(*rest, F.col("text").isNull().alias("null_")).alias("row"), F.coalesce(F.col(key).cast("long"), F.lit(_NULL)).alias("key_"), F.coalesce("text", F.lit("")).alias("text_"),
            F.shiftright(F.monotonically_increasing_id(), part_bits).alias("part_"),
        )
        number = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        held = _bucketed(rows, scratch, "texts", number)
        size = held.agg(F.sum(F.octet_length("text_"))).first()[0] or 0
        bits = max(8, int(size).bit_length())
        shift = max(min(bits, BLOCK_BITS), bits - BLOCKS)
        parts = held.select("part_", "key_", "text_")
        sketches = parts.select("part_", "text_").groupBy("part_").applyInArrow(_sketches(bits, shift, width), _SKETCH)
        hot = scratch.keep(sketches.groupBy("block").applyInArrow(_merged, _HOT), "hot")
        questions = hot.groupBy("part_").cogroup(parts.groupBy("part_")).applyInArrow(_questions(bits, shift, max(1, bits - shift), width), _ASKED)
        told = scratch.keep(questions.groupBy("block").applyInArrow(_answers, _TOLD), "told")
        scratch.drop("hot")
        schema = T.StructType([held.schema["row"], held.schema["text_"], T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType())])
        cut = told.groupBy("part_").cogroup(held.groupBy("part_")).applyInArrow(_cut(schema, width), schema)
        text = F.when(~F.col("row.null_"), F.col("text_"))
        out = cut.select(*(text.alias(c) if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns if c not in ("n_words", "n_removed")), "n_words", "n_removed")
        return last.keep(out, "cut")
