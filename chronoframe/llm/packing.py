"""Packing by concatenating all documents and cutting the stream into fixed windows.

First pass: each task encodes its documents and writes their ids with its own number and the
running token sum within it. Between the passes only one total for each task is added up.
Second pass: each document knows its place in the endless stream, so its pieces and the sequences
they lie in are arithmetic; no row is moved. A document across a window's edge gives one boundary
record in each window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from chronoframe.llm.common import Scratch, ordinal_starts
from chronoframe.llm.wordbpe import END_ID, WORD_FILE, encoded

WINDOW = 4096


def encode_numbered(docs: DataFrame, key: str, file: str, end: int | None, scratch: Scratch, name: str) -> DataFrame:
    """Written table (key, part_, local_, n_tokens, ids binary of little-endian uint32), in the order of ``docs``.

    part_ is the task's number, local_ the tokens before the row in that task. A task that is
    run again overwrites its whole file, so the numbers always fit the ids.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before = TaskContext.get().partitionId(), 0
        for rows, ids, sizes in encoded(batches, file, end):
            ends = np.cumsum(sizes)
            data = ids.astype("<u4").tobytes()
            yield pa.record_batch(
                [
                    rows.column(0),
                    pa.array(np.full(len(sizes), part, np.int32)),
                    pa.array(before + ends - sizes, pa.int64()),
                    pa.array(sizes, pa.int64()),
                    pa.array([data[4 * (e - n) : 4 * e] for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)], pa.binary()),
                ],
                names=[key, "part_", "local_", "n_tokens", "ids"],
            )
            before += int(ends[-1]) if len(ends) else 0

    kind = docs.schema[key].dataType.simpleString()
    return scratch.keep(docs.select(key, "text").mapInArrow(run, f"`{key}` {kind}, part_ int, local_ long, n_tokens long, ids binary"), name)


def pack(docs: DataFrame, key: str = "doc_id", window: int = WINDOW, file: str = WORD_FILE, end: int = END_ID) -> DataFrame:
    """Pieces of all documents: (key, piece, start, length, doc_tokens, sequence_id, offset, ids binary).

    ``ids`` are the piece's ids as little-endian uint32. Every id lies in exactly one piece;
    every sequence but the last is full, so there is no padding but at the very end. A null or
    empty text is one token (``end``). Rows keep their own pieces even where keys repeat or are
    null; an empty table has no pieces. Other columns are not read. The order of the documents is
    that in which the table is read.
    """
    scratch = Scratch(docs.sparkSession)
    kept = encode_numbered(docs, key, file, end, scratch, "packed-ids")
    placed = ordinal_starts(kept, "part_", "local_", "n_tokens", "begin_").select(key, "begin_", "n_tokens", "ids")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 500):
                part = batch.slice(at, 500)
                begin, size = (part.column(k).to_numpy(zero_copy_only=False) for k in (1, 2))
                pieces = (begin + size - 1) // window - begin // window + 1
                row = np.repeat(np.arange(len(part)), pieces)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                sequence = begin[row] // window + piece
                start = np.maximum(sequence * window - begin[row], 0)
                stop = np.minimum((sequence + 1) * window - begin[row], size[row])
                data = part.column(3).to_pylist()
                yield pa.record_batch(
                    [
                        part.column(0).take(pa.array(row)),
                        pa.array(piece.astype(np.int32)),
                        pa.array(start, pa.int64()),
                        pa.array(stop - start, pa.int64()),
                        pa.array(size[row], pa.int64()),
                        pa.array(sequence, pa.int64()),
                        pa.array(begin[row] + start - sequence * window, pa.int64()),
                        pa.array([data[r][4 * s : 4 * e] for r, s, e in zip(row.tolist(), start.tolist(), stop.tolist(), strict=True)], pa.binary()),
                    ],
                    names=[key, "piece", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"],
                )

    kind = docs.schema[key].dataType.simpleString()
    return placed.mapInArrow(cut, f"`{key}` {kind}, piece int, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary")

