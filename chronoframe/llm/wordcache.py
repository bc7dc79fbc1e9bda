"""Token ids by whole segments: the tokenizers library sees each distinct segment once in a task.

A segment is a stretch of text at whose ends the tokenizer always cuts, so that the ids of a
text are the ids of its segments in order. Ids of seen segments lie in one flat array, and a
batch of texts is encoded by gathering from it; only new segments go through the library.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Segments and ids that one Python worker remembers before it starts afresh: bounds its memory (about 120 MB).
MOST_SEGMENTS, MOST_IDS = 450_000, 4_000_000


class _Numbering(dict):
    """segment -> number; a new segment gets the next number and is put on ``new``."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list[bytes] = []

    def __missing__(self, segment: bytes) -> int:
        self[segment] = number = len(self)
        self.new.append(segment)
        return number


class SegmentEncoder:
    """``encode_new`` gives the ids of a list of segments (None for one at which texts can't be cut)."""

    def __init__(self, encode_new: Callable[[list[bytes]], list[list[int] | None]]):
        self.encode_new = encode_new
        self._fresh()

    def _fresh(self) -> None:
        self.number = _Numbering()
        self.flat = np.zeros(1 << 16, np.int32)
        self.used = 0
        self.first = np.zeros(1 << 12, np.int64)
        self.count = np.zeros(1 << 12, np.int64)  # -1: texts can't be cut here

    def _learn(self) -> None:
        new, self.number.new = self.number.new, []
        ids = self.encode_new(new)
        size = np.array([-1 if x is None else len(x) for x in ids], np.int64)
        added = np.maximum(size, 0)
        total, n = int(added.sum()), len(self.number)
        while self.used + total > len(self.flat):
            self.flat = np.concatenate((self.flat, np.zeros_like(self.flat)))
        while n > len(self.first):
            self.first, self.count = (np.concatenate((x, np.zeros_like(x))) for x in (self.first, self.count))
        self.flat[self.used : self.used + total] = np.array(list(chain.from_iterable(x or () for x in ids)), np.int32)
        self.first[n - len(new) : n] = self.used + np.cumsum(added) - added
        self.count[n - len(new) : n] = size
        self.used += total

    def encode(self, distinct: list[bytes], index: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[int]]:
        """Ids of texts whose segments are ``distinct[index]``, from ``bound[k]`` to ``bound[k + 1]`` for text k.

        (all ids, ids of each text, texts that hold a segment which can't be cut; those have no ids here.)
        """
        if len(self.number) > MOST_SEGMENTS or self.used > MOST_IDS:
            self._fresh()
        numbers = np.array(list(map(self.number.__getitem__, distinct)), np.int64)
        if self.number.new:
            self._learn()
        at = numbers[index]
        count = self.count[at]
        bad: list[int] = []
        if (count < 0).any():
            bad = np.unique(np.searchsorted(bound, np.flatnonzero(count < 0), side="right") - 1).tolist()
            for i in bad:
                count[bound[i] : bound[i + 1]] = 0
        ends = np.cumsum(count)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.flat[np.repeat(self.first[at] - (ends - count), count) + np.arange(total)]
        upto = np.concatenate(([0], ends))[bound]
        return ids, np.diff(upto), bad


def segments_of(lists: pa.ListArray) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """(distinct values, index of each value, bounds of the lists) of an array of lists of strings."""
    bound = np.concatenate(([0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False)))).astype(np.int64)
    coded = lists.flatten().dictionary_encode()
    return coded.dictionary.cast(pa.binary()).to_pylist(), coded.indices.to_numpy(), bound


def splice(ids: np.ndarray, sizes: np.ndarray, instead: dict[int, list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Puts the ids of the texts in ``instead`` in their places."""
    if not instead:
        return ids, sizes
    ends = np.cumsum(sizes)
    parts, at = [], 0
    sizes = sizes.copy()
    for i in sorted(instead):
        parts += [ids[at : ends[i]], np.array(instead[i], np.int32)]
        at, sizes[i] = ends[i], len(instead[i])
    return np.concatenate([*parts, ids[at:]]), sizes


def byte_table() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies.

    Fixed rule: printable bytes of Latin-1 stand for themselves, the others take the code
    points from 256 on in ascending order.
    """
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table = {b: chr(b) for b in plain}
    for n, b in enumerate(b for b in range(256) if b not in table):
        table[b] = chr(256 + n)
    return table
