"""Token ids of whole texts by a word-end BPE vocabulary file (lower case, white space dropped)."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc

from chronoframe.llm.common import slices
from chronoframe.llm.wordcache import SegmentEncoder, byte_table, segments_of, splice

#: The vocabulary file of the token-id operators; a parameter everywhere.
WORD_FILE = public_tokenizers.path("word_bpe_49k.json")
END_ID = 2

#: A segment of lower-case Latin letters, digits and ASCII signs, and its pieces by the vocabulary
#: file's own public pattern, narrowed to these characters. A fast path; other segments go through the library.
_SIMPLE = re.compile(r"[!-@\[-~ß-öø-ÿ]+")
_PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")


class WordEncoder:
    """Ids as ``Tokenizer.encode(text, add_special_tokens=False)`` gives them.

    Segments are the stretches between ASCII white space: the file's tokenizer drops white space and
    merges nothing across it. ASCII letters are lower-cased first, as the tokenizer does to all. A
    text with ``<|`` may hold a special token and goes to the library whole.
    """

    def __init__(self, file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(file)
        chars = byte_table()
        self.to_chars = {chr(c): "".join(chars[b] for b in chr(c).encode()) for c in range(33, 256)}
        self.stops = {ord(c): self._piece(c) for c in ".,;:!?"}
        self.segments = SegmentEncoder(self._new)

    def _piece(self, piece: str) -> list[int]:
        text = piece if piece.isascii() else "".join(map(self.to_chars.__getitem__, piece))
        return [t.id for t in self.tokenizer.model.tokenize(text)]

    def _new(self, segments: list[bytes]) -> list[list[int] | None]:
        out: list[list[int] | None] = []
        rest: list[tuple[int, str]] = []
        tokenize = self.tokenizer.model.tokenize
        for k, segment in enumerate(segments):
            if segment.isalpha():  # ASCII letters only: one piece
                out.append([t.id for t in tokenize(segment.decode("ascii"))])
                continue
            if not segment:
                out.append([])
                continue
            if segment[-1] in self.stops and segment[:-1].isalpha():  # a word and a stop: two pieces
                out.append([t.id for t in tokenize(segment[:-1].decode("ascii"))] + self.stops[segment[-1]])
                continue
            word = segment.decode("utf-8")
            if _SIMPLE.fullmatch(word):
                out.append([i for piece in _PIECE.findall(word) for i in self._piece(piece)])
            else:
                out.append(None)
                rest.append((k, word))
        if rest:
            for (k, _), found in zip(rest, self.tokenizer.encode_batch_fast([w for _, w in rest], add_special_tokens=False), strict=True):
                out[k] = found.ids
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(all ids in order, how many each text has) of an array of strings without nulls."""
        special = pc.match_substring(texts, "<|")
        lowered = pc.ascii_lower(pc.if_else(special, "", texts))
        ids, sizes, _ = self.segments.encode(*segments_of(pc.ascii_split_whitespace(lowered)))
        whole = np.flatnonzero(special.to_numpy(zero_copy_only=False)).tolist()
        return splice(ids, sizes, {k: self.tokenizer.encode(texts[k].as_py(), add_special_tokens=False).ids for k in whole})


@cache
def word_encoder(file: str = WORD_FILE) -> WordEncoder:
    return WordEncoder(file)


def encoded(batches: Iterator[pa.RecordBatch], file: str, end: int | None) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(slice, all its ids as int32, ids of each row), with ``end`` after each text; a null text counts as empty."""
    encoder = word_encoder(file)
    for batch in batches:
        column = pc.fill_null(batch.column("text"), "")
        for at, to in slices(column):
            part = batch.slice(at, to - at)
            ids, sizes = encoder.encode(column.slice(at, to - at))
            if end is not None:
                ids = np.insert(ids, np.cumsum(sizes), end).astype(np.int32)
                sizes = sizes + 1
            yield part, ids, sizes
