"""Byte-level BPE from a rank file with the tokenizers library: encoding, offsets and decoding.

A rank file lists byte strings by merge rank and no merges. The merge that makes a token is found by
merging the token's own bytes with the lower ranks only, until two parts are left. Pieces that are tokens
themselves are taken whole. Together these give the ids that the rank file's own library gives.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from chronoframe.llm.common import slices
from chronoframe.llm.wordcache import SegmentEncoder, byte_table, segments_of, splice

RANK_FILE = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")

#: A segment of Latin letters and then ASCII signs (no apostrophe): two pieces of the pattern.
_SIMPLE = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")


def read_ranks(file: str) -> dict[bytes, int]:
    with open(file, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def merge_of(token: bytes, rank: int, ranks: dict[bytes, int]) -> tuple[bytes, bytes] | None:
    """The two parts whose merge makes ``token``; None if merging by lower ranks leaves more than two."""
    parts = [token[i : i + 1] for i in range(len(token))]
    while len(parts) > 2:
        low, at = min(((ranks.get(a + b, rank), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False))), default=(rank, 0))
        if low >= rank:
            return None
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return (parts[0], parts[1]) if len(parts) == 2 else None


class ByteBpe:
    """Encoder and decoder of one rank file."""

    def __init__(self, file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Regex, Tokenizer, models, pre_tokenizers

        ranks = read_ranks(file)
        char = byte_table()
        spell = lambda token: "".join(char[b] for b in token)
        merges = (merge_of(t, r, ranks) for t, r in sorted(ranks.items(), key=lambda x: x[1]) if len(t) > 1)
        self.tokenizer = Tokenizer(
            models.BPE(vocab={spell(t): r for t, r in ranks.items()}, merges=[(spell(a), spell(b)) for a, b in filter(None, merges)], ignore_merges=True)
        )
        self.tokenizer.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.Split(Regex(public_tokenizers.PATTERN), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
        )
        # Decoding: the vocabulary's characters back to bytes.
        back = {c: b for b, c in char.items()}
        vocabulary = self.tokenizer.get_vocab()
        self.token_bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.token_bytes[i] = bytes(back[c] for c in token)
        self.token_size = np.array([len(t) for t in self.token_bytes], np.int64)
        self.flat = np.frombuffer(b"".join(self.token_bytes), np.uint8)
        self.first = np.cumsum(self.token_size) - self.token_size
        self.to_chars = {chr(c): spell(chr(c).encode()) for c in range(32, 256)}
        self.segments = SegmentEncoder(self._new)

    def _piece(self, piece: str) -> list[int]:
        return [t.id for t in self.tokenizer.model.tokenize("".join(map(self.to_chars.__getitem__, piece)))]

    def _new(self, segments: list[bytes]) -> list[list[int] | None]:
        """A segment has lost the space before it; a text's first one has none and is marked by a space."""
        out: list[list[int] | None] = [None] * len(segments)
        rest: list[tuple[int, str]] = []
        for k, segment in enumerate(segments):
            first = segment[:1] == b" "
            word = segment[first:].decode("utf-8")
            if first and not word:  # an empty text
                out[k] = []
                continue
            if simple := _SIMPLE.fullmatch(word):
                letters, signs = simple.groups()
                out[k] = self._piece(letters if first else f" {letters}") + (self._piece(signs) if signs else [])
            elif word and not word[-1].isspace() and (first or not word[0].isspace()):
                rest.append((k, word if first else f" {word}"))
        if rest:
            for (k, _), found in zip(rest, self.tokenizer.encode_batch_fast([w for _, w in rest], add_special_tokens=False), strict=True):
                out[k] = found.ids
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(all ids in order, how many each text has) of an array of strings without nulls.

        A single space between two other characters always starts a piece, so texts are cut there;
        texts with longer white space go to the library whole.
        """
        lists = pc.split_pattern(texts, " ")
        distinct, index, bound = segments_of(lists)
        filled = np.flatnonzero(pc.binary_length(texts).to_numpy(zero_copy_only=False) > 0)
        # The first segment of a text has no space before it: it gets a number of its own.
        first = [b" " + distinct[k] for k in index[bound[filled]].tolist()]
        index = index.astype(np.int64)
        index[bound[filled]] = len(distinct) + np.arange(len(filled))
        empty = np.setdiff1d(np.arange(len(texts)), filled)
        index[bound[empty]] = len(distinct) + len(first)
        ids, sizes, whole = self.segments.encode([*distinct, *first, b" "], index, bound)
        if whole:
            found = self.tokenizer.encode_batch_fast(texts.take(pa.array(whole)).to_pylist(), add_special_tokens=False)
            ids, sizes = splice(ids, sizes, {k: f.ids for k, f in zip(whole, found, strict=True)})
        return ids, sizes

    def decode(self, ids: np.ndarray | list[int]) -> bytes:
        """The bytes of all tokens in order, gathered from the byte table in bounded blocks."""
        ids, parts = np.asarray(ids, np.int64), []
        for at in range(0, len(ids), 100_000):
            some = ids[at : at + 100_000]
            size = self.token_size[some]
            before = np.cumsum(size) - size
            parts.append(self.flat[np.repeat(self.first[some] - before, size) + np.arange(int(size.sum()))].tobytes())
        return b"".join(parts)

    def offsets(self, text: bytes, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first character, end character) of each token; a character that is split lies in each of its tokens."""
        ends = np.cumsum(self.token_size[ids])
        character = np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80) - 1
        if not len(ids):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return character[ends - self.token_size[ids]], character[ends - 1] + 1


@cache
def byte_bpe(file: str) -> ByteBpe:
    return ByteBpe(file)


def _lists(sizes: np.ndarray, values: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), pa.array(values, pa.int32()))


def encode(docs: DataFrame, key: str = "doc_id", file: str = RANK_FILE, offsets: bool = False) -> DataFrame:
    """(key, ids) of every whole text, and with ``offsets`` each token's char_start and char_end.

    A null or empty text has an empty list. Rows are kept as they are, repeated and null keys too;
    other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(file)
        for batch in batches:
            column = pc.fill_null(batch.column("text"), "")
            for at, to in slices(column):
                ids, sizes = bpe.encode(column.slice(at, to - at))
                out = [batch.column(0).slice(at, to - at), _lists(sizes, ids)]
                if offsets:
                    ends = np.cumsum(sizes)
                    texts = column.slice(at, to - at).cast(pa.binary()).to_pylist()
                    spans = [bpe.offsets(t, ids[e - n : e]) for t, e, n in zip(texts, ends, sizes, strict=True)]
                    out += [_lists(sizes, np.concatenate([s[k] for s in spans])) for k in (0, 1)]
                yield pa.record_batch(out, names=[key, "ids", "char_start", "char_end"][: len(out)])

    kind = docs.schema[key].dataType.simpleString()
    more = ", char_start array<int>, char_end array<int>" if offsets else ""
    return docs.select(key, "text").mapInArrow(run, f"`{key}` {kind}, ids array<int>{more}")


def decode(encoded: DataFrame, key: str = "doc_id", file: str = RANK_FILE) -> DataFrame:
    """(key, ids, decoded): the bytes that the ids stand for.

    The bytes of a document are joined before anything reads them as text, so that characters
    split over tokens come back whole: ``decoded.cast("string")`` is the text. Null ids give null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(file)
        for batch in batches:
            for at in range(0, len(batch), 500):
                part = batch.slice(at, 500)
                lists = part.column(1)
                ids = lists.flatten().to_numpy()
                count = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
                ends = np.concatenate(([0], np.cumsum(bpe.token_size[ids])))[np.concatenate(([0], np.cumsum(count)))].tolist()
                data, given = bpe.decode(ids), lists.is_valid().to_pylist()
                out = [data[a:b] if there else None for a, b, there in zip(ends[:-1], ends[1:], given, strict=True)]
                yield pa.record_batch([part.column(0), part.column(1), pa.array(out, pa.binary())], names=[key, "ids", "decoded"])

    kind = encoded.schema[key].dataType.simpleString()
    return encoded.select(key, "ids").mapInArrow(run, f"`{key}` {kind}, ids array<int>, decoded binary")
