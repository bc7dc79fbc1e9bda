"""Toxicity scores from a learned lexicon, matched with misspellings, and the context of the matches.

The lexicon is learned: words and word beginnings that occur in toxic training texts after many
different words, and hardly in others, so much more often there that chance would not have it for a tenth of one
candidate; that rule alone bounds it. Texts that are copies of each other repeat their neighbours, so that
words of copied texts don't get in. Matches between quotation marks count apart from the others,
and so do the closest crowd of matches and their share of the words; a logistic model weighs them all.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice, takewhile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoframe.llm.automaton import Entry, LexiconAutomaton
from chronoframe.llm.common import code_points, kinds, sampled, text_slices, word_runs

#: Labelled rows of each label that lexicon and model are fitted on, at most (about): a documented bound.
SAMPLE_PER_LABEL = 3000
#: A lexicon entry is in this many toxic sample texts at least and in this share of the others at most, of its share of the toxic ones.
LEAST_TEXTS, MOST_CLEAN = 3, 0.02
#: False entries expected of all candidates, at most, if words fell into toxic and other texts by chance.
CHANCE = 0.1
#: Of an entry's toxic texts at least this share have different words before it.
LEAST_VARIETY = 0.5
#: Lengths of stems.
STEMS = (4, 5, 6)
#: A misspelling of an entry shorter than this counts for its own weight only, not as a match of any kind.
SURE_FROM = 5
#: Words that a crowd of matches spans; characters to the quotation marks around a match, at most.
CROWD, QUOTE = 12, 200
THRESHOLD = 0.7
STEPS, DECAY = 400, 2e-4

#: Quotation marks by what they do.
OPENING, CLOSING, EITHER = "“„«‹", "”»›", '"'
#: Signs that stand inside words for letters.
INSIDE = "@$*"


def words_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(code points, bounds of texts, starts and ends of words, limits of each text's words) of the lower-cased texts.

    Words are runs of letters and digits, and of masking signs where they stand between such; text that is written
    without spaces is one word up to its next mark.
    """
    codes, bounds = code_points([t.lower() for t in texts])
    kind = kinds(codes)
    inside = (kind == 1) | (kind == 2)
    first, last = word_runs(np.isin(codes, [ord(c) for c in INSIDE]))
    between = (first > 0) & (last < len(codes))
    first, last = first[between], last[between]
    between = inside[first - 1] & inside[last]
    level = np.zeros(len(codes) + 1, np.int8)
    level[first[between]], level[last[between]] = 1, -1
    starts, ends = word_runs(inside | (np.cumsum(level[:-1]) > 0))
    return codes, bounds, starts, ends, np.searchsorted(starts, bounds)


@dataclass
class ToxicityModel:
    automaton: LexiconAutomaton
    weights: np.ndarray
    bias: float

    @property
    def width(self) -> int:
        return 2 * len(self.automaton.entries) + 6

    def cells(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, column, value) of all features that are not zero.

        Columns: matches to the letter and misspelt by entry, then any of each, quoted ones, crowd, share of
        words, and crowd to the letter.
        """
        codes, bounds, starts, ends, limits = words_of(texts)
        n, first = len(texts), self.width - 6
        result = self.automaton.run(codes, starts, ends)
        hit = np.flatnonzero(result >= 0)
        if not len(hit):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32)
        text = np.searchsorted(limits, hit, side="right") - 1
        quoted = self._quoted(codes, bounds, text, starts[hit], ends[hit])
        plain, code = ~quoted, result[hit].astype(np.int64)
        length = np.array([len(e.text) for e in self.automaton.entries])[code >> 1]
        sure = plain & ((code & 1 == 0) | (length >= SURE_FROM))
        own = np.unique(text[plain] * first + code[plain])
        dense = np.zeros((n, 6), np.float32)
        exact, near = (np.bincount(text[sure & (code & 1 == k)], minlength=n) for k in (0, 1))
        dense[:, 0], dense[:, 1] = exact > 0, near > 0
        dense[:, 2] = np.log1p(np.bincount(text[quoted], minlength=n))
        for column, some in ((3, sure), (5, plain & (code & 1 == 0))):
            at, of = hit[some], text[some]
            # Matches from each one on that lie within CROWD words of it, in its own text.
            crowd = np.minimum(np.searchsorted(at, at + CROWD), np.searchsorted(of, of, side="right")) - np.arange(len(at))
            np.maximum.at(dense[:, column], of, np.log1p(crowd).astype(np.float32))
        dense[:, 4] = np.sqrt((exact + near) / np.maximum(np.diff(limits), 1))
        rows, columns = np.nonzero(dense)
        return (
            np.concatenate((own // max(first, 1), rows)),
            np.concatenate((own % max(first, 1), first + columns)),
            np.concatenate((np.ones(len(own), np.float32), dense[rows, columns])),
        )

    def features(self, texts: list[str]) -> np.ndarray:
        """The same as a table (rows x width)."""
        x = np.zeros((len(texts), self.width), np.float32)
        rows, columns, values = self.cells(texts)
        x[rows, columns] = values
        return x

    @staticmethod
    def _quoted(codes: np.ndarray, bounds: np.ndarray, text: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A match is quoted if the next marks before and after it are near, in its text, and open and close a quotation."""
        mark = np.flatnonzero(np.isin(codes, [ord(c) for c in OPENING + CLOSING + EITHER]))
        if not len(mark):
            return np.zeros(len(starts), bool)
        straight = np.cumsum(codes[mark] == ord(EITHER))
        before, after = np.searchsorted(mark, starts) - 1, np.searchsorted(mark, ends)
        inner = (before >= 0) & (after < len(mark))
        b, a = mark[np.maximum(before, 0)], mark[np.minimum(after, len(mark) - 1)]
        inner &= (b >= bounds[text]) & (a < bounds[text + 1]) & (starts - b <= QUOTE) & (a - ends <= QUOTE)
        first = np.searchsorted(mark, bounds[text])
        earlier = np.where(first > 0, straight[np.maximum(first - 1, 0)], 0)
        odd = (straight[np.maximum(before, 0)] - earlier) % 2 == 1
        opens = np.isin(codes[b], [ord(c) for c in OPENING]) & np.isin(codes[a], [ord(c) for c in CLOSING])
        return inner & (opens | ((codes[b] == ord(EITHER)) & (codes[a] == ord(EITHER)) & odd))

    def score(self, texts: list[str]) -> np.ndarray:
        rows, columns, values = self.cells(texts)
        z = np.full(len(texts), self.bias)
        if len(rows):
            z += np.bincount(rows, values * self.weights[columns], minlength=len(texts))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct (term, stem) of each text with a hash of the word before its first."""
    types = (pa.int32(), pa.string(), pa.bool_(), pa.int64())

    def sent(rows: list[tuple]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["label", "term", "stem", "previous"])

    for part, texts in text_slices(batches):
        rows: list[tuple[int, str, bool, int]] = []
        for label, text in zip(part.column("label").to_pylist(), texts, strict=True):
            _, _, starts, ends, _ = words_of([text])
            lower = text.lower()
            words = [lower[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
            seen: set[tuple[str, bool]] = set()
            for previous, word in zip(["", *words], words, strict=False):
                for term in ((word, False), *((word[:k], True) for k in STEMS if len(word) > k)):
                    if term not in seen:
                        seen.add(term)
                        rows.append((label, *term, zlib.crc32(previous.encode())))
            if len(rows) > 100_000:
                yield sent(rows)
                rows = []
        if rows:
            yield sent(rows)


def surprise(n: int, innocent: int, toxic: int, clean: int) -> float:
    """Chernoff's bound, as a negative logarithm, on the chance that n or more of a term's n + innocent texts are toxic ones."""
    share, expected = n / (n + innocent), toxic / (toxic + clean)
    if share <= expected:
        return 0.0
    rest = innocent * np.log((1 - share) / (1 - expected)) if innocent else 0.0
    return float(n * np.log(share / expected) + rest)


def learn_lexicon(sample: DataFrame) -> list[Entry]:
    """Entries from (label, text) of the bounded sample; see the module's text for the rule.

    Of a word and its inflections the stem stays, and beside a stem that is too short to be matched
    with an edit the words that are long enough.
    """
    sizes = {r[0]: r[1] for r in sample.groupBy("label").count().collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    if not toxic or not clean:
        return []
    schema = "label int, term string, stem boolean, previous long"
    found = sample.filter("label = 1").mapInArrow(_terms, schema).groupBy("term", "stem").agg(F.count("*").alias("n"), F.countDistinct("previous").alias("variety"))
    found = found.filter((F.col("n") >= LEAST_TEXTS) & (F.col("variety") >= LEAST_VARIETY * F.col("n")))
    others = sample.filter("label = 0").mapInArrow(_terms, schema).groupBy("term", "stem").agg(F.count("*").alias("innocent"))
    rule = F.coalesce("innocent", F.lit(0)) / F.lit(clean) <= MOST_CLEAN * F.col("n") / F.lit(toxic)
    kept: list[Entry] = []
    words: list[tuple[str, int]] = []  # terms kept, sorted, with their texts
    stems: set[str] = set()
    candidates = found.join(others, ["term", "stem"], "left").filter(rule).collect()
    least = np.log(max(1, len(candidates)) / CHANCE)
    for r in sorted(candidates, key=lambda r: (-r.n, -len(r.term), r.stem, r.term)):
        if surprise(r.n, r.innocent or 0, toxic, clean) < least:
            continue
        entry = Entry(r.term, r.stem)
        over = [r.term[:k] for k in STEMS if r.term[:k] in stems]
        if any(entry.edits <= Entry(t, True).edits for t in over):
            continue
        at = bisect_left(words, (r.term, 0))
        if r.stem and any(r.n <= 1.05 * n for _, n in takewhile(lambda w: w[0].startswith(r.term), islice(words, at, None))):
            continue
        kept.append(entry)
        insort(words, (r.term, r.n))
        if r.stem:
            stems.add(r.term)
    return kept


def _featured(model: ToxicityModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_slices(batches):
            rows, columns, values = model.cells(texts)
            order = np.lexsort((columns, rows))
            bounds = np.searchsorted(rows[order], np.arange(len(texts) + 1)).tolist()
            c, v = columns[order].astype(np.int32), values[order].astype(np.float32)
            pairs = [[a[i:j].tobytes() for i, j in zip(bounds[:-1], bounds[1:], strict=True)] for a in (c, v)]
            yield pa.record_batch([part.column("label"), *(pa.array(p, pa.binary()) for p in pairs)], names=["label", "columns", "x"])

    return run


def train(rows: np.ndarray, columns: np.ndarray, values: np.ndarray, y: np.ndarray, width: int) -> tuple[np.ndarray, float]:
    """Logistic regression by Adam on (row, column, value) features, with both labels weighted alike; (0, -30) where there is one label or none."""
    w, b = np.zeros(width), 0.0
    if not len(y) or y.min() == y.max():
        return w, -30.0
    weight = np.where(y == 1, 0.5 / (y == 1).sum(), 0.5 / (y == 0).sum())
    m, v = np.zeros(width + 1), np.zeros(width + 1)
    for step in range(1, STEPS + 1):
        z = b + np.bincount(rows, values * w[columns], minlength=len(y))
        g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * weight
        grad = np.concatenate((np.bincount(columns, values * g[rows], minlength=width) + DECAY * w, [g.sum()]))
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        move = 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    return w, float(b)


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "toxic", most: int = SAMPLE_PER_LABEL) -> ToxicityModel:
    """Fit on ``docs`` (key, text) with ``labels`` (key, label of 0 or 1).

    About ``most`` labelled keys of each label are used, chosen by a hash of the key, so what is
    broadcast and what reaches the driver is bounded. Null labels teach nothing. Without both labels there
    is nothing to learn: all scores are 0.
    """
    sample = sampled(docs, labels, key, label, most)
    model = ToxicityModel(LexiconAutomaton(learn_lexicon(sample)), np.zeros(0), -30.0)
    got = sample.mapInArrow(_featured(model), "label int, columns binary, x binary").toPandas().sort_values(["label", "columns", "x"], ignore_index=True)
    columns, values = np.frombuffer(b"".join(got["columns"]), np.int32), np.frombuffer(b"".join(got.x), np.float32)
    rows = np.repeat(np.arange(len(got)), got.x.map(len).to_numpy(np.int64) // 4)
    model.weights, model.bias = train(rows, columns, values.astype(np.float64), got.label.to_numpy(), model.width)
    return model


def score(docs: DataFrame, model: ToxicityModel, key: str = "doc_id") -> DataFrame:
    """(key, score, predicted) of every row of ``docs`` (key, text), of whole texts.

    A text without a match (null and empty ones too) gets the model's base score, near 0. Rows are kept as
    they are, repeated and null keys too; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_slices(batches):
            s = shared.value.score(texts)
            yield pa.record_batch([part.column(0), pa.array(s, pa.float64()), pa.array((s >= THRESHOLD).astype(np.int32))], names=[key, "score", "predicted"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, "text").mapInArrow(scored, f"`{key}` {kind}, score double, predicted int")


def accepted(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose texts are predicted to be not toxic."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_slices(batches):
            s = shared.value.score(texts)
            yield part.filter(pa.array(s < THRESHOLD))

    return docs.mapInArrow(run, docs.schema)
