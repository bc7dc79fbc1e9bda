"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from chronoframe.llm.common import code_points, kinds, run_hashes, sampled, text_slices, word_runs

#: Buckets of the word hash, structure statistics, size classes (the metadata), rank of the pairwise interactions.
WORDS, STATISTICS, SIZES, RANK = 2048, 16, 20, 8
WIDTH = WORDS + STATISTICS + SIZES
#: Labelled rows of each label that the machine is fitted on, at most (about): a documented bound.
SAMPLE_PER_LABEL = 2500
EPOCHS, BATCH, RATE, DECAY = 30, 128, 0.02, 1e-4
THRESHOLD = 0.7


def features(texts: list[str]) -> np.ndarray:
    """(rows x WIDTH float32): square-rooted word counts of unit length, statistics in 0 to about 1, one size class."""
    n = len(texts)
    raw, bounds = code_points(texts)
    kind = kinds(raw)
    lower, low_bounds = code_points([t.lower() for t in texts])
    low_kind = kind if len(lower) == len(raw) else kinds(lower)
    starts, ends = word_runs((low_kind == 1) | (low_kind == 2))
    words = run_hashes(lower, starts, ends)
    limits = np.searchsorted(starts, low_bounds)
    count = np.diff(limits)
    owner = np.repeat(np.arange(n), count)
    x = np.zeros((n, WIDTH), np.float32)
    hashed = np.bincount(owner * WORDS + (words >> np.uint64(53)).astype(np.int64), minlength=n * WORDS).reshape(n, WORDS)
    root = np.sqrt(hashed.astype(np.float32))
    x[:, :WORDS] = root / np.maximum(np.sqrt(hashed.sum(axis=1, keepdims=True)), 1)

    def per_text(mask: np.ndarray, upto: np.ndarray = bounds) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(mask)))
        return (total[upto[1:]] - total[upto[:-1]]).astype(np.float64)

    size = np.array([len(t) for t in texts], np.float64)
    chars, spaces = np.maximum(size, 1), per_text(kind == 3) - 1
    letters, digits = per_text(kind == 1), per_text(kind == 2)
    capital = per_text((kind == 1) & (raw != lower)) if len(lower) == len(raw) else np.array([sum(c.isupper() for c in t) for t in texts], np.float64)
    signs = np.maximum(size - letters - digits - spaces, 0)
    stop = per_text(np.isin(raw, [ord(c) for c in ".?"]))
    comma = per_text(np.isin(raw, [ord(c) for c in ",;:"]))
    bar = per_text(np.isin(raw, [ord(c) for c in "|\t"]))
    shout = per_text(raw == ord("!"))
    line = per_text(raw == 10)
    ended = per_text((raw == 10) & (np.concatenate(([0], raw[:-1])) == ord(".")))
    held = np.maximum(count, 1)
    repeat = np.zeros(n)
    if len(words):
        again = (words[1:] == words[:-1]) & (owner[1:] == owner[:-1])
        np.add.at(repeat, owner[1:][again], 1)
    length = np.bincount(owner, ends - starts, minlength=n)
    long_word = np.bincount(owner, ends - starts > 20, minlength=n)
    kinds_of_word = (hashed > 0).sum(axis=1)
    stats = (
        np.log1p(size) / 12, np.log1p(count) / 10, letters / chars, digits / chars, signs / chars * 4, np.maximum(spaces, 0) / chars * 3,
        capital / np.maximum(letters, 1), length / held / 12, long_word / held, repeat / held, kinds_of_word / np.minimum(held, WORDS),
        np.minimum(stop / held * 5, 2), np.minimum(comma / held * 5, 2), np.minimum(bar / held * 2, 2), np.minimum(shout / held * 2, 2), ended / line,
    )
    x[:, WORDS : WORDS + STATISTICS] = np.stack(stats, axis=1)
    x[np.arange(n), WORDS + STATISTICS + np.minimum(np.log2(chars).astype(int), SIZES - 1)] = 1
    return x


@dataclass
class FactorisationMachine:
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        """Logistic of bias + linear part + pairs; the pairs cost linear time: half of (sum)^2 - sum of squares, by factor."""
        mixed = x @ self.factors
        pairs = 0.5 * ((mixed * mixed).sum(axis=1) - (x * x) @ (self.factors * self.factors).sum(axis=1))
        return 1 / (1 + np.exp(-np.clip(self.bias + x @ self.weights + pairs, -30, 30).astype(np.float64)))


def train(x: np.ndarray, y: np.ndarray, seed: int = 7) -> FactorisationMachine:
    """Adam on the logistic loss, with both labels weighted alike."""
    rng = np.random.default_rng(seed)
    machine = FactorisationMachine(0.0, np.zeros(x.shape[1], np.float32), rng.normal(0, 0.02, (x.shape[1], RANK)).astype(np.float32))
    if not len(x) or y.min() == y.max():
        machine.bias = 0.0 if not len(x) else (20.0 if y[0] else -20.0)
        return machine
    weight = np.where(y == 1, 0.5 / (y == 1).mean(), 0.5 / (y == 0).mean())
    first, second, step = [0.0, np.zeros_like(machine.weights), np.zeros_like(machine.factors)], [0.0, np.zeros_like(machine.weights), np.zeros_like(machine.factors)], 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(x))
        for at in range(0, len(x), BATCH):
            rows = order[at : at + BATCH]
            xb, step = x[rows], step + 1
            g = ((machine.score(xb) - y[rows]) * weight[rows] / len(rows)).astype(np.float32)
            mixed = xb @ machine.factors
            grads = (
                g.sum(),
                xb.T @ g + DECAY * machine.weights,
                xb.T @ (g[:, None] * mixed) - machine.factors * ((xb * xb).T @ g)[:, None] + DECAY * machine.factors,
            )
            moved = []
            for k, grad in enumerate(grads):
                first[k] = 0.9 * first[k] + 0.1 * grad
                second[k] = 0.999 * second[k] + 0.001 * grad * grad
                moved.append(RATE * (0.5 if epoch > EPOCHS // 2 else 1.0) * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8))
            machine.bias -= float(moved[0])
            machine.weights -= moved[1]
            machine.factors -= moved[2]
    return machine


def _sampled_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, texts in text_slices(batches):
        x = features(texts).astype(np.float16)
        yield pa.record_batch([part.column("label"), pa.array([row.tobytes() for row in x], pa.binary())], names=["label", "x"])


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality", most: int = SAMPLE_PER_LABEL) -> FactorisationMachine:
    """Fit on ``docs`` (key, text) with ``labels`` (key, label of 0 or 1).

    About ``most`` labelled keys of each label are used, chosen by a hash of the key; so the labels that are
    broadcast to the documents are bounded, and so are the features (4 KB each) that reach the
    driver. Null labels teach nothing, null texts count as empty. With one label only, all scores
    lean to it; with none they are one half.
    """
    got = sampled(docs, labels, key, label, most).mapInArrow(_sampled_features, "label int, x binary").toPandas()
    got = got.sort_values(["label", "x"], ignore_index=True)
    x = np.frombuffer(b"".join(got.x), np.float16).reshape(len(got), WIDTH).astype(np.float32)
    return train(x, got.label.to_numpy())


def score(docs: DataFrame, machine: FactorisationMachine, key: str = "doc_id") -> DataFrame:
    """(key, score, predicted) of every row of ``docs`` (key, text), of whole texts.

    A null or empty text is scored by its statistics like any other. Rows are kept as they are, repeated and null
    keys too; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_slices(batches):
            s = shared.value.score(features(texts))
            yield pa.record_batch([part.column(0), pa.array(s, pa.float64()), pa.array((s >= THRESHOLD).astype(np.int32))], names=[key, "score", "predicted"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, "text").mapInArrow(scored, f"`{key}` {kind}, score double, predicted int")


def accepted(docs: DataFrame, model: FactorisationMachine) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose texts are predicted to be of quality."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_slices(batches):
            s = shared.value.score(features(texts))
            yield part.filter(pa.array(s >= THRESHOLD))

    return docs.mapInArrow(run, docs.schema)
