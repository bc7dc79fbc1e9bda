"""Language identification in two steps: the family first, then pairwise linear SVMs within it.

``fit`` learns from a bounded sample of labelled rows; ``predict`` scores every whole text.
Features are hashed character trigrams and bigrams of the lower-cased letters of the whole text,
square-rooted and scaled to unit length, so that length and repetition weigh little.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoframe.llm.common import bounded_sample, code_points, kinds, text_slices

#: Language families by ISO 639-1 code. A language not named is a family of its own.
FAMILIES = {
    "germanic": ("da", "de", "en", "is", "nl", "no", "sv"),
    "romance": ("ca", "es", "fr", "gl", "it", "pt", "ro"),
    "slavic": ("bg", "cs", "hr", "pl", "ru", "sk", "sl", "sr", "uk"),
    "uralic": ("et", "fi", "hu"),
    "indo_aryan": ("bn", "gu", "hi", "mr", "pa", "ur"),
    "semitic": ("ar", "he", "mt"),
    "turkic": ("az", "kk", "tr", "uz"),
}

#: Hash buckets of the n-grams.
DIMENSIONS = 4096
#: Labelled rows that the classifiers are fitted on, at most (about), of each language and of all together: documented bounds.
SAMPLE_PER_LANGUAGE, SAMPLE = 800, 16_000
#: Full-gradient steps and regularisation of each SVM.
STEPS, DECAY = 120, 1e-4


def family_of(lang: str) -> str:
    return next((f for f, members in FAMILIES.items() if lang.lower().split("-")[0].split("_")[0] in members), f"own:{lang}")


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(rows x DIMENSIONS float32 of unit length, whether a text has a letter)."""
    codes, bounds = code_points([t.lower() for t in texts])
    letter = kinds(codes) == 1
    n = len(texts)
    owner = np.repeat(np.arange(n, dtype=np.int64), np.diff(bounds))
    c = np.where(letter, codes, 32).astype(np.uint32)
    out = np.zeros(n * DIMENSIONS, np.float32)
    if len(c):
        before = np.concatenate(([np.uint32(32)], c[:-1]))
        after = np.concatenate((c[1:], [np.uint32(32)]))
        pair = c * np.uint32(0x9E3779B1) + after * np.uint32(0x85EBCA77)
        three = pair + before * np.uint32(0xC2B2AE3D)
        shift = np.uint32(32 - DIMENSIONS.bit_length() + 1)
        for h in (pair * np.uint32(0x27D4EB2F), three * np.uint32(0x165667B1)):
            at = owner[letter] * DIMENSIONS + (h[letter] >> shift)
            out += np.bincount(at, minlength=n * DIMENSIONS)
    x = np.sqrt(out.reshape(n, DIMENSIONS))
    has = x.any(axis=1)
    x /= np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-12)
    return x, has


def linear_svm(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear SVM (squared hinge, classes weighted alike) for y in {-1, 1}."""
    y = y.astype(np.float32)
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    w, b = np.zeros(x.shape[1], np.float32), np.float32(0.0)
    m, v = np.zeros(x.shape[1] + 1, np.float32), np.zeros(x.shape[1] + 1, np.float32)
    for step in range(1, STEPS + 1):
        slack = np.maximum(np.float32(0), 1 - y * (x @ w + b)) * y * weight
        g = np.concatenate((DECAY * w - 2 * (slack @ x), [-2 * slack.sum()])).astype(np.float32)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = 0.2 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, b = (w - move[:-1]).astype(np.float32), np.float32(b - move[-1])
    return w, float(b)


@dataclass
class LanguageModel:
    """families: names; members: languages of each; first: one-versus-rest planes of the families; pairs: one-versus-one planes within each."""

    families: list[str]
    members: dict[str, list[str]]
    first: tuple[np.ndarray, np.ndarray]
    pairs: dict[str, list[tuple[int, int, np.ndarray, float]]]

    def predict(self, x: np.ndarray, has: np.ndarray) -> tuple[list[str], np.ndarray]:
        n = len(x)
        if not self.families:
            return ["und"] * n, np.zeros(n)
        margin = x @ self.first[0] + self.first[1]
        squash = lambda z: 1.0 / (1.0 + np.exp(-4.0 * np.clip(z, -8, 8)))
        best = margin.argmax(axis=1)
        score = squash(margin[np.arange(n), best]) if len(self.families) > 1 else np.ones(n)
        lang = np.empty(n, object)
        for k, family in enumerate(self.families):
            rows = np.flatnonzero(best == k)
            names = self.members[family]
            if len(names) == 1 or not len(rows):
                lang[rows] = names[0]
                continue
            votes, sure = np.zeros((len(rows), len(names))), np.zeros((len(rows), len(names)))
            for i, j, w, b in self.pairs[family]:
                z = x[rows] @ w + b
                votes[:, i] += z > 0
                votes[:, j] += z <= 0
                sure[:, i] += squash(z) / (len(names) - 1)
                sure[:, j] += squash(-z) / (len(names) - 1)
            won = (votes + sure).argmax(axis=1)  # most duels won; the surer one on a tie
            lang[rows] = np.array(names, object)[won]
            score[rows] *= sure[np.arange(len(rows)), won]
        lang[~has] = "und"
        score[~has] = 0.0
        return lang.tolist(), np.clip(score, 0.0, 1.0)


def train(x: np.ndarray, langs: list[str]) -> LanguageModel:
    members: dict[str, list[str]] = {}
    for lang in sorted(set(langs)):
        members.setdefault(family_of(lang), []).append(lang)
    names, lang = sorted(members), np.array(langs, object)
    family = np.array([family_of(v) for v in langs], object)
    planes = [linear_svm(x, np.where(family == f, 1.0, -1.0)) for f in names] if len(names) > 1 else [(np.zeros(x.shape[1], np.float32), 0.0) for _ in names]
    first = (np.stack([w for w, _ in planes], axis=1), np.array([b for _, b in planes], np.float32)) if names else (np.zeros((DIMENSIONS, 0)), np.zeros(0))
    pairs = {}
    for f in names:
        duels = []
        for i, j in combinations(range(len(members[f])), 2):
            rows = np.flatnonzero((lang == members[f][i]) | (lang == members[f][j]))
            duels.append((i, j, *linear_svm(x[rows], np.where(lang[rows] == members[f][i], 1.0, -1.0))))
        pairs[f] = duels
    return LanguageModel(names, members, first, pairs)


def _sampled_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, texts in text_slices(batches):
        x, has = features(texts)
        keep = np.flatnonzero(has)
        yield pa.record_batch([part.column("lang").take(pa.array(keep)), pa.array([x[i].astype(np.float16).tobytes() for i in keep], pa.binary())], names=["lang", "x"])


def fit(labelled: DataFrame, key: str = "doc_id", most: int = SAMPLE_PER_LANGUAGE) -> LanguageModel:
    """Fit on ``labelled`` (key, text, lang).

    Rows with a null lang or no letter teach nothing. About ``most`` rows of each language are
    used, fewer where there are more languages than SAMPLE has room for, chosen by a hash of key and text (null
    keys are like any other); rows that repeat both count once. Their features (8 KB each) are what reaches the driver.
    No rows at all give a model that answers ``und``.
    """
    rows = labelled.filter("lang is not null and text is not null").select(F.col(key).alias("key_"), F.xxhash64("text").alias("hash_"), "text", "lang")
    sample = bounded_sample(rows, "lang", ["key_", "hash_"], most, SAMPLE).select("text", "lang")
    got = sample.mapInArrow(_sampled_features, "lang string, x binary").toPandas()
    got = got.sort_values(["lang", "x"], ignore_index=True)
    x = np.frombuffer(b"".join(got.x), np.float16).reshape(len(got), DIMENSIONS).astype(np.float32)
    return train(x, got.lang.tolist())


def predict(docs: DataFrame, model: LanguageModel, key: str = "doc_id") -> DataFrame:
    """(key, lang_pred, score) of every row of ``docs`` (key, text); other columns are not read.

    ``und`` with score 0 where the text is null or has no letter. A text is read whole; equal
    texts get equal results. Repeated rows and null keys are kept as they are.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for part, texts in text_slices(batches):
            lang, score = m.predict(*features(texts))
            yield pa.record_batch([part.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=[key, "lang_pred", "score"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, "text").mapInArrow(scored, f"`{key}` {kind}, lang_pred string, score double")


def accuracy(predicted: pd.DataFrame) -> float:
    """Share of rows whose lang_pred is their lang."""
    return float((predicted.lang_pred == predicted.lang).mean())
