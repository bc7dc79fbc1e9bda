"""Classifiers: held-out results, defined results for awkward rows, the parts against plain versions."""

from __future__ import annotations

import re

import numpy as np
import pytest

from chronoframe.llm import langid, quality, queries, toxicity
from chronoframe.llm.automaton import Entry, LexiconAutomaton
from chronoframe.llm.common import bounded_sample
from chronoframe.llm.toxicity import words_of
from tests.llm.conftest import prose

LARGER = "/root/testdata/sf0.01"


def test_language_held_out(spark):
    truth = spark.read.parquet(f"{LARGER}/documents.parquet").select("doc_id", "lang").filter("lang is not null")
    got = queries.op1_language_id(spark, LARGER).join(truth, "doc_id").filter("held_out").toPandas()
    assert len(got) > 100 and langid.accuracy(got) >= 0.95
    assert got.score.between(0, 1).all()


def test_language_families_come_first(spark):
    rows = [(i, t, lang) for i, (t, lang) in enumerate([("the stone and the river", "en"), ("der stein und der fluss", "de"), ("la pierre et le fleuve", "fr"), ("la piedra y el rio", "es")] * 5)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.families == ["germanic", "romance"]
    assert {f: len(p) for f, p in model.pairs.items()} == {"germanic": 1, "romance": 1}
    langs, _ = model.predict(*langid.features([r[1] for r in rows]))
    assert langs == [r[2] for r in rows]


def test_language_of_awkward_rows(awkward, nothing, spark):
    model = langid.fit(awkward)
    found = {r.doc_id: r for r in langid.predict(awkward, model).collect()}
    for row in awkward.collect():
        letters = any(c.isalpha() for c in row.text or "")
        assert found[row.doc_id].lang_pred == ("en" if letters else "und")
    assert langid.predict(awkward, langid.fit(nothing)).filter("lang_pred <> 'und'").count() == 0
    assert langid.predict(nothing, model).count() == 0


@pytest.mark.parametrize(("query", "label", "least"), [("op8_toxicity", "toxic", 0.9), ("op10_quality", "quality", 0.9)])
def test_scores_held_out(spark, query, label, least):
    labels = spark.read.parquet(f"{LARGER}/labels.parquet").select("doc_id", label).filter(f"{label} is not null")
    got = queries.QUERIES[query](spark, LARGER).join(labels, "doc_id").filter("held_out").toPandas()
    assert got.score.between(0, 1).all() and ((got.score >= 0.7).astype(int) == got.predicted).all()
    order = got.score.rank().to_numpy()
    y = got[label].to_numpy() == 1
    area = (order[y].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (~y).sum())
    assert area >= least


@pytest.mark.parametrize("module", [toxicity, quality])
def test_awkward_rows_are_scored(spark, awkward, nothing, module):
    label = "toxic" if module is toxicity else "quality"
    labels = spark.createDataFrame([(i, i % 2 if i % 5 else None) for i in range(14)] + [(None, 1)], f"doc_id long, {label} int")
    model = module.fit(awkward, labels)
    found = module.score(awkward, model).collect()
    assert len(found) == awkward.count() and all(0 <= r.score <= 1 for r in found)
    assert module.accepted(awkward, model).columns == awkward.columns
    untaught = module.fit(nothing, labels)
    assert module.score(awkward, untaught).count() == awkward.count()
    assert module.score(nothing, model).count() == 0


def plain_distance(a: str, b: str) -> int:
    """Edits from a to b: one character changed, put in or left out, or two neighbours exchanged."""
    d = {(i, j): i + j for i in range(len(a) + 1) for j in range(len(b) + 1) if not i or not j}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


def plain_match(word: str, entries: list[Entry]) -> set[int]:
    """All results that are right: the fewest edits with any entry that has them."""
    found = []
    for number, entry in enumerate(entries):
        tries = [word[:k] for k in range(len(word) + 1)] if entry.stem else [word]
        d = min(plain_distance(t, entry.text) for t in tries)
        if d <= entry.edits:
            found.append((d, number))
    return {2 * n + d for d, n in found if d == min(found)[0]} or {-1}


def test_automaton_against_plain_distances():
    entries = [Entry("stupid", False), Entry("moron", False), Entry("idio", True), Entry("vermin", True), Entry("rat", False)]
    machine = LexiconAutomaton(entries)
    rng = np.random.default_rng(4)
    words = ["rat", "rats", "idiot", "idio", "vermn", "verminous", "vermim", "stupdi", "stpid", "stuppid", "mor0n", "moroon", "x", "omron", "mornow", "vremin", "art"]
    for entry in entries:
        for _ in range(150):
            w = list(entry.text)
            for _ in range(int(rng.integers(0, 3))):
                k = int(rng.integers(0, len(w) + 1))
                kind = rng.integers(0, 4)
                if kind == 3:
                    w[k : k + 2] = w[k : k + 2][::-1]
                    continue
                if kind == 0:
                    w.insert(k, chr(97 + int(rng.integers(0, 26))))
                elif len(w) > 1 and k < len(w):
                    w[k : k + 1] = [] if kind == 1 else [chr(97 + int(rng.integers(0, 26)))]
            words.append("".join(w))
    codes, _, starts, ends, _ = words_of([" ".join(words)])
    for word, result in zip(words, machine.run(codes, starts, ends).tolist(), strict=True):
        assert result in plain_match(word, entries), word


def test_words_hold_masks():
    codes, _, starts, ends, _ = words_of(["f**k a*b *c* d$$ 5@@x"])
    assert ["".join(map(chr, codes[a:b])) for a, b in zip(starts, ends, strict=True)] == ["f**k", "a*b", "c", "d", "5@@x"]


def test_lexicon_has_no_cap_and_short_terms(spark):
    """300 terms of different lengths, each in enough toxic texts after different words, are all learned."""
    rng = np.random.default_rng(8)
    name = lambda k, n: "".join(chr(97 + int(c)) for c in np.random.default_rng(k).integers(0, 26, n))
    terms = ["zug", "qax"] + sorted({name(k, 5 + k % 5) for k in range(300)})
    calm = [name(5000 + k, 7) for k in range(400)]
    say = lambda: " ".join(calm[int(i)] for i in rng.integers(0, 400, 6))
    toxic = [f"{say()} {t} {say()}" for t in terms for _ in range(15)]
    docs = [(i, t, 1) for i, t in enumerate(toxic)] + [(10_000 + i, f"{say()} {say()}", 0) for i in range(4500)]
    table = spark.createDataFrame(docs, "doc_id long, text string, toxic int").repartition(4)
    entries = {e.text for e in toxicity.learn_lexicon(table.selectExpr("toxic AS label", "text"))}
    missed = [t for t in terms if t not in entries and not any(t[:k] in entries for k in toxicity.STEMS)]
    assert len(entries) > 256 and {"zug", "qax"} <= entries and len(missed) <= 3


def test_surprise_is_the_bound_on_chance():
    assert np.isclose(toxicity.surprise(5, 0, 30, 270), -5 * np.log(0.1))
    assert toxicity.surprise(3, 40, 30, 270) == 0
    from math import comb

    tail = sum(comb(12, k) * 0.1**k * 0.9 ** (12 - k) for k in range(6, 13))
    assert np.exp(-toxicity.surprise(6, 6, 30, 270)) >= tail


def plain_toxicity(model: toxicity.ToxicityModel, text: str) -> float:
    """A text's score by one word after the other, without quotations."""
    words = re.findall(r"[^\W_]+(?:[@$*]+[^\W_]+)*", text.lower())
    found = [(k, m) for k, m in ((k, min(plain_match(w, model.automaton.entries))) for k, w in enumerate(words)) if m >= 0]
    entries, w = model.automaton.entries, model.weights
    sure = [(k, m) for k, m in found if not m % 2 or len(entries[m // 2].text) >= toxicity.SURE_FROM]
    crowd = lambda some: max((np.log1p(sum(k <= j < k + toxicity.CROWD for j, _ in some)) for k, _ in some), default=0.0)
    z = model.bias + sum(w[m] for m in {m for _, m in found})
    z += w[-6] * any(m % 2 == 0 for _, m in sure) + w[-5] * any(m % 2 for _, m in sure) + w[-3] * crowd(sure)
    z += w[-2] * np.sqrt(len(sure) / max(1, len(words))) + w[-1] * crowd([f for f in found if f[1] % 2 == 0])
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def test_toxicity_scores_equal_a_plain_version(awkward_texts):
    entries = [Entry("moron", False), Entry("scum", False), Entry("vermin", True), Entry("zug", False)]
    model = toxicity.ToxicityModel(LexiconAutomaton(entries), np.random.default_rng(1).normal(size=2 * len(entries) + 6), -0.3)
    texts = [t or "" for t in awkward_texts] + ["you morons, moron!", "sucm and scum", "verminous zug zugs " * 9, "a m*ron here", prose(200, 3) + " omron vermni"]
    assert np.allclose(model.score(texts), [plain_toxicity(model, t) for t in texts], atol=1e-6)


def test_quoted_matches_count_apart():
    model = toxicity.ToxicityModel(LexiconAutomaton([Entry("moron", False)]), np.zeros(8), 0.0)
    open_, quoted, neither = model.features(["you moron, go", 'he said "you moron" and left', "calm words"])
    assert open_[-4] == 0 and open_[0] == 1
    assert quoted[-4] > 0 and quoted[0] == 0
    assert not neither.any()


def test_language_predictions_equal_a_plain_version(awkward_texts):
    """Counts of hashed pairs and triples by a loop, then family, duels and votes one at a time."""
    rng = np.random.default_rng(6)
    langs = ["en", "de", "nl", "fr", "es", "xx"]
    texts = [f"{prose(12, k)} {langs[k % 6] * 3} {langs[k % 6]}" for k in range(48)]
    model = langid.train(langid.features(texts)[0], [langs[k % 6] for k in range(48)])
    some = [t or "" for t in awkward_texts if len(t or "") < 5000] + texts[:6]
    x = np.zeros((len(some), langid.DIMENSIONS))
    shift = 32 - langid.DIMENSIONS.bit_length() + 1
    for i, t in enumerate(some):
        c = [32, *(ord(ch) if ch.isalpha() else 32 for ch in t.lower()), 32, 32]
        for k in range(1, len(c) - 2):
            if c[k] != 32:
                pair = (c[k] * 0x9E3779B1 + c[k + 1] * 0x85EBCA77) % 2**32
                three = (pair + c[k - 1] * 0xC2B2AE3D) % 2**32
                for h in (pair * 0x27D4EB2F % 2**32, three * 0x165667B1 % 2**32):
                    x[i, h >> shift] += 1
    x = np.sqrt(x)
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    found, has = langid.features(some)
    assert np.allclose(found, x, atol=1e-5)
    told, score = model.predict(found, has)
    for row, lang, sure, letters in zip(found, told, score, has, strict=True):
        family = model.families[int(np.argmax([row @ model.first[0][:, k] + model.first[1][k] for k in range(len(model.families))]))]
        names, wins = model.members[family], {}
        for i, j, w, b in model.pairs[family]:
            winner = names[i] if row @ w + b > 0 else names[j]
            wins[winner] = wins.get(winner, 0) + 1
        best = {n for n, k in wins.items() if k == max(wins.values())} or {names[0]}
        assert (lang in best if letters else lang == "und") and 0 <= sure <= 1
    del rng


def test_null_and_repeated_keys_stay_in_bounds(spark):
    """The sample's bound holds for rows without a key, and rows that repeat key and text count once."""
    rows = [(None, prose(8, k), "en") for k in range(900)] + [(1, "der stein", "de")] * 500 + [(k, prose(9, 5000 + k), "fr") for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    sample = bounded_sample(docs, "lang", ["doc_id", "text"], 100)
    got = {r.lang: r["count"] for r in sample.groupBy("lang").count().collect()}
    assert 60 <= got["en"] <= 140 and 60 <= got["fr"] <= 140 and got.get("de", 0) <= 1
    assert langid.predict(docs, langid.fit(docs)).count() == len(rows)


@pytest.mark.parametrize("module", [toxicity, quality])
def test_scores_of_repeated_and_null_keys(spark, module):
    label = "toxic" if module is toxicity else "quality"
    rows = [(1, "calm river"), (1, "calm river"), (1, "stone"), (None, "calm river"), (None, None)]
    docs = spark.createDataFrame([(k, t, 9, "x") for k, t in rows], "doc_id long, text string, score int, label string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (5, None)], f"doc_id long, {label} int")
    found = module.score(docs, module.fit(docs, labels)).collect()
    assert sorted((str(r.doc_id) for r in found)) == sorted(str(k) for k, _ in rows)
    assert len({round(r.score, 12) for r in found if r.doc_id == 1}) <= 2


def test_quality_features_equal_a_plain_version(awkward_texts):
    """Words, statistics and the size class of a text by plain string methods."""
    texts = [t or "" for t in awkward_texts] + ["One two two three. Four!", "a|b\tc; D: e?\nEnd.\n", "12 34 ABC abc"]
    x = quality.features(texts)
    for t, row in zip(texts, x, strict=True):
        words = re.findall(r"[^\W_]+", t.lower())
        n, held = len(t), max(len(words), 1)
        kinds = [1 if c.isalpha() else 2 if c.isdigit() else 3 if c.isspace() else 0 for c in t]
        spaces, letters = kinds.count(3), kinds.count(1)
        stats = row[quality.WORDS :][: quality.STATISTICS]
        assert np.isclose(stats[0], np.log1p(n) / 12, atol=1e-5) and np.isclose(stats[2], letters / max(n, 1), atol=1e-5)
        assert np.isclose(stats[3], kinds.count(2) / max(n, 1), atol=1e-5) and np.isclose(stats[5], spaces / max(n, 1) * 3, atol=1e-5)
        assert np.isclose(stats[1], np.log1p(len(words)) / 10, atol=1e-5) and np.isclose(stats[7], sum(map(len, words)) / held / 12, atol=1e-5)
        assert np.isclose(stats[9], sum(a == b for a, b in zip(words, words[1:], strict=False)) / held, atol=1e-5)
        assert np.isclose(stats[11], min(sum(c in ".?" for c in t) / held * 5, 2), atol=1e-5)
        assert np.isclose(stats[14], min(t.count("!") / held * 2, 2), atol=1e-5)
        size = row[quality.WORDS + quality.STATISTICS :]
        assert size.sum() == 1 and size[min(int(np.log2(max(n, 1))), quality.SIZES - 1)] == 1
        assert np.isclose((row[: quality.WORDS] ** 2).sum(), 1 if words else 0, atol=1e-4)


def test_pairwise_terms_by_the_sum_of_squares_identity():
    rng = np.random.default_rng(2)
    x, v = rng.normal(size=(6, 9)), rng.normal(size=(9, 3))
    machine = quality.FactorisationMachine(0.1, rng.normal(size=9), v)
    plain = [0.1 + r @ machine.weights + sum(v[i] @ v[j] * r[i] * r[j] for i in range(9) for j in range(i + 1, 9)) for r in x]
    assert np.allclose(machine.score(x), 1 / (1 + np.exp(-np.clip(plain, -30, 30))))
