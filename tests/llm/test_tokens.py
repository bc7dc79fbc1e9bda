"""Tokens: byte BPE against its own library, the store and packing against the tokenizers library."""

from __future__ import annotations

import zlib
from collections import defaultdict
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from chronoframe.llm import bytebpe, packing, queries, tokenstore
from chronoframe.llm.common import Scratch
from tests.llm.conftest import prose


@pytest.fixture(scope="module")
def ranks():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bytebpe.read_ranks(bytebpe.RANK_FILE), special_tokens={})


@pytest.fixture(scope="module")
def words():
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def whole_ids(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_byte_bpe_equals_its_library(spark, awkward, ranks, small):
    some = spark.read.parquet(f"{small}/documents.parquet").select(F.col("doc_id") + 1000, "text").toDF("doc_id", "text")
    docs = awkward.select("doc_id", "text").unionByName(some)
    texts = {r.doc_id: r.text for r in docs.collect()}
    for row in bytebpe.decode(bytebpe.encode(docs)).collect():
        text = texts[row.doc_id] or ""
        assert row.ids == ranks.encode_ordinary(text)
        assert bytes(row.decoded) == text.encode()


def test_offsets_cover_every_character(awkward):
    for row in awkward.select("doc_id", "text").join(bytebpe.encode(awkward, offsets=True), "doc_id").collect():
        text = row.text or ""
        assert len(row.ids) == len(row.char_start) == len(row.char_end)
        reached = 0
        for a, b in zip(row.char_start, row.char_end, strict=True):
            assert a <= reached <= b and a < b
            reached = b
        assert reached == len(text)


def test_split_characters_decode_whole():
    bpe = bytebpe.byte_bpe(bytebpe.RANK_FILE)
    word = "🤷🏽𒀀"
    singles = [bpe.token_bytes.index(bytes([b])) for b in word.encode()]
    assert bpe.decode(singles).decode() == word


def test_null_ids_decode_to_null(spark):
    assert bytebpe.decode(spark.createDataFrame([(1, None)], "doc_id long, ids array<int>")).first().decoded is None


def test_store_round_trip(spark, awkward, words):
    path = Scratch(spark).path("store")
    tokenstore.write(awkward, path)
    texts = {r.doc_id: r.text for r in awkward.collect()}
    found = {r.doc_id: r for r in tokenstore.read(spark, path).collect()}
    sums = {r.doc_id: r for r in tokenstore.checksums(spark, path).collect()}
    start = 0
    for key in sorted(texts):
        ids = whole_ids(words, texts[key])
        assert np.frombuffer(found[key].ids, "<u4").tolist() == ids
        assert (found[key].start, found[key].n_tokens) == (sums[key].start, sums[key].n_tokens) == (start, len(ids))
        assert sums[key].ids_crc32 == crc(ids)
        start += len(ids)
    chunks = tokenstore.read_chunks(spark, path)
    assert chunks.count() == chunks.select("chunk").distinct().count()


def test_store_tells_damage(spark, awkward):
    path = Scratch(spark).path("store")
    tokenstore.write(awkward, path)
    recipes = tokenstore.read_recipes(spark, path)
    turned = recipes.withColumn("chunks", F.reverse("chunks")).cache()
    turned.count()
    turned.write.mode("overwrite").parquet(f"{path}/turned")
    (spark.read.parquet(f"{path}/turned")).write.mode("overwrite").parquet(f"{path}/recipes")
    with pytest.raises(Exception, match="does not fit its root"):
        tokenstore.checksums(spark, path).collect()


@pytest.mark.parametrize("table", ["recipes", "manifest"])
def test_store_misses_a_lost_file(spark, awkward, table):
    path = Scratch(spark).path("store")
    tokenstore.write(awkward.repartition(4), path)
    files = sorted(Path(path.removeprefix("file://"), table).glob("part-*.parquet"))
    files[-1].unlink()
    for crc_file in files[-1].parent.glob(".part-*.crc"):
        crc_file.unlink()
    with pytest.raises(tokenstore.DamagedStore):
        tokenstore.checksums(spark, path)
    with pytest.raises(tokenstore.DamagedStore):
        tokenstore.read(spark, path)


def test_store_misses_a_lost_chunk(spark, awkward):
    path = Scratch(spark).path("store")
    tokenstore.write(awkward, path)
    chunks = spark.read.parquet(f"{path}/objects").filter("kind = 'chunk'")
    some = chunks.orderBy("chunk").limit(chunks.count() - 1)
    recipes = spark.read.parquet(f"{path}/objects").filter("kind = 'recipe'")
    some.unionByName(recipes).write.partitionBy("kind").parquet(f"{path}/less")
    spark.read.parquet(f"{path}/less").write.mode("overwrite").partitionBy("kind").parquet(f"{path}/objects")
    with pytest.raises(Exception, match="missing"):
        tokenstore.checksums(spark, path).collect()


def test_store_with_half_of_the_texts_empty(spark, words):
    """References to one chunk by half of the rows are joined where they lie."""
    texts = {i: None if i % 4 == 0 else "" if i % 2 == 0 else prose(30, i) for i in range(3000)}
    path = Scratch(spark).path("store")
    tokenstore.write(spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4), path)
    found = {r.doc_id: r for r in tokenstore.checksums(spark, path).collect()}
    assert {k: r.ids_crc32 for k, r in found.items()} == {k: crc(whole_ids(words, t)) for k, t in texts.items()}
    assert all(np.frombuffer(r.ids, "<u4").tolist() == whole_ids(words, texts[r.doc_id]) for r in tokenstore.read(spark, path).collect())


def test_store_refuses_ids_that_do_not_fit(spark, monkeypatch):
    monkeypatch.setitem(tokenstore.WIDTHS, 1, np.dtype("u1"))
    with pytest.raises(Exception, match="does not fit"):
        tokenstore.write(spark.createDataFrame([(1, "river stone")], "doc_id long, text string"), Scratch(spark).path("store"), width=1)


def test_repeated_and_null_keys(spark, words):
    rows = [(1, "river"), (1, "river"), (1, "stone"), (None, "cloud"), (None, None), (2, "")]
    docs = spark.createDataFrame([(k, t, "x", 0) for k, t in rows], "doc_id long, text string, n_tokens string, start int").repartition(2)
    path = Scratch(spark).path("store")
    tokenstore.write(docs, path)
    want = sorted(((k, crc(whole_ids(words, t))) for k, t in rows), key=repr)
    for found in (tokenstore.checksums(spark, path), packing.pack(docs).withColumn("ids_crc32", F.crc32("ids"))):
        assert sorted(((r.doc_id, r.ids_crc32) for r in found.collect()), key=repr) == want
    assert sorted((r.doc_id or 0 for r in tokenstore.checksums(spark, path).orderBy("start").collect())) == sorted(k or 0 for k, _ in rows)
    decoded = bytebpe.decode(bytebpe.encode(docs)).collect()
    assert sorted(((r.doc_id, bytes(r.decoded).decode()) for r in decoded), key=repr) == sorted(((k, t or "") for k, t in rows), key=repr)


def test_chunks_do_not_move_with_an_insertion():
    ids = np.random.default_rng(3).integers(0, 49000, 20000).astype(np.int32)
    cut = lambda x: {x[a:b].tobytes() for a, b in zip([0, *tokenstore.cuts(x)], tokenstore.cuts(x), strict=False)}
    moved = np.concatenate((np.arange(7, dtype=np.int32), ids))
    assert len(cut(ids) & cut(moved)) >= len(cut(ids)) - 3


def test_crc32_of_parts():
    parts = [b"alpha", b"", b"\0\0\0\0beta", b"x" * 4096]
    assert tokenstore.crc32_combined([(zlib.crc32(p), len(p)) for p in parts]) == zlib.crc32(b"".join(parts))


@pytest.mark.parametrize("window", [64, 4096])
def test_packing_is_gapless(awkward, words, window):
    texts = {r.doc_id: r.text for r in awkward.collect()}
    pieces = packing.pack(awkward, window=window).collect()
    by_document, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_document[p.doc_id].append(p)
        by_sequence[p.sequence_id].append(p)
    for key, text in texts.items():
        own = sorted(by_document[key], key=lambda p: p.start)
        ids = whole_ids(words, text)
        assert [i for p in own for i in np.frombuffer(p.ids, "<u4").tolist()] == ids
        assert all(p.doc_tokens == len(ids) and p.length == len(p.ids) // 4 for p in own)
    for number, found in by_sequence.items():
        at = 0
        for p in sorted(found, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at == window if number < max(by_sequence) else at <= window


def test_empty_tables(spark, nothing):
    assert bytebpe.encode(nothing).count() == 0
    assert packing.pack(nothing).count() == 0
    path = Scratch(spark).path("store")
    tokenstore.write(nothing, path)
    assert tokenstore.checksums(spark, path).count() == 0


def test_queries_agree_on_ids(spark, small, words):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    for row in queries.op4_token_store(spark, small).collect():
        ids = whole_ids(words, texts[row.doc_id])
        assert (row.n_tokens, row.ids_crc32) == (len(ids), crc(ids))
    for row in queries.op7_packing(spark, small).collect():
        ids = whole_ids(words, texts[row.doc_id])
        assert (row.doc_tokens, row.ids_crc32) == (len(ids), crc(ids[row.start : row.start + row.length]))
