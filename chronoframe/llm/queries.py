"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoframe.llm import bytebpe, embeddedup, kmeans, langid, linededup, merkle, ngramjoin, ogg, packing, quality, tokenstore, toxicity, windows
from chronoframe.llm.common import Scratch, in_fold


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document: doc_id, held_out, lang_pred, score."""
    docs = _table(spark, sf_dir, "documents")
    held = in_fold(F.col("doc_id"), 4, 2)
    model = langid.fit(docs.filter(~held).select("doc_id", "text", "lang"))
    return langid.predict(docs, model).select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text encoded and decoded again: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    decoded = bytebpe.decode(bytebpe.encode(_table(spark, sf_dir, "documents")))
    return decoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without its later repeated runs of lines."""
    return linededup.dedup_lines(_table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_removed")


def op4_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All texts' ids written to a content-addressed store and read back: doc_id, start, n_tokens, ids_crc32."""
    path = Scratch(spark).path("store")
    tokenstore.write(_table(spark, sf_dir, "documents"), path)
    return tokenstore.checksums(spark, path)


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links, component and decision of every vector."""
    return embeddedup.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op6_ogg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text stored as Ogg samples and read back."""
    loaded = ogg.load(ogg.store(_table(spark, sf_dir, "documents")))
    return loaded.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -16, 16)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
        "damage",
    )


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in windows of 4096 ids, with the ids' checksum instead of the ids."""
    pieces = packing.pack(_table(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document: doc_id, held_out, score, predicted."""
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels").filter(~in_fold(F.col("doc_id"), 3, 1)))
    return toxicity.score(docs, model).select("doc_id", in_fold(F.col("doc_id"), 3, 1).alias("held_out"), "score", "predicted")


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class and number of near duplicates of every document."""
    return ngramjoin.near_duplicates(_table(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document: doc_id, held_out, score, predicted."""
    docs = _table(spark, sf_dir, "documents")
    machine = quality.fit(docs, _table(spark, sf_dir, "labels").filter(~in_fold(F.col("doc_id"), 4, 2)))
    return quality.score(docs, machine).select("doc_id", in_fold(F.col("doc_id"), 4, 2).alias("held_out"), "score", "predicted")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, roots and proof of every document, folded again from a copy that was tampered with."""
    return merkle.tamper_check(_table(spark, sf_dir, "documents"))


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that a window of an earlier one repeats."""
    cut = windows.dedup_windows(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op13_exponion_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster, distance and inertia of every vector."""
    return kmeans.cluster(_table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_byte_bpe": op2_byte_bpe,
    "op3_line_dedup": op3_line_dedup,
    "op4_token_store": op4_token_store,
    "op5_embedding_dedup": op5_embedding_dedup,
    "op6_ogg_media": op6_ogg_media,
    "op7_packing": op7_packing,
    "op8_toxicity": op8_toxicity,
    "op9_ngram_join": op9_ngram_join,
    "op10_quality": op10_quality,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_substring_dedup": op12_substring_dedup,
    "op13_exponion_clusters": op13_exponion_clusters,
}

ORACLES: dict[str, str] = {
    "op3_line_dedup": linededup.ORACLE,
    "op5_embedding_dedup": embeddedup.ORACLE,
    "op9_ngram_join": ngramjoin.ORACLE,
    "op11_merkle_manifest": merkle.ORACLE,
    "op13_exponion_clusters": kmeans.ORACLE,
}
