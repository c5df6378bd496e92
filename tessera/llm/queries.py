"""The queries of this subpackage and, where SQL can express one, its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import brown, decontaminate, fill_middle, gif, language, licenses, mixing, pieces, prefix_trie, quality, sharding, simhash, token_files
from ._common import id_crc32, table

SHARDS = 24


def op1_shard_lpt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards of near-equal bytes, equal texts together."""
    return sharding.assign_shards(table(spark, sf_dir, "documents"), SHARDS).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_brown_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class-based and unigram log probabilities of every document; ids whose CRC-32 leaves 2 modulo 7 are held out of all counts."""
    model, found = brown.fit_and_score(table(spark, sf_dir, "documents"), id_crc32("doc_id") % 7 != 2)
    return found.select(
        "doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", F.lit(model.words.train_tokens).cast("long").alias("train_tokens"), "base_score", "score", "perplexity", F.lit(model.passes).alias("passes"), F.lit(model.likelihoods[-1] - model.likelihoods[0]).alias("likelihood_rise"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document; ids whose CRC-32 leaves 2 modulo 4 are held out of the fit."""
    docs = table(spark, sf_dir, "documents").withColumn("held_out", id_crc32("doc_id") % 4 == 2)
    model = quality.fit_quality(docs, table(spark, sf_dir, "labels"), ~F.col("held_out"))
    return quality.scores(docs, model).select("doc_id", (id_crc32("doc_id") % 4 == 2).alias("held_out"), "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"))


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a mix of the sources at weights 5, 2, 1 takes of every document."""
    return mixing.mix(table(spark, sf_dir, "documents"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document; ids whose CRC-32 leaves 2 modulo 4 are held out of the dictionaries."""
    docs = table(spark, sf_dir, "documents")
    model = language.fit_languages(docs, id_crc32("doc_id") % 4 != 2)
    return language.identify(docs, model).select("doc_id", (id_crc32("doc_id") % 4 == 2).alias("held_out"), "lang_pred", "score", "rejected")


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of all documents, written to segments with Elias-Fano boundaries and read back."""
    import public_tokenizers

    return token_files.read_segments(token_files.write_segments(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item that a document leaks."""
    return decontaminate.leaked_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_gif_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All texts stored as GIF frames and read back, with digests and histograms of what was read."""
    return gif.read_digests(gif.store_texts(table(spark, sf_dir, "documents")))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every license notice in every document."""
    return licenses.scan(table(spark, sf_dir, "documents"))


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op11_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of every document with the bytes they stand for, and the text they decode to."""
    import public_tokenizers

    model = public_tokenizers.path("piece_bpe_32k.model")
    found = pieces.encode(table(spark, sf_dir, "documents"), model, decode=True)
    hexed = lambda text: F.sha2(text, 256)
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), hexed(F.array_join("ids", ",")).alias("ids_sha256"), hexed(F.col("decoded")).alias("decoded_sha256"),
                        hexed(F.concat_ws(" ", F.array_join("begins", ","), F.array_join("ends", ","))).alias("spans_sha256"))


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the trie of rebuilt conversations."""
    nodes = prefix_trie.conversation_trie(table(spark, sf_dir, "conversations"))
    return nodes.select(*[F.col(c) if c == "ends_sha256" else F.col(c).cast("long").alias(c) for c in nodes.columns])


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document cut into prefix, middle and suffix and put in another order, and put back."""
    made = fill_middle.fill_in_middle(table(spark, sf_dir, "documents"))
    digest = lambda text: F.sha2(text, 256)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(fill_middle.restored(F.col("form"), F.col("output"))).alias("restored_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_shard_lpt": op1_shard_lpt,
    "op2_language_id": op2_language_id,
    "op3_token_files": op3_token_files,
    "op4_decontaminate": op4_decontaminate,
    "op5_gif_frames": op5_gif_frames,
    "op6_license_scan": op6_license_scan,
    "op7_simhash_near_dedup": op7_simhash_near_dedup,
    "op8_brown_lm": op8_brown_lm,
    "op9_quality_classifier": op9_quality_classifier,
    "op10_mix_sources": op10_mix_sources,
    "op11_sentencepiece": op11_sentencepiece,
    "op12_conversation_trie": op12_conversation_trie,
    "op13_fill_in_middle": op13_fill_in_middle,
}
ORACLE_SQL: dict[str, str] = {"op10_mix_sources": mixing.ORACLE, "op12_conversation_trie": prefix_trie.ORACLE}
