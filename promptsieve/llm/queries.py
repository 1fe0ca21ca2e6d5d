"""Registered queries of the corpus operators, with production parameters, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from promptsieve.llm import bpe, grace, imatch, jaccard, langid, licenses, mixing, packing, passages, pii, toxicity, tries, zones
from promptsieve.llm.common import crc_of_id, documents, ship


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(documents(spark, sf_dir))


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.classes(documents(spark, sf_dir), n=4, num=85, den=100).select(
        "doc_id", "n_shingles", "component_id")


def op3_compression_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = documents(spark, sf_dir), crc_of_id("doc_id", 5) == 0
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.train(toxicity.sample(docs, labels, ~held_out))
    return toxicity.scores(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op4_grace_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grace.duplicates(documents(spark, sf_dir))


def op5_compact_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated(documents(spark, sf_dir))


def op6_crf_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.detected(documents(spark, sf_dir), pii.train())


def op7_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.fingerprints(documents(spark, sf_dir))


def op8_ppm_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held_out = crc_of_id("doc_id", 4) == 2
    model = langid.train(langid.sample(docs, ~held_out))
    return langid.predictions(docs, model).select(
        "doc_id", held_out.alias("held_out"), "lang_pred", "score", "bits_per_byte")


def op9_hilbert_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pieces(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken")).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op10_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op11_systematic_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.copies(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op12_zone_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return zones.clusters(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return tries.trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


QUERIES = {f.__name__: f for f in (
    op1_license_scan, op2_ngram_jaccard, op3_compression_toxicity, op4_grace_dedup, op5_compact_windows, op6_crf_pii, op7_imatch, op8_ppm_language, op9_hilbert_packing, op10_bpe_round_trip,
    op11_systematic_mix, op12_zone_clusters, op13_prefix_trie,
)}
ORACLES = {
    "op1_license_scan": licenses.oracle(),
    "op2_ngram_jaccard": jaccard.ORACLE,
    "op4_grace_dedup": grace.ORACLE,
    "op11_systematic_mix": mixing.ORACLE,
    "op12_zone_clusters": zones.oracle(),
    "op13_prefix_trie": tries.ORACLE,
}
