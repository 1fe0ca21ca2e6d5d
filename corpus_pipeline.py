"""The corpus pipeline: language, exact and near duplicates, personal data, packing.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept and returns a
DataFrame, which ``run`` writes as Parquet to the shared folder and rereads as the next stage's docs.
All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from promptsieve.llm import grace, jaccard, langid, packing, pii
from promptsieve.llm.common import discard, documents, scope, ship, written


# Working tables of stages by the stage's name: their scope, and what tells that the stage's result was consumed.
WORKING: dict[str, list[tuple[str, Observation]]] = {}


def _working(result: DataFrame, stage: str, name: str) -> DataFrame:
    """The stage's result, whose working tables are in the scope ``name``."""
    consumed = Observation()
    WORKING.setdefault(stage, []).append((name, consumed))
    return result.observe(consumed, F.count(F.lit(1)).alias("rows"))


def _begun(spark: SparkSession, docs: DataFrame, before: str) -> None:
    """Ready the session and drop the working tables of the stage before, as far as its results were consumed.

    A result that nobody has read yet, of this run or another, keeps its tables, and so does one
    that ``docs`` reads directly instead of a written copy.
    """
    ship(spark)
    read = docs.inputFiles()
    kept = []
    for name, consumed in WORKING.pop(before, []):
        if consumed._jo.getRowOrEmpty().isEmpty() or any(f"/{name}/" in file for file in read):
            kept.append((name, consumed))
        else:
            discard(spark, name)
    if kept:
        WORKING[before] = kept


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts that are in no language (no letter, or worse than unknown bytes in every one)."""
    ship(spark)
    return langid.accepted(docs, langid.train(langid.sample(docs, F.lit(True))))


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of equal texts the row with the largest id."""
    _begun(spark, docs, "language")
    with scope("exact_duplicates") as name:
        return _working(grace.deduplicated(docs), "exact_duplicates", name)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of documents linked by a Jaccard index of 0.8 on five-word shingles the one with the smallest id."""
    _begun(spark, docs, "exact_duplicates")
    with scope("near_duplicates") as name:
        return _working(jaccard.deduplicated(docs, n=5, num=80, den=100), "near_duplicates", name)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by its kind in brackets and counts the characters anew."""
    _begun(spark, docs, "near_duplicates")
    return pii.masked(docs, pii.train()).withColumn("n_chars", F.length("text").cast("bigint"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 tokens, neighbours along the curve together, with their ids."""
    _begun(spark, docs, "personal_data")
    return packing.pieces(docs, public_tokenizers.path("byte_bpe_50k.tiktoken")).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "ids")


STAGES = [
    ("language", language),
    ("exact_duplicates", exact_duplicates),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("pack", pack),
]
# SQL expresses neither the language model nor the random field; the tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
