"""The corpus pipeline: quality classifier, near-duplicates, repeated passages,
mixing, byte-level BPE. Each stage takes (spark, docs, sf_dir) and returns a
DataFrame that is written as Parquet and read again as the next one's docs.

Stages but the last return the columns of ``documents``; the last returns the
token ids. Edge cases are those of the operators: rows with null or empty text
are rejected by the first stage, rows without doc_id pass the duplicate stages,
an empty table gives an empty table, extra columns are kept up to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from budgetlens.llm import bpe, kneserney, mixing, passages, superminhash
from budgetlens.llm.common import prepare, read_table, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the Kneser-Ney classifier keeps; trusted text is what
    ``labels`` calls good and not toxic."""
    return kneserney.keep_good(docs, kneserney.trusted_of(read_table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    prepare(spark)
    return superminhash.deduplicated(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier document holds."""
    prepare(spark)
    return passages.remove_passages(docs, passages.repeated_passages(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, lang, n_tokens, ids (little-endian unsigned 32-bit) and
    digests of the ids and of the text decoded from them."""
    prepare(spark)
    coded = bpe.encode_decode(docs.select("doc_id", "source", "lang", "text"))
    return coded.select("doc_id", "source", "lang", "n_tokens", "ids", bpe.sha256_hex("ids").alias("ids_sha256"),
                        bpe.sha256_hex("decoded").alias("decoded_sha256"))


STAGES = [
    ("quality classifier", quality),
    ("near-duplicates", near_duplicates),
    ("repeated passages", repeated_passages),
    ("source mix", mix_sources),
    ("byte-level bpe", encode),
]

#: SQL cannot express the stages; tests/llm/test_pipeline.py checks them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``."""
    docs = read_table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = table(docs, f"stage{i}")
    return docs
