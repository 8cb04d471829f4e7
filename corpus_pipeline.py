"""From raw documents to packed training sequences, as a chain of the operators."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from fleetlens.llm import exact_dedup, near_copies, packing, secret_scan, toxicity
from fleetlens.session import materialize


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go."""
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def one_of_equal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal text the one with the largest id stays."""
    return exact_dedup.drop_exact_duplicates(docs, stored=True)


def one_of_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of a group of near copies (five words, a similarity of 0.8) the document with the smallest id stays."""
    return near_copies.drop_near_copies(docs, stored=True)


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; secrets in their texts are replaced by their kind."""
    return secret_scan.redact_documents(docs)


def pack_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents with their ids, placed in sequences of 2048 tokens."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    return packing.pack_documents(docs, path).withColumn("ids_crc32", packing.ids_crc32())


STAGES = [
    ("toxicity", reject_toxic),
    ("exact dedup", one_of_equal),
    ("SimHash near-dedup", one_of_near),
    ("secret scan", hide_secrets),
    ("packing", pack_tokens),
]

#: A learned score, fingerprints and tokens can't be said in SQL; tests/llm/test_pipeline.py checks the stages instead.
ORACLE_SQL = None


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed training sequences: the last stage's rows, ids included."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialize(docs)
    return docs


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query: the rows of ``sequences``, with a digest of the placed ids in the ids' place."""
    return packing.piece_digests(sequences(spark, sf_dir).drop("ids_crc32"))
