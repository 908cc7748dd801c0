"""A training corpus from raw documents: filter, dedup, pseudonyms, packed sequences.

Each stage gets the documents its predecessor kept; `run` writes each stage's documents to the
shared folder and reads them again, so a lost executor never repeats an earlier stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gradeloom.llm import exact_dedup, packing, pii, quality, simhash
from gradeloom.llm.batches import written
from gradeloom.llm.queries import PACKING_TOKENIZER, quality_rows


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.drop_low_quality(docs, labels, quality_rows())


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the smallest id."""
    return exact_dedup.drop_exact(docs)


def unlike_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near copies (fingerprints of three-word shingles, three bits apart or fewer) the one with the smallest id."""
    return simhash.drop_near_fingerprints(docs, words=3, max_bits=3)


def private_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal values under pseudonyms of the same format."""
    return pii.pseudonymize(docs)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of 1024-token sequences with their token ids, each window with the sources' own mixture."""
    return packing.pack(docs, PACKING_TOKENIZER, with_ids=True)


STAGES = [
    ("quality", good_documents),
    ("exact_dedup", distinct_documents),
    ("near_dedup", unlike_documents),
    ("pii", private_documents),
    ("packing", packed_sequences),
]

# Classifier, fingerprints and tokenizer are beyond SQL; tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed sequences of the whole `documents` table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
