"""Labelled rows for the classifiers: a bounded sample that depends on ids alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def crc_class(id_column: str, classes: int) -> Column:
    """crc32 of the id as text, modulo a number of classes; 0 for a null id."""
    text = F.coalesce(F.col(id_column).cast("string"), F.lit(""))
    return F.crc32(F.encode(text, "UTF-8")) % classes


def training_sample(labels: DataFrame, docs: DataFrame, label: str, learn: Column, rows: int,
                    id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """`id`, `label`, `text` of the `rows` labelled documents with the smallest hash of the id.

    Only rows for which `learn` holds and the label is 0 or 1; an id labelled twice takes the
    larger label, and one in several documents the smallest text. The sample has at most `rows` rows,
    so it can be broadcast and collected. Labels name the documents by `doc_id`.
    """
    ids = (
        labels.where(learn & F.col(label).isin(0, 1))
        .groupBy(F.col("doc_id").cast("long").alias("id"))
        .agg(F.max(label).cast("int").alias("label"))
        .where("id is not null")
        .orderBy(F.xxhash64("id"), "id")
        .limit(rows)
    )
    texts = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text"))
    return texts.join(F.broadcast(ids), "id").groupBy("id", "label").agg(F.min("text").alias("text"))
