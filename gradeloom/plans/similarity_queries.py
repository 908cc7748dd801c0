"""Nearest neighbours over `embeddings`."""

from __future__ import annotations

from pyspark.sql import functions as F

from gradeloom.operators import similarity as S
from gradeloom.plans.base import QuerySet, table

QUERIES = QuerySet()

TAU = 0.30

_COS = "list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"


def vectors(spark, sf_dir):
    return S.unit_vectors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")


@QUERIES.add(
    "cosine_topk",
    f"""WITH p AS (SELECT a.vec_id AS query, b.vec_id AS doc, {_COS} AS s FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id),
        k AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY s DESC, doc) AS rank FROM p)
        SELECT query, doc, round(s, 6) AS score, CAST(rank AS INTEGER) AS rank FROM k WHERE rank <= 3""",
)
def cosine_topk(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return S.cosine_topk(v, v, 3, exclude_self=True).withColumn("score", F.round("score", 6))


@QUERIES.add(
    "cosine_topk_between",
    f"""WITH p AS (SELECT a.item AS query, b.vec_id AS doc, {_COS} AS s FROM (SELECT label AS item, first(embedding ORDER BY vec_id) AS embedding FROM embeddings GROUP BY 1) a, embeddings b),
        k AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY s DESC, doc) AS rank FROM p)
        SELECT CAST(query AS BIGINT) AS query, doc, round(s, 6) AS score, CAST(rank AS INTEGER) AS rank FROM k WHERE rank <= 10""",
)
def cosine_topk_between(spark, sf_dir):
    """Queries and documents of different tables: one query per label."""
    e = table(spark, sf_dir, "embeddings")
    asked = e.groupBy(F.col("label").cast("bigint").alias("item")).agg(F.min_by("embedding", "vec_id").alias("embedding"))
    queries = S.unit_vectors(asked, "item", "embedding")
    return S.cosine_topk(queries, vectors(spark, sf_dir), 10).withColumn("score", F.round("score", 6))


@QUERIES.add(
    "exclude_similar",
    f"""SELECT vec_id AS id FROM embeddings a WHERE label <> 0 AND NOT EXISTS
        (SELECT 1 FROM embeddings b WHERE b.label = 0 AND {_COS} > {TAU})""",
)
def exclude_similar(spark, sf_dir):
    """Label 0 is the benchmark, all others are candidates."""
    e = table(spark, sf_dir, "embeddings")
    candidates = S.unit_vectors(e.where("label <> 0"), "vec_id", "embedding")
    reference = S.unit_vectors(e.where("label = 0"), "vec_id", "embedding")
    return S.exclude_similar(candidates, reference, TAU).select("id")


@QUERIES.add(
    "dedup_similar",
    f"""WITH RECURSIVE p AS (SELECT a.vec_id AS src, b.vec_id AS dst, {_COS} AS s FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id),
        k AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY s DESC, dst) AS rank FROM p),
        t AS MATERIALIZED (SELECT src, list(dst) AS targets FROM k WHERE rank <= 4 AND s > {TAU} GROUP BY 1),
        o AS MATERIALIZED (SELECT vec_id, row_number() OVER (ORDER BY vec_id) AS i, coalesce(targets, []::BIGINT[]) AS targets
          FROM embeddings LEFT JOIN t ON src = vec_id),
        w(i, removed) AS (SELECT CAST(0 AS BIGINT), []::BIGINT[] UNION ALL
          SELECT o.i, CASE WHEN list_contains(removed, o.vec_id) THEN removed ELSE list_concat(removed, o.targets) END
          FROM w JOIN o ON o.i = w.i + 1)
        SELECT vec_id AS id FROM embeddings WHERE NOT list_contains((SELECT arg_max(removed, i) FROM w), vec_id)""",
)
def dedup_similar(spark, sf_dir):
    return S.dedup_similar(vectors(spark, sf_dir), TAU, 5).select("id")


@QUERIES.add(
    "exclude_matched_bad",
    "SELECT vec_id AS id FROM embeddings WHERE label <> 3",
)
def exclude_matched_bad(spark, sf_dir):
    v = vectors(spark, sf_dir)
    bad = S.unit_vectors(table(spark, sf_dir, "embeddings").where("label = 3"), "vec_id", "embedding")
    # The bad list comes with ids of its own and vectors of another length.
    bad = bad.select((F.col("id") + 10_000_000).alias("id"), "vec")
    return S.exclude_matched_bad(v, bad).select("id")
