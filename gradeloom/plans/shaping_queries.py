"""Order, sampling and batches over `documents`, `labels`, `part` and `orders`."""

from __future__ import annotations

from pyspark.sql import functions as F

from gradeloom.operators import shaping as S
from gradeloom.operators.curation import word_count
from gradeloom.operators.ordering import with_global_index, with_shuffle_index
from gradeloom.plans.base import QuerySet, table
from gradeloom.plans.rollout_queries import rounded
from gradeloom.session import checkpointed, stored

QUERIES = QuerySet()


def hash_sql(key: str, seed: int) -> str:
    return f"('0x' || substr(md5('{seed}:' || {key}), 1, 13))::BIGINT"


def docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "source", "lang")


@QUERIES.add(
    "seeded_shuffle",
    f"SELECT doc_id, row_number() OVER (ORDER BY {hash_sql('doc_id', 42)}, doc_id) - 1 AS idx FROM documents",
)
def seeded_shuffle(spark, sf_dir):
    return with_shuffle_index(docs(spark, sf_dir).select("doc_id"), "doc_id", 42)


@QUERIES.add(
    "holdout_split",
    f"""WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY {hash_sql('doc_id', 42)} DESC, doc_id DESC) AS rn FROM documents)
        SELECT doc_id, CASE WHEN rn <= 200 THEN 'test' ELSE 'train' END AS split FROM r""",
)
def holdout_split(spark, sf_dir):
    train, test = S.holdout_split(docs(spark, sf_dir).select("doc_id"), "doc_id", 42, 200)
    return train.withColumn("split", F.lit("train")).unionByName(test.withColumn("split", F.lit("test")))


@QUERIES.add(
    "fraction_split",
    """WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS i, count(*) OVER () AS n FROM orders)
       SELECT o_orderkey, CASE WHEN i < floor(n * 0.75) THEN 'train' ELSE 'test' END AS split FROM r""",
)
def fraction_split(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    order = [F.col("o_totalprice"), F.col("o_orderkey")]
    train, test = S.fraction_split(o, order, 0.75)
    both = train.withColumn("split", F.lit("train")).unionByName(test.withColumn("split", F.lit("test")))
    return both.drop("o_totalprice")


@QUERIES.add("head", "SELECT doc_id, source FROM documents ORDER BY doc_id LIMIT 16")
def head(spark, sf_dir):
    return S.head(docs(spark, sf_dir), [F.col("doc_id")], 16).drop("lang")


@QUERIES.add(
    "sample_n", f"SELECT doc_id, lang FROM documents ORDER BY {hash_sql('doc_id', 7)}, doc_id LIMIT 50"
)
def sample_n(spark, sf_dir):
    return S.sample_n(docs(spark, sf_dir), "doc_id", 50, 7).drop("source")


@QUERIES.add(
    "log_sample", f"SELECT doc_id, source FROM documents ORDER BY {hash_sql('doc_id', 3)}, doc_id LIMIT 1"
)
def log_sample(spark, sf_dir):
    return S.log_sample(docs(spark, sf_dir), "doc_id", 3).drop("lang")


_WEIGHTS = {"en": 3.0, "fr": 1.0, "de": 0.5, "es": 2.0}


@QUERIES.add(
    "weighted_mixture",
    f"""WITH sizes AS (SELECT lang, count(*) AS n, CASE lang WHEN 'en' THEN 3.0 WHEN 'fr' THEN 1.0 WHEN 'de' THEN 0.5 ELSE 2.0 END AS w,
          CASE lang WHEN 'en' THEN 0 WHEN 'fr' THEN 1 WHEN 'de' THEN 2 ELSE 3 END AS i FROM documents GROUP BY 1),
        cuts AS (SELECT *, sum(w) OVER (ORDER BY i) / sum(w) OVER () AS hi, (sum(w) OVER (ORDER BY i) - w) / sum(w) OVER () AS lo FROM sizes),
        draws AS (SELECT range AS draw, {hash_sql('range', 5)} / 4503599627370496.0 AS u, {hash_sql('range', 6)} / 4503599627370496.0 AS v
          FROM range((SELECT CAST(sum(n) AS BIGINT) FROM sizes))),
        picked AS (SELECT draw, lang, CAST(floor(v * n) AS BIGINT) AS local_index FROM draws JOIN cuts ON u >= lo AND u < hi),
        rows AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS local_index FROM documents)
        SELECT draw, p.lang, p.local_index, doc_id FROM picked p JOIN rows r ON r.lang = p.lang AND r.local_index = p.local_index""",
)
def weighted_mixture(spark, sf_dir):
    d = docs(spark, sf_dir).drop("source")
    return S.weighted_mixture(d, "lang", "doc_id", _WEIGHTS, 5)


@QUERIES.add(
    "weighted_draws",
    """WITH s AS (SELECT lang, count(*) AS n_rows, CASE lang WHEN 'en' THEN 3.0 WHEN 'fr' THEN 1.0 WHEN 'de' THEN 0.5 ELSE 2.0 END AS w FROM documents GROUP BY 1)
       SELECT lang, n_rows, true AS near_share, (SELECT count(*) FROM documents) AS n_draws FROM s""",
)
def weighted_draws(spark, sf_dir):
    """Draws per language lie within six deviations of their share, and add up."""
    d = docs(spark, sf_dir).select("doc_id", "lang")
    drawn = stored(S.weighted_draws(d, "lang", "doc_id", _WEIGHTS, 5), "draws")
    total = S.row_count(drawn)
    p = F.create_map(*[x for k, v in _WEIGHTS.items() for x in (F.lit(k), F.lit(v))])[F.col("lang")] / F.lit(sum(_WEIGHTS.values()))
    sizes = d.groupBy("lang").agg(F.count(F.lit(1)).alias("n_rows"))
    near = F.abs(F.col("n") - total * p) <= 6 * F.sqrt(total * p * (1 - p))
    return drawn.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).join(sizes, "lang").select(
        "lang", "n_rows", near.alias("near_share"), total.alias("n_draws"))


@QUERIES.add(
    "mixture_lookup",
    """WITH rows AS (SELECT doc_id, lang, row_number() OVER (ORDER BY CASE lang WHEN 'fr' THEN 0 WHEN 'es' THEN 1 WHEN 'en' THEN 2 ELSE 3 END, doc_id) - 1 AS g,
         row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS local_index FROM documents)
       SELECT l.doc_id AS global_index, r.lang, local_index, r.doc_id FROM labels l JOIN rows r ON r.g = l.doc_id""",
)
def mixture_lookup(spark, sf_dir):
    wanted = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("global_index"))
    d = docs(spark, sf_dir).drop("source")
    return S.mixture_lookup(wanted, d, "lang", "doc_id", ["fr", "es", "en", "de"])


@QUERIES.add(
    "assign_batches",
    f"""WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY {hash_sql('doc_id', 1)}, doc_id) - 1 AS i, count(*) OVER () AS n FROM documents)
        SELECT doc_id, i // 32 AS batch, i % 32 AS place FROM r WHERE i // 32 < n // 32""",
)
def assign_batches(spark, sf_dir):
    return S.assign_batches(docs(spark, sf_dir).select("doc_id"), "doc_id", 1, 32)


_WORDS_SQL = "words AS (SELECT doc_id, len(string_split(text, ' ')) AS n_tokens FROM documents)"


def words(spark, sf_dir):
    """Lengths as a narrow stored table, so the texts are read once."""
    d = table(spark, sf_dir, "documents")
    return checkpointed(d.select("doc_id", word_count("text").cast("bigint").alias("n_tokens")))


_SERPENTINE = "CAST(CASE WHEN i % ({k} * 2) < {k} THEN i % ({k} * 2) ELSE {k} * 2 - 1 - i % ({k} * 2) END AS INTEGER)"


@QUERIES.add(
    "balanced_groups",
    f"""WITH {_WORDS_SQL}, r AS (SELECT *, row_number() OVER (ORDER BY n_tokens, doc_id) - 1 AS i FROM words)
        SELECT doc_id, n_tokens, {_SERPENTINE.format(k=8)} AS "group" FROM r""",
)
def balanced_groups(spark, sf_dir):
    return S.balanced_groups(words(spark, sf_dir), "n_tokens", "doc_id", 8)


@QUERIES.add(
    "token_budget_groups",
    f"""WITH {_WORDS_SQL}, r AS (SELECT *, row_number() OVER (ORDER BY n_tokens, doc_id) - 1 AS i,
          CAST(ceil(sum(n_tokens) OVER () / 16384.0) AS BIGINT) AS k FROM words)
        SELECT doc_id, n_tokens, {_SERPENTINE.format(k='k')} AS "group" FROM r""",
)
def token_budget_groups(spark, sf_dir):
    return S.token_budget_groups(words(spark, sf_dir), "n_tokens", "doc_id", 16384)


@QUERIES.add(
    "balance_stats",
    f"""WITH {_WORDS_SQL}, r AS (SELECT *, row_number() OVER (ORDER BY n_tokens, doc_id) - 1 AS i,
          row_number() OVER (ORDER BY doc_id) - 1 AS j, count(*) OVER () AS n FROM words),
        p AS (SELECT j // (n // 8) AS g, sum(n_tokens) AS s FROM r GROUP BY 1),
        b AS (SELECT {_SERPENTINE.format(k=8)} AS g, sum(n_tokens) AS s FROM r GROUP BY 1)
        SELECT CAST(min(s) AS BIGINT) AS min, CAST(max(s) AS BIGINT) AS max, CAST(max(s) - min(s) AS BIGINT) AS minmax_diff,
          (SELECT CAST(min(s) AS BIGINT) FROM b) AS balanced_min, (SELECT CAST(max(s) AS BIGINT) FROM b) AS balanced_max,
          round(sum(s) / 8, 4) AS mean FROM p""",
)
def balance_stats(spark, sf_dir):
    return rounded(S.balance_stats(words(spark, sf_dir), "n_tokens", "doc_id", 8), 4)


@QUERIES.add(
    "reorder_restore",
    f"SELECT doc_id, source, row_number() OVER (ORDER BY {hash_sql('doc_id', 9)}, doc_id) - 1 AS place FROM documents",
)
def reorder_restore(spark, sf_dir):
    """Shuffled places, applied and kept; `restore_order` would drop them again."""
    d = docs(spark, sf_dir).drop("lang")
    places = with_shuffle_index(d.select("doc_id"), "doc_id", 9, "place")
    return S.reorder(d, places, "doc_id")


@QUERIES.add(
    "pad_to_divisor",
    """WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i, count(*) OVER () AS n FROM documents),
       c AS (SELECT range AS p FROM range(384) WHERE range < (SELECT (384 - any_value(n) % 384) % 384 FROM r))
       SELECT doc_id, false AS is_pad, CAST(NULL AS BIGINT) AS pad_index FROM documents
       UNION ALL SELECT doc_id, true, p FROM c JOIN r ON r.i = p % n""",
)
def pad_to_divisor(spark, sf_dir):
    return S.pad_to_divisor(docs(spark, sf_dir).select("doc_id"), "doc_id", 384)


@QUERIES.add("unpad", "SELECT doc_id, lang FROM documents")
def unpad(spark, sf_dir):
    return S.unpad(S.pad_to_divisor(docs(spark, sf_dir).drop("source"), "doc_id", 384))


@QUERIES.add(
    "repeat_rows",
    """WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS idx, count(*) OVER () AS n FROM documents)
       SELECT doc_id, CAST(range AS INTEGER) AS rep, idx * 3 + range AS together, range * n + idx AS passes FROM r, range(3)""",
)
def repeat_rows(spark, sf_dir):
    d = with_global_index(docs(spark, sf_dir).select("doc_id"), [F.col("doc_id")])
    a = S.repeat_rows(d, "idx", 3).withColumnRenamed("place", "together").drop("idx")
    b = S.repeat_rows(d, "idx", 3, interleave=False).withColumnRenamed("place", "passes").drop("idx")
    return S.union_columns(
        a.withColumn("key", F.struct("doc_id", "rep")), b.withColumn("key", F.struct("doc_id", "rep")), "key"
    ).drop("key")


@QUERIES.add(
    "chunk",
    """SELECT o_orderkey, CAST((row_number() OVER (ORDER BY o_custkey, o_orderkey) - 1) // (SELECT count(*) // 5 FROM orders) AS INTEGER) AS chunk FROM orders""",
)
def chunk(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return S.chunk(o, [F.col("o_custkey"), F.col("o_orderkey")], 5).drop("o_custkey")


@QUERIES.add(
    "fold_unfold",
    """WITH r AS (SELECT doc_id, lang, row_number() OVER (ORDER BY doc_id) - 1 AS i FROM documents)
       SELECT i // 6 AS fold, CAST(i % 6 AS INTEGER) AS place, doc_id, lang FROM r""",
)
def fold_unfold(spark, sf_dir):
    d = docs(spark, sf_dir).drop("source")
    return S.unfold(S.fold(d, [F.col("doc_id")], 6))


@QUERIES.add(
    "union_columns",
    "SELECT doc_id, source, lang, n_chars FROM documents",
)
def union_columns(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return S.union_columns(d.select("doc_id", "source", "lang"), d.select("doc_id", "lang", "n_chars"), "doc_id")
