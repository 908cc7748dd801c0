"""The registered queries of the pipeline's operators, over their whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeloom.llm import bpe, curves, exact_dedup, html_text, line_dedup, merkle, packing
from gradeloom.llm import periodic_runs, pieces, pii, quality, simhash, toxicity
from gradeloom.llm.labelled import crc_class
from gradeloom.plans.base import QuerySet, table

QUERIES = QuerySet()

PACKING_TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def quality_rows() -> Column:
    """Rows of `labels` that the quality classifier may learn from."""
    return crc_class("doc_id", 3) != 1


def toxicity_rows() -> Column:
    """Rows of `labels` that the toxicity classifier may learn from."""
    return crc_class("doc_id", 5) != 0


@QUERIES.add("op1_exact_dedup", r"""
WITH d AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id,
       count(*) OVER (PARTITION BY t) AS group_size,
       row_number() OVER (PARTITION BY t ORDER BY doc_id) = 1 AS kept, sha256(t) AS text_sha256
FROM d""")
def op1_exact_dedup(spark, sf_dir) -> DataFrame:
    return exact_dedup.exact_classes(table(spark, sf_dir, "documents"))


@QUERIES.add("op2_simhash_near_dedup")
def op2_simhash_near_dedup(spark, sf_dir) -> DataFrame:
    return simhash.near_classes(table(spark, sf_dir, "documents"))


@QUERIES.add("op3_pii_pseudonyms")
def op3_pii_pseudonyms(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("kinds", pii.personal_values(F.col("text")))
    return pii.pseudonymize(docs).select("doc_id", "text", "kinds")


@QUERIES.add("op4_mixture_packing")
def op4_mixture_packing(spark, sf_dir) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), PACKING_TOKENIZER)


@QUERIES.add("op5_quality_votes")
def op5_quality_votes(spark, sf_dir) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return quality.score_quality(docs, labels, quality_rows()).select(
        "doc_id", (crc_class("doc_id", 3) == 1).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


@QUERIES.add("op6_html_main_text")
def op6_html_main_text(spark, sf_dir) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


@QUERIES.add("op7_curve_neighbours")
def op7_curve_neighbours(spark, sf_dir) -> DataFrame:
    return curves.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


@QUERIES.add("op8_byte_pairs")
def op8_byte_pairs(spark, sf_dir) -> DataFrame:
    encoded = bpe.encode(table(spark, sf_dir, "documents"), RANKS, public_tokenizers.PATTERN)
    return bpe.decode(encoded, RANKS, public_tokenizers.PATTERN).select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@QUERIES.add("op9_line_dedup")
def op9_line_dedup(spark, sf_dir) -> DataFrame:
    return line_dedup.drop_repeats(table(spark, sf_dir, "documents")).select(
        "doc_id", "text", "removed_spans"
    )


@QUERIES.add("op10_toxicity")
def op10_toxicity(spark, sf_dir) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return toxicity.score_toxicity(docs, labels, toxicity_rows()).select(
        "doc_id", (crc_class("doc_id", 5) == 0).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"), "neighbours", "terms",
    )


@QUERIES.add("op11_sentence_pieces")
def op11_sentence_pieces(spark, sf_dir) -> DataFrame:
    encoded = pieces.encode(table(spark, sf_dir, "documents"), PIECES, with_decoded=True)
    return encoded.select(
        "doc_id", "n_tokens",
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """Every tenth document by its checksum repeats a stretch of its own words to the end."""
    h = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8"))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    rows = docs.select("doc_id", "text", h.alias("h"), F.floor(h / 10).alias("g"),
                       F.when(h % 10 == 0, words).alias("words"))
    n = F.size("words")
    rows = rows.withColumn("a", F.when(n > 0, F.col("g") % n))
    rows = rows.withColumn("p", 1 + F.floor((n - F.col("a")) / (3 + F.col("g") % 8)))
    planted = F.transform("words", lambda w, i: F.when(i < F.col("a"), w).otherwise(
        F.get("words", (F.col("a") + (i - F.col("a")) % F.col("p")).cast("int"))))
    return rows.select("doc_id", F.when(n > 0, F.array_join(planted, " ")).otherwise(F.col("text")).alias("text"))


@QUERIES.add("op12_periodic_runs")
def op12_periodic_runs(spark, sf_dir) -> DataFrame:
    found = periodic_runs.find_runs(with_planted_runs(table(spark, sf_dir, "documents")))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(
        r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(
        F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    best = found.withColumn("best", longest)
    length, period = F.col("best.length"), -F.col("best.period")
    return best.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"),
        length.alias("length"), period.alias("period"),
        F.floor(1000 * length / period).alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


# The check folds level by level; a tree of this many levels has 8 ** 8 leaves or fewer.
_SQL_LEVELS = 8


def _sql_leaf(text: str) -> str:
    def field(c: str) -> str:
        v = f"CAST({c} AS VARCHAR)"
        return f"coalesce(strlen({v}) || ':' || {v}, '-')"

    return "sha256(" + " || ".join(field(c) for c in ["doc_id", "source", "lang", "n_chars", text]) + ")"


def _merkle_sql() -> str:
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    # CRC-32, bit by bit over the bytes of the decimal id.
    byte = "flatten(list_transform(range(1, strlen(CAST(doc_id AS VARCHAR)) + 1), " \
           "lambda i: [CAST(ascii(CAST(doc_id AS VARCHAR)[i]) AS UBIGINT), 0, 0, 0, 0, 0, 0, 0]))"
    crc = f"xor(list_reduce(list_prepend(4294967295::UBIGINT, {byte}), " \
          "lambda a, x: xor(xor(a, x) >> 1, 3988292384::UBIGINT * (xor(a, x) & 1))), 4294967295::UBIGINT)"

    def levels(name: str, first: str, key: str) -> list[str]:
        """CTEs of a forest's levels: (key, place, digest); a tree stops at one node."""
        out = [f"{name}0 AS MATERIALIZED ({first})"]
        for i in range(1, _SQL_LEVELS + 1):
            out.append(f"""{name}{i} AS MATERIALIZED (
  SELECT {key}, place // 8 AS place, sha256(string_agg(digest, '' ORDER BY place)) AS digest
  FROM (SELECT *, count(*) OVER (PARTITION BY {key}) AS n FROM {name}{i - 1}) WHERE n > 1
  GROUP BY {key}, place // 8)""")
        return out

    def steps(name: str, key: str, base: int) -> str:
        """Per node what its run holds before and behind it, by level; one node has no step."""
        return " UNION ALL ".join(
            f"""SELECT {base + i} AS level, {key}, place, n,
  coalesce(string_agg(digest, '') OVER (PARTITION BY {key}, place // 8 ORDER BY place
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before,
  coalesce(string_agg(digest, '') OVER (PARTITION BY {key}, place // 8 ORDER BY place
    ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS behind
  FROM (SELECT *, count(*) OVER (PARTITION BY {key}) AS n FROM {name}{i})"""
            for i in range(_SQL_LEVELS))

    roots = " UNION ALL ".join(
        f"SELECT lang, digest FROM (SELECT *, count(*) OVER (PARTITION BY lang) AS n FROM a{i}) WHERE n = 1"
        for i in range(_SQL_LEVELS + 1))
    root = " UNION ALL ".join(
        f"SELECT digest FROM (SELECT *, count(*) OVER (PARTITION BY one) AS n FROM t{i}) WHERE n = 1"
        for i in range(_SQL_LEVELS + 1))
    parts = [
        f"""leaves AS MATERIALIZED (
  SELECT doc_id, lang, {_sql_leaf('text')} AS leaf,
         CASE WHEN {crc} % 3 = 0 THEN {_sql_leaf(lower)} ELSE {_sql_leaf('text')} END AS changed,
         row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS place FROM documents)""",
        *levels("a", "SELECT lang, place, leaf AS digest FROM leaves", "lang"),
        f"subroots AS MATERIALIZED ({roots})",
        *levels("t", """SELECT 1 AS one, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS place, digest
  FROM subroots""", "one"),
        f"root AS ({root})",
        """langs AS (SELECT lang, digest, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS top FROM subroots)""",
        f"low AS MATERIALIZED ({steps('a', 'lang', 0)})",
        f"high AS MATERIALIZED ({steps('t', 'one', _SQL_LEVELS)})",
        """proofs AS MATERIALIZED (
  SELECT l.doc_id, s.level, s.before, s.behind FROM leaves l JOIN low s
    ON l.lang IS NOT DISTINCT FROM s.lang AND s.place = l.place // CAST(pow(8, s.level) AS BIGINT) AND s.n > 1
  UNION ALL
  SELECT l.doc_id, s.level, s.before, s.behind FROM leaves l
    JOIN langs g ON l.lang IS NOT DISTINCT FROM g.lang
    JOIN high s ON s.place = g.top // CAST(pow(8, s.level - %d) AS BIGINT) AND s.n > 1)""" % _SQL_LEVELS,
        "f0 AS MATERIALIZED (SELECT doc_id, changed AS digest FROM leaves)",
    ]
    for i in range(2 * _SQL_LEVELS):
        parts.append(f"""f{i + 1} AS MATERIALIZED (
  SELECT f.doc_id, CASE WHEN p.level IS NULL THEN f.digest ELSE sha256(p.before || f.digest || p.behind) END AS digest
  FROM f{i} f LEFT JOIN proofs p ON p.doc_id = f.doc_id AND p.level = {i})""")
    return "WITH " + ",\n".join(parts) + f"""
SELECT l.doc_id, l.leaf, g.digest AS subroot, r.digest AS root,
       sha256(coalesce(p.siblings, '')) AS proof_sha256, f.digest AS folded_root, f.digest = r.digest AS verified
FROM leaves l JOIN langs g ON l.lang IS NOT DISTINCT FROM g.lang CROSS JOIN root r
JOIN f{2 * _SQL_LEVELS} f ON f.doc_id = l.doc_id
LEFT JOIN (SELECT doc_id, string_agg(before || behind, '' ORDER BY level) AS siblings FROM proofs GROUP BY doc_id) p
  ON p.doc_id = l.doc_id"""


@QUERIES.add("op13_merkle_manifest", _merkle_sql())
def op13_merkle_manifest(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    others = {c: F.col(c) for c in merkle.FIELDS} | {"text": F.translate("text", upper, upper.lower())}
    forged = F.when(crc_class("doc_id", 3) == 0, merkle.leaf_hash(*others.values()))
    rows = merkle.manifest(docs, extra={"forged": forged})
    folded = rows.withColumn("folded_root", merkle.folded(F.coalesce("forged", "leaf"), F.col("proof")))
    return folded.select(
        "doc_id", "leaf", "subroot", "root", merkle.proof_hash(F.col("proof")).alias("proof_sha256"),
        "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
