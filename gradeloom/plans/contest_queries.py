"""Contests: one per market segment, its customers as handles, balances as ratings."""

from __future__ import annotations

from pyspark.sql import functions as F

from gradeloom.operators import contests as C
from gradeloom.operators.skew import with_group_index
from gradeloom.plans.base import QuerySet, table
from gradeloom.plans.rollout_queries import rounded
from gradeloom.sources.problems import read_rating_histogram

QUERIES = QuerySet()

_SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
_CASE = "CASE c_mktsegment " + " ".join(f"WHEN '{s}' THEN {i}" for i, s in enumerate(_SEGMENTS)) + " ELSE 9 END"

CONTEST_SQL = f"""standings AS (SELECT CAST({_CASE} AS BIGINT) AS contest, c_custkey AS handle,
    floor(c_acctbal / 10) AS points, CAST(c_nationkey AS DOUBLE) AS penalty FROM customer WHERE c_nationkey <> 7),
  changes AS (SELECT CAST({_CASE} AS BIGINT) AS contest, c_custkey AS handle, CAST(greatest(floor(c_acctbal / 3), 0) AS INTEGER) AS old_rating
    FROM customer WHERE c_nationkey <> 9),
  s AS (SELECT * FROM standings x WHERE EXISTS (SELECT 1 FROM changes y WHERE y.contest = x.contest AND y.handle = x.handle)),
  c AS (SELECT * FROM changes x WHERE EXISTS (SELECT 1 FROM standings y WHERE y.contest = x.contest AND y.handle = x.handle)),
  big AS (SELECT contest FROM s GROUP BY 1 HAVING count(*) > 200),
  ks AS (SELECT *, row_number() OVER (PARTITION BY contest ORDER BY points DESC, penalty, handle) - 1 AS place FROM s WHERE contest IN (SELECT contest FROM big)),
  kc AS (SELECT * FROM c WHERE contest IN (SELECT contest FROM big))"""

# The model's tries: one problem per part, in the contest given by its size.
MODEL_SQL = """tries AS (SELECT CAST(p_size % 5 AS BIGINT) AS contest, p_partkey, [p_partkey % 3 = 0, p_partkey % 4 = 0, p_partkey % 5 = 0] AS st,
    CASE WHEN p_partkey % 2 = 0 THEN NULL ELSE p_retailprice / 100 END AS points FROM part),
  firsts AS (SELECT *, coalesce(list_position(st, true), 0) - 1 AS i FROM tries),
  model AS (SELECT contest, round(sum(CASE WHEN i < 0 THEN 0 WHEN points IS NULL THEN 1 ELSE greatest(points - 50 * i, 0) END), 4) AS score,
    CAST(sum(CASE WHEN i >= 0 AND points IS NULL THEN 10 * i ELSE 0 END) AS DOUBLE) AS penalty FROM firsts GROUP BY 1)"""


def _contest():
    return F.expr(f"CAST({_CASE} AS BIGINT)").alias("contest")


def standings_and_changes(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    standings = c.where("c_nationkey <> 7").select(
        _contest(), F.col("c_custkey").alias("handle"),
        F.floor(F.col("c_acctbal") / 10).cast("double").alias("points"),
        F.col("c_nationkey").cast("double").alias("penalty"),
    )
    changes = c.where("c_nationkey <> 9").select(
        _contest(), F.col("c_custkey").alias("handle"),
        F.greatest(F.floor(F.col("c_acctbal") / 3), F.lit(0)).cast("int").alias("old_rating"),
    )
    return standings, changes


def kept(spark, sf_dir):
    s, c = C.common_handles(*standings_and_changes(spark, sf_dir))
    order = [F.lit(0.0) - F.col("points"), F.col("penalty"), F.col("handle")]
    return with_group_index(s, ["contest"], order, "place"), c


def _submissions(spark, sf_dir):
    key = F.col("p_partkey")
    p = table(spark, sf_dir, "part").select(
        F.concat((F.col("p_size") % 5).cast("string"), F.lit("P"), key.cast("string")).alias("problem_id"),
        F.array(key % 3 == 0, key % 4 == 0, key % 5 == 0).alias("statuses"),
        F.when(key % 2 != 0, F.col("p_retailprice") / 100).alias("points"),
    )
    return C.group_by_contest(p.drop("points")), C.group_by_contest(p.drop("statuses"))


def model_scores(spark, sf_dir):
    scores = C.contest_score(*_submissions(spark, sf_dir), attempts=3)
    return scores.withColumn("score", F.round("score", 4))


@QUERIES.add(
    "group_by_contest",
    """SELECT CAST(p_size % 5 AS BIGINT) AS contest, (p_size % 5) || 'P' || p_partkey AS problem_id, p_partkey % 3 = 0 AS first FROM part""",
)
def group_by_contest(spark, sf_dir):
    rows, _ = _submissions(spark, sf_dir)
    return rows.select("contest", "problem_id", F.col("statuses")[0].alias("first"))


@QUERIES.add("intersect_handles", f"WITH {CONTEST_SQL} SELECT contest, handle FROM s")
def intersect_handles(spark, sf_dir):
    return C.intersect_handles(*standings_and_changes(spark, sf_dir))


@QUERIES.add(
    "common_handles",
    f"""WITH {CONTEST_SQL} SELECT ks.contest, ks.handle, points, old_rating FROM ks JOIN kc ON kc.contest = ks.contest AND kc.handle = ks.handle""",
)
def common_handles(spark, sf_dir):
    s, c = C.common_handles(*standings_and_changes(spark, sf_dir))
    return s.join(c, ["contest", "handle"]).drop("penalty")


@QUERIES.add("contest_score", f"WITH {MODEL_SQL} SELECT * FROM model")
def contest_score(spark, sf_dir):
    return model_scores(spark, sf_dir)


_RANK_SQL = """ranks AS (SELECT k.contest, coalesce(min(CASE WHEN k.points < m.score OR (k.points = m.score AND k.penalty > m.penalty) THEN place END), count(*)) AS rank, count(*) AS n
    FROM ks k JOIN m ON m.contest = k.contest GROUP BY 1)"""
# The model's score, brought to the scale of the standings.
_SCALED = "m AS (SELECT contest, score / @ AS score, penalty FROM model)"


def ranked(spark, sf_dir, scale):
    s, c = kept(spark, sf_dir)
    model = model_scores(spark, sf_dir).withColumn("score", F.col("score") / scale)
    return C.standing_rank(s, model), c


@QUERIES.add(
    "standing_rank",
    f"WITH {CONTEST_SQL}, {MODEL_SQL}, {_SCALED.replace('@', '3.0')}, {_RANK_SQL} SELECT * FROM ranks",
)
def standing_rank(spark, sf_dir):
    return ranked(spark, sf_dir, 3.0)[0]


def _elo_sql(scale: str) -> str:
    return f"""{CONTEST_SQL}, {MODEL_SQL}, {_SCALED.replace('@', scale)}, {_RANK_SQL},
      tops AS (SELECT contest, max(old_rating) AS top FROM kc GROUP BY 1),
      b(contest, rank, l, r) AS (SELECT t.contest, rank, 0, top + 100 FROM tops t JOIN ranks k ON k.contest = t.contest
        UNION ALL SELECT x.contest, x.rank, CASE WHEN x.seed < x.rank THEN x.l ELSE (x.l + x.r) // 2 END,
          CASE WHEN x.seed < x.rank THEN (x.l + x.r) // 2 ELSE x.r END
        FROM (SELECT b.contest, b.rank, b.l, b.r, 1 + sum(1 / (1 + pow(10, ((b.l + b.r) // 2 - kc.old_rating) / 400.0))) AS seed
          FROM b JOIN kc ON kc.contest = b.contest WHERE b.r - b.l > 1 GROUP BY ALL) x),
      elos AS (SELECT contest, CAST(max(l) AS BIGINT) AS elo FROM b GROUP BY 1)"""


@QUERIES.add("elo_rating", f"WITH RECURSIVE {_elo_sql('3.0')} SELECT * FROM elos")
def elo_rating(spark, sf_dir):
    ranks, changes = ranked(spark, sf_dir, 3.0)
    return C.elo_rating(changes, ranks)


@QUERIES.add(
    "rating_percentile",
    """SELECT s_suppkey, s_acctbal AS rating, round_even((SELECT count(*) FROM customer WHERE c_acctbal < s_acctbal) / (SELECT count(*) FROM customer) * 100, 1) AS percentile
       FROM supplier""",
)
def rating_percentile(spark, sf_dir):
    ratings = table(spark, sf_dir, "customer").select(F.col("c_acctbal").alias("rating"), F.lit(1).alias("n"))
    asked = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_acctbal").alias("rating"))
    return C.rating_percentile(ratings, asked, "s_suppkey")


@QUERIES.add(
    "elo_summary",
    f"""WITH RECURSIVE {_elo_sql('3.0')}, a AS (SELECT avg(elo) AS rating, count(*) AS contests FROM elos)
        SELECT round(rating, 4) AS rating, contests, round_even((SELECT count(*) FROM customer WHERE c_acctbal < rating) / (SELECT count(*) FROM customer) * 100, 1) AS percentile FROM a WHERE contests > 0""",
)
def elo_summary(spark, sf_dir):
    ratings = table(spark, sf_dir, "customer").select(F.col("c_acctbal").alias("rating"), F.lit(1).alias("n"))
    ranks, changes = ranked(spark, sf_dir, 3.0)
    return rounded(C.elo_summary(C.elo_rating(changes, ranks), ratings), 4)


@QUERIES.add(
    "read_rating_histogram",
    """SELECT CAST(p_size AS DOUBLE) AS rating, CAST(count(*) AS BIGINT) AS n FROM part GROUP BY 1""",
)
def read_rating_histogram_query(spark, sf_dir):
    """Histogram maps as JSON text, one per brand, summed after reading."""
    sizes = table(spark, sf_dir, "part").groupBy("p_brand", "p_size").count()
    entry = F.concat(F.lit('{"'), F.col("p_size").cast("string"), F.lit('": '), F.col("count").cast("string"), F.lit("}"))
    lines = sizes.select(entry.alias("value"))
    return read_rating_histogram(lines).groupBy("rating").agg(F.sum("n").alias("n"))
