"""Contest scores, ranks and ratings from stored standings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeloom.functions.text import split_problem_id
from gradeloom.operators.ordering import with_running_totals
from gradeloom.operators.skew import join_keyed
from gradeloom.session import stored


def group_by_contest(submissions: DataFrame, problem: str = "problem_id") -> DataFrame:
    """Submissions with their contest: one row per (contest, problem), not a nested map."""
    contest = split_problem_id(F.col(problem))
    message = F.concat(F.lit("invalid problem id: "), F.col(problem))
    checked = F.when(contest.isNull(), F.raise_error(message).cast("bigint")).otherwise(contest)
    return submissions.withColumn("contest", checked)


def intersect_handles(standings: DataFrame, changes: DataFrame) -> DataFrame:
    keys = ["contest", "handle"]
    return standings.select(*keys).intersect(changes.select(*keys))


def common_handles(
    standings: DataFrame, changes: DataFrame, min_handles: int = 200
) -> tuple[DataFrame, DataFrame]:
    """Rows of handles found in both tables, for contests with equal counts above the limit."""
    keys = ["contest", "handle"]
    s = standings.join(changes.select(*keys), keys, "left_semi")
    c = changes.join(standings.select(*keys), keys, "left_semi")
    sizes = s.groupBy("contest").agg(F.count(F.lit(1)).alias("ns")).join(
        c.groupBy("contest").agg(F.count(F.lit(1)).alias("nc")), "contest"
    )
    kept = sizes.where((F.col("ns") == F.col("nc")) & (F.col("ns") > min_handles)).select(
        "contest", F.lit(True).alias("__kept")
    )
    return (
        join_keyed(s, kept, ["contest"]).drop("__kept"),
        join_keyed(c, kept, ["contest"]).drop("__kept"),
    )


def contest_score(submissions: DataFrame, problems: DataFrame, attempts: int) -> DataFrame:
    """Score and penalty per contest over the first `attempts` tries of each problem.

    Solved at try i (from 0): max(0, points - 50 i), or 1 point and 10 i penalty
    where the problem has no points.
    """
    solved = F.array_position(F.slice("statuses", 1, attempts), True) - 1
    joined = submissions.join(problems, ["contest", "problem_id"]).withColumn("i", solved)
    hit = F.col("i") >= 0
    points = F.col("points")
    earned = F.when(points.isNotNull(), F.greatest(points - 50.0 * F.col("i"), F.lit(0.0))).otherwise(1.0)
    lost = F.when(points.isNull(), 10.0 * F.col("i")).otherwise(0.0)
    return joined.groupBy("contest").agg(
        F.sum(F.when(hit, earned).otherwise(0.0)).alias("score"),
        F.sum(F.when(hit, lost).otherwise(0.0)).alias("penalty"),
    )


def standing_rank(standings: DataFrame, model: DataFrame) -> DataFrame:
    """First place whose holder the model beats, else the number of places.

    `standings` has `contest`, `place` (from 0), `points`, `penalty`; `model` has one
    row per contest with `score` and `penalty`.
    """
    mine = model.select("contest", "score", F.col("penalty").alias("__penalty"))
    rows = join_keyed(standings, mine, ["contest"])
    beaten = (F.col("points") < F.col("score")) | (
        (F.col("points") == F.col("score")) & (F.col("penalty") > F.col("__penalty"))
    )
    return rows.groupBy("contest").agg(
        F.coalesce(F.min(F.when(beaten, F.col("place"))), F.count(F.lit(1))).alias("rank"),
        F.count(F.lit(1)).alias("n"),
    )


# Candidate ratings tried in one round of the search.
CANDIDATES = 16


def _expected_rank(candidate: Column) -> Column:
    """Aggregate over rated players: 1 + the sum of all chances to be beaten."""
    chance = F.lit(1.0) / (
        F.lit(1.0) + F.pow(F.lit(10.0), (candidate - F.col("rating")) / 400.0)
    )
    return F.lit(1.0) + F.sum(F.col("n") * chance)


def elo_rating(changes: DataFrame, ranks: DataFrame) -> DataFrame:
    """Integer rating in [0, max + 99] where the expected rank meets the actual one.

    The expected rank falls as the rating grows. Each round narrows [low, high) of
    every contest at once by trying a fixed number of ratings as columns of one
    aggregate; it ends where a bisection would. Players are counted by rating
    first. The rounds, some four, follow from the largest rating, so they are one plan.
    """
    histogram = stored(
        changes.groupBy("contest", F.col("old_rating").alias("rating")).agg(
            F.count(F.lit(1)).alias("n")
        ),
        "ratings",
    )
    top = histogram.groupBy("contest").agg(F.max("rating").cast("bigint").alias("top"))
    state = ranks.join(top, "contest").select(
        "contest", "rank", F.lit(0).cast("bigint").alias("low"), (F.col("top") + 100).alias("high")
    )
    highest = histogram.agg(F.max("rating").cast("bigint")).first()[0]
    widest = 1 if highest is None else highest + 100
    span = F.col("high") - F.col("low")
    tried = [
        F.col("low") + F.floor(span * j / (CANDIDATES + 1)) for j in range(1, CANDIDATES + 1)
    ]
    while widest > 1:
        seeds = (
            histogram.join(state, "contest")
            .groupBy("contest", "rank", "low", "high")
            .agg(*[_expected_rank(c).alias(f"s{j}") for j, c in enumerate(tried)])
        )
        # Candidates equal to `low` are settled already.
        behind = [(F.col(f"s{j}") >= F.col("rank")) | (c == F.col("low")) for j, c in enumerate(tried)]
        low = F.greatest("low", *[F.when(b, c) for b, c in zip(behind, tried)])
        high = F.least("high", *[F.when(~b, c) for b, c in zip(behind, tried)])
        state = seeds.select("contest", "rank", low.alias("low"), high.alias("high"))
        # Neighbouring candidates are this far apart at most.
        widest = -(-widest // (CANDIDATES + 1))
    return state.select("contest", F.col("low").alias("elo"))


def rating_percentile(
    ratings: DataFrame, asked: DataFrame, id_column: str, rating: str = "rating", weight: str = "n"
) -> DataFrame:
    """Share of the rated below each asked rating, in percent with one decimal.

    Both tables are laid out in one order of ratings and a running total is read
    off, so many questions cost one sort.
    """
    # At equal ratings the questions come first: only strictly lower ones count.
    counts = ratings.groupBy(F.col(rating).cast("double").alias("rating")).agg(
        F.sum(weight).alias("w")
    ).select("rating", "w", F.lit(2**62).alias("id"), F.lit(False).alias("asked"))
    questions = asked.select(
        F.col(rating).cast("double").alias("rating"), F.lit(0).cast("bigint").alias("w"),
        F.col(id_column).cast("bigint").alias("id"), F.lit(True).alias("asked"),
    )
    line = counts.unionByName(questions)
    placed = with_running_totals(line, [F.col("rating"), F.col("id")], {"below": F.col("w")})
    total = counts.agg(F.sum("w")).scalar()
    return placed.where("asked").select(
        F.col("id").alias(id_column),
        F.col("rating"),
        F.bround(F.col("below") / total * 100, 1).alias("percentile"),
    )


def elo_summary(elos: DataFrame, ratings: DataFrame) -> DataFrame:
    """Mean rating over contests, its percentile, and the contests used."""
    mean = elos.agg(F.avg("elo").alias("rating"), F.count("elo").alias("contests")).withColumn(
        "id", F.lit(0).cast("bigint")
    )
    mean = mean.where(F.col("contests") > 0)
    place = rating_percentile(ratings, mean, "id")
    return mean.join(place.select("id", "percentile"), "id").drop("id")
