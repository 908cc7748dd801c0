"""Accuracy of recorded responses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def validation_by_source(
    scored: DataFrame,
    source: str = "data_source",
    reward: str = "reward",
    length: str = "n_tokens",
    correct: float = 1.0,
) -> DataFrame:
    """Accuracy and mean length overall, of correct and of incorrect responses."""
    is_correct = F.col(reward) == correct
    return scored.groupBy(source).agg(
        F.avg(is_correct.cast("double")).alias("accuracy"),
        F.avg(length).alias("mean_length"),
        F.avg(F.when(is_correct, F.col(length))).alias("mean_length_correct"),
        F.avg(F.when(~is_correct, F.col(length))).alias("mean_length_incorrect"),
    )


def pass_at_k(
    scored: DataFrame, key: str = "uid", score: str = "reward", equal_counts: bool = False
) -> DataFrame:
    """One row: mean score, share of prompts with a full score, and sample counts.

    `samples_min` and `samples_max` differ when prompts have unequal counts; the
    mean is over all samples then. `equal_counts` makes unequal counts an error.
    """
    per = scored.groupBy(key).agg(
        F.max(score).alias("best"), F.sum(score).alias("total"), F.count(F.lit(1)).alias("n")
    )
    fewest = F.min("n")
    if equal_counts:
        unequal = F.raise_error(F.lit("prompts have unequal numbers of samples")).cast("bigint")
        fewest = F.when(F.min("n") < F.max("n"), unequal).otherwise(F.min("n"))
    return per.agg(
        (F.sum("total") / F.sum("n")).alias("pass_at_1"),
        F.avg((F.col("best") == 1).cast("double")).alias("pass_at_n"),
        fewest.alias("samples_min"),
        F.max("n").alias("samples_max"),
        F.count(F.lit(1)).alias("prompts"),
    )
