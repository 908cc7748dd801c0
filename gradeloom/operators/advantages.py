"""Advantages relative to a group of responses, and along a sequence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeloom.operators.skew import join_keyed, with_group_stats
from gradeloom.session import checkpointed, stored

GROUP_EPSILON = 1e-6


def _largest_group(df: DataFrame, key: str) -> Column:
    return df.groupBy(key).count().agg(F.max("count")).scalar()


def prompt_accuracy(rollouts: DataFrame, key: str = "uid", score: str = "reward") -> DataFrame:
    """Mean score per prompt; 0 everywhere when every prompt has a single sample."""
    means = rollouts.groupBy(key).agg(F.avg(score).alias("accuracy"), F.count(F.lit(1)).alias("n"))
    largest = means.agg(F.max("n")).scalar()
    return means.select(key, F.when(largest == 1, 0.0).otherwise(F.col("accuracy")).alias("accuracy"))


def grpo_advantage(
    rollouts: DataFrame,
    key: str = "uid",
    score: str = "reward",
    length: str = "n_tokens",
    max_length: int | None = None,
    hot_rows: int | None = None,
) -> DataFrame:
    """(score - group mean) / (group deviation + 1e-6), one value per response.

    A single sample in its group has deviation 0, or mean 0 and deviation 1 when
    no group has two. With `max_length`, zero-score responses of full length get 0.
    """
    grouped = with_group_stats(
        rollouts,
        [key],
        {
            "__mean": F.avg(score),
            "__std": F.stddev_samp(score),
        },
        hot_rows,
    )
    all_single = _largest_group(rollouts, key) == 1
    mean = F.when(all_single, 0.0).otherwise(F.col("__mean"))
    std = F.when(all_single, 1.0).otherwise(F.coalesce("__std", F.lit(0.0)))
    value = (F.col(score) - mean) / (std + F.lit(GROUP_EPSILON))
    if max_length is not None:
        truncated = (F.col(score) == 0) & (F.col(length) == max_length)
        value = F.when(truncated, 0.0).otherwise(value)
    return grouped.withColumn("advantage", value).drop("__mean", "__std")


def spread_to_tokens(tokens: DataFrame, values: DataFrame, key: str, column: str) -> DataFrame:
    """A response's value on each of its unmasked tokens, 0 on the others."""
    joined = join_keyed(tokens, values.select(key, F.col(column).alias("__v")), [key])
    return joined.withColumn(column, F.col("__v") * F.col("mask")).drop("__v")


def gae_advantage(
    tokens: DataFrame, gamma: float = 1.0, lam: float = 1.0, block: int = 64
) -> DataFrame:
    """Advantage and return of every token, by the backward recurrence.

    `pos` counts from 0 within `seq_id`. No row holds more than `block` tokens of a
    sequence (few, since appending to an array copies it): a run of tokens acts on what follows it like one long
    token, with a first value, a result of its own and a length. Runs are summed up
    level by level until one is left per sequence, then what arrives from the right
    goes down again. Sequences within one block need no join at all.
    """
    w = gamma * lam
    longest = tokens.agg(F.max("pos")).first()[0] or 0
    zero = F.lit(0.0)

    def gathered(rows):
        item = F.struct("pos", "first", "own", "n")
        return rows.groupBy("seq_id", F.floor(F.col("pos") / block).alias("run")).agg(
            F.array_sort(F.collect_list(item)).alias("items")
        )

    def fold(next_value, carry):
        """From the last item to the first: what arrives at each, and its result."""
        out = "array<struct<pos:bigint,next:double,carry:double,result:double,first:double>>"
        start = F.struct(
            next_value.alias("next"), carry.alias("carry"), F.array().cast(out).alias("out")
        )

        def step(state, it):
            arriving = F.lit(gamma) * state["next"] + F.lit(w) * state["carry"]
            result = it["own"] + F.pow(F.lit(w), it["n"] - 1) * arriving
            entry = F.struct(
                it["pos"].cast("bigint").alias("pos"),
                state["next"].alias("next"),
                state["carry"].alias("carry"),
                result.alias("result"),
                it["first"].alias("first"),
            )
            return F.struct(
                it["first"].alias("next"),
                result.alias("carry"),
                F.array_append(state["out"], entry).alias("out"),
            )

        return F.aggregate(F.reverse("items"), start, step)

    rows = tokens.select(
        "seq_id", "pos", F.col("value").alias("first"),
        (F.col("reward") - F.col("value")).alias("own"), F.lit(1).alias("n"),
    )
    levels = [gathered(rows)]
    runs = longest // block + 1
    while runs > 1:
        levels[-1] = checkpointed(levels[-1])
        summary = levels[-1].select(
            "seq_id",
            F.col("run").alias("pos"),
            F.col("items")[0]["first"].alias("first"),
            fold(zero, zero)["carry"].alias("own"),
            F.aggregate("items", F.lit(0), lambda a, i: a + i["n"]).alias("n"),
        )
        levels.append(gathered(summary))
        runs = (runs - 1) // block + 1
    down = levels.pop().withColumns({"next": zero, "carry": zero})
    while True:
        entries = down.select("seq_id", F.explode(fold(F.col("next"), F.col("carry"))["out"]).alias("e"))
        if not levels:
            break
        arriving = entries.select("seq_id", F.col("e.pos").alias("run"), "e.next", "e.carry")
        down = levels.pop().join(arriving, ["seq_id", "run"])
    return entries.select(
        "seq_id",
        F.col("e.pos").alias("pos"),
        F.col("e.result").alias("advantage"),
        (F.col("e.result") + F.col("e.first")).alias("returns"),
    )


def masked_whiten(
    df: DataFrame, column: str, mask: str = "mask", shift_mean: bool = True
) -> DataFrame:
    """Column scaled to unit variance (and zero mean) over the unmasked rows."""
    kept = df.where(F.col(mask) == 1)
    mean = kept.agg(F.avg(column)).scalar()
    var = kept.agg(F.var_samp(column)).scalar()
    scaled = (F.col(column) - mean) / F.sqrt(var + F.lit(1e-8))
    return df.withColumn(column, scaled if shift_mean else scaled + mean)


def fitness_weights(
    rows: DataFrame, fitness: str = "F", scale: tuple[str, ...] = ("advantage", "returns")
) -> DataFrame:
    """Scales columns by F / sum(F) * n; all weights are 1 when the sum is tiny.

    The rows are stored, so what they come from is not run again for the sum and the count.
    """
    rows = stored(rows, "unweighted")
    total = rows.agg(F.sum(fitness)).scalar()
    count = rows.agg(F.count(F.lit(1))).scalar()
    weight = F.when(total > 1e-8, F.col(fitness) / total * count).otherwise(F.lit(1.0))
    weighted = rows.withColumn("weight", weight)
    return weighted.withColumns({c: F.col(c) * F.col("weight") for c in scale})
