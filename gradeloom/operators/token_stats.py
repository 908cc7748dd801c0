"""Metrics and losses over token tables, sequences and training steps.

Token tables hold one row per token: `seq_id`, `pos`, `mask` (0/1) and logged
numbers. All sums are hash aggregates with a partial step before the shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeloom.functions.sequences import clip, kl_penalty
from gradeloom.operators.ordering import with_running_totals
from gradeloom.operators.skew import with_group_running

# Sections whose time is spread over prompt and response tokens.
WHOLE_SECTIONS = ["ref", "values", "adv", "update_critic", "update_actor"]
# Fixed value: the section whose time is spread over response tokens.
RESPONSE_SECTION = "gen"


def masked_mean(value: Column, mask: Column) -> Column:
    return F.try_divide(F.sum(value * mask), F.sum(mask))


def masked_stats(df: DataFrame, column: str, mask: str = "mask", by: list[str] | None = None):
    """Masked sum, mean, variance and corrected variance.

    Without groups, fewer than two unmasked rows are an error, as the corrected
    variance has no meaning; in a grouped table they give null.
    """
    kept = F.when(F.col(mask) == 1, F.col(column))
    count = F.count(kept)
    corrected = F.var_samp(kept)
    if not by:
        message = F.lit("masked variance needs at least two unmasked rows")
        corrected = F.when(count < 2, F.raise_error(message).cast("double")).otherwise(corrected)
    return df.groupBy(*(by or [])).agg(
        F.coalesce(F.sum(kept), F.lit(0.0)).alias("masked_sum"),
        F.avg(kept).alias("masked_mean"),
        F.var_pop(kept).alias("masked_var"),
        corrected.alias("masked_var_unbiased"),
    )


def sequence_lengths(tokens: DataFrame, is_prompt: Column) -> DataFrame:
    """Unmasked prompt and response tokens of each sequence."""
    return tokens.groupBy("seq_id").agg(
        F.sum(F.when(is_prompt, F.col("mask")).otherwise(0)).alias("prompt_length"),
        F.sum(F.when(is_prompt, 0).otherwise(F.col("mask"))).alias("response_length"),
    )


def _spread(name: str, column: Column) -> list[Column]:
    return [
        F.avg(column).alias(f"{name}_mean"),
        F.max(column).alias(f"{name}_max"),
        F.min(column).alias(f"{name}_min"),
    ]


def _as_metrics(one_row: DataFrame) -> DataFrame:
    """A one-row table as (name, value) rows."""
    doubles = one_row.select([F.col(c).cast("double") for c in one_row.columns])
    return doubles.unpivot([], doubles.columns, "name", "value")


def batch_metrics(
    tokens: DataFrame,
    max_response: int,
    prompt_lengths: DataFrame | None = None,
    max_prompt: int | None = None,
) -> DataFrame:
    """Spread of scores, rewards, advantages, returns, values and lengths, as metric rows."""
    kept = tokens.where(F.col("mask") == 1)
    explained = F.lit(1.0) - F.var_samp(F.col("returns") - F.col("value")) / (
        F.var_samp("returns") + F.lit(1e-5)
    )
    by_token = kept.agg(
        *_spread("advantages", F.col("advantage")),
        *_spread("returns", F.col("returns")),
        *_spread("values", F.col("value")),
        explained.alias("vf_explained_var"),
    )
    sequences = tokens.groupBy("seq_id").agg(
        F.sum("score").alias("score"),
        F.sum("reward").alias("reward"),
        F.sum("mask").alias("response_length"),
    )
    full = (F.col("response_length") == max_response).cast("double")
    by_sequence = sequences.agg(
        *_spread("score", F.col("score")),
        *_spread("rewards", F.col("reward")),
        *_spread("response_length", F.col("response_length")),
        F.avg(full).alias("response_length_clip_ratio"),
    )
    out = _as_metrics(by_token).unionByName(_as_metrics(by_sequence))
    if prompt_lengths is None:
        return out
    full = (F.col("prompt_length") == max_prompt).cast("double")
    by_prompt = prompt_lengths.agg(
        *_spread("prompt_length", F.col("prompt_length")),
        F.avg(full).alias("prompt_length_clip_ratio"),
    )
    return out.unionByName(_as_metrics(by_prompt))


def timing_metrics(sections: DataFrame, totals: DataFrame, key: str = "step") -> DataFrame:
    """Seconds of each section, and milliseconds per token it worked on.

    `totals` has one row per step with `prompt_tokens` and `response_tokens`; a section of
    a step without totals has null milliseconds.
    """
    tokens = F.when(F.col("section") == RESPONSE_SECTION, F.col("response_tokens")).when(
        F.col("section").isin(WHOLE_SECTIONS), F.col("prompt_tokens") + F.col("response_tokens")
    )
    return sections.join(totals, key, "left").select(
        key,
        "section",
        F.col("seconds").alias("timing_s"),
        F.try_divide(F.col("seconds") * 1000, tokens).alias("timing_per_token_ms"),
    )


def reduce_metrics(metrics: DataFrame) -> DataFrame:
    """Mean of each metric per step."""
    return metrics.groupBy("step", "name").agg(F.avg("value").alias("value"))


def eos_mask(tokens: DataFrame, eos: int, hot_rows: int | None = None) -> DataFrame:
    """1 up to and including the first end token of each sequence."""
    ended = with_group_running(
        tokens, ["seq_id"], [F.col("pos")],
        {"__ended": (F.col("token_id") == eos).cast("int")}, hot_rows,
    )
    return ended.withColumn("eos_mask", (F.col("__ended") == 0).cast("int")).drop("__ended")


def position_ids(tokens: DataFrame, hot_rows: int | None = None) -> DataFrame:
    """Running count of unmasked tokens, less one, never below zero."""
    counted = with_group_running(
        tokens, ["seq_id"], [F.col("pos")], {"__before": F.col("mask")}, hot_rows
    )
    place = F.greatest(F.col("__before") + F.col("mask") - 1, F.lit(0)).cast("bigint")
    return counted.withColumn("position_id", place).drop("__before")


def cumulative_tokens(steps: DataFrame, column: str = "tokens") -> DataFrame:
    """Running total over steps, this step included."""
    run = with_running_totals(steps, [F.col("step")], {"__before": F.col(column)})
    return run.withColumn("total_tokens", F.col("__before") + F.col(column)).drop("__before")


def adaptive_kl_series(
    steps: DataFrame, init: float, target: float, horizon: float, kl: str = "kl", n: str = "n"
) -> DataFrame:
    """Coefficient used at each step: the start value times all earlier factors."""
    error = clip(F.col(kl) / F.lit(target) - 1, F.lit(-0.2), F.lit(0.2))
    factor = F.lit(1.0) + error * F.col(n) / F.lit(horizon)
    # A product as a sum of logarithms; signs and zeros are counted apart.
    size = F.when(factor == 0, 0.0).otherwise(F.log(F.abs(factor)))
    run = with_running_totals(
        steps,
        [F.col("step")],
        {
            "__log": size,
            "__minus": (factor < 0).cast("int"),
            "__zero": (factor == 0).cast("int"),
        },
    )
    sign = F.when(F.col("__minus") % 2 == 0, F.lit(1.0)).otherwise(F.lit(-1.0))
    value = F.when(F.col("__zero") > 0, 0.0).otherwise(F.lit(init) * sign * F.exp("__log"))
    return run.withColumn("kl_coef", value).drop("__log", "__minus", "__zero")


def kl_reward(tokens: DataFrame, beta: float, kind: str = "kl") -> DataFrame:
    """Token rewards less the penalty on unmasked tokens."""
    kl = kl_penalty(F.col("old_logp"), F.col("ref_logp"), kind) * F.col("mask")
    return tokens.withColumn("kl", kl).withColumn("reward", F.col("reward") - F.lit(beta) * F.col("kl"))


def mean_sequence_kl(tokens: DataFrame) -> DataFrame:
    """Mean over sequences of their mean penalty; sequences without tokens are left out."""
    each = tokens.groupBy("seq_id").agg(masked_mean(F.col("kl"), F.col("mask")).alias("kl"))
    return each.agg(F.avg("kl").alias("kl"), F.count("kl").alias("sequences"))


def policy_loss_stats(
    tokens: DataFrame, clip_range: float, clip_low: float | None = None,
    clip_high: float | None = None, token_level: bool = True,
) -> DataFrame:
    """Clipped-ratio loss, share of clipped tokens, approximate divergence."""
    low = clip_range if clip_low is None else clip_low
    high = clip_range if clip_high is None else clip_high
    mask = F.col("mask")
    ratio = F.exp(F.col("logp") - F.col("old_logp"))
    free = F.lit(0.0) - F.col("advantage") * ratio
    clipped = F.lit(0.0) - F.col("advantage") * clip(ratio, F.lit(1.0 - low), F.lit(1.0 + high))
    rows = tokens.select(
        "seq_id", "mask",
        (F.greatest(free, clipped) * mask).alias("loss"),
        ((clipped > free).cast("double") * mask).alias("clipped"),
        ((F.col("old_logp") - F.col("logp")) * mask).alias("kl"),
    )
    if token_level:  # plain sums; no need to bring a sequence together
        loss, per = F.sum("loss") / F.sum("n"), rows.withColumnRenamed("mask", "n")
    else:
        loss = F.avg(F.col("loss") / F.greatest(F.col("n"), F.lit(1)))
        per = rows.groupBy("seq_id").agg(
            *[F.sum(c).alias(c) for c in ("loss", "clipped", "kl")], F.sum("mask").alias("n")
        )
    return per.agg(
        loss.alias("pg_loss"),
        (F.sum("clipped") / F.sum("n")).alias("pg_clipfrac"),
        (F.sum("kl") / F.sum("n")).alias("ppo_kl"),
    )


def value_loss_stats(tokens: DataFrame, clip_range: float) -> DataFrame:
    """Half the mean of the larger squared error, and the share of clipped tokens."""
    predicted, old, target = F.col("vpred"), F.col("value"), F.col("returns")
    bounded = clip(predicted, old - F.lit(clip_range), old + F.lit(clip_range))
    free = (predicted - target) * (predicted - target)
    clipped = (bounded - target) * (bounded - target)
    mask = F.col("mask")
    return tokens.agg(
        (F.lit(0.5) * masked_mean(F.greatest(free, clipped), mask)).alias("vf_loss"),
        masked_mean((clipped > free).cast("double"), mask).alias("vf_clipfrac"),
    )


def kl_entropy_stats(
    tokens: DataFrame, pg_loss: Column, entropy_coef: float, kl_coef: float, kind: str = "low_var_kl"
) -> DataFrame:
    """Mean entropy and penalty, and the loss they make together."""
    kl = kl_penalty(F.col("logp"), F.col("ref_logp"), kind)
    means = tokens.agg(
        masked_mean(F.col("entropy"), F.col("mask")).alias("entropy"),
        masked_mean(kl, F.col("mask")).alias("kl"),
    )
    total = pg_loss - F.lit(entropy_coef) * F.col("entropy") + F.lit(kl_coef) * F.col("kl")
    return means.withColumn("total_loss", total)


def masked_token_loss(tokens: DataFrame, loss: str) -> DataFrame:
    return tokens.agg(masked_mean(F.col(loss), F.col("mask")).alias("loss"))


def step_totals(roots: DataFrame, responses: DataFrame) -> DataFrame:
    """Mean root reward and response tokens of each step; null where a step has none."""
    reward = roots.groupBy("step").agg(F.avg("reward").alias("mean_reward"))
    count = responses.groupBy("step").agg(F.sum("n_tokens").alias("response_tokens"))
    return reward.join(count, "step", "full")


@dataclass(frozen=True)
class ModelShape:
    """Sizes of a decoder-only model."""

    hidden: int
    layers: int
    heads: int
    kv_heads: int
    intermediate: int
    vocab: int

    @property
    def dense_parameters(self) -> int:
        head = self.hidden // self.heads
        mlp = 3 * self.hidden * self.intermediate
        attention = self.hidden * head * (2 * self.heads + 2 * self.kv_heads)
        return (mlp + attention) * self.layers + 2 * self.vocab * self.hidden

    @property
    def attention_width(self) -> int:
        return self.hidden // self.heads * self.heads * self.layers


def flops_by_step(sequences: DataFrame, shape: ModelShape, seconds: str = "seconds") -> DataFrame:
    """Teraflops per second of each step from its sequence lengths."""
    n = F.col("n_tokens").cast("double")
    work = F.lit(6.0 * shape.dense_parameters) * F.sum(n) + F.lit(
        12.0 * shape.attention_width
    ) * F.sum(n * n)
    return sequences.groupBy("step").agg((work / F.max(seconds) / F.lit(1e12)).alias("tflops"))


def best_metric(parsed: DataFrame, metric: str, threshold: float) -> DataFrame:
    """Largest value of one metric over parsed log lines, and whether it passes."""
    best = parsed.agg(F.max(F.col("metrics")[metric]).alias("best"))
    return best.withColumn("passed", F.col("best") > threshold)
