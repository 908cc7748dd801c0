"""Columns over token arrays and token-level numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gradeloom.functions.answers import let


def _fit(ids: Column, length: int, side: str) -> Column:
    if side == "left":
        start = F.greatest(F.size(ids) - length, F.lit(0)) + 1
        return F.slice(ids, start, F.lit(length))
    return F.slice(ids, 1, length)


def pad_truncate(ids: Column, length: int, pad: int, pad_side: str = "left", over: str = "error"):
    """Token array of exactly `length`.

    `pad_side` says where padding goes; `over` what a longer array loses: 'left'
    keeps its end, 'right' keeps its start, 'error' fails the job.
    """
    missing = F.greatest(F.lit(length) - F.size(ids), F.lit(0))
    padding = F.array_repeat(F.lit(pad), missing)
    filled = F.concat(padding, ids) if pad_side == "left" else F.concat(ids, padding)
    if over == "error":
        message = F.concat(F.lit("sequence is too long: "), F.size(ids).cast("string"))
        return F.when(F.size(ids) > length, F.raise_error(message)).otherwise(filled)
    if over not in ("left", "right"):
        raise ValueError(f"unknown truncation {over}")
    return F.when(F.size(ids) > length, _fit(ids, length, over)).otherwise(filled)


def attention_mask(ids: Column, length: int, pad_side: str = "left") -> Column:
    """1 for a token, 0 for padding, to go with `pad_truncate`."""
    kept = F.least(F.size(ids), F.lit(length))
    ones, zeros = F.array_repeat(F.lit(1), kept), F.array_repeat(F.lit(0), F.lit(length) - kept)
    return F.concat(zeros, ones) if pad_side == "left" else F.concat(ones, zeros)


def position_ids(mask: Column) -> Column:
    """Running count of unmasked tokens, less one, never below zero."""
    # Padding sits on one side, so a running count is a clipped ramp.
    def ramp(mask: Column) -> Column:
        # Bound once per row: the ramp would find them again at each place.
        bounds = F.struct(
            F.array_position(mask, 1).alias("first"),
            F.aggregate(mask, F.lit(0), lambda a, m: a + m).alias("total"),
        )
        n = F.size(mask)
        return F.when(
            n > 0,
            let(bounds, lambda b: F.transform(
                F.sequence(F.lit(1), n),
                lambda i: F.when(b["first"] == 0, F.lit(0)).otherwise(
                    F.greatest(F.least(i - b["first"] + 1, b["total"]) - 1, F.lit(0)).cast("int")
                ),
            )),
        ).otherwise(F.array().cast("array<int>"))

    return let(mask, ramp)


def eos_mask(ids: Column, eos: int) -> Column:
    """1 up to and including the first end token."""
    at = F.array_position(ids, eos)
    return F.transform(
        ids, lambda _, i: F.when((at == 0) | (i < at), F.lit(1)).otherwise(F.lit(0))
    )


def loss_mask(attention: Column, prompt_length: Column, response_length: Column) -> Column:
    """Attention mask without the prompt (but its last place) and the last response place."""
    n = F.size(attention)
    prompt_end = F.when(prompt_length > 1, F.least(prompt_length, n) - 1).otherwise(F.lit(0))
    last = F.least(prompt_length + response_length, n) - 1
    return F.transform(
        attention, lambda m, i: F.when((i < prompt_end) | (i == last), F.lit(0)).otherwise(m)
    )


def chat_mask(roles: Column, lengths: Column, limit: int) -> Column:
    """1 on the tokens of assistant turns, cut at `limit`, padded with 0."""
    per_turn = F.zip_with(
        roles, lengths,
        lambda r, n: F.array_repeat(F.when(r == "assistant", F.lit(1)).otherwise(F.lit(0)), n),
    )
    mask = F.slice(F.flatten(per_turn), 1, limit)
    return F.concat(mask, F.array_repeat(F.lit(0), F.lit(limit) - F.size(mask)))


def chat_labels(ids: Column, mask: Column) -> Column:
    """Token ids on masked places, -100 elsewhere."""
    return F.zip_with(ids, mask, lambda t, m: F.when(m == 1, t).otherwise(F.lit(-100)))


def strip_padding(ids: Column, mask: Column) -> Column:
    """The last tokens, as many as the mask counts (padding on the left)."""
    count = F.aggregate(mask, F.lit(0), lambda a, m: a + m)
    return F.slice(ids, F.size(ids) - count + 1, count)


def place_reward(length: Column, valid: Column, reward: Column) -> Column:
    """Reward at the last valid place, 0 elsewhere."""
    return F.transform(
        F.sequence(F.lit(1), length),
        lambda i: F.when(i == valid, reward).otherwise(F.lit(0.0)),
    )


def kl_penalty(logp: Column, ref_logp: Column, kind: str = "kl") -> Column:
    """Per-token estimate of the divergence from the reference model."""
    diff = logp - ref_logp
    if kind == "kl":
        return diff
    if kind == "abs":
        return F.abs(diff)
    if kind == "mse":
        return F.lit(0.5) * diff * diff
    if kind == "low_var_kl":
        back = ref_logp - logp
        return clip(F.exp(back) - back - F.lit(1.0), F.lit(-10.0), F.lit(10.0))
    raise ValueError(f"unknown penalty {kind}")


def penalized_reward(score: Column, old_logp: Column, ref_logp: Column, ratio: float) -> Column:
    return score - (old_logp - ref_logp) * F.lit(ratio)


def clip(value: Column, low: Column, high: Column) -> Column:
    return F.greatest(F.least(value, high), low)


def bernoulli_variance(p: Column) -> Column:
    return p * (F.lit(1.0) - p)


def binary_entropy(p: Column) -> Column:
    """Entropy of a coin in bits, 0 at the ends."""
    q = F.lit(1.0) - p
    return F.when((p <= 0) | (p >= 1), F.lit(0.0)).otherwise(
        F.lit(0.0) - (p * F.log2(p) + q * F.log2(q))
    )
