"""Draws split over blocks: totals exact, shares and rows as the weights say."""

from collections import Counter

from pyspark.sql import functions as F

from gradeloom.operators import shaping


def test_draws_follow_the_weights(spark):
    df = spark.range(3_000).select("id", F.when(F.col("id") < 2_000, "big").when(F.col("id") < 2_900, "small").otherwise("left").alias("d"))
    got = shaping.weighted_draws(df, "d", "id", {"big": 1.0, "small": 3.0, "none": 9.0}, 11, draws=40_000, block_rows=300).collect()
    assert len(got) == 40_000
    by = Counter(r["d"] for r in got)
    assert set(by) == {"big", "small"} and abs(by["small"] - 30_000) < 6 * 87
    times = Counter(r["id"] for r in got if r["d"] == "small")
    # Every row is as likely: the counts spread as Poisson counts of mean 33 do.
    mean = by["small"] / 900
    spread = sum((times.get(i, 0) - mean) ** 2 for i in range(2_000, 2_900)) / 900 / mean
    assert 0.7 < spread < 1.3
    copies = Counter((r["id"], r["copy"]) for r in got)
    assert max(copies.values()) == 1 and all((i, c - 1) in copies for i, c in copies if c)


def test_draws_repeat_and_hold_in_any_partitioning(spark):
    df = spark.range(500).withColumn("d", F.lit("a"))
    first = sorted(shaping.weighted_draws(df, "d", "id", {"a": 1.0}, 3, block_rows=50).collect())
    moved = df.repartition(5, F.rand(1))
    assert first == sorted(shaping.weighted_draws(moved, "d", "id", {"a": 1.0}, 3, block_rows=50).collect())
    assert len(first) == 500
    assert first != sorted(shaping.weighted_draws(df, "d", "id", {"a": 1.0}, 4, block_rows=50).collect())


def test_nothing_to_draw(spark):
    df = spark.range(5).withColumn("d", F.lit("a"))
    assert shaping.weighted_draws(df, "d", "id", {"b": 1.0}, 3).count() == 0
    assert shaping.weighted_draws(df.limit(0), "d", "id", {"a": 1.0}, 3).count() == 0
