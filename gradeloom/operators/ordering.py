"""Positions and running totals over a whole table.

An unpartitioned window would move every row to one task. Here rows are cut into
ordered buckets, each bucket is numbered on its own, and the totals of the
earlier buckets (a few rows) are added.
"""

from __future__ import annotations

import math
from collections import Counter

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradeloom.session import estimated_bytes, shuffle_partitions

BUCKETS_PER_PARTITION = 4
MAX_BUCKETS = 10_000
# Rows looked at per bucket when its bounds are chosen, as range partitioning does.
ROWS_PER_BOUND = 500
READ_WHOLE_BYTES = 16 * 2**20


def _quantiles(df: DataFrame, column: Column, n: int) -> list[float]:
    """Cut points for `n` buckets from a bounded sample.

    They decide how even the buckets are, not which rows or positions come out. A table that Catalyst takes
    for small is read whole, which saves counting it first.
    """
    probs = [i / n for i in range(1, n)]
    values = df.select(F.when(~F.isnan(column), column).alias("v"))
    if estimated_bytes(df) > READ_WHOLE_BYTES:
        rows, wanted = df.count(), ROWS_PER_BOUND * n
        if rows > wanted:
            values = values.sample(wanted / rows, seed=0)
    row = values.agg(F.percentile_approx("v", probs, max(10_000, 10 * n))).first()
    return list(row[0] or [])


def bucket_count(df: DataFrame) -> int:
    return min(BUCKETS_PER_PARTITION * shuffle_partitions(df.sparkSession), MAX_BUCKETS)


def quantile_bounds(df: DataFrame, column: Column) -> list[float]:
    """Distinct approximate quantiles, one fewer than there are buckets."""
    return sorted(set(_quantiles(df, column.cast("double"), bucket_count(df))))


def bucketize(df: DataFrame, column: Column, bounds: list[float], name: str) -> DataFrame:
    """Adds the number of bounds at or below the value.

    Nulls go first and NaN last, as Spark sorts them, so no row is lost.
    """
    splits = [-math.inf, *bounds, math.inf]
    key = F.coalesce(column.cast("double"), F.lit(-math.inf))
    if len(splits) < 3:
        return df.withColumn(name, F.isnan(key).cast("int"))
    binned = Bucketizer(
        splits=splits, inputCol="__key", outputCol="__bin", handleInvalid="keep"
    ).transform(df.withColumn("__key", key))
    return binned.withColumn(name, F.col("__bin").cast("int")).drop("__key", "__bin")


def with_order_bucket(
    df: DataFrame, order: list[Column], name: str, bounds: list[float] | None = None
) -> DataFrame:
    """Adds a bucket number that never decreases along `order`.

    `order` is one or two numeric columns (a key, then a tie-breaker). Bounds are
    quantiles of the key; a value so frequent that it fills whole buckets is cut
    along the tie-breaker instead, so no bucket grows with a repeated value.
    Known `bounds` of the key save the pass that finds them.
    """
    n = bucket_count(df)
    key = order[0].cast("double")
    if bounds is not None:
        return bucketize(df, key, bounds, name)
    quantiles = _quantiles(df, key, n)
    bounds = sorted(set(quantiles))
    repeated = [b for b, times in Counter(quantiles).items() if times > 1]
    out = bucketize(df, key, bounds, "__outer")
    if not repeated or len(order) < 2:
        return out.withColumnRenamed("__outer", name)
    is_repeated = F.coalesce(key.isin(repeated), F.lit(False))
    tie = order[1].cast("double")
    tie_bounds = sorted(set(_quantiles(df.where(is_repeated), tie, n)))
    out = bucketize(out, tie, tie_bounds, "__inner")
    # A repeated value is the lower bound of its bucket, so it comes first there. It gets
    # as many pieces as quantile points fell on it, so all pieces together are at most n.
    taken = Counter(quantiles)
    pieces = F.get(F.lit([0, *(taken[b] for b in bounds)]), F.col("__outer"))
    width = len(tie_bounds) + 2
    piece = F.floor(F.col("__inner") * pieces / F.lit(width - 1)).cast("int")
    inner = F.when(is_repeated, piece).otherwise(F.lit(width - 1))
    return out.withColumn(name, F.col("__outer") * width + inner).drop("__outer", "__inner")


def with_running_totals(
    df: DataFrame, order: list[Column], sums: dict[str, Column], bounds: list[float] | None = None
) -> DataFrame:
    """Adds the total of each expression over all rows before this one in `order`."""
    rows = with_order_bucket(df, order, "__bucket", bounds)
    totals = rows.groupBy("__bucket").agg(*[F.sum(e).alias(n) for n, e in sums.items()])
    # One row per bucket; their number follows the partition setting, not the data.
    ahead = Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0)
    offsets = totals.select(
        "__bucket", *[F.coalesce(F.sum(n).over(ahead), zero).alias(f"__{n}") for n in sums]
    )
    w = (
        Window.partitionBy("__bucket")
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    return rows.join(F.broadcast(offsets), "__bucket").select(
        *df.columns,
        *[
            (F.col(f"__{n}") + F.coalesce(F.sum(e).over(w), zero)).alias(n)
            for n, e in sums.items()
        ],
    )


def with_global_index(df: DataFrame, order: list[Column], name: str = "idx") -> DataFrame:
    """Adds the 0-based position of every row in the total order `order`."""
    out = with_running_totals(df, order, {name: F.lit(1)})
    return out.withColumn(name, F.col(name).cast("bigint"))


def with_shuffle_index(df: DataFrame, id_column: str, seed: int, name: str = "idx") -> DataFrame:
    """Adds the 0-based position of every row in a seeded shuffle."""
    n = bucket_count(df)
    bounds = [2**52 * i / n for i in range(1, n)]
    out = with_running_totals(df, hash_order(id_column, seed), {name: F.lit(1)}, bounds)
    return out.withColumn(name, F.col(name).cast("bigint"))


def hash_order(id_column: str, seed: int) -> list[Column]:
    """A reproducible shuffle order: independent of partitioning and of retries."""
    return [hash52(F.col(id_column), seed), F.col(id_column)]


def hash52(key: Column, seed: int) -> Column:
    """The first 52 bits of the MD5 of seed and key, as a number a double holds exactly."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string")))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint")


def hash_uniform(key: Column, seed: int) -> Column:
    """A reproducible number in [0, 1)."""
    return hash52(key, seed) / F.lit(float(2**52))
