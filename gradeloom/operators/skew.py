"""Group-wise columns that stay balanced when one key holds much of the data.

A plain `Window.partitionBy(key)` sends a whole key to one task. The helpers
here find the keys that are too large for that, treat them with partial aggregates
and salted joins, and leave the window to all others.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradeloom.operators.ordering import with_order_bucket
from gradeloom.session import estimated_bytes, scratch_path

# Rows of one key that a single task handles with ease. A key with more is split.
HOT_ROWS = 4_000_000
# Tables that Catalyst takes for smaller than this are not counted first.
SMALL_BYTES = 128 * 2**20
# Groups of keys that are counted before keys are.
COUNTED = 4096


def hot_keys(df: DataFrame, keys: list[str], hot_rows: int | None = None) -> DataFrame | None:
    """Keys with more rows than one task should take: (__h, __parts), or None.

    `__h` is the hash of the key, `__parts` the tasks its rows are dealt to. The counts are
    exact and pre-aggregated before their shuffle. A key has at most the rows of all keys that share its hash modulo
    `COUNTED`; only where these are too many are keys counted one by one. There is at most one entry for
    `HOT_ROWS` rows; whether it is broadcast is left to Spark's check of its written size.
    """
    if hot_rows is None and estimated_bytes(df) < SMALL_BYTES:
        return None
    limit = HOT_ROWS if hot_rows is None else hot_rows
    shared = F.pmod(F.xxhash64(*keys), F.lit(COUNTED))
    totals = df.groupBy(shared.alias("__b")).agg(F.count(F.lit(1)).alias("__n"))
    large = [r["__b"] for r in totals.where(F.col("__n") > limit).select("__b").collect()]  # COUNTED at most
    if not large:
        return None
    of_large = df.where(shared.isin(large))
    counts = of_large.groupBy(F.xxhash64(*keys).alias("__h")).agg(F.count(F.lit(1)).alias("__n"))
    parts = F.ceil(F.col("__n") / F.lit(limit)).cast("int")
    path = scratch_path(df.sparkSession, "hot_keys")
    counts.where(F.col("__n") > limit).select("__h", parts.alias("__parts")).write.parquet(path)
    hot = df.sparkSession.read.schema("__h bigint, __parts int").parquet(path)
    return None if hot.isEmpty() else hot


def _marked(df: DataFrame, keys: list[str], hot: DataFrame) -> DataFrame:
    """Rows with the parts of their key; null for a key that is not hot."""
    return df.withColumn("__h", F.xxhash64(*keys)).join(hot, "__h", "left").drop("__h")


def _salt(df: DataFrame) -> Column:
    """The part of a hot key that a row belongs to, by its content, so that retries agree."""
    hashable = [c for c, kind in df.dtypes if "map<" not in kind]
    return F.pmod(F.xxhash64(*hashable), F.coalesce("__parts", F.lit(1))).cast("int")


def _every_part() -> Column:
    return F.explode(F.sequence(F.lit(0), F.coalesce("__parts", F.lit(1)) - 1))


def with_group_stats(
    df: DataFrame, keys: list[str], aggs: dict[str, Column], hot_rows: int | None = None
) -> DataFrame:
    """Adds aggregates of each row's group, keeping every row."""
    hot = hot_keys(df, keys, hot_rows)
    window = Window.partitionBy(*keys)
    over = [a.over(window).alias(n) for n, a in aggs.items()]
    if hot is None:
        return df.select("*", *over)
    rows = _marked(df, keys, hot)
    cold = rows.where("__parts is null").drop("__parts").select("*", *over)
    big = rows.where("__parts is not null")
    stats = big.groupBy(*keys, "__parts").agg(*[a.alias(n) for n, a in aggs.items()])
    stats = stats.withColumn("__salt", _every_part()).drop("__parts")
    salted = big.withColumn("__salt", _salt(big))
    return cold.unionByName(_attach(salted, stats, [*keys, "__salt"]).select(cold.columns))


def _attach(rows: DataFrame, keyed: DataFrame, keys: list[str]) -> DataFrame:
    """Joins a table with one row per key, where a null key meets a null key."""
    renamed = keyed.withColumnsRenamed({k: f"__key_{k}" for k in keys})
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__key_{k}")) for k in keys])
    return rows.join(renamed, same).drop(*[f"__key_{k}" for k in keys])


def with_group_running(
    df: DataFrame,
    keys: list[str],
    order: list[Column],
    sums: dict[str, Column],
    hot_rows: int | None = None,
) -> DataFrame:
    """Adds, per group, the total of each expression over the rows before this one.

    `order` must be total within a group; its first two columns must be numeric
    because hot groups are cut along them.
    """
    hot = hot_keys(df, keys, hot_rows)
    rows = df if hot is None else _marked(df, keys, hot)
    cold = df if hot is None else rows.where("__parts is null").drop("__parts")

    def before(window):
        return window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)

    zero = F.lit(0)
    w = before(Window.partitionBy(*keys))
    out = cold.select("*", *[F.coalesce(F.sum(e).over(w), zero).alias(n) for n, e in sums.items()])
    if hot is None:
        return out
    big = rows.where("__parts is not null").drop("__parts")
    cut = with_order_bucket(big, order[:2], "__bucket")
    totals = cut.groupBy(*keys, "__bucket").agg(*[F.sum(e).alias(n) for n, e in sums.items()])
    # Per key one row per bucket; the buckets follow the partition setting, not the data.
    b = Window.partitionBy(*keys).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *keys, "__bucket", *[F.coalesce(F.sum(n).over(b), zero).alias(f"__{n}") for n in sums]
    )
    w = before(Window.partitionBy(*keys, "__bucket"))
    big = _attach(cut, offsets, [*keys, "__bucket"]).select(
        *df.columns,
        *[
            (F.col(f"__{n}") + F.coalesce(F.sum(e).over(w), zero)).alias(n)
            for n, e in sums.items()
        ],
    )
    return out.unionByName(big)


def with_group_index(
    df: DataFrame, keys: list[str], order: list[Column], name: str, hot_rows: int | None = None
) -> DataFrame:
    """Adds the 0-based position of each row within its group."""
    out = with_group_running(df, keys, order, {name: F.lit(1)}, hot_rows)
    return out.withColumn(name, F.col(name).cast("bigint"))


def join_keyed(
    rows: DataFrame,
    keyed: DataFrame,
    keys: list[str],
    how: str = "inner",
    hot_rows: int | None = None,
) -> DataFrame:
    """Joins many rows per key to a table with one row per key.

    Rows of a hot key are dealt to its parts, and its entry is repeated for each part.
    """
    hot = hot_keys(rows, keys, hot_rows)
    if hot is None:
        return rows.join(keyed, keys, how)
    marked = _marked(rows, keys, hot)
    salted = marked.withColumn("__salt", _salt(marked)).drop("__parts")
    copies = _marked(keyed, keys, hot).withColumn("__salt", _every_part()).drop("__parts")
    return salted.join(copies, [*keys, "__salt"], how).drop("__salt")
