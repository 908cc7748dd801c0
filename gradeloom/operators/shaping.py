"""Order, sampling, batches and groups of rows."""

from __future__ import annotations

from itertools import accumulate

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gradeloom.operators.ordering import (
    bucketize,
    hash_order,
    hash_uniform,
    with_global_index,
    with_shuffle_index,
)
from gradeloom.operators.skew import join_keyed, with_group_index


def row_count(df: DataFrame) -> Column:
    return df.agg(F.count(F.lit(1))).scalar()


def seeded_shuffle(df: DataFrame, id_column: str, seed: int) -> DataFrame:
    """Rows in an order that depends on the seed and the ids only."""
    return df.orderBy(*hash_order(id_column, seed))


def holdout_split(
    df: DataFrame, id_column: str, seed: int, n: int
) -> tuple[DataFrame, DataFrame]:
    """All but the last `n` rows of the shuffle, and those `n`.

    The held-out rows are a top-n; one boundary value splits off the others, so
    the data itself is not shuffled.
    """
    key = F.struct(*hash_order(id_column, seed))
    last = df.select(key.alias("__key")).orderBy(F.desc("__key")).limit(n)
    boundary = last.agg(F.min("__key")).scalar()
    return df.where(key < boundary), df.where(key >= boundary)


def fraction_split(
    df: DataFrame, order: list[Column], fraction: float
) -> tuple[DataFrame, DataFrame]:
    """The first `fraction` of the rows in an order, and the rest."""
    indexed = with_global_index(df, order, "__idx")
    limit = F.floor(row_count(df) * F.lit(fraction))
    head = indexed.where(F.col("__idx") < limit).drop("__idx")
    return head, indexed.where(F.col("__idx") >= limit).drop("__idx")


def head(df: DataFrame, order: list[Column], k: int) -> DataFrame:
    return df.orderBy(*order).limit(k)


def sample_n(df: DataFrame, id_column: str, n: int, seed: int) -> DataFrame:
    """`n` rows without replacement: the first of a seeded shuffle."""
    return df.orderBy(*hash_order(id_column, seed)).limit(n)


def log_sample(df: DataFrame, id_column: str, seed: int, n: int = 1) -> DataFrame:
    """The rows a run logs: the first of a seeded shuffle."""
    return sample_n(df, id_column, n, seed)


def dataset_sizes(df: DataFrame, source: str, names: list[str]) -> list[int]:
    """Rows of each named dataset; the list is as long as the caller's own."""
    counts = df.where(F.col(source).isin(names)).groupBy(source).count().collect()
    found = {r[source]: r["count"] for r in counts}
    return [found.get(n, 0) for n in names]


def _fetch(requests: DataFrame, df: DataFrame, source: str, id_column: str) -> DataFrame:
    """Rows for (source, local index) requests; a row may be asked for many times."""
    rows = with_group_index(df, [source], [F.col(id_column)], "local_index")
    return join_keyed(requests, rows, [source, "local_index"])


def weighted_mixture(
    df: DataFrame, source: str, id_column: str, weights: dict[str, float], seed: int,
    draws: int | None = None,
) -> DataFrame:
    """Draws with replacement, p(row) = weight of its dataset / size of its dataset.

    As many draws as rows unless `draws` is given. Each draw is a function of the
    seed and its number, so a lost task draws the same again.
    """
    names = list(weights)
    sizes = dataset_sizes(df, source, names)
    total = sum(w for w, s in zip(weights.values(), sizes) if s)
    shares = [w / total if s else 0.0 for w, s in zip(weights.values(), sizes)]
    live = [(n, s, p) for n, s, p in zip(names, sizes, shares) if p > 0]
    cuts = list(accumulate(p for _, _, p in live))[:-1]
    spark = df.sparkSession
    requests = spark.range(sum(sizes) if draws is None else draws).withColumnRenamed("id", "draw")
    requests = bucketize(requests, hash_uniform(F.col("draw"), seed), cuts, "__dataset")
    name = F.array(*[F.lit(n) for n, _, _ in live])[F.col("__dataset")]
    size = F.array(*[F.lit(s) for _, s, _ in live])[F.col("__dataset")]
    local = F.floor(hash_uniform(F.col("draw"), seed + 1) * size).cast("bigint")
    requests = requests.select("draw", name.alias(source), local.alias("local_index"))
    return _fetch(requests, df, source, id_column)


# Rows of a dataset that share one block of draws, about.
BLOCK_ROWS = 1_000_000


def weighted_draws(
    df: DataFrame, source: str, id_column: str, weights: dict[str, float], seed: int,
    draws: int | None = None, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Rows as often as they are drawn, p(row) = weight of its dataset / size of its dataset, with their `copy`.

    The draws are not made one by one and looked up, they are split: over the datasets by
    weight, over hashed blocks of a dataset by their rows, and over a block's rows evenly, each by
    binomials on what is left. A block then repeats its own rows, so the table is shuffled once and joined
    with nothing. There is one number per block to pass on, a millionth of the rows. Ids must be
    unique; the same seed, ids and block size draw the same rows.
    """
    rows = df.where(F.col(source).isin(list(weights)))
    total = rows.count()
    blocks = max(1, -(-total // block_rows))
    cut = rows.withColumn("__block", F.pmod(F.xxhash64(F.col(id_column), F.lit(seed)), F.lit(blocks)).cast("int"))
    sizes: dict[str, list[int]] = {n: [0] * blocks for n in weights}
    for r in cut.groupBy(source, "__block").count().collect():
        sizes[r[source]][r["__block"]] = r["count"]
    live = [n for n in weights if sum(sizes[n]) and weights[n] > 0]
    if not live:
        return cut.limit(0).drop("__block").withColumn("copy", F.lit(0).cast("bigint"))
    generator = np.random.default_rng(seed)
    shares = np.array([weights[n] for n in live])
    wanted = dict(zip(live, generator.multinomial(total if draws is None else draws, shares / shares.sum())))
    # Per dataset and block: the rows it has and the draws that fall on it.
    plan = {}
    for number, name in enumerate(live):
        own = np.array(sizes[name])
        for block, n in enumerate(generator.multinomial(wanted[name], own / own.sum())):
            plan[name, block] = (number, int(own[block]), int(n))
    shared = df.sparkSession.sparkContext.broadcast(plan)

    def repeat(batches):
        key, at, counts = None, 0, None
        for pdf in batches:
            starts = np.flatnonzero((pdf[source] != pdf[source].shift()) | (pdf["__block"] != pdf["__block"].shift()))
            for a, b in zip(starts, [*starts[1:], len(pdf)]):
                part = pdf.iloc[a:b]
                here = (part[source].iloc[0], int(part["__block"].iloc[0]))
                if here != key:
                    key, at = here, 0
                    number, size, n = shared.value.get(key, (0, 0, 0))
                    drawn = np.random.default_rng([seed, number, key[1]]).integers(0, max(size, 1), n)
                    counts = np.bincount(drawn, minlength=size)
                times = counts[at : at + len(part)]
                at += len(part)
                out = part.loc[part.index.repeat(times)].drop(columns="__block")
                out["copy"] = np.arange(len(out)) - np.repeat(np.cumsum(times) - times, times)
                yield out

    kind = T.StructType([*df.schema.fields, T.StructField("copy", T.LongType())])
    ordered = cut.repartition(source, "__block").sortWithinPartitions(source, "__block", id_column)
    return ordered.mapInPandas(repeat, kind)


def mixture_lookup(
    requests: DataFrame, df: DataFrame, source: str, id_column: str, names: list[str],
    index: str = "global_index",
) -> DataFrame:
    """Rows at global positions of the datasets laid end to end in the given order.

    A position outside of all datasets is an error.
    """
    sizes = dataset_sizes(df, source, names)
    starts = [0, *accumulate(sizes)]
    outside = F.concat(
        F.lit(f"no row at this position of {starts[-1]}: "), F.coalesce(F.col(index).cast("string"), F.lit("null"))
    )
    inside = requests.withColumn(
        index,
        F.when((F.col(index) >= 0) & (F.col(index) < starts[-1]), F.col(index)).otherwise(F.raise_error(outside)),
    )
    cuts = sorted(set(starts[1:-1]) - {0, starts[-1]})
    placed = bucketize(inside, F.col(index).cast("double"), [float(c) for c in cuts], "__dataset")
    # Empty datasets share a start with the next one and can hold no position.
    live = [(n, a) for n, a, s in zip(names, starts, sizes) if s]
    name = F.array(*[F.lit(n) for n, _ in live])[F.col("__dataset")]
    start = F.array(*[F.lit(a) for _, a in live])[F.col("__dataset")]
    wanted = placed.withColumns(
        {source: name, "local_index": (F.col(index) - start).cast("bigint")}
    ).drop("__dataset")
    return _fetch(wanted, df, source, id_column)


def assign_batches(
    df: DataFrame, id_column: str, seed: int, size: int, drop_last: bool = True
) -> DataFrame:
    """Batch number of each row of a seeded shuffle; a partial last batch is dropped."""
    batched = with_shuffle_index(df, id_column, seed, "__idx").withColumn(
        "batch", F.floor(F.col("__idx") / size)
    )
    if drop_last:
        batched = batched.where(F.col("batch") < F.floor(row_count(df) / size))
    return batched.withColumn("place", F.col("__idx") % size).drop("__idx")


def _serpentine(index: Column, k: Column) -> Column:
    turn = index % (k * 2)
    return F.when(turn < k, turn).otherwise(k * 2 - 1 - turn).cast("int")


def balanced_groups(df: DataFrame, length: str, id_column: str, k: int) -> DataFrame:
    """`k` groups of equal size with close token sums: dealt back and forth by length."""
    indexed = with_global_index(df, [F.col(length), F.col(id_column)], "__idx")
    return indexed.withColumn("group", _serpentine(F.col("__idx"), F.lit(k))).drop("__idx")


def token_budget_groups(df: DataFrame, length: str, id_column: str, max_tokens: int) -> DataFrame:
    """As many balanced groups as the token total needs at `max_tokens` each."""
    total = df.agg(F.sum(length)).scalar()
    k = F.greatest(F.ceil(total / F.lit(max_tokens)), F.lit(1))
    indexed = with_global_index(df, [F.col(length), F.col(id_column)], "__idx")
    return indexed.withColumn("group", _serpentine(F.col("__idx"), k)).drop("__idx")


def balance_stats(df: DataFrame, length: str, id_column: str, k: int) -> DataFrame:
    """Token sums of plain consecutive groups against those of balanced groups."""
    n = row_count(df)
    size = F.floor(n / k)
    plain = with_global_index(df, [F.col(id_column)], "__idx").groupBy(
        F.floor(F.col("__idx") / size).alias("g")
    ).agg(F.sum(length).alias("s"))
    even = balanced_groups(df, length, id_column, k).groupBy(F.col("group").alias("g")).agg(
        F.sum(length).alias("s")
    )
    before = plain.agg(F.min("s").alias("min"), F.max("s").alias("max"), F.sum("s").alias("total"))
    after = even.agg(F.min("s").alias("balanced_min"), F.max("s").alias("balanced_max"))
    return before.select(
        "min",
        "max",
        (F.col("max") - F.col("min")).alias("minmax_diff"),
        after.select("balanced_min").scalar().alias("balanced_min"),
        after.select("balanced_max").scalar().alias("balanced_max"),
        (F.col("total") / F.lit(k)).alias("mean"),
    )


def reorder(df: DataFrame, places: DataFrame, id_column: str, place: str = "place") -> DataFrame:
    """Rows in a new order given as (id, place); `place` stays as the way back."""
    return df.join(places.select(id_column, place), id_column).orderBy(place)


def restore_order(df: DataFrame, id_column: str, place: str = "place") -> DataFrame:
    return df.drop(place).orderBy(id_column)


def pad_to_divisor(df: DataFrame, id_column: str, divisor: int) -> DataFrame:
    """Repeats head rows until the row count divides; copies are flagged `is_pad`."""
    n = row_count(df)
    missing = (F.lit(divisor) - n % divisor) % divisor
    # At most `divisor` head rows are ever needed, so one small window numbers them.
    heads = df.orderBy(id_column).limit(divisor).withColumn(
        "__place", F.row_number().over(Window.orderBy(id_column)) - 1
    )
    copies = df.sparkSession.range(divisor).select(
        F.col("id").alias("pad_index"), (F.col("id") % n).alias("__place")
    ).where(F.col("pad_index") < missing)
    padding = copies.join(heads, "__place").drop("__place").withColumn("is_pad", F.lit(True))
    own = df.withColumn("is_pad", F.lit(False))
    return own.unionByName(padding, allowMissingColumns=True)


def unpad(df: DataFrame) -> DataFrame:
    return df.where(~F.col("is_pad")).drop("is_pad", "pad_index")


def repeat_rows(df: DataFrame, index: str, n: int, interleave: bool = True) -> DataFrame:
    """Each row `n` times; `place` lists copies next to each other or pass after pass."""
    repeated = df.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    total = row_count(df)
    place = (
        F.col(index) * n + F.col("rep") if interleave else F.col("rep") * total + F.col(index)
    )
    return repeated.withColumn("place", place.cast("bigint"))


def chunk(df: DataFrame, order: list[Column], k: int) -> DataFrame:
    """Number of the equal consecutive part each row is in; the count must divide."""
    n = row_count(df)
    message = F.concat(n.cast("string"), F.lit(f" rows do not split into {k} equal parts"))
    size = F.when(n % k == 0, n / k).otherwise(F.raise_error(message).cast("double"))
    indexed = with_global_index(df, order, "__idx")
    return indexed.withColumn("chunk", F.floor(F.col("__idx") / size).cast("int")).drop("__idx")


def fold(df: DataFrame, order: list[Column], size: int) -> DataFrame:
    """Consecutive rows as lists of `size`; every list but the last is full."""
    row = F.struct("__idx", F.struct(*df.columns).alias("row"))
    return (
        with_global_index(df, order, "__idx")
        .groupBy(F.floor(F.col("__idx") / size).alias("fold"))
        .agg(F.array_sort(F.collect_list(row)).alias("rows"))
        .withColumn("rows", F.col("rows.row"))
    )


def unfold(folded: DataFrame) -> DataFrame:
    return folded.select("fold", F.posexplode("rows").alias("place", "row")).select(
        "fold", "place", "row.*"
    )


def union_columns(left: DataFrame, right: DataFrame, id_column: str) -> DataFrame:
    """Columns of both tables for the same rows; shared columns must agree.

    A row that only one side has is an error too.
    """
    shared = [c for c in right.columns if c in left.columns and c != id_column]
    renamed = right.withColumnsRenamed({c: f"__{c}" for c in shared})
    joined = left.withColumn("__left", F.lit(True)).join(
        renamed.withColumn("__right", F.lit(True)), id_column, "full"
    )
    paired = F.col("__left") & F.col("__right")
    problem = F.when(paired.isNull(), F.lit("the two sides hold different rows"))
    for c in shared:
        differs = ~F.col(c).eqNullSafe(F.col(f"__{c}"))
        problem = problem.when(differs, F.lit(f"{c} differs between the sides"))
    # The check must not be optimised away with an unused column, so it filters.
    checked = joined.where(F.when(problem.isNotNull(), F.raise_error(problem).cast("boolean")).otherwise(True))
    return checked.drop("__left", "__right", *[f"__{c}" for c in shared])
