"""Correlations and summaries of evaluation runs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gradeloom.session import shuffle_partitions, stored

MIN_DEVIATION = 1e-12


def pearson_of_moments(x: Column, y: Column) -> Column:
    """Aggregate: correlation of x and y, 0 for fewer than two rows or a constant.

    `corr` fails on a constant column; the moments do not.
    """
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x).cast("double"), F.when(both, y).cast("double")
    sx, sy = F.stddev_pop(x), F.stddev_pop(y)
    usable = (F.count(x) >= 2) & (sx >= MIN_DEVIATION) & (sy >= MIN_DEVIATION)
    r = F.try_divide(F.covar_pop(x, y), sx * sy)
    return F.when(usable, F.greatest(F.least(r, F.lit(1.0)), F.lit(-1.0))).otherwise(0.0)


def pearson_guarded(df: DataFrame, x: str, y: str, by: list[str] | None = None) -> DataFrame:
    return df.groupBy(*(by or [])).agg(
        pearson_of_moments(F.col(x), F.col(y)).alias("r"), F.count(F.lit(1)).alias("n")
    )


def _local_ranks(batches: Iterator[pa.RecordBatch], part: int) -> Iterator[pa.RecordBatch]:
    """Places inside one sorted partition: rows `below` a value and its `ties` there.

    Rows of the first and the last value also keep it as `edge`, since other partitions may hold it.
    """
    rows = pa.Table.from_batches(batches)
    if not rows.num_rows:
        return
    rows = rows.combine_chunks()
    value = rows.column("value").chunk(0)
    differs = pc.not_equal(value[1:], value[:-1]).to_numpy(zero_copy_only=False)
    if pa.types.is_floating(value.type):
        nan = np.isnan(value.to_numpy(zero_copy_only=False))
        differs &= ~(nan[1:] & nan[:-1])
    starts = np.concatenate([[0], np.flatnonzero(differs) + 1])
    ties = np.diff(np.append(starts, len(value)))
    run = np.repeat(np.arange(len(starts)), ties)
    edge = (run == 0) | (run == len(starts) - 1)
    columns = {
        "part": pa.array(np.full(len(value), part, "int32")), "below": pa.array(starts[run]),
        "ties": pa.array(ties[run]), "edge": pc.if_else(pa.array(edge), value, pa.scalar(None, value.type)),
    }
    for name, column in columns.items():
        rows = rows.append_column(name, column)
    yield from rows.drop_columns(["value"]).to_batches()


def with_average_rank(df: DataFrame, column: str, name: str, task_rows: int | None = None) -> DataFrame:
    """The rows with, in place of a column, the mean of the places its value fills (from 1), as a written table.

    Rows are range-partitioned and ranked where they are. What a partition lacks are the rows of
    earlier ones and, for its first and last value, how many equal ones others hold: three rows per
    partition. A value that fills whole partitions is cut at random, so none grows with it. The
    column must hold no nulls; NaN ranks above all numbers. There are as many partitions as the session
    shuffles to, or one for `task_rows` rows.
    """
    parts = shuffle_partitions(df.sparkSession) if task_rows is None else df.count() // task_rows + 1
    others = [c for c in df.columns if c != column]
    rows = df.select(*others, F.col(column).alias("value"), F.rand(11).alias("__cut"))
    ranged = rows.repartitionByRange(parts, "value", "__cut").sortWithinPartitions("value").drop("__cut")
    kind = ranged.schema["value"].dataType
    out = T.StructType([*[ranged.schema[c] for c in others], T.StructField("part", T.IntegerType()),
                        T.StructField("below", T.LongType()), T.StructField("ties", T.LongType()), T.StructField("edge", kind)])

    def place(batches):
        yield from _local_ranks(batches, TaskContext.get().partitionId())

    local = stored(ranged.mapInArrow(place, out), "local_ranks")
    groups = local.groupBy("part", "edge").agg(F.count(F.lit(1)).alias("n"), F.min("below").alias("below"))
    # At most three rows per partition from here on.
    earlier = Window.orderBy("part").rangeBetween(Window.unboundedPreceding, -1)
    base = F.coalesce(F.sum("n").over(earlier), F.lit(0))
    value = Window.partitionBy("edge")
    first = F.when(F.col("edge").isNull(), F.col("base")).otherwise(F.min(F.col("base") + F.col("below")).over(value))
    known = groups.withColumn("base", base).select(
        "part", "edge", first.alias("base"), F.sum("n").over(value).alias("all"))
    known = known.withColumnsRenamed({"part": "__part", "edge": "__edge"})
    placed = local.join(F.broadcast(known), (F.col("part") == F.col("__part")) & F.col("edge").eqNullSafe(F.col("__edge")))
    inner = F.col("edge").isNull()
    rank = F.col("base") + F.when(inner, F.col("below") + (F.col("ties") + 1) / 2).otherwise((F.col("all") + 1) / 2)
    return placed.select(*others, rank.alias(name))


def spearman(df: DataFrame, x: str, y: str, task_rows: int | None = None) -> DataFrame:
    """One row: correlation of the average ranks, 0 when degenerate.

    Each rank is found in flight, carried along while the other is, and summed up; nothing is
    joined back. A row with a null in either column takes no part; NaN ranks above all numbers.
    """
    rows = df.select(F.col(x).alias("x"), F.col(y).alias("y")).where("x is not null and y is not null")
    ranked = with_average_rank(with_average_rank(rows, "x", "rx", task_rows), "y", "ry", task_rows)
    sums = ranked.agg(F.count(F.lit(1)).alias("n"), F.covar_pop("rx", "ry").alias("xy"), F.var_pop("rx").alias("xx"), F.var_pop("ry").alias("yy"))
    usable = (F.col("xx") > 0) & (F.col("yy") > 0)
    r = F.try_divide(F.col("xy"), F.sqrt(F.col("xx")) * F.sqrt(F.col("yy")))
    return sums.select(F.when(usable, r).otherwise(0.0).alias("spearman"), "n")


def fitness_correlations(trees: DataFrame, norm: str = "grad_norm_sq") -> DataFrame:
    """Spearman of F, p(1-p) and 1 - rho^2 against log(1 + norm), positive norms only."""
    valid = stored(
        trees.where(F.col(norm) > 0).select(
            F.log1p(F.col(norm)).alias("log_norm"),
            "F",
            "bern_var",
            (F.lit(1.0) - F.col("rho") * F.col("rho")).alias("unexplained"),
        ),
        "valid_trees",
    )
    parts = [
        spearman(valid, c, "log_norm").withColumn("term", F.lit(c))
        for c in ("F", "bern_var", "unexplained")
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def healing_summary(healed: DataFrame) -> DataFrame:
    """One row over healed trees (`F_before`, `F_after`, `n_refinements`, `n_correct`).

    `correct_delta_spearman` ranks correct refinements against the change of F; null for
    fewer than three trees.
    """
    rows = healed.withColumn("d", F.col("F_after") - F.col("F_before"))
    n = F.count(F.lit(1))
    t = F.when(
        (n >= 3) & (F.stddev_samp("d") > 0),
        F.try_divide(F.avg("d"), F.stddev_samp("d") / F.sqrt(n.cast("double"))),
    )
    by_rank = spearman(rows, "n_correct", "d").select(F.when(F.col("n") >= 3, F.col("spearman")))
    summary = rows.agg(
        n.alias("healed"),
        F.sum((F.col("d") > 0).cast("bigint")).alias("improved"),
        F.avg((F.col("d") > 0).cast("double")).alias("success_rate"),
        F.avg("F_before").alias("mean_before"),
        F.avg("F_after").alias("mean_after"),
        F.avg("d").alias("mean_delta"),
        F.percentile("d", F.lit(0.5)).alias("median_delta"),
        F.stddev_samp("d").alias("std_delta"),
        t.alias("t_statistic"),
        F.try_divide(F.sum("n_correct"), F.sum("n_refinements")).alias("refinement_accuracy"),
    )
    return summary.withColumn("correct_delta_spearman", by_rank.scalar())
