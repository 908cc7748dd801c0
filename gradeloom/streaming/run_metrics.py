"""Run metrics from a rollout log that grows.

The log is append-only, so a running aggregate per step stays exact; its state is
one row per (step, source). Every micro-batch writes the rows it changed under its
own number, so a batch that is run again replaces its own output only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gradeloom.session import scratch_path


def read_rollout_log(
    spark: SparkSession, path: str, schema: StructType, pattern: str = "*.parquet",
    files_per_batch: int = 1_000,
) -> DataFrame:
    """New parquet files of a folder as a stream."""
    return (
        spark.readStream.schema(schema)
        .option("pathGlobFilter", pattern)
        .option("maxFilesPerTrigger", files_per_batch)
        .parquet(path)
    )


def step_metrics(log: DataFrame) -> DataFrame:
    """Sums per step and source, from which every reported mean follows."""
    return log.groupBy("step", "data_source").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum((F.col("reward") == 1).cast("bigint")).alias("correct"),
        F.sum("n_tokens").alias("tokens"),
    )


def with_means(sums: DataFrame) -> DataFrame:
    return sums.select(
        "step", "data_source", "n", "tokens",
        (F.col("correct") / F.col("n")).alias("accuracy"),
        (F.col("tokens") / F.col("n")).alias("mean_length"),
    )


def running_totals(log: DataFrame) -> DataFrame:
    """Responses and response tokens so far."""
    return log.agg(F.count(F.lit(1)).alias("n"), F.sum("n_tokens").alias("total_tokens"))


def _sink(path: str) -> Callable[[DataFrame, int], None]:
    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def run_available(result: DataFrame, mode: str, path: str, checkpoint: str) -> None:
    """Handles what the log holds now and stops; a later call goes on from there."""
    query = (
        result.writeStream.outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(_sink(path))
        .start()
    )
    query.awaitTermination()


def latest(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The newest row of each key among all batches written."""
    written = spark.read.parquet(path)
    values = [c for c in written.columns if c not in (*keys, "batch")]
    newest = F.max_by(F.struct(*values), "batch").alias("v")
    return written.groupBy(*keys).agg(newest).select(*keys, "v.*")


def stream_step_metrics(spark: SparkSession, log: DataFrame) -> DataFrame:
    """Step metrics of everything the log holds, by way of the stream."""
    path, checkpoint = scratch_path(spark, "step-metrics"), scratch_path(spark, "step-state")
    run_available(step_metrics(log), "update", path, checkpoint)
    return with_means(latest(spark, path, ["step", "data_source"]))


def stream_running_totals(spark: SparkSession, log: DataFrame) -> DataFrame:
    path, checkpoint = scratch_path(spark, "run-totals"), scratch_path(spark, "run-state")
    run_available(running_totals(log), "complete", path, checkpoint)
    written = spark.read.parquet(path)
    newest = F.max_by(F.struct("n", "total_tokens"), "batch").alias("v")
    return written.agg(newest).select("v.*")
