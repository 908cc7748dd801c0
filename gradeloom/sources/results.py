"""Writers for curated sets, scores and result tables."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.errors import AnalysisException

from gradeloom.sources.data_sources import ResultsSource


# Records of an array that are marked at a time.
WRITTEN_ROWS = 1_000


def write_examples(df: DataFrame, path: str) -> None:
    """Parquet, one folder per split and data source.

    Rebalancing gathers each source into few files and splits a large one.
    """
    flat = df.withColumn("split", F.col("extra_info.split"))
    gathered = flat.hint("rebalance", "split", "data_source")
    gathered.write.mode("overwrite").partitionBy("split", "data_source").parquet(path)


def write_json_records(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_csv_records(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def append_pass_csv(results: DataFrame, path: str) -> None:
    """Adds (model, dataset, pass@1, pass@n) rows to a results table, which has one header."""
    results.sparkSession.dataSource.register(ResultsSource)
    results.write.format(ResultsSource.name()).mode("append").option("path", path).save()


def read_pass_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of such a table."""
    return spark.read.schema(schema).option("pathGlobFilter", "part-*.csv").option("escape", "\"").csv(path)


def write_score_matrix(scores: DataFrame, path: str) -> None:
    """One row per prompt: its 0/1 scores in sample order."""
    scores.write.mode("overwrite").json(path)


def score_matrix(df: DataFrame, responses: str = "scores") -> DataFrame:
    """Scores as 1.0 for anything but 0, false or null."""
    return df.withColumn(
        responses,
        F.transform(
            responses, lambda s: F.when(F.coalesce(s.cast("double"), F.lit(0.0)) != 0, 1.0)
            .otherwise(0.0)
        ),
    )


def reuse_if_exists(
    spark: SparkSession, path: str, build: Callable[[], DataFrame]
) -> DataFrame:
    """Reads the table at `path`, building and writing it only when absent."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
    build().write.mode("ignore").parquet(path)
    return spark.read.parquet(path)


def write_json_arrays(df: DataFrame, path: str) -> None:
    """One JSON array per partition and file, the form problem sets are read from."""

    def bracketed(batches):
        mark = "["
        for batch in batches:
            for at in range(0, batch.num_rows, WRITTEN_ROWS):
                records = batch.column(0).slice(at, WRITTEN_ROWS)
                marks = pa.array([mark] + [","] * (len(records) - 1))
                yield pa.RecordBatch.from_arrays([pc.binary_join_element_wise(marks, records, "")], ["value"])
                mark = ","
        yield pa.RecordBatch.from_arrays([pa.array(["[]" if mark == "[" else "]"])], ["value"])

    lines = df.select(F.to_json(F.struct(*df.columns)).alias("value"))
    lines.mapInArrow(bracketed, "value string").write.text(path)
