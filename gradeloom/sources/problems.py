"""Readers for problem sets, examples and rating histograms."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeloom.sources.data_sources import ExamplesSource

PROBLEM_SCHEMA = (
    "problem string, solution string, answer string, difficulty double, dataset string"
)


def read_problem_json(
    spark: SparkSession, root: str, split: str, category: str, name: str,
    schema: str = PROBLEM_SCHEMA,
) -> DataFrame:
    """One problem set stored as `{root}/{split}/{category}/{name}.json`, a JSON array."""
    path = f"{root}/{split}/{category}/{name.lower()}.json"
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def read_examples(
    spark: SparkSession, paths: dict[str, str], schema: str | None = None
) -> DataFrame:
    """Many files as one table; each path names its format ('parquet' or 'json').

    Paths of one format are read together. A given schema saves the pass that finds one.
    """
    by_format: dict[str, list[str]] = {}
    for path, fmt in paths.items():
        by_format.setdefault(fmt, []).append(path)
    frames = []
    for fmt, group in by_format.items():
        reader = spark.read.format(fmt)
        reader = reader.schema(schema) if schema else reader.option("mergeSchema", True)
        frames.append(reader.load(group))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def read_mixed_examples(spark: SparkSession, paths: list[str], schema: str) -> DataFrame:
    """Files of either format side by side, told apart by their first bytes, not by their names."""
    spark.dataSource.register(ExamplesSource)
    return spark.read.format(ExamplesSource.name()).schema(schema).option("paths", json.dumps(paths)).load()


def read_rating_histogram(lines: DataFrame, column: str = "value") -> DataFrame:
    """Rating and count rows from a JSON map; counts stay weights."""
    parsed = lines.select(F.from_json(F.col(column), "map<string,bigint>").alias("m"))
    return (
        parsed.select(F.explode("m").alias("rating", "n"))
        .select(F.col("rating").cast("double").alias("rating"), "n")
    )
