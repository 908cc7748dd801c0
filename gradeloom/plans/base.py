"""What a registered query is, and the views of the test tables they share."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeloom.operators.skew import with_group_index


@dataclass(frozen=True)
class Query:
    """`run(spark, sf_dir)` gives the DataFrame; `sql` is its check, if one exists."""

    name: str
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None


class QuerySet(list):
    """Queries of one family, filled by decorating their functions."""

    def add(self, name: str, sql: str | None = None):
        def register(run):
            self.append(Query(name, run, sql))
            return run

        return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Order that is unique within an order's lines; a position needs all of it.
LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice"]

LINES_SQL = f"""lines AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(LINE_ORDER)}) - 1 AS pos
  FROM lineitem)"""


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines with their 0-based position in the order."""
    return with_group_index(
        table(spark, sf_dir, "lineitem"), ["l_orderkey"], [F.col(c) for c in LINE_ORDER], "pos"
    )


TOKENS_SQL = LINES_SQL + """, tokens AS (
  SELECT l_orderkey AS seq_id, pos, CAST(l_linestatus = 'O' AS INTEGER) AS mask,
         CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END::DOUBLE AS reward, l_tax AS value,
         0.0 - l_discount AS old_logp, 0.0 - l_discount * 1.5 AS logp, 0.0 - l_tax AS ref_logp,
         l_quantity / 50.0 AS entropy, (l_quantity - 25.0) / 25.0 AS advantage,
         CAST(l_partkey % 50 AS INTEGER) AS token_id
  FROM lines)"""


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines read as tokens of a sequence per order."""
    zero = F.lit(0.0)
    return lines(spark, sf_dir).select(
        F.col("l_orderkey").alias("seq_id"),
        "pos",
        (F.col("l_linestatus") == "O").cast("int").alias("mask"),
        F.when(F.col("l_returnflag") == "R", 1.0).otherwise(0.0).alias("reward"),
        F.col("l_tax").alias("value"),
        (zero - F.col("l_discount")).alias("old_logp"),
        (zero - F.col("l_discount") * 1.5).alias("logp"),
        (zero - F.col("l_tax")).alias("ref_logp"),
        (F.col("l_quantity") / 50.0).alias("entropy"),
        ((F.col("l_quantity") - 25.0) / 25.0).alias("advantage"),
        (F.col("l_partkey") % 50).cast("int").alias("token_id"),
    )


ROLLOUTS_SQL = LINES_SQL + """, rollouts AS (
  SELECT l_orderkey AS uid, pos AS sample, l_returnflag AS data_source,
         CASE WHEN l_quantity >= 45 THEN 1.0 ELSE 0.0 END::DOUBLE AS reward,
         CAST(l_quantity AS INTEGER) AS n_tokens, CAST(year(l_shipdate) AS BIGINT) AS step
  FROM lines)"""


def rollouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines read as sampled responses, one prompt per order."""
    return lines(spark, sf_dir).select(
        F.col("l_orderkey").alias("uid"),
        F.col("pos").alias("sample"),
        F.col("l_returnflag").alias("data_source"),
        F.when(F.col("l_quantity") >= 45, 1.0).otherwise(0.0).alias("reward"),
        F.col("l_quantity").cast("int").alias("n_tokens"),
        F.year("l_shipdate").cast("bigint").alias("step"),
    )
