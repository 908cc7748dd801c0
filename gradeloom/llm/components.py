"""Connected components of a table of links, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeloom.session import checkpointed


def _signature(links: DataFrame) -> tuple:
    """Tells two tables of distinct links apart."""
    row = links.agg(
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")), F.lit(0)).alias("h"),
    ).first()
    return row["n"], row["h"]


def component_roots(links: DataFrame) -> DataFrame:
    """Smallest node of each linked node's component: columns `node`, `root`.

    `links` has two columns of one orderable type, in any direction, repeats and loops
    allowed. Each round links every node to the smallest node it knows of, first towards
    larger neighbours, then towards smaller ones; rounds grow with the logarithm of the
    nodes. The links stay in a table throughout; only their number and a hash of them
    reach the driver. Minima are pre-aggregated, and adaptive execution splits the join
    of a node that has very many links.
    """
    a, b = links.columns
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    edges = checkpointed(edges.where("u <> v").distinct())
    last = None
    now = _signature(edges)
    while now != last and now[0]:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = (
            both.where("v > u").join(least, "u")
            .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        )
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lower, "u")
        edges = checkpointed(
            small.select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(small.select("u", F.col("m").alias("v")))
            .where("u <> v")
            .distinct()
        )
        last, now = now, _signature(edges)
    return edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root")).union(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
