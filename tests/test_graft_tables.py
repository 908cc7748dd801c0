"""Orders left out by key are those left out by the names of their nodes."""

from pyspark.sql import functions as F

from gradeloom.plans import tree_queries


def test_nodes_without_orders(spark, tmp_path):
    spark.createDataFrame(
        [(1, 7, 10.0), (2, 7, 20.0), (3, 8, 30.0), (3, 8, 30.0), (4, None, 40.0)],
        "o_orderkey long, o_custkey long, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    spark.range(10).select(
        (F.col("id") % 5).alias("l_orderkey"), F.col("id").alias("l_linenumber"), F.lit(1).alias("l_partkey"),
        F.lit(2).alias("l_suppkey"), F.lit("d").alias("l_shipdate"), F.lit(5.0).alias("l_extendedprice"),
        F.lit(45.0).alias("l_quantity")).write.parquet(f"{tmp_path}/lineitem.parquet")
    keys = spark.createDataFrame([(1,), (3,), (None,)], "l_orderkey long")
    got = sorted(map(repr, tree_queries.nodes(spark, str(tmp_path), keys).collect()))
    rows = tree_queries.nodes(spark, str(tmp_path)).collect()
    want = [r for r in rows if not {r["node_id"], r["parent_id"]} & {"o1", "o3"}]
    assert got == sorted(map(repr, want)) and len(want) < len(rows)
