"""Rows beyond a limit are an error, large numbers are exact, nulls take no part."""

import pytest
from pyspark.sql import functions as F

from gradeloom.functions.answers import answers_match, normalize_answer
from gradeloom.functions.code_text import output_matches
from gradeloom.operators import shaping, statistics, trees
from gradeloom.operators.ordering import bucket_count, with_global_index, with_order_bucket

CHAIN = [(1, "a", None, 0, 0.0, [0]), (1, "b", "a", 1, 0.0, [0, 0]), (1, "c", "b", 2, 0.0, [0, 0, 0]),
         (1, "d", "c", 3, 1.0, [0, 0, 0, 0])]
SCHEMA = "tree_id int, node_id string, parent_id string, depth int, reward double, path array<int>"


@pytest.mark.parametrize("walk", [trees.propagate_rewards, trees.walk_order, trees.node_to_root])
def test_deep_trees_are_whole_or_an_error(spark, walk):
    nodes = spark.createDataFrame(CHAIN, SCHEMA)
    assert walk(nodes, 3).count() == 4
    with pytest.raises(Exception, match="depth 2|2 levels"):
        walk(nodes, 2).collect()


def test_long_responses_are_whole_or_an_error(spark):
    df = spark.createDataFrame([(1, 0, list(range(10, 17)), 1.0)], "tree_id int, sample int, ids array<int>, reward double")
    assert trees.responses_to_nodes(df, 2, None, 2).count() == 4
    with pytest.raises(Exception, match="more than 3 steps"):
        trees.responses_to_nodes(df, 2, 3, 2).collect()


def test_positions_outside_are_an_error(spark):
    df = spark.createDataFrame([(1, "x"), (2, "y")], "id int, s string")
    wanted = spark.createDataFrame([(0,), (2,)], "global_index long")
    with pytest.raises(Exception, match="no row at this position of 2: 2"):
        shaping.mixture_lookup(wanted, df, "s", "id", ["x", "y"]).collect()


ANSWERS = [
    ("100000000000000000000", "200000000000000000000", False),
    ("100000000000000000000", "100000000000000000001", False),
    ("100000000000000000000", "100000000000000000000", True),
    ("0100000000000000000000", "100000000000000000000", True),
    ("100,000,000,000,000,000,000", "100000000000000000000", True),
    ("0.50", "0.5", True), ("(0.50, 1)", "(0.5, 1)", True), ("0.51", "0.5", False), ("x", "y", False),
]


def test_numbers_of_any_size_match_exactly(spark):
    df = spark.createDataFrame(ANSWERS, "a string, b string, want boolean")
    got = df.withColumn("got", answers_match(F.col("a"), F.col("b"))).collect()
    assert [r["got"] for r in got] == [r["want"] for r in got]
    big = spark.createDataFrame([("123456789012345678901234567890123456789012",)], "a string")
    assert big.select(normalize_answer(F.col("a"))).first()[0] == "123456789012345678901234567890123456789012"


OUTPUTS = [
    ("0.1000000000000000000055", "0.1", False), ("100000000000000000000000.0", "100000000000000000000000", True),
    ("1e3", "1000.0", True), ("-0.0", "0", True), ("+5", "5.", True), (".5 1", "0.50 01", True), ("a", "b", False),
    ("1 x", "1.0 x", False), ("", "", True), (".", "0", False),
]


def test_outputs_match_exactly(spark):
    df = spark.createDataFrame(OUTPUTS, "a string, b string, want boolean")
    got = df.withColumn("got", output_matches(F.col("a"), F.col("b"))).collect()
    assert [(r["a"], r["got"]) for r in got] == [(r["a"], r["want"]) for r in got]


def test_nulls_take_no_part_in_ranks(spark):
    whole = [(1.0, 2.0), (2.0, 1.0), (3.0, 4.0), (4.0, 3.0)]
    df = spark.createDataFrame([*whole, (None, 1.0), (None, 9.0), (5.0, None)], "x double, y double")
    assert statistics.spearman(df, "x", "y").first() == statistics.spearman(df.dropna(), "x", "y").first()


def test_repeated_values_make_no_more_buckets_than_asked_for(spark):
    df = spark.range(200_000).select(F.col("id"), (F.xxhash64("id") % 300).alias("v"))
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 200)
    try:
        buckets = with_order_bucket(df, [F.col("v"), F.col("id")], "b")
        assert buckets.select("b").distinct().count() <= 2 * bucket_count(df) + 2
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    got = with_global_index(df.limit(5_000), [F.col("v"), F.col("id")]).orderBy("idx").collect()
    assert [r["idx"] for r in got] == list(range(5_000))
    assert [(r["v"], r["id"]) for r in got] == sorted((r["v"], r["id"]) for r in got)
