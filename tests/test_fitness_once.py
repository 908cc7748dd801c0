"""Fitness of trees: what several steps read is computed once."""

import pandas as pd
from pyspark.sql import functions as F

from gradeloom.operators import advantages, skew, trees

SCHEMA = "tree_id int, node_id string, parent_id string, depth int, reward double, log_prob double, path array<int>"
ROWS = [
    (1, "r", None, 0, 0.0, None, [1]), (1, "a", "r", 1, 0.0, -0.5, [1, 1]), (1, "b", "r", 1, 1.0, -1.0, [1, 2]),
    (1, "a0", "a", 2, 0.0, -2.0, [1, 1, 1]), (1, "a1", "a", 2, 1.0, -3.0, [1, 1, 2]),
    (1, "c", "r", 1, 0.0, None, [1, 3]), (1, "c0", "c", 2, 0.0, -1.0, [1, 3, 1]), (1, "c1", "c", 2, None, -2.0, [1, 3, 2]),
    # A root without children, a null tree, and a node that is there twice.
    (2, "s", None, 0, 0.3, None, [2]), (None, "t", None, 0, 0.2, None, [0]), (None, "t0", "t", 1, 1.0, -1.0, [0, 1]),
    (3, "u", None, 0, 0.0, None, [3]), (3, "v", "u", 1, 0.1, -1.0, [3, 1]), (3, "v", "u", 1, 0.1, -1.0, [3, 1]),
    (3, "w", "v", 2, 1.0, -1.0, [3, 1, 1]), (3, "x", "u", 1, 0.0, -4.0, [3, 2]),
]
KEEP = ["tree_id", "node_id", "parent_id", "reward", "log_prob", "is_leaf"]


def counted(spark, rows):
    """The rows, and how many of them were computed so far."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    return rows.mapInPandas(count, rows.schema), seen


def rounded(rows):
    """Sums may be taken in another order."""
    return sorted(str([round(v, 9) if isinstance(v, float) else v for v in row]) for row in rows.collect())


def same(got, want):
    assert rounded(got) == rounded(want.select(got.columns))


def test_levels_are_written_once(spark):
    nodes = spark.createDataFrame(ROWS, SCHEMA)
    plain = trees.propagate_rewards(nodes, 2)
    rows, seen = counted(spark, nodes)
    kept = trees.propagate_rewards(rows, 2, keep=KEEP)
    assert kept.columns == KEEP
    same(kept, plain)
    same(trees.propagate_rewards(nodes, 2, keep=["node_id", "depth", "path"]), plain)
    for _ in range(2):
        same(trees.tree_fitness(kept), trees.tree_fitness(plain))
    assert seen.value == 3 * len(ROWS)  # once a level
    deep = trees.propagate_rewards(nodes.where("tree_id = 1"), keep=KEEP)
    same(deep, plain.where("tree_id = 1"))


def test_what_is_left_out_is_not_computed(spark):
    broken = F.when(F.col("depth") == 2, F.raise_error(F.lit("not asked for")).cast("array<int>")).otherwise(F.col("path"))
    nodes = spark.createDataFrame(ROWS, SCHEMA).withColumn("path", broken)
    assert trees.propagate_rewards(nodes, 2, keep=KEEP).count() == len(ROWS)


def test_siblings_meet_once(spark):
    tree = trees.propagate_rewards(spark.createDataFrame(ROWS, SCHEMA), 2, keep=KEEP)
    marked = trees.with_sibling_stats(tree)
    same(trees.tree_fitness(marked), trees.tree_fitness(tree))
    same(trees.sibling_advantage(marked), trees.sibling_advantage(tree))
    want = trees.prune_flat_siblings(trees.sibling_advantage(tree))
    same(trees.sibling_advantage(marked, min_spread=trees.MIN_SPREAD), want)


def test_rows_are_weighted_from_one_run(spark):
    rows = spark.createDataFrame(pd.DataFrame({"F": [0.1, 0.2, 0.3], "advantage": [1.0, -1.0, 2.0]}))
    rows, seen = counted(spark, rows)
    out = advantages.fitness_weights(rows, scale=("advantage",)).orderBy("F").collect()
    assert [round(r["weight"], 9) for r in out] == [0.5, 1.0, 1.5]
    assert [round(r["advantage"], 9) for r in out] == [0.5, -1.0, 3.0]
    assert seen.value == 3


def test_keys_are_counted_only_where_they_can_be_hot(spark, monkeypatch):
    """Without a hot key nothing is written; with one, its exact parts are found among keys that share its group."""
    rows = spark.range(20_000).select(F.when(F.col("id") < 900, F.lit(None)).otherwise(F.col("id") % 9_000).alias("k"))
    paths = []
    plain = skew.scratch_path
    monkeypatch.setattr(skew, "scratch_path", lambda *a: paths.append(a) or plain(*a))
    assert skew.hot_keys(rows, ["k"], 1_000) is None and not paths
    want = rows.groupBy(F.xxhash64("k").alias("h")).count().where("count > 400").collect()
    assert [tuple(r) for r in skew.hot_keys(rows, ["k"], 400).collect()] == [(want[0]["h"], 3)] and len(want) == 1
    # Groups that are large though none of their keys is.
    monkeypatch.setattr(skew, "COUNTED", 2)
    assert skew.hot_keys(rows, ["k"], 1_000) is None
