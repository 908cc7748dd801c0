"""Hot keys take other paths than cold ones; both must agree with plain windows."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from gradeloom.operators import skew
from gradeloom.operators.ordering import with_global_index, with_running_totals, with_shuffle_index
from gradeloom.operators.statistics import spearman
from gradeloom.operators.trees import sibling_advantage, walk_order


@pytest.fixture(scope="module")
def rows(spark):
    """A third of all rows under one key, and one order value that fills buckets."""
    key = F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 50)
    place = F.when(F.col("id") % 2 == 0, 5).otherwise((F.col("id") * 7919) % 211)
    return spark.range(3000).select(
        "id", key.alias("k"), place.cast("int").alias("t"), (F.col("id") % 13).alias("v")
    )


def same(a, b):
    assert sorted(a.columns) == sorted(b.columns)
    cols = sorted(a.columns)
    left, right = (sorted(map(tuple, d.select(cols).collect())) for d in (a, b))
    assert left == right


def test_hot_keys_are_found(rows):
    """A third of 3,000 rows in parts of at most 500; small tables are not counted."""
    found = skew.hot_keys(rows, ["k"], hot_rows=500).collect()
    assert [r["__parts"] for r in found] == [3]
    assert skew.hot_keys(rows, ["k"]) is None


def test_many_hot_keys_far_below_a_share_of_the_rows(spark):
    """The limit is a number of rows: 200 keys of 0.5 % each are all split."""
    df = spark.range(4000).select("id", (F.col("id") % 200).alias("k"))
    assert skew.hot_keys(df, ["k"], hot_rows=10).count() == 200
    aggs = {"total": F.sum("id")}
    same(skew.with_group_stats(df, ["k"], aggs, hot_rows=10), skew.with_group_stats(df, ["k"], aggs))
    keyed = df.groupBy("k").agg(F.max("id").alias("m"))
    same(skew.join_keyed(df, keyed, ["k"], hot_rows=10), df.join(keyed, "k"))
    order = [F.col("id")]
    same(skew.with_group_index(df, ["k"], order, "i", hot_rows=10), skew.with_group_index(df, ["k"], order, "i"))


def test_group_stats(rows):
    aggs = {"total": F.sum("v"), "low": F.min("v")}
    same(skew.with_group_stats(rows, ["k"], aggs, hot_rows=500), skew.with_group_stats(rows, ["k"], aggs))


def test_group_running_in_a_hot_group(rows):
    order = [F.col("t"), F.col("id")]
    hot = skew.with_group_running(rows, ["k"], order, {"before": F.col("v")}, hot_rows=500)
    w = Window.partitionBy("k").orderBy("t", "id").rowsBetween(Window.unboundedPreceding, -1)
    same(hot, rows.withColumn("before", F.coalesce(F.sum("v").over(w), F.lit(0))))


def test_group_index_counts_from_zero(rows):
    out = skew.with_group_index(rows, ["k"], [F.col("t"), F.col("id")], "i", hot_rows=500)
    w = Window.partitionBy("k").orderBy("t", "id")
    same(out, rows.withColumn("i", (F.row_number().over(w) - 1).cast("bigint")))


def test_join_keyed(rows):
    keyed = spark_keyed = rows.groupBy("k").agg(F.max("v").alias("m"))
    same(skew.join_keyed(rows, keyed, ["k"], hot_rows=500), rows.join(spark_keyed, "k"))
    few = keyed.where("k <> 7 and k > 10")
    same(skew.join_keyed(rows, few, ["k"], "left", hot_rows=500), rows.join(few, "k", "left"))


def test_global_index_with_a_repeated_value(rows):
    got = with_global_index(rows, [F.col("t"), F.col("id")]).toPandas().sort_values("idx")
    want = rows.toPandas().sort_values(["t", "id"])
    assert list(got.idx) == list(range(3000))
    assert list(got.id) == list(want.id)


@pytest.mark.parametrize("partitions", [1, 4, 37])
def test_positions_do_not_depend_on_partitions(rows, partitions):
    moved = rows.repartition(partitions)
    order = [F.col("t"), F.col("id")]
    same(with_global_index(moved, order), with_global_index(rows, order))
    same(with_shuffle_index(moved, "id", 3), with_shuffle_index(rows, "id", 3))


def test_running_totals(rows):
    out = with_running_totals(rows, [F.col("t"), F.col("id")], {"s": F.col("v")}).toPandas()
    want = rows.toPandas().sort_values(["t", "id"])
    want["s"] = want.v.cumsum() - want.v
    assert dict(zip(out.id, out.s)) == dict(zip(want.id, want.s))


def test_spearman_with_a_hot_value(rows):
    pdf = rows.toPandas()
    want = pdf.t.rank().corr(pdf.v.rank())
    for hot_rows in (None, 500):
        row = spearman(rows, "t", "v", hot_rows).first()
        assert abs(row["spearman"] - want) < 1e-9
        assert row["n"] == 3000


def test_tree_with_a_hot_parent(spark):
    """One parent holds most nodes; siblings and walk places stay right."""
    leaf = F.when(F.col("id") % 4 == 0, F.lit("p1")).otherwise(F.lit("p0"))
    leaves = spark.range(2000).select(
        F.lit(1).alias("tree_id"), F.concat(F.lit("n"), F.col("id").cast("string")).alias("node_id"),
        leaf.alias("parent_id"), F.lit(2).alias("depth"), (F.col("id") % 5 == 0).cast("double").alias("reward"),
        F.array(F.lit(0).cast("bigint"), F.when(F.col("id") % 4 == 0, 1).otherwise(0).cast("bigint"), "id").alias("path"),
    )
    top = spark.createDataFrame(
        [(1, "r", None, 0, 0.0, [0]), (1, "p0", "r", 1, 0.0, [0, 0]), (1, "p1", "r", 1, 0.0, [0, 1])],
        "tree_id int, node_id string, parent_id string, depth int, reward double, path array<bigint>",
    )
    tree = top.unionByName(leaves)
    same(sibling_advantage(tree, hot_rows=100).drop("path"), sibling_advantage(tree).drop("path"))
    got = walk_order(tree, 2, hot_rows=100).toPandas().set_index("node_id").place
    want = [r["node_id"] for r in tree.orderBy("path").collect()]
    assert list(got.sort_values().index) == want
    assert sorted(got) == list(range(2003))


def test_nulls_and_nan_keep_their_place(spark):
    """Null orders first and NaN last, as Spark sorts them; no row is dropped."""
    value = (
        F.when(F.col("id") % 7 == 0, F.lit(None)).when(F.col("id") % 7 == 1, F.lit(float("nan")))
        .otherwise(F.col("id") % 5).cast("double")
    )
    df = spark.range(400).withColumn("x", value)
    got = with_global_index(df, [F.col("x"), F.col("id")]).orderBy("idx").select("id").collect()
    assert got == df.orderBy("x", "id").select("id").collect()


def test_a_null_key_may_be_hot(spark):
    df = spark.range(900).select("id", F.when(F.col("id") % 3 > 0, F.col("id") % 20).alias("k"))
    aggs = {"n": F.count(F.lit(1))}
    same(skew.with_group_stats(df, ["k"], aggs, hot_rows=100), skew.with_group_stats(df, ["k"], aggs))
    order = [F.col("id")]
    same(skew.with_group_index(df, ["k"], order, "i", hot_rows=100), skew.with_group_index(df, ["k"], order, "i"))
