"""Trees of any depth and lists of any length against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from gradeloom.operators import pointers, trees

SCHEMA = "tree_id long, node_id string, parent_id string, depth int, reward double, path array<int>"


def grown(draw, tree, n, shape):
    """A tree whose nodes hang on the last one, the first one, or any."""
    rows = [(tree, "n0", None, 0, draw.random(), [0])]
    for i in range(1, n):
        deep = shape == "chain" or (shape == "deep" and draw.random() < 0.9)
        above = rows[i - 1 if deep else 0 if shape == "wide" else draw.randrange(i)]
        rows.append((tree, f"n{i}", above[1], above[3] + 1, draw.choice([None, draw.random(), 1.0]), [i]))
    return rows


@pytest.fixture(scope="module")
def forest():
    draw = random.Random(0)
    shapes = [("chain", 700), ("deep", 500), ("any", 500), ("wide", 500), ("any", 1)]
    return [r for t, (shape, n) in enumerate(shapes) for r in grown(draw, t, n, shape)]


@pytest.fixture(scope="module")
def nodes(spark, forest):
    return spark.createDataFrame(forest, SCHEMA)


def children(forest):
    below = {}
    for r in forest:
        below.setdefault((r[0], r[2]), []).append(r)
    return below


@pytest.fixture
def rounds(monkeypatch):
    """How many rounds of pointer doubling ran."""
    seen, plain = [], pointers.counted

    def counted(df, name, **conditions):
        seen.append(name)
        return plain(df, name, **conditions)

    monkeypatch.setattr(pointers, "counted", counted)
    return seen


def test_rewards_move_up_deep_trees(nodes, forest):
    below, want = children(forest), {}
    for r in sorted(forest, key=lambda r: -r[3]):
        values = [want[c[0], c[1]] for c in below.get((r[0], r[1]), [])]
        values = [v for v in values if v is not None]
        want[r[0], r[1]] = sum(values) / len(values) if values else r[4]
    rows = trees.propagate_rewards(nodes).collect()
    assert {(r["tree_id"], r["node_id"]): r["reward"] for r in rows} == {
        k: None if v is None else pytest.approx(v, abs=1e-12) for k, v in want.items()}
    assert all(r["is_leaf"] == ((r["tree_id"], r["node_id"]) not in below) for r in rows)


def test_deep_and_shallow_plans_agree(spark, forest):
    """Trees of at most eight levels, moved up either way."""
    low = [r for r in forest if r[0] in (2, 3, 4) and r[3] <= 8]
    frame = spark.createDataFrame(low, SCHEMA)
    plain = {(r["tree_id"], r["node_id"]): r["reward"] for r in trees.propagate_rewards(frame, 8).collect()}
    deep = {(r["tree_id"], r["node_id"]): r["reward"] for r in trees.propagate_rewards(frame).collect()}
    assert deep == {k: None if v is None else pytest.approx(v, abs=1e-12) for k, v in plain.items()}
    places = [sorted(trees.walk_order(frame, *limit).collect()) for limit in ([8], [])]
    assert places[0] == places[1]


def test_long_chain_takes_logarithmic_rounds(spark, rounds):
    """5,000 nodes in a row: at most 14 rounds for roots as for rewards."""
    n = spark.range(5_000)
    chain = n.select(
        F.lit(1).alias("tree_id"), F.col("id").cast("string").alias("node_id"),
        F.when(F.col("id") > 0, (F.col("id") - 1).cast("string")).alias("parent_id"),
        F.col("id").cast("int").alias("depth"), F.when(F.col("id") == 4_999, 0.25).otherwise(0.0).alias("reward"))
    roots = trees.node_to_root(chain)
    assert rounds.count("links") <= 14
    assert roots.where("root_id = '0'").count() == 5_000
    rounds.clear()
    rewards = trees.propagate_rewards(chain)
    assert rounds.count("links") <= 14
    assert rewards.where("reward = 0.25").count() == 5_000


@pytest.mark.parametrize("small", [100_000, 100])
def test_walk_of_deep_and_wide_trees(nodes, forest, monkeypatch, small):
    monkeypatch.setattr(pointers, "SMALL_LIST", small)
    below, want = children(forest), {}
    for tree in {r[0] for r in forest}:
        stack = ["n0"]
        for place in range(sum(r[0] == tree for r in forest)):
            node = stack.pop()
            want[tree, node] = place
            stack += [c[1] for c in sorted(below.get((tree, node), []), key=lambda c: -c[5][-1])]
    assert {(r["tree_id"], r["node_id"]): r["place"] for r in trees.walk_order(nodes).collect()} == want


def test_weighted_list_ranks(spark):
    draw = random.Random(1)
    order = draw.sample(range(2_000), 2_000)
    rows = [(0, b, a, b % 7) for a, b in zip([None, *order], order)]
    links = spark.createDataFrame(rows, "s int, id long, to long, weight long")
    total, want = 0, {}
    for i in order:
        want[i] = total
        total += i % 7
    assert {r["id"]: r["rank"] for r in pointers.list_ranks(links, ["s"]).collect()} == want


def test_popular_targets_are_dealt_out(nodes):
    plain = {tuple(r) for r in trees.node_to_root(nodes.where("tree_id = 3")).collect()}
    assert {tuple(r) for r in trees.node_to_root(nodes.where("tree_id = 3"), hot_rows=50).collect()} == plain


def test_cycles_and_lost_parents_are_errors(spark):
    ring = [(1, "a", "b", 0, 0.0, [0]), (1, "b", "a", 0, 0.0, [0]), (1, "r", None, 0, 0.0, [0])]
    for walk in (trees.node_to_root, trees.propagate_rewards):
        with pytest.raises(ValueError, match="cycle"):
            walk(spark.createDataFrame(ring, SCHEMA)).collect()
    lost = [(1, "a", "x", 1, 0.0, [0]), (1, "r", None, 0, 0.0, [0])]
    with pytest.raises(Exception, match="no row is linked from a"):
        trees.node_to_root(spark.createDataFrame(lost, SCHEMA)).collect()


def test_empty_trees(spark):
    none = spark.createDataFrame([], SCHEMA)
    for walk in (trees.node_to_root, trees.propagate_rewards, trees.walk_order):
        assert walk(none).count() == 0
