"""Trees settled in groups, the rounds for all others, and both side by side, against plain Python."""

import random

import pytest

from gradeloom.operators import pointers, small_trees, trees
from tests.test_deep_trees import SCHEMA, children, grown


@pytest.fixture(scope="module")
def forest():
    draw = random.Random(3)
    shapes = [("chain", 90), ("deep", 60), ("any", 60), ("wide", 60), ("any", 1), ("any", 25)]
    return [r for t, (shape, n) in enumerate(shapes) for r in grown(draw, t, n, shape)]


@pytest.fixture(scope="module")
def nodes(spark, forest):
    return spark.createDataFrame(forest, SCHEMA)


@pytest.fixture
def rounds(monkeypatch):
    """How many tables of links were written."""
    seen, plain = [], pointers.counted

    def counted(df, name, **conditions):
        seen.append(name)
        return plain(df, name, **conditions)

    monkeypatch.setattr(pointers, "counted", counted)
    return seen


def walked(forest):
    below, want = children(forest), {}
    for tree in {r[0] for r in forest}:
        stack = ["n0"]
        for place in range(sum(r[0] == tree for r in forest)):
            node = stack.pop()
            want[tree, node] = place
            stack += [c[1] for c in sorted(below.get((tree, node), []), key=lambda c: -c[5][-1])]
    return want


@pytest.mark.parametrize("small", [100_000, 60, 0])
def test_places(nodes, forest, monkeypatch, rounds, small):
    """No rounds for small trees; larger ones are toured."""
    monkeypatch.setattr(small_trees, "SMALL_TREE", small)
    monkeypatch.setattr(small_trees, "GROUP_NODES", 100)
    got = {(r["tree_id"], r["node_id"]): r["place"] for r in trees.walk_order(nodes).collect()}
    assert got == walked(forest)
    assert bool(rounds) == (small < 90)


@pytest.mark.parametrize("small", [100_000, 60])
def test_rewards(spark, nodes, forest, monkeypatch, rounds, small):
    """No rounds for small trees; a node of no rewarded child keeps its own, and other columns stay."""
    monkeypatch.setattr(small_trees, "SMALL_TREE", small)
    forest = [*forest, (9, "n0", None, 0, 0.5, [0]), (9, "n1", "n0", 1, None, [0])]
    nodes = spark.createDataFrame(forest, SCHEMA)
    below, want = children(forest), {}
    for r in sorted(forest, key=lambda r: -r[3]):
        values = [want[c[0], c[1]] for c in below.get((r[0], r[1]), [])]
        values = [v for v in values if v is not None]
        want[r[0], r[1]] = sum(values) / len(values) if values else r[4]
    moved = trees.propagate_rewards(nodes)
    assert moved.columns == [*nodes.columns, "is_leaf"] and dict(moved.dtypes) == {**dict(nodes.dtypes), "is_leaf": "boolean"}
    rows = moved.collect()
    assert {(r["tree_id"], r["node_id"]): r["reward"] for r in rows} == {
        k: None if v is None else pytest.approx(v, abs=1e-12) for k, v in want.items()}
    assert all(r["is_leaf"] == ((r["tree_id"], r["node_id"]) not in below) for r in rows)
    assert bool(rounds) == (small < 90)


@pytest.mark.parametrize("small", [100_000, 30])
def test_roots(spark, forest, monkeypatch, rounds, small):
    """No rounds for small trees; ids hold across trees, so a link may lead into another one."""
    monkeypatch.setattr(small_trees, "SMALL_TREE", small)
    forest = [(t, f"{t}{n}", p and f"{t}{p}", *rest) for t, n, p, *rest in forest]
    frame = spark.createDataFrame(forest, SCHEMA)
    want = {r[1]: f"{r[0]}n0" for r in forest}
    assert {r["node_id"]: r["root_id"] for r in trees.node_to_root(frame).collect()} == want
    assert bool(rounds) == (small < 90)
    joined = spark.createDataFrame([*forest, (7, "own", None, 0, 0.0, [0]), (7, "far", "0n5", 6, 0.0, [0])], SCHEMA)
    got = {r["node_id"]: r["root_id"] for r in trees.node_to_root(joined).collect()}
    assert got == {**want, "own": "own", "far": "0n0"}
