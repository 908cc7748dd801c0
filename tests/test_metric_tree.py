"""The tree of clusters: exact results, leaves of bounded size, few copies on clustered data."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gradeloom.operators import similarity
from tests.test_operators import brute_force, vector_frame


def nested(n, seed=0):
    """Clusters of clusters of unit vectors, twenty to each."""
    rng = np.random.default_rng(seed)
    wide = rng.normal(size=(n // 200, 16))
    narrow = np.repeat(wide, 10, axis=0) + 0.15 * rng.normal(size=(n // 20, 16))
    v = np.repeat(narrow, 20, axis=0) + 0.01 * rng.normal(size=(n, 16))
    return v / np.linalg.norm(v, axis=1, keepdims=True)


@pytest.fixture
def small_fanout(monkeypatch):
    monkeypatch.setattr(similarity, "FANOUT", 6)
    monkeypatch.setattr(similarity, "ASSIGNED_ROWS", 150)


@pytest.mark.parametrize("tau", [None, 0.99])
def test_deep_tree_is_exact(spark, small_fanout, tau):
    v = nested(400)
    df = vector_frame(spark, v)
    got = {q: [] for q in range(400)}
    for r in similarity.cosine_topk(df, df, 3, tau, exclude_self=True, block_rows=10).orderBy("rank").collect():
        got[r["query"]].append(r["doc"])
    assert got == brute_force(v, v, 3, tau, True)


def test_leaves_and_copies_are_bounded(spark, small_fanout):
    """The same at two sizes: leaves hold a block, a query within reach of its cluster visits few."""
    copies = {}
    for n in (800, 2_400):
        vectors = vector_frame(spark, nested(n)).select(F.col("id").alias("group"), "vec", F.lit(0.12).alias("reach"))
        tree = similarity.MetricTree(vectors, n, 16)
        sizes = {r["node"]: r["n"] for r in tree.sizes.collect()}
        assert max(sizes.values()) <= 64 and sum(sizes.values()) == n
        assert {r["node"]: r["count"] for r in tree.leaves.groupBy("node").count().collect()} == sizes
        assert len(tree.levels) >= 2
        copies[n] = tree.routed(vectors, n).count() / n
        assert tree.routed(vectors, n, least=3).count() == n
    assert copies[2_400] <= max(4.0, 1.5 * copies[800]), copies


def test_reach_of_everything_visits_every_leaf(spark, small_fanout):
    vectors = vector_frame(spark, nested(400)).select(F.col("id").alias("group"), "vec", F.lit(math.pi).alias("reach"))
    tree = similarity.MetricTree(vectors, 400, 16)
    assert tree.routed(vectors.where("group < 5"), 5).count() == 5 * tree.sizes.count()


def test_vectors_that_do_not_come_apart(spark, small_fanout, monkeypatch):
    """Levels end; what is too large then is met in blocks."""
    monkeypatch.setattr(similarity, "MAX_LEVELS", 1)
    v = nested(400)
    df = vector_frame(spark, v)
    got = {q: [] for q in range(400)}
    for r in similarity.cosine_topk(df, df, 2, exclude_self=True, block_rows=8).orderBy("rank").collect():
        got[r["query"]].append(r["doc"])
    assert got == brute_force(v, v, 2, None, True)


@pytest.mark.parametrize("tau", [None, 0.3])
def test_vectors_without_structure_are_not_copied_to_every_leaf(spark, small_fanout, monkeypatch, tau):
    """Clusters keep nothing away here: each query is sent once, and parts of the tables meet piece by piece."""
    monkeypatch.setattr(similarity, "SHOWN_QUERIES", 30)
    monkeypatch.setattr(similarity, "TASK_BLOCKS", 3)
    sent, plain = [], similarity._sent
    monkeypatch.setattr(similarity, "_sent", lambda *a: sent.append(plain(*a)) or sent[-1])
    v = np.random.default_rng(5).normal(size=(300, 16))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    df = vector_frame(spark, v)
    got = {q: [] for q in range(300)}
    for r in similarity.cosine_topk(df, df, 3, tau, exclude_self=True, block_rows=10).orderBy("rank").collect():
        got[r["query"]].append(r["doc"])
    assert got == brute_force(v, v, 3, tau, True)
    assert sent[-1].count() == 300
