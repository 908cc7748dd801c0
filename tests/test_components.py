"""Components and removals in order, against plain Python."""

import random

import pytest

from gradeloom.operators import pointers, similarity


def drawn_edges(seed):
    """Long chains, dense knots and single pairs."""
    draw = random.Random(seed)
    edges = [(i, i + 1) for i in range(300)]
    chain = draw.sample(range(1_000, 1_200), 200)
    edges += list(zip(chain, chain[1:]))
    edges += [(draw.randrange(2_000, 2_040), draw.randrange(2_000, 2_040)) for _ in range(150)]
    edges += [(i, i + 1) for i in range(3_000, 3_100, 2)]
    return [e for e in edges if e[0] != e[1]]


def brute_components(edges):
    lead = {}

    def find(x):
        while lead.setdefault(x, x) != x:
            x = lead[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        lead[b] = a
    return {x: find(x) for x in list(lead)}


@pytest.mark.parametrize("seed", [0, 1])
def test_components(spark, seed):
    edges = drawn_edges(seed)
    frame = spark.createDataFrame(edges, "src long, dst long")
    got = {r["id"]: r["component"] for r in pointers.components(frame).collect()}
    assert got == brute_components(edges)
    assert {r["id"]: r["component"] for r in pointers.components(frame, hot_rows=20).collect()} == got
    assert pointers.components(frame.limit(0)).count() == 0


@pytest.mark.parametrize("small", [500_000, 100])
def test_removal_in_order(spark, monkeypatch, small):
    edges = drawn_edges(2)
    removed, targets = set(), {}
    for a, b in edges:
        targets.setdefault(a, set()).add(b)
    for a in sorted(targets):
        if a not in removed:
            removed |= targets[a]
    frame = spark.createDataFrame(edges, "src long, dst long")
    assert {r["id"] for r in similarity.removed_in_order(frame, small).collect()} == removed


def test_rounds_do_not_follow_chains(spark, monkeypatch):
    """A chain of 600 takes the first rounds and one task, not 300 rounds."""
    seen = []
    plain = similarity._mark
    monkeypatch.setattr(similarity, "_mark", lambda *a: seen.append(1) or plain(*a))
    frame = spark.range(600).selectExpr("id AS src", "id + 1 AS dst")
    got = {r["id"] for r in similarity.removed_in_order(frame).collect()}
    assert got == set(range(1, 601, 2)) and len(seen) <= similarity.FIRST_ROUNDS + 1
