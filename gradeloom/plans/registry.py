"""All registered queries."""

from __future__ import annotations

from gradeloom.plans import (
    curation_queries,
    grading_queries,
    rollout_queries,
    tree_queries,
    shaping_queries,
    similarity_queries,
    contest_queries,
    io_queries,
)
from gradeloom.plans.base import Query

FAMILIES = [
    curation_queries,
    grading_queries,
    rollout_queries,
    tree_queries,
    shaping_queries,
    similarity_queries,
    contest_queries,
    io_queries,
]


def all_queries() -> list[Query]:
    out = [q for family in FAMILIES for q in family.QUERIES]
    names = [q.name for q in out]
    assert len(names) == len(set(names)), "two queries share a name"
    return out
