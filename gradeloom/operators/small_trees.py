"""Trees that fit a task, many to a task.

Trees of at most `SMALL_TREE` nodes are dealt by a hash of their id to groups of about `GROUP_NODES`
nodes. A group finds the row of each parent by sorting, and all its trees go up and down together
in array steps, so the whole table is shuffled once instead of once a round. What a group
must not settle comes back for the rounds that take any tree: larger trees, trees without id, and
trees that break a rule (an id that is null or repeats, a lost parent, a cycle).
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeloom.operators.pointers import counted

# A tree with more nodes than this is not settled in one task.
SMALL_TREE = 100_000
# Nodes that are settled at a time, on average.
GROUP_NODES = 200_000
ID_TYPES = {"string", "bigint", "int", "smallint", "tinyint"}

Settle = Callable[[pa.Table, np.ndarray], dict[str, pa.Array]]


def settled_in_groups(nodes: DataFrame, settle: Settle, added: str, name: str) -> tuple[DataFrame | None, DataFrame | None]:
    """The rows of small trees with the columns `settle` gives, and all other rows; None where there are none.

    `settle` gets the rows of whole trees and, for each, the row of its parent (-1 for a root).
    A column it gives takes the place of one of that name; `added` is the schema of new ones.
    """
    kinds = dict(nodes.dtypes)
    if not {kinds["tree_id"], kinds["node_id"]} <= ID_TYPES or kinds["parent_id"] != kinds["node_id"]:
        return None, nodes
    sizes = nodes.groupBy("tree_id").agg(F.count(F.lit(1)).alias("n"))
    large = F.col("tree_id").isNull() | (F.col("n") > SMALL_TREE)
    shape = sizes.agg(F.sum("n").alias("n"), F.count_if(large).alias("large")).first()
    others = sizes.where(large).select(F.col("tree_id").alias("__other")) if shape["large"] else None
    small = nodes if others is None else nodes.join(others, F.col("tree_id").eqNullSafe(F.col("__other")), "left_anti")
    groups = -(-(shape["n"] or 1) // GROUP_NODES)
    columns = nodes.columns

    def settled(rows: pa.Table) -> pa.Table:
        rows = rows.select(columns)
        parent, whole = parent_rows(rows["tree_id"], rows["node_id"], rows["parent_id"])
        given = settle(rows, parent)
        return pa.table({**{c: rows[c] for c in columns}, **given, "__whole": whole})

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in nodes.schema)
    schema = f"{kept}, {added}, __whole boolean"
    done, found = counted(
        small.groupBy(F.pmod(F.xxhash64("tree_id"), F.lit(groups)).alias("__group")).applyInArrow(settled, schema),
        name, broken=~F.col("__whole"))
    if found["broken"]:
        broken = done.where("not __whole").select(F.col("tree_id").alias("__other")).distinct()
        others = broken if others is None else others.unionByName(broken)
        done = done.where("__whole")
    done = done.drop("__whole")
    if others is None:
        return done, None
    return done, nodes.join(others, F.col("tree_id").eqNullSafe(F.col("__other")), "left_semi")


def _codes(values: pa.Array) -> np.ndarray:
    """Equal values as equal numbers from 0, null as -1."""
    return pc.fill_null(values.dictionary_encode().indices, -1).to_numpy(zero_copy_only=False).astype(np.int64)


def _flat(column: pa.ChunkedArray) -> pa.Array:
    return pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)


def parent_rows(tree: pa.ChunkedArray, node: pa.ChunkedArray, parent: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The row of each row's parent, -1 for none, and whether the row's tree keeps all rules.

    In a tree that does not, every row counts as a root.
    """
    n = len(node)
    trees = _codes(_flat(tree))
    ids = _codes(pa.concat_arrays([_flat(node), _flat(parent)]))
    width = ids.max(initial=0) + 1
    own, above = trees * width + ids[:n], trees * width + ids[n:]
    order = np.argsort(own, kind="stable")
    ordered = own[order]
    at = np.minimum(np.searchsorted(ordered, above), max(n - 1, 0))
    has = ids[n:] >= 0
    met = has & (ordered[at] == above)
    wrong = (ids[:n] < 0) | (has & ~met)
    wrong[order[1:][ordered[1:] == ordered[:-1]]] = True
    rows = np.where(met, order[at], -1)
    broken = np.zeros(trees.max(initial=0) + 1, bool)
    broken[trees[wrong]] = True
    rows[broken[trees]] = -1
    _, ends = summed_above(rows, np.zeros(n, np.int64))
    if not ends.all():
        broken[trees[~ends]] = True
        rows[broken[trees]] = -1
    return rows, ~broken[trees]


def summed_above(parent: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The weights of each row and of all rows above it, and whether its way ends at a root."""
    n = len(parent)
    jump = np.append(np.where(parent < 0, n, parent), n)
    total = np.append(weight, 0)
    for _ in range(n.bit_length() + 1):
        if (jump == n).all():
            break
        total = total + total[jump]
        jump = jump[jump]
    return total[:n], jump[:n] == n


def levels(parent: np.ndarray) -> list[np.ndarray]:
    """The rows of each depth, roots first."""
    depth, _ = summed_above(parent, np.ones(len(parent), np.int64))
    order = np.argsort(depth, kind="stable")
    return np.split(order, np.flatnonzero(np.diff(depth[order])) + 1)


def places(rows: pa.Table, parent: np.ndarray) -> dict[str, pa.Array]:
    """Pre-order places; siblings are ordered by `__child`, nulls first."""
    n = len(parent)
    size = np.ones(n, np.int64)
    for at in reversed(levels(parent)[1:]):
        np.add.at(size, parent[at], size[at])
    by_child = pc.array_sort_indices(_flat(rows["__child"]), null_placement="at_start").to_numpy().astype(np.int64)
    order = by_child[np.argsort(parent[by_child], kind="stable")]
    order = order[parent[order] >= 0]
    inside = size[order]
    before = np.cumsum(inside) - inside
    first = np.append(True, np.diff(parent[order]) != 0)[: len(order)]
    before -= before[first][np.cumsum(first) - 1]
    step = np.zeros(n, np.int64)
    step[order] = before + 1
    return {"place": pa.array(summed_above(parent, step)[0])}


def means(rows: pa.Table, parent: np.ndarray) -> dict[str, pa.Array]:
    """Each inner node's reward as the mean of its children's, nulls left out, and whether it is a leaf."""
    n = len(parent)
    own = _flat(rows["reward"])
    known = pc.is_valid(own).to_numpy(zero_copy_only=False).copy()
    value = pc.fill_null(own, 0.0).to_numpy(zero_copy_only=False).copy()
    total, count = np.zeros(n), np.zeros(n, np.int64)
    for at in reversed(levels(parent)):
        told = at[count[at] > 0]
        value[told] = total[told] / count[told]
        known[told] = True
        up = at[known[at] & (parent[at] >= 0)]
        np.add.at(total, parent[up], value[up])
        np.add.at(count, parent[up], 1)
    leaf = np.ones(n, bool)
    leaf[parent[parent >= 0]] = False
    return {"reward": pa.array(value, mask=~known), "is_leaf": pa.array(leaf)}


def roots(rows: pa.Table, parent: np.ndarray) -> dict[str, pa.Array]:
    """The id of each row's root."""
    n = len(parent)
    top, before = np.where(parent < 0, np.arange(n), parent), None
    while before is None or (top != before).any():
        before, top = top, top[top]
    return {"root_id": _flat(rows["node_id"]).take(pa.array(top))}
