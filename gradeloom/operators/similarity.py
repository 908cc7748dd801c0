"""Exact nearest neighbours by cosine, as blocked matrix products.

The tables are cut into blocks; a block of queries meets a block of documents in
one task, which multiplies two small matrices and keeps the best few per query.
No pair table exists. Two things keep the work down without losing a result:

* equal vectors are one vector: only the lowest ids of a copy group can appear in
  an answer, and all copies share one neighbour list;
* a tree of clusters keeps a query to the leaves that can hold a match. By the triangle
  inequality for angles, a vector at angle a from a pivot is at least a - r away from every
  member of the pivot's cluster of radius r. Clusters split again until a few blocks hold one, so
  leaves grow in number with the table, not in size. Where a sample of the queries shows that the
  clusters keep little away, parts of the whole tables meet instead.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradeloom.operators.ordering import hash52
from gradeloom.operators.pointers import components
from gradeloom.operators.skew import join_keyed, with_group_stats
from gradeloom.session import checkpointed, stored

BLOCK_ROWS = 2048
# A cluster of more blocks than this is split.
LEAF_BLOCKS = 4
# Clusters that one is split into, and how often one is split.
FANOUT = 64
MAX_LEVELS = 9
# Vectors of a cluster that one task holds against its pivots.
ASSIGNED_ROWS = 32_768
# Queries that one call sends on: each can go on to all pivots, with its vector.
ROUTED_ROWS = 512
# Blocks of either side that meet in one task.
TASK_BLOCKS = 16
# About so many queries show whether clusters keep work down; if these are sent to more
# than this share of all documents, every block meets every other.
SHOWN_QUERIES = 1024
DENSE = 0.25
ANGLE_SLACK = 1e-6
# More than the digits that are cut from scores.
SCORE_SLACK = 1e-11
BEST_SCHEMA = "query bigint, doc bigint, score double"


def unit_vectors(df: DataFrame, id_column: str, vector: str) -> DataFrame:
    """(id, vec) with vectors of length one as doubles; a zero vector stays zero."""
    values = F.col(vector).cast("array<double>")
    norm = F.sqrt(F.aggregate(values, F.lit(0.0), lambda a, v: a + v * v))
    scaled = F.transform("__v", lambda v: F.when(F.col("__n") > 0, v / F.col("__n")).otherwise(0.0))
    return df.select(F.col(id_column).alias("id"), values.alias("__v"), norm.alias("__n")).select(
        "id", scaled.alias("vec")
    )


def _copy_groups(vectors: DataFrame, keep: int) -> tuple[DataFrame, DataFrame]:
    """Each id with its group (the lowest id of equal vectors), and one row per group."""
    # The hash goes first: sorting then compares vectors only where hashes agree.
    hashed = vectors.withColumn("hash", F.xxhash64("vec"))
    members = checkpointed(
        with_group_stats(hashed, ["hash", "vec"], {"group": F.min("id")}).drop("hash")
    )
    lowest = Window.partitionBy("group").orderBy("id")
    # The rank limit is applied before the shuffle, so a large copy group sends few rows.
    groups = (
        members.withColumn("__rank", F.row_number().over(lowest))
        .where(F.col("__rank") <= keep)
        .groupBy("group")
        .agg(F.min_by("vec", "id").alias("vec"), F.array_sort(F.collect_list("id")).alias("ids"))
    )
    return members.select("id", "group"), checkpointed(groups)


def _dealt(rows: DataFrame, keys: str, sizes: DataFrame, per_task: int) -> DataFrame:
    """Adds `parts`, how many tasks share the rows of a node, and `part`, the row's own, by its group."""
    parts = F.ceil(F.col("__n") / per_task).cast("int")
    sized = join_keyed(rows, sizes.select(keys, F.col("n").alias("__n")), [keys])
    return sized.withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("group"), F.col("parts")).cast("int")).drop("__n")


def _every_part(rows: DataFrame) -> DataFrame:
    return rows.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))


def _angles(left: pd.Series, right: pd.Series) -> np.ndarray:
    return np.arccos(np.clip(np.stack(left.to_numpy()) @ np.stack(right.to_numpy()).T, -1.0, 1.0))


class MetricTree:
    """Document vectors in a tree of clusters, built level by level.

    A cluster with more than `LEAF_BLOCKS` blocks is split by up to `FANOUT` vectors, its pivots;
    each vector goes to the nearest. `levels` holds, per level, the children: `parent`, `node`,
    `pivot`, the largest angle `radius` of a member to it, and `n`. `leaves` has `group`,
    `vec` and `node` of all vectors, `sizes` the leaves' `n`. All are tables; none is collected.
    """

    def __init__(self, docs: DataFrame, n_docs: int, block_rows: int, split: bool = True):
        rows = docs.select("group", "vec", F.lit(0).cast("bigint").alias("node"))
        self.levels: list[DataFrame] = []
        most = LEAF_BLOCKS * block_rows
        if n_docs <= most or not split:
            self.leaves = rows
            self.sizes = docs.sparkSession.range(1).select(F.lit(0).cast("bigint").alias("node"), F.lit(n_docs).alias("n"))
            return
        open_ = rows.withColumn("n", F.lit(n_docs).cast("bigint"))
        leaves, sizes = [], []
        for _ in range(MAX_LEVELS):
            assigned, children = self._split(open_, block_rows)
            self.levels.append(children)
            small = F.col("n") <= most
            sized = stored(join_keyed(assigned, children.select("node", "n"), ["node"]), "cluster_rows")
            leaves.append(sized.where(small).select("group", "vec", "node"))
            sizes.append(children.where(small).select("node", "n"))
            open_, last = sized.where(~small), children.where(~small).select("node", "n")
            if last.isEmpty():
                break
        # A cluster that would not come apart is met in blocks.
        leaves.append(open_.select("group", "vec", "node"))
        sizes.append(last)
        self.leaves = reduce(DataFrame.unionByName, leaves)
        self.sizes = reduce(DataFrame.unionByName, sizes)

    @staticmethod
    def _split(rows: DataFrame, block_rows: int) -> tuple[DataFrame, DataFrame]:
        """Each row with its child node, and the children."""
        # Spark cuts to the first few rows of a node before it shuffles them.
        drawn = Window.partitionBy("node").orderBy(hash52(F.col("group"), 0), "group")
        wanted = F.ceil(F.col("n") / block_rows) + 1
        pivots = stored(
            rows.withColumn("__at", F.row_number().over(drawn))
            .where((F.col("__at") <= FANOUT) & (F.col("__at") <= wanted))
            .select(F.col("node").alias("parent"), F.col("vec").alias("pivot"), "n",
                    (F.col("node") * FANOUT + F.col("__at")).alias("child")), "pivots")
        parts = F.ceil(F.col("n") / ASSIGNED_ROWS).cast("int")
        dealt = rows.withColumn("part", F.pmod(F.xxhash64("group"), parts).cast("int"))
        each = _every_part(pivots.withColumn("parts", parts)).withColumnRenamed("parent", "node")

        def nearest(members: pd.DataFrame, around: pd.DataFrame) -> pd.DataFrame:
            if not len(members):
                return pd.DataFrame({"group": [], "vec": [], "node": [], "parent": [], "angle": []})
            angles = _angles(members["vec"], around["pivot"])
            best = angles.argmin(axis=1)
            return pd.DataFrame({
                "group": members["group"], "vec": members["vec"], "node": around["child"].to_numpy()[best],
                "parent": members["node"], "angle": angles[np.arange(len(best)), best]})

        assigned = stored(
            dealt.select("group", "vec", "node", "part").groupBy("node", "part")
            .cogroup(each.select("node", "part", "pivot", "child").groupBy("node", "part"))
            .applyInPandas(nearest, "group bigint, vec array<double>, node bigint, parent bigint, angle double"), "assigned")
        shape = assigned.groupBy("node").agg(F.max("angle").alias("radius"), F.count(F.lit(1)).alias("n"))
        children = pivots.select("parent", F.col("child").alias("node"), "pivot").join(shape, "node")
        return assigned.select("group", "vec", "node"), stored(children, "children")

    def routed(self, queries: DataFrame, n_queries: int, least: int | None = None) -> DataFrame:
        """Queries (`group`, `vec`, `reach`) at the leaves that may hold a vector within that angle.

        With `least`, each goes to one leaf, the nearest among clusters of that many vectors.
        """
        columns = "group bigint, vec array<double>, reach double, node bigint"
        at = queries.select("group", "vec", "reach", F.lit(0).cast("bigint").alias("node"))
        arrived = []
        for depth, children in enumerate(self.levels):
            inner = children.select(F.col("parent").alias("node")).distinct()
            if depth:
                arrived.append(at.join(inner, "node", "left_anti"))
                at = stored(at.join(inner, "node", "left_semi"), "frontier")
                counts = at.groupBy("node").agg(F.count(F.lit(1)).alias("n"))
            else:
                counts = inner.withColumn("n", F.lit(n_queries))
            dealt = _dealt(at, "node", counts, ROUTED_ROWS)
            parts = counts.select("node", F.ceil(F.col("n") / ROUTED_ROWS).cast("int").alias("parts"))
            each = _every_part(children.select(
                F.col("parent").alias("node"), F.col("node").alias("child"), "pivot", "radius", "n").join(parts, "node"))

            def onward(rows: pd.DataFrame, around: pd.DataFrame) -> pd.DataFrame:
                if not len(rows) or not len(around):
                    return pd.DataFrame({"group": [], "vec": [], "reach": [], "node": []})
                angles = _angles(rows["vec"], around["pivot"])
                if least is None:
                    kept = angles - around["radius"].to_numpy() <= rows["reach"].to_numpy()[:, None] + ANGLE_SLACK
                else:
                    enough = around["n"].to_numpy() >= min(least, int(around["n"].max()))
                    best = np.where(enough, angles, np.inf).argmin(axis=1)
                    kept = best[:, None] == np.arange(angles.shape[1])
                q, c = np.nonzero(kept)
                out = rows[["group", "vec", "reach"]].iloc[q].reset_index(drop=True)
                out["node"] = around["child"].to_numpy()[c]
                return out

            at = stored(
                dealt.drop("parts").groupBy("node", "part")
                .cogroup(each.select("node", "part", "child", "pivot", "radius", "n").groupBy("node", "part"))
                .applyInPandas(onward, columns), "frontier")
        return reduce(DataFrame.unionByName, [*arrived, at]).select("group", "vec", "node")


def _best_in_block(k: int, tau: float, block_rows: int):
    def best(queries: pd.DataFrame, docs: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(docs):
            return pd.DataFrame({"query": [], "doc": [], "score": []})
        asked, held = np.stack(queries["vec"].to_numpy()), np.stack(docs["vec"].to_numpy())
        found = [(start, *_best_of_piece(asked[start : start + block_rows], held, k, tau, block_rows))
                 for start in range(0, len(asked), block_rows)]
        return pd.DataFrame({
            "query": queries["group"].to_numpy()[np.concatenate([start + q for start, q, _, _ in found])],
            "doc": docs["group"].to_numpy()[np.concatenate([d for _, _, d, _ in found])],
            "score": np.concatenate([s for _, _, _, s in found])})

    return best


def _best_of_piece(asked: np.ndarray, held: np.ndarray, k: int, tau: float, block_rows: int) -> tuple[np.ndarray, ...]:
    """Places of queries and documents and their scores: the best `k` of each query above `tau`, and ties."""
    q, d, score = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    # Per query, what a score must reach: its `k`-th best so far.
    low = np.full(len(asked), tau)
    for at in range(0, len(held), block_rows):
        cos = asked @ held[at : at + block_rows].T
        if tau < -1.0 and not at and cos.shape[1] > k:
            low = np.round(np.partition(cos, -k, axis=1)[:, -k], 12)
        i, j = np.nonzero(cos >= (low - SCORE_SLACK)[:, None])
        # Cut the last bits, which depend on the shape of the block.
        new = np.round(cos[i, j], 12)
        kept = (new > tau) & (new >= low[i])
        q, d, score = np.append(q, i[kept]), np.append(d, j[kept] + at), np.append(score, new[kept])
        order = np.lexsort((-score, q))
        q, d, score = q[order], d[order], score[order]
        first = np.searchsorted(q, np.arange(len(asked)))
        enough = np.append(first[1:], len(q)) - first >= k
        low[enough] = score[first[enough] + k - 1]
        kept = score >= low[q]
        q, d, score = q[kept], d[kept], score[kept]
    return q, d, score


def _best_groups(queries: DataFrame, docs: DataFrame, k: int, tau: float | None,
                 block_rows: int) -> DataFrame:
    """The best `k` document groups of each query group (more when scores tie).

    Without a threshold each query first meets the documents of one near leaf; its
    `k`-th score there bounds the angle at which a better one can be, and only leaves
    within that reach are visited.
    """
    n_docs, n_queries = docs.count(), queries.count()
    if not n_docs or not n_queries:
        return docs.sparkSession.createDataFrame([], BEST_SCHEMA)
    tree = MetricTree(docs, n_docs, block_rows)
    floor = -2.0 if tau is None else tau
    if tree.levels:
        one_of = max(1, n_queries // SHOWN_QUERIES)
        shown = queries.where(F.pmod(F.xxhash64("group", F.lit(1)), F.lit(one_of)) == 0)
        sent = _sent(shown, max(1, n_queries // one_of), tree, block_rows, k, tau, floor).join(tree.sizes, "node")
        work, asked = sent.agg(F.sum("n"), F.count_distinct("group")).first()
        if (work or 0) > DENSE * asked * n_docs:
            tree = MetricTree(docs, n_docs, block_rows, split=False)
    return _meet(_sent(queries, n_queries, tree, block_rows, k, tau, floor), tree, n_queries, block_rows, k, floor)


def _sent(queries: DataFrame, n_queries: int, tree: MetricTree, block_rows: int, k: int, tau: float | None, floor: float) -> DataFrame:
    """The queries at all leaves where they can find one of their best."""
    if tau is not None or not tree.levels:
        reach = math.pi if tau is None else math.acos(max(-1.0, min(1.0, tau)))
        return tree.routed(queries.withColumn("reach", F.lit(reach)), n_queries)
    near = tree.routed(queries.withColumn("reach", F.lit(math.pi)), n_queries, least=k)
    first = _meet(near, tree, n_queries, block_rows, k, floor)
    best = Window.partitionBy("query").orderBy(F.desc("score"))
    bound = (
        first.withColumn("__rank", F.row_number().over(best)).where(F.col("__rank") == k)
        .select(F.col("query").alias("group"), F.acos(F.col("score") - SCORE_SLACK).alias("reach"))
    )
    bounded = stored(queries.join(bound, "group", "left").fillna({"reach": math.pi}).select("group", "vec", "reach"), "bounded")
    return tree.routed(bounded, n_queries)


def _meet(routed: DataFrame, tree: MetricTree, n_queries: int, block_rows: int, k: int, floor: float) -> DataFrame:
    """Queries against documents of the same leaf, both cut by hash into blocks.

    A task holds up to `TASK_BLOCKS` blocks of either side and multiplies them pair by pair. A row is
    copied once for each such part of the other side in that leaf.
    """
    task_rows = TASK_BLOCKS * block_rows
    if tree.levels:
        routed = stored(routed, "routed")
        asked = routed.groupBy("node").agg(F.count(F.lit(1)).alias("asked"))
    else:
        asked = tree.sizes.select("node", F.lit(n_queries).alias("asked"))
    blocks = tree.sizes.join(asked, "node").select(
        "node", F.ceil(F.col("n") / task_rows).cast("int").alias("doc_parts"),
        F.ceil(F.col("asked") / task_rows).cast("int").alias("query_parts"))
    if tree.levels:
        blocks = stored(blocks, "blocks")

    def side(rows: DataFrame, own: str, other: str) -> DataFrame:
        cut = join_keyed(rows, blocks, ["node"]).withColumn(own, F.pmod(F.xxhash64("group"), F.col(f"{own}s")).cast("int"))
        copied = cut.withColumn(other, F.explode(F.sequence(F.lit(0), F.col(f"{other}s") - 1)))
        return copied.select("group", "vec", "node", "doc_part", "query_part")

    keys = ["node", "doc_part", "query_part"]
    # Queries may be the documents themselves; the names make their columns others.
    leaves = tree.leaves.toDF("doc", "doc_vec", "leaf").toDF("group", "vec", "node")
    left, right = side(routed, "query_part", "doc_part"), side(leaves, "doc_part", "query_part")
    return (
        left.groupBy(*keys)
        .cogroup(right.groupBy(*keys))
        .applyInPandas(_best_in_block(k, floor, block_rows), BEST_SCHEMA)
    )


def cosine_topk(
    queries: DataFrame,
    docs: DataFrame,
    k: int,
    tau: float | None = None,
    exclude_self: bool = False,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """The best `k` documents of each query, by score then id: (query, doc, score, rank).

    Both tables are (id, vec) with unit vectors. With `tau`, only scores above it
    count. `exclude_self` leaves out the document with the query's own id.
    """
    wanted = k + 1 if exclude_self else k
    members, groups = _copy_groups(docs, wanted)
    asking, query_groups = (members, groups) if exclude_self else _copy_groups(queries, 1)
    best = _best_groups(query_groups, groups, wanted, tau, block_rows)
    # Few rows per query: `wanted` from each block it visited.
    found = Window.partitionBy("query").orderBy(F.desc("score"), "doc")
    best = best.withColumn("__rank", F.row_number().over(found)).where(F.col("__rank") <= wanted)
    entry = F.struct((F.lit(0.0) - F.col("score")).alias("minus"), F.col("doc_id").alias("doc"))
    lists = (
        best.join(groups.select(F.col("group").alias("doc"), "ids"), "doc")
        .select("query", "score", F.explode("ids").alias("doc_id"))
        .groupBy("query")
        .agg(F.slice(F.array_sort(F.collect_list(entry)), 1, wanted).alias("found"))
        .withColumnRenamed("query", "group")
    )
    hits = join_keyed(asking, lists, ["group"])
    kept = F.col("found")
    if exclude_self:
        kept = F.slice(F.filter("found", lambda e: e["doc"] != F.col("id")), 1, k)
    return hits.select("id", F.posexplode(kept).alias("place", "e")).select(
        F.col("id").alias("query"),
        F.col("e.doc").alias("doc"),
        (F.lit(0.0) - F.col("e.minus")).alias("score"),
        (F.col("place") + 1).alias("rank"),
    )


def exclude_similar(
    candidates: DataFrame, reference: DataFrame, tau: float, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Candidates (id, vec) without a reference vector above the threshold."""
    hits = cosine_topk(candidates, reference, 1, tau, block_rows=block_rows)
    return candidates.join(hits.select(F.col("query").alias("id")), "id", "left_anti")


def exclude_matched_bad(
    dataset: DataFrame, bad: DataFrame, min_score: float = 0.99, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """The dataset without the best match of each bad item, which must be that close."""
    best = cosine_topk(bad, dataset, 1, min_score - SCORE_SLACK, block_rows=block_rows)
    message = F.concat(F.lit("no match close enough for "), F.col("query").cast("string"))
    every = bad.select(F.col("id").alias("query")).join(best, "query", "left")
    sure = every.select(
        F.when(F.col("score") >= min_score, F.col("doc")).otherwise(
            F.raise_error(message).cast("bigint")
        ).alias("id")
    )
    return dataset.join(sure, "id", "left_anti")


# Rounds before what is open is split into components.
FIRST_ROUNDS = 6
# A component with more edges than this is settled in rounds, not in one task.
SMALL_COMPONENT = 500_000


def removed_in_order(edges: DataFrame, small_component: int = SMALL_COMPONENT) -> DataFrame:
    """Ids removed when documents act in id order, each removing its targets (src, dst).

    A removed document does not act. One is passive once a lower id that targets it
    acts, and acts once no lower id that may act targets it. Each round settles all
    documents it can and keeps only the edges still in question; the lowest open
    document is always among the settled, so the rounds end. Most are settled at once. What is open after
    `FIRST_ROUNDS` rounds hangs on chains: it is split into connected components, each of which one task
    settles in order, and only a component too large for that goes on in rounds.
    """
    edges = checkpointed(edges.select("src", "dst").distinct())
    forward = edges.where(F.col("src") < F.col("dst"))
    threatened = forward.select(F.col("dst").alias("src")).distinct()
    free = edges.select("src").distinct().join(threatened, "src", "left_anti")
    acting = [free]
    question = checkpointed(_mark(forward, free))
    rounds = 0
    while not question.isEmpty():
        if rounds == FIRST_ROUNDS:
            settled, question = _by_component(question, small_component)
            acting.append(settled)
            if question.isEmpty():
                break
        rounds += 1
        passive = question.where("acts").select(F.col("dst").alias("id")).distinct()
        open_edges = question.join(passive.withColumnRenamed("id", "dst"), "dst", "left_anti").join(
            passive.withColumnRenamed("id", "src"), "src", "left_anti"
        ).select("src", "dst")
        settled = open_edges.select("dst").unionByName(passive.withColumnRenamed("id", "dst"))
        freed = checkpointed(
            question.select("dst").distinct().join(settled, "dst", "left_anti")
            .withColumnRenamed("dst", "src")
        )
        acting.append(freed)
        question = checkpointed(_mark(open_edges, freed))
    all_acting = reduce(DataFrame.unionByName, acting)
    return edges.join(all_acting, "src", "left_semi").select(F.col("dst").alias("id")).distinct()


def _in_order(edges: pd.DataFrame) -> pd.DataFrame:
    """The ids of one component that act, lowest first."""
    edges = edges.sort_values("dst", kind="stable")
    targets, sources = edges["dst"].to_numpy(), edges["src"].to_numpy()
    ids = np.union1d(targets, sources)
    begin, end = np.searchsorted(targets, ids, "left"), np.searchsorted(targets, ids, "right")
    at = np.searchsorted(ids, sources)
    acts = np.ones(len(ids), bool)
    for i in range(len(ids)):
        # All sources are lower ids, which are settled.
        acts[i] = not acts[at[begin[i] : end[i]]].any()
    return pd.DataFrame({"src": ids[acts]})


def _by_component(question: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """What acts in components of at most `most` edges, and the edges of the others."""
    member = components(question).select(F.col("id").alias("src"), "component")
    rows = join_keyed(question, member, ["src"])
    sizes = rows.groupBy("component").agg(F.count(F.lit(1)).alias("__n"))
    sized = checkpointed(join_keyed(rows, sizes, ["component"]))
    kind = sized.schema["src"].dataType.simpleString()
    settled = sized.where(F.col("__n") <= most).select("component", "src", "dst").groupBy("component").applyInPandas(
        lambda edges: _in_order(edges), f"src {kind}")
    return checkpointed(settled), checkpointed(sized.where(F.col("__n") > most).select(question.columns))


def _mark(edges: DataFrame, acting: DataFrame) -> DataFrame:
    """Edges with whether their source is known to act."""
    flag = acting.withColumn("__acts", F.lit(True))
    return edges.join(flag, "src", "left").select(
        "src", "dst", F.coalesce("__acts", F.lit(False)).alias("acts")
    )


def dedup_similar(
    docs: DataFrame, tau: float = 0.792, k: int = 5, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Documents (id, vec) left when each, in id order, removes its close neighbours.

    The best `k` of a document count itself, so it removes at most `k` - 1 others.
    """
    near = cosine_topk(docs, docs, k - 1, tau, exclude_self=True, block_rows=block_rows)
    edges = near.select(F.col("query").alias("src"), F.col("doc").alias("dst"))
    return docs.join(removed_in_order(edges), "id", "left_anti")
