"""Merkle manifest of a dataset: a root, and for each row the proof that it belongs to it (operator 13).

A row is a leaf, the hash of its fields. The leaves of a tree (here one per `lang`) are ordered by id;
runs of `FANOUT` neighbours become the hash of their digests, the last run of a level with what it
has, until one node remains. The roots of the trees are the leaves of the tree on top.

The leaves are range-partitioned by tree and id, which gives each its place. Blocks of
`FANOUT ** BLOCK_LEVELS` leaves, aligned in their tree, are the partitions of the exchange: each folds
its leaves to the root of its own subtree. Then the blocks swap roots round by round: a
block holds the node above itself, sends its digest to one block below each neighbour in
the node's run, receives theirs, and hashes the parent. All blocks below a node compute that same
digest, so after the last round each has the root and the digests of its upper proof, and no pass goes
down the tree. Behind an incomplete last node stand fewer blocks than its neighbours have, so those
send to several. A round moves `FANOUT` digests per block, some thousandth of the rows.

A proof has one step per level: the place of the node in its run and the digests of the others.

Nulls: a null field is hashed as `-`; a null tree key is a tree of its own and comes first; null ids
come first in their tree. Equal ids are ordered by leaf, equal leaves at random (any order of equal digests gives
equal roots); each row keeps its own proof. Empty text is a field of no bytes. An empty
table has no rows and no root. Columns of the frame that are not fields are not read.
"""

from __future__ import annotations

from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gradeloom.llm.batches import written
from gradeloom.session import shuffle_partitions

FANOUT = 8
# Levels inside one block: 4096 leaves, some hundred bytes each.
BLOCK_LEVELS = 4
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

PROOF = T.ArrayType(T.StructType([
    T.StructField("at", T.IntegerType()), T.StructField("others", T.ArrayType(T.StringType()))]))
_STEP = pa.struct([("at", pa.int32()), ("others", pa.list_(pa.string()))])


def leaf_hash(*values: Column) -> Column:
    """SHA-256 (hex) of the fields, each by its number of bytes and its value."""
    parts = []
    for v in values:
        text = v.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def _ordered(items: DataFrame, order: list[str]) -> DataFrame:
    """Adds `place`, from 0 in each tree, and `leaves`, their number; a written table.

    Rows are range-partitioned by tree and order, so a tree of any size spreads over partitions, and a
    partition knows its rows' places but for what earlier partitions hold of the tree.
    """
    spark = items.sparkSession
    keys = [F.col(c).asc_nulls_first() for c in ["tree", *order, "leaf", "salt"]]
    # The salt cuts rows that are equal in everything else; it is stored, so each read sees the same.
    salted = written(items.withColumn("salt", F.rand(17)), "leaves")
    ranged = salted.repartitionByRange(shuffle_partitions(spark), *keys).sortWithinPartitions(*keys)
    at = written(
        ranged.withColumn("part", F.spark_partition_id())
        .withColumn("row", F.monotonically_increasing_id()).drop("salt"), "ordered_leaves")
    counts = at.groupBy("tree", "part").agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("first"))
    # A row per tree and partition.
    tree = Window.partitionBy("tree")
    ahead = tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(
        F.col("tree").alias("tree_of"), F.col("part").alias("part_of"), "first",
        F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("before"), F.sum("n").over(tree).alias("leaves"))
    same = F.col("tree").eqNullSafe(F.col("tree_of")) & (F.col("part") == F.col("part_of"))
    return at.join(counts, same).withColumn(
        "place", F.col("before") + F.col("row") - F.col("first")
    ).drop("tree_of", "part_of", "part", "row", "before", "first")


def _levels(digests: list[str], alone: bool, block_levels: int) -> list[list[str]]:
    """The digests of a block and of all levels above them inside the block."""
    levels = [digests]
    for _ in range(block_levels):
        last = levels[-1]
        if alone and len(last) == 1:
            break
        levels.append([sha256("".join(last[i : i + FANOUT]).encode()).hexdigest()
                       for i in range(0, len(last), FANOUT)])
    return levels


def _is_alone(leaves: int, block_levels: int) -> bool:
    """Whether a tree has one block, which then ends at its root."""
    return leaves <= FANOUT**block_levels


def _block_roots(placed: DataFrame, block_levels: int) -> DataFrame:
    """One row per block: `tree`, `block`, `blocks` of its tree, `digest` of its subtree."""
    def fold(group: pa.Table) -> pa.Table:
        group = group.sort_by("place")
        leaves = group.column("leaves")[0].as_py()
        top = _levels(group.column("leaf").to_pylist(), _is_alone(leaves, block_levels), block_levels)[-1]
        return group.slice(0, 1).select(["tree", "block", "leaves"]).append_column("digest", pa.array(top))

    tree = placed.schema["tree"]
    out = T.StructType([tree, *[T.StructField(c, T.LongType()) for c in ("block", "leaves")],
                        T.StructField("digest", T.StringType())])
    blocks = placed.select("tree", "block", "leaves", "place", "leaf").groupBy("tree", "block").applyInArrow(fold, out)
    return blocks.withColumn("blocks", F.ceil(F.col("leaves") / FANOUT**block_levels))


def _exchange(blocks: DataFrame, span: int) -> DataFrame:
    """One round: blocks below nodes of `span` blocks each take the digest of the parent node.

    Trees with one node left stay as they are.
    """
    last = F.col("blocks") - 1
    node = F.floor(F.col("block") / span)
    nodes = F.floor(last / span) + 1
    size = F.least(F.lit(span), F.col("blocks") - node * span)
    open_ = blocks.where(nodes > 1)
    first_in_run = F.floor(node / FANOUT) * FANOUT
    last_in_run = F.least(first_in_run + FANOUT - 1, nodes - 1)
    sent = open_.select(
        "tree", "blocks", "digest", node.alias("node"), "block", size.alias("size"), "proof",
        (F.col("block") - node * span).alias("offset"),
        F.explode(F.sequence(first_in_run, last_in_run)).alias("to"))
    # The blocks below the neighbour are dealt to the blocks below this node.
    begin = F.col("to") * span + F.col("offset")
    end = F.least(F.col("to") * span + span, F.col("blocks")) - 1
    sent = sent.where(begin <= end).withColumn("receiver", F.explode(F.sequence(begin, end, F.col("size"))))
    own = F.col("receiver") == F.col("block")
    got = sent.groupBy("tree", "blocks", F.col("receiver").alias("block")).agg(
        F.array_sort(F.collect_list(F.struct("node", "digest"))).alias("run"),
        F.max(F.when(own, F.col("node"))).alias("node"),
        F.max_by("proof", own.cast("int")).alias("proof"))
    at = (F.col("node") % FANOUT).cast("int").alias("at")
    others = F.transform(F.filter("run", lambda x: x["node"] != F.col("node")), lambda x: x["digest"])
    digest = F.sha2(F.array_join(F.transform("run", lambda x: x["digest"]), ""), 256)
    moved = got.select(
        "tree", "block", "blocks", digest.alias("digest"),
        F.concat("proof", F.array(F.struct(at, others.alias("others")))).alias("proof"))
    return blocks.where(nodes <= 1).select(moved.columns).unionByName(moved)


def _upper_proofs(blocks: DataFrame) -> DataFrame:
    """Adds to each block the `proof` from its subtree to the root of its tree; `digest` is that root."""
    blocks = written(blocks, "block_roots")
    most = blocks.agg(F.max("blocks")).first()[0] or 0
    blocks, span = blocks.select("tree", "block", "blocks", "digest", F.array().cast(PROOF).alias("proof")), 1
    while span < most:
        blocks = _exchange(blocks, span)
        span *= FANOUT
    return written(blocks, "upper_proofs")


def _leaf_proofs(placed: DataFrame, upper: DataFrame, kept: list[str], block_levels: int) -> DataFrame:
    """The rows with `root` and their whole `proof`; a task holds one block at a time."""
    def with_proofs(rows: pa.Table, above: pa.Table) -> pa.Table:
        rows = rows.sort_by("place")
        leaves = rows.column("leaves")[0].as_py()
        levels = _levels(rows.column("leaf").to_pylist(), _is_alone(leaves, block_levels), block_levels)
        rest = above.column("proof")[0].as_py()
        steps = []
        for level in levels[:-1]:
            own = []
            for i in range(len(level)):
                run = level[i - i % FANOUT : i - i % FANOUT + FANOUT]
                own.append({"at": i % FANOUT, "others": run[: i % FANOUT] + run[i % FANOUT + 1 :]})
            steps.append(own)
        proofs = [[own[i // FANOUT**h] for h, own in enumerate(steps)] + rest for i in range(rows.num_rows)]
        out = rows.select(kept)
        for name in ("subroot", "root"):
            out = out.append_column(name, pa.array([above.column(name)[0].as_py()] * rows.num_rows, pa.string()))
        return out.append_column("proof", pa.array(proofs, pa.list_(_STEP)))

    out = T.StructType([*placed.select(*kept).schema.fields, T.StructField("subroot", T.StringType()),
                        T.StructField("root", T.StringType())]).add("proof", PROOF)
    return placed.groupBy("tree", "block").cogroup(upper.groupBy("tree", "block")).applyInArrow(with_proofs, out)


def prove(items: DataFrame, order: list[str], tops: bool = True, block_levels: int = BLOCK_LEVELS) -> DataFrame:
    """Adds `subroot`, `root` and `proof` to rows with `tree`, `leaf` and the columns of `order`.

    With `tops` the roots of the trees are leaves of one tree on top, ordered by `tree`.
    """
    block = F.floor(F.col("place") / FANOUT**block_levels)
    placed = _ordered(items, order).withColumn("block", block)
    upper = _upper_proofs(_block_roots(placed, block_levels))
    if tops:
        roots = upper.where(F.col("block") == 0).select(
            F.lit(0).alias("tree"), F.col("tree").alias("key"), F.col("digest").alias("leaf"))
        top = prove(roots, ["key"], False, block_levels).select(
            F.col("key").alias("top_key"), F.col("root"), F.col("proof").alias("top_proof"))
        upper = upper.join(top, F.col("tree").eqNullSafe(F.col("top_key"))).select(
            "tree", "block", F.col("digest").alias("subroot"), "root", F.concat("proof", "top_proof").alias("proof"))
    else:
        upper = upper.select("tree", "block", F.col("digest").alias("subroot"), F.col("digest").alias("root"), "proof")
    return _leaf_proofs(placed, upper, items.columns, block_levels)


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and the digests of its proof lead to."""
    def up(below: Column, step: Column) -> Column:
        others = step["others"]
        before = F.slice(others, F.lit(1), step["at"])
        behind = F.slice(others, step["at"] + 1, F.lit(FANOUT))
        return F.sha2(F.concat(F.array_join(before, ""), below, F.array_join(behind, "")), 256)

    return F.aggregate(proof, leaf, up)


def proof_hash(proof: Column) -> Column:
    """SHA-256 (hex) of all digests of a proof, level by level."""
    return F.sha2(F.array_join(F.flatten(F.transform(proof, lambda s: s["others"])), ""), 256)


def manifest(docs: DataFrame, id_column: str = "doc_id", tree_column: str = "lang",
             fields: tuple[str, ...] = FIELDS, extra: dict[str, Column] | None = None) -> DataFrame:
    """Per row: id, `leaf`, `subroot`, `root`, `proof`, and the expressions of `extra`."""
    items = docs.select(
        F.col(id_column).alias("id"), F.col(tree_column).alias("tree"),
        leaf_hash(*[F.col(c) for c in fields]).alias("leaf"),
        *[e.alias(f"extra_{n}") for n, e in (extra or {}).items()])
    rows = prove(items, ["id"])
    return rows.select(F.col("id").alias(id_column), "leaf", "subroot", "root", "proof",
                       *[F.col(f"extra_{n}").alias(n) for n in extra or {}])
