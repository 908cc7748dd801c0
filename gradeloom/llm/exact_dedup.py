"""Exact dedup by owners with Patricia tries (operator 1).

Texts are equal when they are the same after each run of ASCII white space became
one space; null counts as empty. Each input partition first puts its texts into a
trie of its own, so a text leaves it once however many copies there are. Owners are
partitions by length and content hash; they insert the full byte strings that reach
them into compressed radix tries whose terminals hold the smallest id and the number
of rows. An owner's rows arrive sorted by subtree (the first digits of the content
hash): one subtree is held at a time, the others wait in Spark's sorted spill files.

A text that a third of all rows hold reaches its owner once per input partition.
The documents meet their class again in a join by content hash, whose large keys
adaptive execution splits; no task gathers the members of a class.

Null ids: a class keeps its smallest id that is not null, and null only if all are.
Repeated rows (same id, same text) count each, and one of them is kept. No rows in,
no rows out. Columns of other names never matter.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeloom.llm.batches import batch, numbered, renamed

# Text bytes a task's first trie holds before it hands them on and starts anew.
LOCAL_BYTES = 48_000_000
# Hex digits of the content hash that name a subtree of an owner.
SUBTREE_DIGITS = 3
# Terminals handed on at once.
ROWS_OUT = 1_000

_CLASS = pa.schema(
    [("sha", pa.string()), ("size", pa.int64()), ("body", pa.binary()), ("keep", pa.int64()),
     ("rows", pa.int64())]
)
_CLASS_SQL = "sha string, size long, body binary, keep long, rows long"


class _Node:
    __slots__ = ("label", "children", "value")

    def __init__(self, label: bytes, value=None):
        self.label = label
        self.children: dict[int, _Node] = {}
        self.value = value


class PatriciaTrie:
    """Compressed radix trie over byte strings; `at` gives the mutable value of a key."""

    def __init__(self):
        self._root = _Node(b"")
        self.held = 0

    def at(self, key: bytes, fresh) -> list:
        """The value at the key, `fresh()` if the key is new."""
        node, pos = self._root, 0
        while pos < len(key):
            child = node.children.get(key[pos])
            if child is None:
                leaf = _Node(key[pos:], fresh())
                node.children[key[pos]] = leaf
                self.held += len(leaf.label)
                return leaf.value
            if not key.startswith(child.label, pos):
                child = self._split(node, child, key, pos)
            pos += len(child.label)
            node = child
        if node.value is None:
            node.value = fresh()
        return node.value

    @staticmethod
    def _split(parent: _Node, child: _Node, key: bytes, pos: int) -> _Node:
        """Cuts an edge where the key leaves it."""
        low, high = 1, min(len(child.label), len(key) - pos)
        while low < high:
            mid = (low + high + 1) // 2
            if key.startswith(child.label[:mid], pos):
                low = mid
            else:
                high = mid - 1
        upper = _Node(child.label[:low])
        child.label = child.label[low:]
        upper.children[child.label[0]] = child
        parent.children[key[pos]] = upper
        return upper

    def items(self):
        """Keys and values; a key is put together on the way down."""
        stack = [(self._root, b"")]
        while stack:
            node, prefix = stack.pop()
            path = prefix + node.label
            if node.value is not None:
                yield path, node.value
            stack.extend((c, path) for c in node.children.values())


def normalised(text) -> F.Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def _drain(trie: PatriciaTrie, with_body: bool):
    """The classes of a trie, a thousand at a time. Values: [sha, keep, rows]."""
    rows, shas = [], set()
    for body, (sha, keep, count) in trie.items():
        if sha in shas:
            raise ValueError(f"two different texts have the SHA-256 {sha}")
        shas.add(sha)
        rows.append((sha, len(body), body if with_body else None, keep, count))
        if len(rows) == ROWS_OUT:
            yield batch(_CLASS, zip(*rows))
            rows = []
    if rows:
        yield batch(_CLASS, zip(*rows))


def _merge(value: list, sha: str, keep, rows: int) -> None:
    value[0] = sha
    if keep is not None and (value[1] is None or keep < value[1]):
        value[1] = keep
    value[2] += rows


def _new() -> list:
    return [None, None, 0]


def _local_tries(batches):
    """Columns sha, body, keep, rows of an input partition, in any order."""
    trie = PatriciaTrie()
    for b in batches:
        shas, bodies, keeps, rows = (b.column(c) for c in ("sha", "body", "keep", "rows"))
        for i in range(b.num_rows):
            sha = shas[i].as_py()
            _merge(trie.at(bodies[i].as_py(), _new), sha, keeps[i].as_py(), rows[i].as_py())
            if trie.held > LOCAL_BYTES:
                yield from _drain(trie, True)
                trie = PatriciaTrie()
    yield from _drain(trie, True)


def _owner_tries(batches):
    """The same, sorted by subtree: one trie at a time."""
    trie, subtree = PatriciaTrie(), None
    for b in batches:
        shas, bodies, keeps, rows = (b.column(c) for c in ("sha", "body", "keep", "rows"))
        for i in range(b.num_rows):
            sha = shas[i].as_py()
            if sha[:SUBTREE_DIGITS] != subtree:
                yield from _drain(trie, False)
                trie, subtree = PatriciaTrie(), sha[:SUBTREE_DIGITS]
            _merge(trie.at(bodies[i].as_py(), _new), sha, keeps[i].as_py(), rows[i].as_py())
    yield from _drain(trie, False)


def text_classes(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per distinct text: `sha`, `size` (bytes), `keep` (smallest id), `rows`."""
    plain = docs.select(
        F.col(id_column).cast("long").alias("keep"), normalised(F.col(text_column)).alias("t")
    ).select(F.sha2("t", 256).alias("sha"), F.encode("t", "UTF-8").alias("body"), "keep",
             F.lit(1).cast("long").alias("rows"))
    local = plain.mapInArrow(_local_tries, _CLASS_SQL)
    owned = local.repartition("size", "sha").sortWithinPartitions(
        F.substring("sha", 1, SUBTREE_DIGITS)
    )
    return owned.mapInArrow(_owner_tries, _CLASS_SQL).drop("body")


def exact_classes(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_sha256."""
    classes = text_classes(docs, id_column, text_column)
    # Rows of the same id and text are counted, so the one that is kept can be told apart.
    rows = docs.select(
        F.col(id_column).cast("long").alias("__id"),
        F.sha2(normalised(F.col(text_column)), 256).alias("sha"),
    ).groupBy("__id", "sha").agg(F.count(F.lit(1)).alias("copies"))
    return rows.join(classes, "sha").select(
        F.col("__id").alias(id_column),
        F.col("keep").alias("keep_id"),
        F.col("rows").alias("group_size"),
        F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("__copy"),
        F.col("sha").alias("text_sha256"),
    ).select(
        id_column, "keep_id", "group_size",
        (F.col(id_column).eqNullSafe(F.col("keep_id")) & (F.col("__copy") == 1)).alias("kept"),
        "text_sha256",
    )


def drop_exact(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The documents without later copies; all columns stay as they are."""
    keepers = text_classes(docs, id_column, text_column).select("sha", "keep")
    rows, names = numbered(docs)
    marked = rows.withColumn("own_sha", F.sha2(normalised(F.col(names[text_column])), 256))
    marked = marked.withColumn("own_id", F.col(names[id_column]).cast("long"))
    same = (marked["own_sha"] == keepers["sha"]) & marked["own_id"].eqNullSafe(keepers["keep"])
    kept = marked.join(keepers, same, "left_semi")
    return renamed(kept.dropDuplicates(["own_sha", "own_id"]), names)
