"""Mixture-controlled packing by deficit round-robin (operator 4).

Every group (source) is a queue of documents in table order. A window of tokens gives each
queue a quantum, its target share of the window; a document is served in the window
in which its first token falls due, whole, and what it takes beyond the quantum is a
deficit that the queue carries into the next windows. Served windows follow one another and
are cut into sequences of equal length, so all but the very last sequence are full and
a document is cut only at a sequence's end.

By default the target of a queue is its share of all tokens: every window has the
corpus's own mixture and all queues end together. Other targets can be given; a queue that
runs dry leaves its part to the rest.

Where a document falls due follows from the tokens ahead of it in its queue, so the rounds
need no loop: tokens are totalled per queue and block of rows, blocks are summed up, and
each block counts its own rows. That carries deficits across windows and partitions, and a
queue with a third of all rows is cut like any other. A window holds at most about
its tokens in rows, so no task gets an unbounded group.

Null text counts as empty and still has its end token. A null group is a queue of its own.
Repeated rows are packed once each. No rows in, no rows out.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gradeloom.llm.batches import text_groups, written
from gradeloom.llm.bpe import split_pattern
from gradeloom.llm.chunks import ChunkEncoder

# Sequences per window of the mixture.
WINDOW_SEQUENCES = 256
# Rows of the table that are counted together: 2^16 at most.
BLOCK_BITS = 16
# Windows whose totals are summed up together.
WINDOWS_TOGETHER = 1024


# Chunks whose ids a worker remembers.
REMEMBERED = 700_000


def byte_alphabet() -> dict[int, int]:
    """The characters that stand for bytes in byte-level vocabularies.

    Printable Latin-1 characters stand for themselves, the others for 256 and up in order.
    """
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in own]
    return {b: b for b in own} | {b: 256 + i for i, b in enumerate(other)}


# A run of so much white space is beyond what the native encoder's pattern takes.
LONG_SPACE = re.compile(r"\s{200}")


def _as_ranks(path: str) -> tiktoken.Encoding | None:
    """The vocabulary as ranks, where its ids rise in the order of its merges; None for any other."""
    with open(path, encoding="utf-8") as file:
        model = json.load(file)["model"]
    vocab, byte_of = model["vocab"], {chr(c): b for b, c in byte_alphabet().items()}
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    merged = [vocab[a + b] for a, b in pairs]
    letters = [vocab[c] for c in byte_of if c in vocab]
    if len(letters) < 256 or merged != sorted(merged) or merged[0] < max(letters):
        return None
    made = {vocab[t] for t in byte_of} | set(merged)
    ranks = {bytes(byte_of[c] for c in t): i for t, i in vocab.items() if i in made}
    return tiktoken.Encoding("merges", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


class _Encoder:
    """Ids of texts in the vocabulary's merges; special tokens are ordinary text.

    A vocabulary that can be read as ranks encodes whole texts natively; for any other, and for
    texts with very long white space, chunks are encoded one by one and remembered.
    """

    def __init__(self, path: str):
        tokenizer = Tokenizer.from_file(path)
        wide = tokenizer.get_vocab_size() > 1 << 16
        self.code, self.kind = ("I", "<u4") if wide else ("H", "<u2")
        self.merges, self.matches = tokenizer.model, split_pattern(public_tokenizers.PATTERN)
        self.alphabet = byte_alphabet()
        self.ranks = _as_ranks(path)
        self.chunks = ChunkEncoder(lambda chunks: [self._chunk(c) for c in chunks], REMEMBERED)

    def _chunk(self, chunk: str) -> bytes:
        ids = array(self.code)
        for m in self.matches.findall(chunk):
            ids.extend([t.id for t in self.merges.tokenize(m.encode().decode("latin-1").translate(self.alphabet))])
        return ids.tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        slow = [i for i, t in enumerate(texts) if self.ranks is None or LONG_SPACE.search(t)]
        made = dict(zip(slow, self.chunks.encode([texts[i] for i in slow])))
        return [made[i] if i in made else array(self.code, self.ranks.encode_ordinary(t)).tobytes()
                for i, t in enumerate(texts)]


@lru_cache(maxsize=2)
def _worker(path: str) -> _Encoder:
    """One vocabulary per Python worker, kept between its tasks."""
    return _Encoder(path)


def tokenized(docs: DataFrame, path: str, end_id: int, id_column: str, text_column: str,
              group_column: str) -> DataFrame:
    """`row` (unique, in table order), id, `queue`, `n` tokens, `ids` (2 or 4 bytes each)."""
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(id_column).cast("long").alias("id"),
        F.col(group_column).cast("string").alias("queue"),
        F.col(text_column).alias("text"),
    )

    def run(batches):
        encoder = _worker(path)
        kind = encoder.kind
        width, end = int(kind[-1]), np.array([end_id], dtype=kind).tobytes()
        for b in batches:
            for part, texts in text_groups(b, "text"):
                ids = [x + end for x in encoder.encode([t or "" for t in texts])]
                made = [pa.array([len(x) // width for x in ids], pa.int64()), pa.array(ids, pa.binary())]
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in ("row", "id", "queue")), *made],
                    names=["row", "id", "queue", "n", "ids"],
                )

    return rows.mapInArrow(run, "row long, id long, queue string, n long, ids binary")


def _before(keys: list[str], order: list[str | Column]) -> Window:
    return Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)


def _ahead(total: str, keys: list[str], order: list[str | Column]) -> Column:
    return F.coalesce(F.sum(total).over(_before(keys, order)), F.lit(0))


def queue_places(rows: DataFrame) -> DataFrame:
    """Adds `due`, the tokens ahead of a row in its queue, and `queue_tokens`, all of it."""
    rows = rows.withColumn("block", F.shiftright("row", BLOCK_BITS))
    blocks = rows.groupBy("queue", "block").agg(F.sum("n").alias("block_tokens"))
    # One row per queue and block: few however long the queue.
    whole = F.sum("block_tokens").over(Window.partitionBy("queue"))
    offsets = blocks.select(
        F.col("queue").alias("q"), F.col("block").alias("b"), whole.alias("queue_tokens"),
        _ahead("block_tokens", ["queue"], ["block"]).alias("block_due"),
    )
    own = _ahead("n", ["queue", "block"], ["row"])
    counted = rows.withColumn("own_due", own)
    same = counted["queue"].eqNullSafe(offsets["q"]) & (counted["block"] == offsets["b"])
    return counted.join(offsets, same).select(
        "row", "queue", "n", "queue_tokens", (F.col("block_due") + F.col("own_due")).alias("due")
    )


def served(places: DataFrame, tokens: int, window: int, targets: dict[str, float] | None) -> DataFrame:
    """Adds `window`, the round in which a row is served."""
    if targets is None:
        share = F.col("queue_tokens") / F.lit(float(tokens))
    else:
        given = sum(targets.values())
        pairs = [x for k, v in targets.items() for x in (F.lit(k), F.lit(v / given))]
        share = F.create_map(*pairs)[F.col("queue")]
        share = F.coalesce(share, F.raise_error(F.concat(F.lit("no target for "), F.col("queue"))))
    return places.withColumn("window", F.floor(F.col("due") / (share * window)).cast("long"))


def global_places(rows: DataFrame) -> DataFrame:
    """Adds `at`, the tokens of all rows served before this one."""
    windows = rows.groupBy("window").agg(F.sum("n").alias("t")).withColumn(
        "together", F.floor(F.col("window") / WINDOWS_TOGETHER)
    )
    # One row per 1024 windows of a quarter million tokens each.
    many = windows.groupBy("together").agg(F.sum("t").alias("s")).select(
        "together", _ahead("s", [], ["together"]).alias("far")
    )
    near = windows.withColumn("near", _ahead("t", ["together"], ["window"])).join(many, "together")
    own = _ahead("n", ["window"], [F.col("queue").asc_nulls_first(), "row"])
    return rows.withColumn("own", own).join(
        near.select("window", (F.col("far") + F.col("near")).alias("start")), "window"
    ).select("row", "n", "window", (F.col("start") + F.col("own")).alias("at"))


_PIECE_SQL = (
    "id long, queue string, window long, start long, length long, ids_crc32 long, "
    "doc_tokens long, sequence_id long, offset long"
)


def pack(docs: DataFrame, path: str, length: int = 1024, end_id: int = 0,
         window_sequences: int = WINDOW_SEQUENCES, targets: dict[str, float] | None = None,
         id_column: str = "doc_id", text_column: str = "text", group_column: str = "source",
         with_ids: bool = False) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset, queue, window.

    With `with_ids` also the piece's ids as little-endian unsigned 32-bit numbers.
    """
    rows = written(tokenized(docs, path, end_id, id_column, text_column, group_column), "tokens")
    tokens = rows.agg(F.sum("n")).first()[0] or 1
    places = queue_places(rows.select("row", "queue", "n"))
    placed = global_places(served(places, tokens, window_sequences * length, targets))
    joined = rows.join(placed.select("row", "window", "at"), "row")

    def run(batches):
        for b in batches:
            cols = [b.column(c).to_pylist() for c in ("id", "queue", "window", "n", "ids", "at")]
            out: list[tuple] = []
            for id_, queue, window, n, ids, at in zip(*cols):
                wide = np.frombuffer(ids, dtype="<u2" if len(ids) == 2 * n else "<u4").astype("<u4")
                lo = 0
                while lo < n:
                    sequence, offset = divmod(at + lo, length)
                    size = min(length - offset, n - lo)
                    raw = wide[lo : lo + size].tobytes()
                    piece = (id_, queue, window, lo, size, zlib.crc32(raw), n, sequence, offset)
                    out.append((*piece, raw) if with_ids else piece)
                    lo += size
                if len(out) >= 2_000:
                    yield _pieces(out, with_ids)
                    out = []
            if out:
                yield _pieces(out, with_ids)

    sql = _PIECE_SQL + (", ids binary" if with_ids else "")
    return joined.mapInArrow(run, sql).withColumnsRenamed({"id": id_column, "queue": group_column})


def _pieces(rows: list[tuple], with_ids: bool) -> pa.RecordBatch:
    names = [x.split()[0] for x in _PIECE_SQL.split(", ")] + ["ids"] * with_ids
    kinds = [pa.string() if n == "queue" else pa.binary() if n == "ids" else pa.int64() for n in names]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, type=k) for c, k in zip(zip(*rows), kinds)], names=names
    )
