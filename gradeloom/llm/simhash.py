"""SimHash near-dedup by anchor points of a covering code (operator 2).

A fingerprint has a bit set if it is set in over half of the hashes of the text's word
shingles. Fingerprints are compared at anchors, the words of a perfect code: each goes
to every anchor within the code's covering radius plus the threshold of a piece of
its bits, so two that differ no more than the threshold meet at the home anchor of
either. Pieces follow from what must be found:

* `exact_pieces`: a 64-bit fingerprint in two halves. Of three differing bits one half
  has at most one, so the threshold of a half is 1, and no link is lost.
* `sampled_pieces`: a 256-bit fingerprint for wide thresholds. Each piece draws 23 or more
  bits, quantised by the Golay code (and Hamming codes as the corpus grows), with threshold
  0; there are as many pieces as find 97 % of the pairs of the similarity asked for, even of
  the sets of shingles whose fingerprints differ most.

Equal fingerprints are one row. Rows of an anchor are compared in blocks against the
home rows they meet, and only links that join two groups go on: a group of n copies gives
at most n links per anchor, never its pairs. An anchor with more than `PART_ROWS` rows is
dealt out: each part has a share of the homes and meets all rows.

`drop_near` takes fingerprints for candidates only. A candidate pair becomes a link if the
shingle sets of its two texts are similar enough, counted exactly. The candidates that join
groups are counted first; then all candidate pairs between texts that are not linked yet,
since a refuted pair may have stood for others. So copies of one text are never compared in
pairs, and the links are those that all candidate pairs would give.

Null texts count as empty; a text without words has fingerprint zero and is linked like
any other. Null ids come last when the smallest is looked for. Repeated rows come back
as often as they came in. Columns of other names never matter.
"""

from __future__ import annotations

import math
import random

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeloom.llm.batches import batch, numbered, renamed, text_groups, written
from gradeloom.llm.codes import AnchorCode, golay_bits, hamming_bits, joined
from gradeloom.llm.components import component_roots

SEED = 42
# Hashes counted at once; a longer text is counted in blocks.
HASHES = 20_000
# Rows of an anchor that one task compares with all others of the anchor.
PART_ROWS = 20_000
# Words compared at once in a block.
BLOCK = 2_000_000
# Share of pairs at the similarity asked for that sampled pieces find, and standard deviations
# of the differing bits above their mean that still make a candidate.
FOUND, DEVIATIONS = 0.97, 2.33
# Candidate links that go on at once.
LINKS = 10_000


def shingles(text: str, words: int) -> list[bytes]:
    """The text's word shingles in order; a shorter text is one shingle. Only A-Z are lowered."""
    parts = text.encode().lower().split()
    if not parts:
        return []
    line = b" ".join(parts)
    spaces = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
    first = [0, *(spaces + 1).tolist()]
    last = [*spaces.tolist(), len(line)]
    ends = last[words - 1 :] if len(parts) >= words else last[-1:]
    return [line[a:b] for a, b in zip(first, ends)]


def fingerprint(text: str, words: int, lanes: int, distinct: bool = False) -> bytes:
    """`lanes` times 64 bits; lane i hashes with XXH64 seed 42 + i. `distinct` counts a shingle once."""
    every = shingles(text, words)
    if distinct:
        every = list(set(every))
    n = len(every)
    digest = xxhash.xxh64_digest
    counts = np.zeros(64 * lanes, dtype=np.int64)
    for lo in range(0, n, HASHES):
        some = every[lo : lo + HASHES]
        if lanes == 1:
            raw = b"".join([digest(s, SEED) for s in some])
        else:
            raw = b"".join([digest(s, SEED + i) for s in some for i in range(lanes)])
        bits = np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8 * lanes), axis=1)
        for at in range(0, len(bits), 255):
            counts += bits[at : at + 255].sum(axis=0, dtype=np.uint8)
    return np.packbits(counts * 2 > n).tobytes()


def _keyed(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    return docs.select(
        F.col(id_column).cast("long").alias("id"),
        F.xxhash64(F.col(text_column)).alias("key"),
        F.col(text_column).alias("text"),
    )


def with_fingerprints(docs: DataFrame, words: int, lanes: int, id_column: str = "doc_id",
                      text_column: str = "text", distinct: bool = False) -> DataFrame:
    """`id`, `key` (hash of the text) and `fp` (hex digits) of every row."""
    rows = _keyed(docs, id_column, text_column)
    schema = pa.schema([("fp", pa.string())])

    def run(batches):
        for b in batches:
            for part, texts in text_groups(b, "text"):
                made = [fingerprint(t or "", words, lanes, distinct).hex() for t in texts]
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), part.column("key"), *batch(schema, [made]).columns],
                    names=["id", "key", "fp"],
                )

    return rows.mapInArrow(run, "id long, key long, fp string")


def exact_pieces(max_bits: int = 3) -> tuple[int, list[list[int]], AnchorCode]:
    """Two halves of 64 bits: a Hamming code of 31 bits and one bit more each."""
    if max_bits > 3:
        raise ValueError("two halves with threshold 1 cover up to 3 differing bits")
    code = AnchorCode([*hamming_bits(5), 0], radius=1, threshold=1)
    return 1, [list(range(32)), list(range(32, 64))], code


def _binomial(n: int, p: float) -> list[float]:
    return [math.comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(n + 1)]


def same_home(bits: int, radius: int, chance: float) -> float:
    """Chance that words of a perfect code whose bits differ with a chance share their home anchor."""
    total = 0.0
    for w in range(radius + 1):
        back, away = _binomial(w, chance), _binomial(bits - w, chance)
        stays = sum(
            p * q for i, p in enumerate(back) for j, q in enumerate(away) if w - i + j <= radius
        )
        total += math.comb(bits, w) * stays
    return total / sum(math.comb(bits, w) for w in range(radius + 1))


def differing_chance(similarity: float) -> float:
    """Largest chance that a bit differs between sets of at least this Jaccard similarity.

    Sets of similarity J have cosine 2J / (1 + J); for large ones the chance is their angle over
    pi. Majorities of small sets of hashes differ more often, which is counted out.
    """
    most = math.acos(2 * similarity / (1 + similarity)) / math.pi
    for n in range(1, min(60, math.ceil(5 / (1 - similarity + 1e-9))) + 1):
        differ = math.floor(n * (1 - similarity) + 1e-9)
        for d in range(1, differ + 1):
            both = _binomial(n - d, 0.5)
            for a in range(d // 2 + 1):
                chance = 0.0
                for k, p in enumerate(both):
                    left, right = (
                        sum(q for i, q in enumerate(_binomial(own, 0.5)) if 2 * (i + k) > n - d + own)
                        for own in (a, d - a)
                    )
                    chance += p * (left * (1 - right) + right * (1 - left))
                most = max(most, chance)
    return most


def sampled_pieces(rows: int, lanes: int = 4, similarity: float = 0.8) -> tuple[
    int, list[list[int]], AnchorCode
]:
    """Pieces that find pairs of a similarity among `rows` fingerprints.

    One Hamming code of 7 bits is added for each 16-fold of rows beyond four million, so the
    rows of an anchor stay about a thousand, and the pieces grow so that the share found stays.
    """
    extra = max(0, math.ceil((math.log2(max(rows, 1)) - 22) / 4))
    differ = differing_chance(similarity)
    chance = same_home(23, 3, differ) * same_home(7, 1, differ) ** extra
    pieces = math.ceil(math.log(1 - FOUND) / math.log(1 - chance))
    code = AnchorCode(joined(golay_bits(), *[hamming_bits(3)] * extra), 3 + extra, 0)
    draw = random.Random(SEED)
    width = 23 + 7 * extra
    return lanes, [draw.sample(range(64 * lanes), width) for _ in range(pieces)], code


def _lanes(fps: list[str], lanes: int) -> np.ndarray:
    raw = bytes.fromhex("".join(fps))
    return np.frombuffer(raw, dtype=">i8").astype(np.int64).reshape(-1, lanes)


def anchor_rows(fps: DataFrame, lanes: int, pieces: list[list[int]], code: AnchorCode) -> DataFrame:
    """A row per fingerprint and anchor: `anchor`, `home`, the lanes `f0`, `f1`, ..., a given `group`."""
    names = [f"f{i}" for i in range(lanes)]
    more = [c for c in fps.columns if c == "group"]
    weights = 1 << np.arange(len(pieces[0]), dtype=np.int64)

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 2_000):
                f = _lanes(b.column("fp").slice(at, 2_000).to_pylist(), lanes)
                groups = [b.column(c).slice(at, 2_000) for c in more]
                bits = np.unpackbits(f.astype(">i8").view(np.uint8).reshape(len(f), -1), axis=1)
                for p, positions in enumerate(pieces):
                    row, anchor, home = code.anchors(bits[:, positions].astype(np.int64) @ weights)
                    columns = [anchor, np.full(len(row), p, np.int32), home, *f[row].T]
                    given = [g.take(pa.array(row)) for g in groups]
                    yield pa.RecordBatch.from_arrays(
                        [*(pa.array(c) for c in columns), *given],
                        names=["anchor", "piece", "home", *names, *more],
                    )

    schema = "anchor long, piece int, home boolean, " + ", ".join(f"{n} long" for n in [*names, *more])
    return fps.select("fp", *more).mapInArrow(run, schema)


def _dealt(rows: DataFrame, part_rows: int) -> DataFrame:
    """Adds `part`; at an anchor with very many rows each part has some of the homes."""
    # Written, so that Catalyst knows how few they are and need not deal out the rows for the join.
    large = written(
        rows.groupBy("anchor", "piece").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > part_rows),
        "large_anchors",
    )
    lanes = [c for c in rows.columns if c.startswith("f")]
    marked = rows.join(
        large.select("anchor", "piece", F.ceil(F.col("n") / part_rows).cast("int").alias("parts")),
        ["anchor", "piece"], "left",
    ).withColumn("parts", F.coalesce("parts", F.lit(1)))
    own = F.pmod(F.xxhash64(*lanes), F.col("parts")).cast("int")
    return marked.withColumn(
        "part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    ).withColumn("home", F.col("home") & (own == F.col("part"))).drop("parts")


class _Bucket:
    """The homes of an anchor, their groups so far, and the rows that come by."""

    def __init__(self, homes: np.ndarray, max_bits: int):
        self.homes, self.max_bits = homes, max_bits
        self.group = np.arange(len(homes))
        self.links: list[tuple[np.ndarray, np.ndarray]] = []

    def _close(self, rows: np.ndarray):
        """Blocks of rows, their first number, and which homes are close to them."""
        step = max(1, BLOCK // (len(self.homes) * rows.shape[1]))
        for at in range(0, len(rows), step):
            some = rows[at : at + step]
            differ = np.bitwise_count(some[:, None, :] ^ self.homes[None, :, :]).sum(axis=2)
            yield at, some, differ <= self.max_bits

    def meet(self, rows: np.ndarray, groups: np.ndarray | None, are_homes: bool):
        """The links of the rows, in lists."""
        for _, some, close in self._close(rows):
            for i in np.flatnonzero(close.sum(axis=1) > are_homes):
                near = np.flatnonzero(close[i])
                self._join(near)
                if not are_homes:
                    self.links.append((some[i], self.homes[near[0]]))
            yield self.links
            self.links = []

    def _join(self, near: np.ndarray) -> None:
        groups = np.unique(self.group[near])
        for other in groups[1:]:
            members = np.flatnonzero(self.group == other)
            self.links.append((self.homes[members[0]], self.homes[near[self.group[near] == groups[0]][0]]))
            self.group[members] = groups[0]


class _Crossing(_Bucket):
    """Gives every close pair of different groups."""

    def __init__(self, homes: np.ndarray, max_bits: int, groups: np.ndarray):
        super().__init__(homes, max_bits)
        self.group = groups

    def meet(self, rows: np.ndarray, groups: np.ndarray | None, are_homes: bool):
        for at, some, close in self._close(rows):
            close &= groups[at : at + len(some), None] != self.group[None, :]
            if are_homes:
                close &= np.arange(len(rows))[None, :] > np.arange(at, at + len(some))[:, None]
            left, right = np.nonzero(close)
            for lo in range(0, len(left), LINKS):
                yield list(zip(some[left[lo : lo + LINKS]], self.homes[right[lo : lo + LINKS]]))


def _compare(lanes: int, max_bits: int, grouped: bool):
    """Links between the rows of each anchor, from rows sorted by anchor with homes first."""
    names = [f"f{i}" for i in range(lanes)]
    schema = pa.schema([("a", pa.string()), ("b", pa.string())])

    def out(links):
        text = lambda rows: [r.astype(">u8").tobytes().hex() for r in rows]
        return batch(schema, [text(a for a, _ in links), text(b for _, b in links)])

    def opened(homes, groups):
        every = np.concatenate(homes)
        if not grouped:
            return _Bucket(every, max_bits), every, None
        own = np.concatenate(groups)
        return _Crossing(every, max_bits, own), every, own

    def found(batches):
        bucket, current = None, None
        homes: list[np.ndarray] = []
        groups: list[np.ndarray] = []
        for b in batches:
            n = b.num_rows
            keys = np.stack([b.column(c).to_numpy(zero_copy_only=False).astype(np.int64)
                             for c in ("anchor", "piece", "part")], axis=1)
            home = b.column("home").to_numpy(zero_copy_only=False)
            # Unsigned, since the bits of a negative number are those of its amount.
            f = np.stack([b.column(c).to_numpy() for c in names], axis=1).view(np.uint64)
            group = b.column("group").to_numpy() if grouped else np.zeros(n, np.int64)
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            edges = [0, *cuts.tolist(), n] if n else [0]
            for lo, hi in zip(edges, edges[1:]):
                key = tuple(keys[lo])
                if key != current:
                    if bucket is None and len(homes) and sum(map(len, homes)) > 1:
                        bucket, *own = opened(homes, groups)
                        yield from bucket.meet(*own, True)
                    bucket, current, homes, groups = None, key, [], []
                    if hi - lo == 1 and hi < n:
                        continue  # alone at its anchor
                split = lo + int(home[lo:hi].sum())
                if split > lo:
                    homes.append(f[lo:split])
                    groups.append(group[lo:split])
                if split < hi and homes:
                    if bucket is None:
                        bucket, *own = opened(homes, groups)
                        yield from bucket.meet(*own, True)
                    yield from bucket.meet(f[split:hi], group[split:hi], False)
        if bucket is None and sum(map(len, homes)) > 1:
            bucket, *own = opened(homes, groups)
            yield from bucket.meet(*own, True)

    def run(batches):
        links: list[tuple[np.ndarray, np.ndarray]] = []
        for some in found(batches):
            links += some
            if len(links) > 1_000:
                yield out(links)
                links = []
        if links:
            yield out(links)

    return run


def fingerprint_links(fps: DataFrame, lanes: int, pieces: list[list[int]], code: AnchorCode,
                      max_bits: int, part_rows: int = PART_ROWS) -> DataFrame:
    """Links that join all fingerprints of a group: columns `a`, `b` (hex digits).

    If `fps` has a column `group`, all close pairs of different groups that share an anchor.
    """
    rows = _dealt(anchor_rows(fps, lanes, pieces, code), part_rows)
    by_anchor = rows.repartition("anchor", "piece", "part").sortWithinPartitions(
        "anchor", "piece", "part", F.desc("home")
    )
    return by_anchor.mapInArrow(_compare(lanes, max_bits, "group" in fps.columns), "a string, b string")


def _representatives(rows: DataFrame) -> DataFrame:
    """`fp` and the smallest (id, key) of its rows, as `least`."""
    first = F.min(F.struct(F.coalesce("id", F.lit(2**63 - 1)).alias("id"), "key")).alias("least")
    return rows.groupBy("fp").agg(first)


def _least_linked(fps: DataFrame, links: DataFrame) -> DataFrame:
    """`fp` and the smallest (id, key) of all fingerprints that links lead to, as `least`."""
    roots = component_roots(links)
    linked = fps.join(roots, fps["fp"] == roots["node"]).select("fp", "root", "least")
    groups = linked.groupBy("root").agg(F.min("least").alias("group_least"))
    known = linked.join(groups, "root").select("fp", "group_least")
    return fps.join(known, "fp", "left").select(
        "fp", F.coalesce("group_least", "least").alias("least")
    )


def fingerprint_groups(rows: DataFrame, lanes: int, pieces, code, max_bits: int) -> DataFrame:
    """`fp` and the smallest (id, key) of all fingerprints that links lead to, as `least`."""
    fps = _representatives(rows)
    return _least_linked(fps, written(fingerprint_links(fps, lanes, pieces, code, max_bits), "links"))


def alike(pairs: DataFrame, texts: DataFrame, words: int, similarity: float) -> DataFrame:
    """The pairs `a`, `b` of fingerprints whose `texts` have shingle sets of the similarity or more."""
    schema = pa.schema([("a", pa.string()), ("b", pa.string())])

    def run(batches):
        of_b: tuple[str | None, set[bytes]] = (None, set())
        for b in batches:
            for part, left in text_groups(b, "text_a"):
                kept: list[int] = []
                for i, text in enumerate(left):
                    name = part.column("b")[i].as_py()
                    if name != of_b[0]:
                        of_b = (name, set(shingles(part.column("text_b")[i].as_py() or "", words)))
                    one = set(shingles(text or "", words))
                    both = len(one & of_b[1])
                    if both >= similarity * (len(one) + len(of_b[1]) - both) - 1e-9:
                        kept.append(i)
                at = pa.array(kept, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [part.column("a").take(at), part.column("b").take(at)], schema=schema
                )

    first = texts.select(F.col("fp").alias("a"), F.col("text").alias("text_a"))
    second = texts.select(F.col("fp").alias("b"), F.col("text").alias("text_b"))
    return pairs.join(first, "a").join(second, "b").select("a", "b", "text_a", "text_b").mapInArrow(
        run, "a string, b string"
    )


def similar_links(docs: DataFrame, fps: DataFrame, lanes: int, pieces, code, max_bits: int, words: int,
                  similarity: float, id_column: str, text_column: str) -> DataFrame:
    """Links `a`, `b` that join all fingerprints whose candidate pairs are similar enough."""

    def candidates(of: DataFrame) -> DataFrame:
        found = fingerprint_links(of, lanes, pieces, code, max_bits)
        return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    first = written(candidates(fps), "candidates")
    linked = first.select(F.explode(F.array("a", "b")).alias("fp")).distinct()
    chosen = fps.join(linked, "fp").select(
        "fp", F.col("least.id").alias("least_id"), F.col("least.key").alias("least_key")
    )
    rows = _keyed(docs, id_column, text_column)
    same = (F.coalesce("id", F.lit(2**63 - 1)) == F.col("least_id")) & (F.col("key") == F.col("least_key"))
    # Rows that repeat have one text.
    texts = written(rows.join(chosen, same).groupBy("fp").agg(F.min("text").alias("text")), "texts")
    links = written(alike(first, texts, words, similarity), "links")
    if links.count() == first.count():
        return links
    roots = component_roots(links)
    known = texts.select("fp").join(roots, F.col("fp") == F.col("node"), "left")
    grouped = written(known.select("fp", F.xxhash64(F.coalesce("root", "fp")).alias("group")), "grouped")
    rest = candidates(grouped).join(first, ["a", "b"], "left_anti")
    return links.union(written(alike(rest, texts, words, similarity), "more_links"))


def near_classes(docs: DataFrame, words: int = 3, max_bits: int = 3, id_column: str = "doc_id",
                 text_column: str = "text") -> DataFrame:
    """Exact components of 64-bit fingerprints: id, fingerprint, component_id per document."""
    lanes, pieces, code = exact_pieces(max_bits)
    rows = written(with_fingerprints(docs, words, lanes, id_column, text_column), "fingerprints")
    groups = fingerprint_groups(rows, lanes, pieces, code, max_bits)
    least = F.col("least.id")
    return rows.join(groups, "fp").select(
        F.col("id").alias(id_column),
        F.col("fp").alias("fingerprint"),
        F.when(least != 2**63 - 1, least).alias("component_id"),
    )


def bits_at(similarity: float, lanes: int) -> int:
    """Differing bits that nearly all pairs of this Jaccard similarity have at most."""
    chance, n = differing_chance(similarity), 64 * lanes
    return math.ceil(n * chance + DEVIATIONS * math.sqrt(n * chance * (1 - chance)))


def drop_near(docs: DataFrame, words: int = 5, similarity: float = 0.8, id_column: str = "doc_id",
              text_column: str = "text") -> DataFrame:
    """The documents without near copies: of each group the one with the smallest id stays.

    Near means that the sets of five-word shingles have a Jaccard similarity of 0.8 or more,
    counted exactly for the candidates that 256-bit fingerprints give. Texts with equal
    fingerprints are near copies. All columns stay as they are.
    """
    lanes = 4
    rows = written(
        with_fingerprints(docs, words, lanes, id_column, text_column, distinct=True), "fingerprints"
    )
    lanes, pieces, code = sampled_pieces(rows.count(), lanes, similarity)
    fps = _representatives(rows)
    links = similar_links(docs, fps, lanes, pieces, code, bits_at(similarity, lanes), words, similarity,
                          id_column, text_column)
    return _without_late(docs, rows, _least_linked(fps, links), id_column, text_column)


def drop_near_fingerprints(docs: DataFrame, words: int = 3, max_bits: int = 3, id_column: str = "doc_id",
                           text_column: str = "text") -> DataFrame:
    """The documents without near copies by their fingerprints alone: of each group the one with the smallest id stays.

    Groups are those of `near_classes`: exact components of 64-bit fingerprints that differ in
    `max_bits` or fewer. All columns stay as they are.
    """
    lanes, pieces, code = exact_pieces(max_bits)
    rows = written(with_fingerprints(docs, words, lanes, id_column, text_column), "fingerprints")
    groups = fingerprint_groups(rows, lanes, pieces, code, max_bits)
    return _without_late(docs, rows, groups, id_column, text_column)


def _without_late(docs: DataFrame, rows: DataFrame, groups: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """The documents but those whose fingerprint's group has a smaller id."""
    late = rows.join(groups, "fp").where(
        (F.coalesce("id", F.lit(2**63 - 1)) != F.col("least.id")) | (F.col("key") != F.col("least.key"))
    ).select("id", "key").distinct()
    plain, names = numbered(docs)
    marked = plain.withColumn("own_key", F.xxhash64(F.col(names[text_column])))
    marked = marked.withColumn("own_id", F.col(names[id_column]).cast("long"))
    same = marked["own_id"].eqNullSafe(late["id"]) & (marked["own_key"] == late["key"])
    return renamed(marked.join(late, same, "left_anti"), names)
