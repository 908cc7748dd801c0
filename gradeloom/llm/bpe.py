"""Byte-level BPE encoding and decoding (operator 8).

A vocabulary of ranks merges the adjacent pair of lowest rank again and again.
The same ids come out of a left-to-right pass: an automaton over all tokens finds
the longest token that starts at a byte, which is taken if it may stand behind the last
one, and a dead end steps back to a shorter one. Two tokens may stand side by side if merging
their joined bytes leaves exactly these two; that test is remembered per pair. Each
position is entered once, so the work is linear in the length of a match.

Bytes are mapped to Latin-1 characters for the automaton. A null text counts as
empty; an empty text has no ids. Rows come back one for one, in any number.
"""

from __future__ import annotations

import base64
import struct
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeloom.llm.batches import batch, text_groups
from gradeloom.llm.chunks import ChunkEncoder

# Results of the test of two neighbours that a worker remembers before it starts anew.
PAIRS_REMEMBERED = 300_000

# Unicode's White_Space, which the pattern's \s stands for.
_SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


def split_pattern(pattern: str) -> regex.Pattern:
    explicit = pattern.replace(r"[^\s", f"[^{_SPACE}")
    return regex.compile(explicit.replace(r"\s", f"[{_SPACE}]").replace(r"\S", f"[^{_SPACE}]"))


class BytePairs:
    """Encoder and decoder of one rank file (base64 token and rank per line)."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.pattern = split_pattern(pattern)
        # The last merge of each token, filled in rank order: its parts have lower ranks.
        self.parts: dict[int, tuple[int, int]] = {}
        for token, rank in sorted(self.ranks.items(), key=lambda x: x[1]):
            if len(token) > 1:
                pair = self._last_merge(token, rank)
                if pair:
                    self.parts[rank] = pair
        # Tokens that merges can end in, as Latin-1 text.
        self._rank_of = {t.decode("latin-1"): r for t, r in self.ranks.items()}
        self._made = {t: r for t, r in self._rank_of.items() if len(t) == 1 or r in self.parts}
        self._longest_token = max(map(len, self._made))
        self.automaton = ahocorasick.Automaton()
        for token, rank in self._made.items():
            self.automaton.add_word(token, rank)
        self.automaton.make_automaton()
        self._token_of_path: dict[str, int] = {}
        self._shorter: dict[int, int] = {}
        self._fits: dict[int, bool] = {}

    def _last_merge(self, token: bytes, rank: int) -> tuple[int, int] | None:
        """The two ranks a token is merged from, None if its bytes never meet as two."""
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            best, at = rank, -1
            for i in range(len(parts) - 1):
                r = self.ranks.get(parts[i] + parts[i + 1], rank)
                if r < best:
                    best, at = r, i
            if at < 0:
                return None
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return self.ranks[parts[0]], self.ranks[parts[1]]

    def fits(self, left: int, right: int) -> bool:
        """Whether the merges of both tokens' joined bytes end in exactly these two.

        The merges inside both tokens are undone from the highest rank down; if at any
        point the pieces that touch would merge before the next merge, they do not fit.
        """
        a, b, limit, ok = left, right, len(self.tokens), True
        while True:
            merged = self.ranks.get(self.tokens[a] + self.tokens[b])
            # Equal ranks merge from the left, so a merge inside the left token goes first.
            if merged is not None and merged < limit:
                ok = False
                break
            in_a, in_b = self.parts.get(a), self.parts.get(b)
            if in_a is None and in_b is None:
                break
            if in_b is None or (in_a is not None and a > b):
                limit, a = a, in_a[1]
            else:
                limit, b = b + 1, in_b[0]
        return ok

    def _longest_in(self, path: str) -> int:
        """The longest token at the start of a path of the automaton's trie, -1 if none."""
        while path and path not in self._made:
            path = path[:-1]
        return self._made[path] if path else -1

    def _longest_at(self, match: str, pos: int) -> int:
        ahead = match[pos : pos + self._longest_token]
        path = ahead[: self.automaton.longest_prefix(ahead)]
        rank = self._token_of_path.get(path)
        if rank is None:
            rank = self._token_of_path[path] = self._longest_in(path)
        return rank

    def _next_shorter(self, rank: int) -> int:
        found = self._shorter.get(rank)
        if found is None:
            token = self.tokens[rank].decode("latin-1")
            found = self._shorter[rank] = self._longest_in(token[:-1])
        return found

    def encode_match(self, match: str) -> list[int]:
        """Ids of one match of the split pattern, given as Latin-1 text of its bytes."""
        whole = self._rank_of.get(match)
        if whole is not None:
            return [whole]
        ids: list[int] = []
        fits, tokens, width = self._fits, self.tokens, len(self.tokens)
        dead: set[int] = set()
        pos, size, last = 0, len(match), -1
        rank = self._longest_at(match, 0)
        while pos < size:
            while rank >= 0:
                end = pos + len(tokens[rank])
                if end not in dead:
                    if last < 0:
                        break
                    pair = last * width + rank
                    ok = fits.get(pair)
                    if ok is None:
                        if len(fits) >= PAIRS_REMEMBERED:
                            fits.clear()
                        ok = fits[pair] = self.fits(last, rank)
                    if ok:
                        break
                rank = self._next_shorter(rank)
            if rank >= 0:
                ids.append(rank)
                pos, last = end, rank
                if pos < size:
                    rank = self._longest_at(match, pos)
            else:
                # Nothing leads on from here: take a shorter token one step back.
                dead.add(pos)
                gone = ids.pop()
                pos -= len(tokens[gone])
                last = ids[-1] if ids else -1
                rank = self._next_shorter(gone)
        return ids

    def encode_chunk(self, chunk: str) -> bytes:
        ids: list[int] = []
        for m in self.pattern.findall(chunk):
            ids.extend(self.encode_match(m.encode().decode("latin-1")))
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode_chunks(self, chunks: list[str]) -> list[bytes]:
        return [self.encode_chunk(c) for c in chunks]

    def decode(self, packed: bytes) -> bytes:
        ids = np.frombuffer(packed, dtype="<u4").tolist()
        return b"".join(map(self.tokens.__getitem__, ids))


@lru_cache(maxsize=2)
def _worker(path: str, pattern: str) -> tuple[BytePairs, ChunkEncoder]:
    """One vocabulary per Python worker, kept between its tasks."""
    pairs = BytePairs(path, pattern)
    return pairs, ChunkEncoder(pairs.encode_chunks)


def encode(docs: DataFrame, path: str, pattern: str, id_column: str = "doc_id",
           text_column: str = "text") -> DataFrame:
    """Ids of every whole text: `ids` (little-endian unsigned 32-bit), `n_tokens`."""
    schema = pa.schema([("n_tokens", pa.int64()), ("ids", pa.binary())])
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    out = rows.select("id").schema.simpleString()[7:-1] + ", n_tokens long, ids binary"

    def run(batches):
        _, encoder = _worker(path, pattern)
        for b in batches:
            for part, texts in text_groups(b, "text"):
                ids = encoder.encode([t or "" for t in texts])
                made = batch(schema, [[len(x) // 4 for x in ids], ids])
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), *made.columns], names=["id", "n_tokens", "ids"]
                )

    return rows.mapInArrow(run, out).withColumnRenamed("id", id_column)


def decode(encoded: DataFrame, path: str, pattern: str, id_column: str = "doc_id") -> DataFrame:
    """Adds `decoded`, the bytes that the ids stand for."""
    rows = encoded.select(F.col(id_column).alias("id"), "n_tokens", "ids")

    def run(batches):
        pairs, _ = _worker(path, pattern)
        for b in batches:
            for part, ids in text_groups(b, "ids"):
                made = pa.array([pairs.decode(x) for x in ids], type=pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, made], names=["id", "n_tokens", "ids", "decoded"]
                )

    out = rows.schema.simpleString()[7:-1].replace(":", " ").replace(",", ", ") + ", decoded binary"
    return rows.mapInArrow(run, out).withColumnRenamed("id", id_column)
