"""Token ids of whole texts from the ids of their chunks.

The split pattern of byte-level vocabularies always ends a match before a single
space or line break that stands between two other characters. A text can be cut
there, each chunk encoded on its own, and the ids joined: the result equals that
of the whole text. Chunks repeat often, so their ids are remembered.
"""

from __future__ import annotations

import re
from collections.abc import Callable

# Python's \s holds every character the vocabularies' pattern takes as white space.
_CUT = re.compile(r"(?<=\S)(?= \S)|(?<=\S)(?=\n\S)")

# Chunks a worker remembers; a chunk and its ids take about 200 bytes.
REMEMBERED = 300_000


class _Memory:
    """Ids by chunk: a young and an old half, so that what is used often stays."""

    def __init__(self, size: int):
        self._half = size // 2
        self._young: dict[str, bytes] = {}
        self._old: dict[str, bytes] = {}

    def learn(self, wanted: set[str], encode: Callable[[list[str]], list[bytes]]) -> dict[str, bytes]:
        """The young half, which then holds all that is wanted."""
        if len(self._young) > self._half:
            self._old, self._young = self._young, {}
        old, young, missing = self._old, self._young, []
        for w in wanted:
            if w not in young:
                ids = old.get(w)
                if ids is None:
                    missing.append(w)
                else:
                    young[w] = ids
        young.update(zip(missing, encode(missing)))
        return young


class ChunkEncoder:
    """`encode_many` gives the packed ids of each of several chunks."""

    def __init__(self, encode_many: Callable[[list[str]], list[bytes]], remembered: int = REMEMBERED):
        self._encode_many = encode_many
        # Words after a space, words after a line break, any other chunk as it is.
        self._space = _Memory(remembered)
        self._line = _Memory(remembered // 8)
        self._bare = _Memory(remembered // 8)

    @staticmethod
    def _plain(text: str) -> bool:
        """True if single spaces and single line breaks are the only white space, all inside."""
        return text.split() == text.replace("\n", " ").split(" ")

    def _after(self, prefix: str) -> Callable[[list[str]], list[bytes]]:
        return lambda words: self._encode_many([prefix + w for w in words])

    def encode(self, texts: list[str]) -> list[bytes]:
        shaped, space, line, bare = [], set(), set(), set()
        for text in texts:
            if not text:
                shaped.append(None)
            elif self._plain(text):
                rows = [r.split(" ") for r in text.split("\n")]
                bare.add(rows[0][0])
                line.update(r[0] for r in rows[1:])
                for r in rows:
                    space.update(r[1:])
                shaped.append((True, rows))
            else:
                parts = _CUT.split(text)
                bare.update(parts)
                shaped.append((False, parts))
        after_space = self._space.learn(space, self._after(" "))
        after_line = self._line.learn(line, self._after("\n"))
        as_is = self._bare.learn(bare, self._encode_many)
        out = []
        for item in shaped:
            if item is None:
                out.append(b"")
            elif item[0]:
                ids = []
                for i, row in enumerate(item[1]):
                    ids.append(after_line[row[0]] if i else as_is[row[0]])
                    ids.extend(map(after_space.__getitem__, row[1:]))
                out.append(b"".join(ids))
            else:
                out.append(b"".join(map(as_is.__getitem__, item[1])))
        return out
