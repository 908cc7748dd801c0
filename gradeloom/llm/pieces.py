"""SentencePiece encoding and decoding of a merge-type (BPE) model (operator 11).

Such a model merges the adjacent pair whose joined piece has the highest score, leftmost
among equals, until no joined pair is a piece. What comes out has two properties:
a prefix that ends at a piece is itself encoded in the same pieces, and a sequence of
pieces is an encoding exactly if any two neighbours are the encoding of their joined text. So
every prefix of a text has one last piece at most. An automaton over the pieces reports
which of them end at each character; the one whose start is the end of an encoded prefix, and
which fits behind that prefix's last piece, goes to the table, and the ids are read from
the end of the table backwards. The fit of two pieces is found by merging the characters of
both and is remembered. The work is linear in the length of a text.

No piece goes on from another character into a space, nor holds a character that only stands
alone, so a text is cut there first (found from the vocabulary, otherwise a text is one
chunk) and frequent chunks are remembered. A null text counts as empty; an empty text has no
ids and decodes to an empty text. Ids of null are those of no text. Rows come back one for one,
in any number; the frame's other columns are not read.
"""

from __future__ import annotations

import codecs
import re
import struct
from collections.abc import Callable, Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gradeloom.llm.batches import text_groups

SPACE = "▁"
WHOLE = ".+"
# Words, chunks and pairs that a worker remembers; longer ones are not kept.
WORDS_REMEMBERED = 300_000
PAIRS_REMEMBERED = 500_000
LONGEST_REMEMBERED = 48


def _replace_each_byte(error: UnicodeError):
    return "�" * (error.end - error.start), error.end


codecs.register_error("each_byte", _replace_each_byte)


class Remembered(dict):
    """What `make` gives for a text; of results once full, those of the last fill are looked at first."""

    def __init__(self, make: Callable[[str], bytes]):
        self._make, self._before = make, {}

    def __missing__(self, text: str) -> bytes:
        made = self._before.get(text)
        if made is None:
            made = self._make(text)
        if len(text) <= LONGEST_REMEMBERED:
            if len(self) >= WORDS_REMEMBERED:
                self._before = dict(self)
                self.clear()
            self[text] = made
        return made


class Pieces:
    """Encoder and decoder of one model file.

    The model must be of the merge type, keep texts as they are but for a space put in front,
    and hold no user-defined or unused pieces; any other is an error.
    """

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        probe = " ﬁ  Å①\t"
        if model.normalize(probe) != SPACE + probe.replace(" ", SPACE):
            raise ValueError("the model changes texts before it encodes them")
        special = ("is_control", "is_unknown", "is_byte")
        n = model.vocab_size()
        kind = [next((s for s in special if getattr(model, s)(i)), "") for i in range(n)]
        if any(model.is_unused(i) for i in range(n)):
            raise ValueError("the model has unused pieces")
        self.score = {model.id_to_piece(i): model.get_score(i) for i in range(n) if not kind[i]}
        self.id_of = {model.id_to_piece(i): i for i in range(n) if not kind[i]}
        self.byte_ids = {int(model.id_to_piece(i)[1:-1], 16): i for i in range(n) if kind[i] == "is_byte"}
        self.unknown = model.unk_id()
        self.control = {i for i in range(n) if kind[i] == "is_control"}
        byte_of = {i: bytes([b]) for b, i in self.byte_ids.items()}
        unknown = model.decode([self.unknown]).encode()
        self.surface = [
            byte_of.get(i) or (unknown if i == self.unknown else b"" if i in self.control
                               else model.id_to_piece(i).replace(SPACE, " ").encode())
            for i in range(n)
        ]
        self.opening = {i for p, i in self.id_of.items() if p.startswith(SPACE)}
        # Results by both pieces' numbers; the number behind the last piece stands for a text's start.
        self._fits: dict[int, bool] = {}
        self._start = n
        self._lone: dict[str, int] = {}
        self._words, self._chunks = Remembered(self._word), Remembered(self.ids_of_chunk)
        self.automaton = ahocorasick.Automaton()
        # The merges inside of each piece; pieces that their own characters do not lead to never come out.
        self._inside: dict[str, list[tuple[float, str, str]]] = {}
        for piece in self.score:
            made = self.merges(piece)
            if len(piece) == 1 or (made and made[-1][1] == piece):
                self._inside[piece] = made
                self.automaton.add_word(piece, self.id_of[piece])
        self.automaton.make_automaton()
        self._letters = {p for p in self._inside if len(p) == 1}
        self._text_of = {i: p for p, i in self.id_of.items()}
        self._size = [len(self._text_of.get(i, "")) for i in range(n)] + [0]
        self._cut = self._cutter()
        self._spaces_part = self._cut.pattern != WHOLE

    def _cutter(self) -> re.Pattern:
        """Cuts a text where no piece can go on: characters that pieces hold together form a class."""
        longer = [p for p in self.score if len(p.lstrip(SPACE)) > 1]
        if any(SPACE in p.lstrip(SPACE) for p in self.score):
            return re.compile(WHOLE, re.DOTALL)
        leader: dict[str, str] = {}

        def lead(c: str) -> str:
            while leader.setdefault(c, c) != c:
                leader[c] = c = leader[leader[c]]
            return c

        for piece in longer:
            for c in piece.lstrip(SPACE):
                leader[lead(c)] = lead(piece.lstrip(SPACE)[0])
        classes: dict[str, list[str]] = {}
        for c in list(leader):
            classes.setdefault(lead(c), []).append(c)
        ways = [f"{SPACE}*[{re.escape(''.join(sorted(c)))}]+"
                for c in sorted(classes.values(), key=len, reverse=True)]
        spaced = {c for p in self.score if p.startswith(SPACE) for c in p.lstrip(SPACE)} - set(leader)
        ways += [f"{SPACE}*[{re.escape(''.join(sorted(spaced)))}]"] if spaced else []
        return re.compile("|".join([*ways, f"{SPACE}+", "."]), re.DOTALL)

    def merges(self, text: str) -> list[tuple[float, str, str]]:
        """The merges of a text in their order: score, first and last part afterwards."""
        parts, score, made = list(text), self.score, []
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            made.append((best, parts[0], parts[-1]))
        return made

    def fits(self, left: int, right: int) -> bool:
        """Whether two neighbours are what their joined text is merged to.

        The merges inside either run side by side, the better score first and the left one
        of equals; they fit if at no point the two parts that touch are the better merge.
        """
        if len(self._fits) >= PAIRS_REMEMBERED:
            self._fits.clear()
        ok = left == self._start or self._meet(self._text_of[left], self._text_of[right])
        self._fits[left << 21 | right] = ok
        return ok

    def _meet(self, left: str, right: str) -> bool:
        in_left, in_right = self._inside.get(left, ()), self._inside.get(right, ())
        x, y, i, j, score = left[-1], right[0], 0, 0, self.score
        while True:
            over = score.get(x + y)
            a = in_left[i][0] if i < len(in_left) else None
            b = in_right[j][0] if j < len(in_right) else None
            if over is not None and (a is None or over > a) and (b is None or over >= b):
                return False
            if a is None and b is None:
                return True
            if b is None or (a is not None and a >= b):
                x = in_left[i][2]
                i += 1
            else:
                y = in_right[j][1]
                j += 1

    def _ends(self, chunk: str) -> Iterator[tuple[int, int]]:
        """(index of the last character, piece) of all pieces in a chunk, in order.

        A character that is no piece stands alone unless a piece goes over it; it gets a number
        behind those of the pieces.
        """
        at = 0
        for end, piece in self.automaton.iter(chunk):
            for i in range(at, end):
                yield i, self._number(chunk[i])
            at = max(at, end)
            yield end, piece
            if chunk[end] in self._letters:
                at = end + 1
        for i in range(at, len(chunk)):
            yield i, self._number(chunk[i])

    def _number(self, letter: str) -> int:
        number = self._lone.get(letter)
        if number is None:
            number = self._lone[letter] = len(self._size)
            self._size.append(1)
            self._text_of[number] = letter
        return number

    def split(self, chunk: str) -> list[int]:
        """The pieces of a chunk: last piece of each prefix, then backwards from the end."""
        last = [-1] * (len(chunk) + 1)
        last[0] = self._start
        known, size = self._fits, self._size
        whole = self._letters.issuperset(chunk)
        full = -1
        for end, piece in self.automaton.iter(chunk) if whole else self._ends(chunk):
            if end == full:
                continue
            before = last[end + 1 - size[piece]]
            if before >= 0:
                pair = before << 21 | piece
                if known[pair] if pair in known else self.fits(before, piece):
                    last[end + 1] = piece
                    full = end
        found, at = [], len(chunk)
        while at:
            found.append(last[at])
            at -= size[last[at]]
        return found[::-1]

    def ids_of_chunk(self, chunk: str) -> bytes:
        ids: list[int] = []
        for piece in self.split(chunk):
            if piece < self._start:
                ids.append(piece)
            elif self.byte_ids:
                ids.extend(self.byte_ids[b] for b in self._text_of[piece].encode())
            else:
                ids.append(self.unknown)
        return struct.pack(f"<{len(ids)}i", *ids)

    def _word(self, word: str) -> bytes:
        """Ids of a word behind a space."""
        return b"".join(map(self._chunks.__getitem__, self._cut.findall(SPACE + word)))

    def encode(self, text: str) -> bytes:
        """Ids as little-endian 32-bit integers."""
        if not text:
            return b""
        if self._spaces_part and "  " not in text and SPACE not in text and text[0] != " " and text[-1] != " ":
            return b"".join(map(self._words.__getitem__, text.split(" ")))
        return b"".join(map(self._chunks.__getitem__, self._cut.findall(SPACE + text.replace(" ", SPACE))))

    def decode(self, ids: list[int]) -> str:
        if not self.control.isdisjoint(ids):
            parts: list[list[int]] = [[]]
            for i in ids:
                if i in self.control:
                    parts.append([])
                else:
                    parts[-1].append(i)
            parts = [p for p in parts if p] or [[]]
            return self.decode(parts[0]) + "".join(map(self._text, parts[1:]))
        text = self._text(ids)
        return text[1:] if ids and ids[0] in self.opening else text

    def _text(self, ids: list[int]) -> str:
        return b"".join(map(self.surface.__getitem__, ids)).decode("utf-8", "each_byte")


@lru_cache(maxsize=2)
def _worker(path: str) -> Pieces:
    """One model per Python worker, kept between its tasks."""
    return Pieces(path)


def _texts(model: Pieces, ids: pa.ListArray) -> pa.Array:
    values, ends = ids.values.to_numpy(zero_copy_only=False), ids.offsets.to_pylist()
    return pa.array([model.decode(values[a:z].tolist()) for a, z in zip(ends, ends[1:])], type=pa.string())


def encode(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text",
           with_decoded: bool = False) -> DataFrame:
    """Ids of every whole text: the id column, `n_tokens` long, `ids` array of int.

    `with_decoded` adds what the ids decode to, `decoded`, in the same pass over the texts.
    """
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    out = T.StructType([rows.schema["id"], T.StructField("n_tokens", T.LongType()),
                        T.StructField("ids", T.ArrayType(T.IntegerType()))])
    if with_decoded:
        out = T.StructType([*out.fields, T.StructField("decoded", T.StringType())])

    def run(batches):
        model = _worker(path)
        for b in batches:
            for part, texts in text_groups(b, "text"):
                packed = [model.encode(t or "") for t in texts]
                counts = np.array([len(p) // 4 for p in packed], dtype="int64")
                ends = np.concatenate([[0], np.cumsum(counts)]).astype("int32")
                ids = pa.ListArray.from_arrays(ends, pa.array(np.frombuffer(b"".join(packed), dtype="<i4")))
                made = [part.column("id"), pa.array(counts), ids]
                yield pa.RecordBatch.from_arrays(
                    [*made, _texts(model, ids)] if with_decoded else made, names=out.names)

    return rows.mapInArrow(run, out).withColumnRenamed("id", id_column)


def decode(encoded: DataFrame, path: str, id_column: str = "doc_id") -> DataFrame:
    """Adds `decoded`, the text that the ids stand for."""
    rows = encoded.select(F.col(id_column).alias("id"), "n_tokens", "ids")
    out = T.StructType([*rows.schema.fields, T.StructField("decoded", T.StringType())])

    def run(batches):
        model = _worker(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, _texts(model, b.column("ids"))], names=out.names)

    return rows.mapInArrow(run, out).withColumnRenamed("id", id_column)
