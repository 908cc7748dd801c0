"""Substring dedup by line hashing (operator 9).

A text is cut into units: lines, and inside a line sentences, since a passage can stand in the
middle of a line. A sentence ends at a full stop, question or exclamation mark before
white space; sentences are joined until a unit has `UNIT_WORDS` words. Units are normalised
(lower case, single spaces) and hashed. Of equal units in all documents the earliest stays:
the one with the smallest document id, then the first in the text. Other occurrences are
repeats. A line that has only repeats is removed, whatever its length, so of equal lines the
earliest alone stays. Inside other lines a run of neighbouring repeats is removed if it has `RUN_WORDS` words
together: passages go, while short sentences that happen to recur stay. The removed spans are
kept as offsets into the original text.

Digests have 128 bits and are grouped with partial aggregates; the join back to the units is
split by adaptive execution where a unit is very frequent. A document's own repeats come
together in one row, bounded by its text.

Null text counts as empty and comes back as null. Null ids rank before others. Rows with equal
id and text are one document seen twice: they get equal results, and neither is the other's
repeat. Columns of other names stay as they are.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeloom.llm.batches import numbered, renamed, text_groups

UNIT_WORDS = 5
RUN_WORDS = 20
# Sentences of a line with the white space behind them.
_SENTENCE = re.compile(r"[^\n]*?[.!?]+(?=\s)[^\S\n]*|[^\n]+")


def units(text: str) -> list[tuple[int, int, int]]:
    """Spans of the units, and their numbers of words; line breaks are between units."""
    out = []
    for line in re.finditer(r"[^\n]+", text):
        begin, words, end = line.start(), 0, line.start()
        for m in _SENTENCE.finditer(text, line.start(), line.end()):
            words += len(m[0].split())
            end = m.end()
            if words >= UNIT_WORDS:
                out.append((begin, end, words))
                begin, words = end, 0
        if words:
            out.append((begin, end, words))
    return out


def _digest(unit: str) -> bytes:
    return hashlib.blake2b(" ".join(unit.lower().split()).encode(), digest_size=16).digest()


def unit_rows(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """`h1`, `h2` (digest), `id`, `key` (hash of the text), `unit` (number in the text)."""
    rows = docs.select(
        F.col(id_column).cast("long").alias("id"),
        F.xxhash64(F.col(text_column)).alias("key"),
        F.col(text_column).alias("text"),
    )

    def run(batches):
        for b in batches:
            for part, texts in text_groups(b, "text"):
                digests, sizes = bytearray(), []
                for t in texts:
                    spans = units(t or "")
                    for lo, hi, _ in spans:
                        digests += _digest(t[lo:hi])
                    sizes.append(len(spans))
                h = np.frombuffer(digests, "<i8").reshape(-1, 2)
                many = np.array(sizes, np.int64)
                at = pa.array(np.repeat(np.arange(len(many)), many))
                number = np.arange(len(h)) - np.repeat(np.cumsum(many) - many, many)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h[:, 0].copy()), pa.array(h[:, 1].copy()), part.column("id").take(at),
                     part.column("key").take(at), pa.array(number.astype(np.int32))],
                    names=["h1", "h2", "id", "key", "unit"],
                )

    return rows.mapInArrow(run, "h1 long, h2 long, id long, key long, unit int")


def repeated_units(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per document that has any: `id`, `key`, and `repeats`, the numbers of repeated units."""
    rows = unit_rows(docs, id_column, text_column)
    place = F.struct("id", "key", "unit")
    firsts = rows.groupBy("h1", "h2").agg(
        F.min(place).alias("first"), F.count(F.lit(1)).alias("n")
    ).where("n > 1").select("h1", "h2", "first")
    late = rows.join(firsts, ["h1", "h2"]).where(~place.eqNullSafe(F.col("first")))
    return late.groupBy("id", "key").agg(F.collect_set("unit").alias("repeats"))


def removed_spans(text: str, repeats: set[int], run_words: int) -> list[tuple[int, int]]:
    """Spans of the lines that are repeats as wholes, and of other runs of repeats with enough words."""
    spans = units(text)
    line, same = [], 0
    for i, (begin, _, _) in enumerate(spans):
        same += i > 0 and "\n" in text[spans[i - 1][1] : begin]
        line.append(same)
    kept_lines = {number for i, number in enumerate(line) if i not in repeats}
    gone, at = [False] * len(spans), 0
    while at < len(spans):
        end = at
        while end < len(spans) and end in repeats:
            end += 1
        enough = sum(w for _, _, w in spans[at:end]) >= run_words
        for i in range(at, end):
            gone[i] = enough or line[i] not in kept_lines
        at = max(end, at + 1)
    out = []
    for i, (begin, end, _) in enumerate(spans):
        if gone[i]:
            joined = i > 0 and gone[i - 1]
            out.append((out.pop()[0] if joined else begin, end))
    return out


def drop_repeats(docs: DataFrame, run_words: int = RUN_WORDS, id_column: str = "doc_id",
                 text_column: str = "text") -> DataFrame:
    """All columns, the text without later repeats, and `removed_spans` of the original text.

    Spans are structs of `start` and `end` in characters, in text order; a line of which
    nothing is left goes with its break.
    """
    late = repeated_units(docs, id_column, text_column)
    plain, given = numbered(docs)
    names, text = list(given.values()), given[text_column]
    marked = plain.withColumn("own_key", F.xxhash64(F.col(text))).withColumn(
        "own_id", F.col(given[id_column]).cast("long")
    )
    same = marked["own_id"].eqNullSafe(late["id"]) & (marked["own_key"] == late["key"])
    joined = marked.join(late, same, "left").select(*names, "repeats")

    def run(batches):
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for b in batches:
            for part, texts in text_groups(b, text):
                new, spans = [], []
                for t, repeats in zip(texts, part.column("repeats").to_pylist()):
                    gone = removed_spans(t, set(repeats), run_words) if repeats else []
                    new.append(without(t, gone) if gone else t)
                    spans.append([{"start": a, "end": z} for a, z in gone])
                columns = [pa.array(new, pa.string()) if n == text else part.column(n) for n in names]
                yield pa.RecordBatch.from_arrays(
                    [*columns, pa.array(spans, span)], names=[*names, "removed_spans"]
                )

    types = ", ".join(f"{n} {joined.schema[n].dataType.simpleString()}" for n in names)
    schema = f"{types}, removed_spans array<struct<start: long, end: long>>"
    return renamed(joined.mapInArrow(run, schema), given, "removed_spans")


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the spans; white space that would double at a cut goes too."""
    out, at = [], 0
    for lo, hi in spans:
        out.append(text[at:lo])
        # A line that goes whole takes its break along.
        if hi < len(text) and text[hi] == "\n" and (lo == 0 or text[lo - 1] == "\n"):
            hi += 1
        at = hi
    out.append(text[at:])
    return "".join(out)
