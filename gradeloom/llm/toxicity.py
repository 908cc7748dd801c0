"""Toxicity: nearest labelled examples by exact TF-IDF cosine (operator 10).

Features are words and beginnings of words, so that inflected forms meet. The ones that
labelled toxic documents hold far more often than others make the vocabulary; their
document frequencies come from all documents. Labelled examples that hold any of
them go into an inverted index in blocks, with the largest weight of each term per block. A
document visits blocks by falling upper bound and stops when no further block can hold a nearer
example: the neighbours are the exact nearest. They vote by distance; an isotonic curve over
leave-one-out votes of the examples turns votes into calibrated scores. The evidence is the
nearest examples' ids and the terms found.

Bounds: at most `SAMPLE_ROWS` labelled documents (smallest hash of the id) are learnt from, at
most `TERMS` terms are kept; the broadcast index is bounded by both.

Null text counts as empty. A document without any term has no neighbours; its score is
the toxic share of such labelled documents. Without labelled documents every score is 0.
Repeated rows get equal scores. Only the text is an input of a score.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeloom.llm.batches import text_groups
from gradeloom.llm.labelled import training_sample

SAMPLE_ROWS = 16_384
TERMS = 1_024
# Least standard score of a term's toxic share over its share elsewhere, least toxic documents.
LEAST_SCORE, LEAST_ROWS = 5.0, 3
PREFIXES = (4, 5, 6, 8)
NEIGHBOURS = 15
BLOCK = 64
# Words whose terms a worker remembers.
REMEMBERED = 500_000

# ASCII letters are lowered, other ASCII but digits becomes a space; bytes of other characters stay.
_PLAIN = bytes(
    i + 32 if 65 <= i <= 90 else i if i >= 128 or chr(i).isalnum() else 32 for i in range(256)
)


def words_of(text: str) -> list[bytes]:
    return text.encode().translate(_PLAIN).split()


def terms_of(word: bytes) -> list[bytes]:
    """The word, marked as whole, and its beginnings."""
    return [b"=" + word, *(word[:n] for n in PREFIXES if n <= len(word))]


class Vocabulary:
    """Term numbers of words; the terms of a word are looked up once."""

    def __init__(self, terms: list[bytes]):
        self.terms = terms
        self._number = {t: i for i, t in enumerate(terms)}
        self._of_word: dict[bytes, tuple[int, ...]] = {}

    def __reduce__(self):
        return Vocabulary, (self.terms,)

    def counts(self, text: str) -> dict[int, int]:
        if len(self._of_word) > REMEMBERED:
            self._of_word.clear()
        out: dict[int, int] = {}
        of_word, number = self._of_word, self._number
        for word in words_of(text):
            found = of_word.get(word)
            if found is None:
                found = tuple(number[t] for t in terms_of(word) if t in number)
                of_word[word] = found
            for i in found:
                out[i] = out.get(i, 0) + 1
        return out


def select_terms(sample: DataFrame) -> list[bytes]:
    """Terms that toxic sample documents hold far more often than others, best first."""
    schema = "term binary, toxic long, clean long"

    def run(batches):
        hits: tuple[Counter, Counter] = (Counter(), Counter())
        docs = [0, 0]
        for b in batches:
            for part, texts in text_groups(b, "text"):
                for label, t in zip(part.column("label").to_pylist(), texts):
                    docs[label] += 1
                    hits[label].update({x for w in set(words_of(t or "")) for x in terms_of(w)})
            if len(hits[0]) + len(hits[1]) > 500_000:
                yield from _counted(hits)
                hits = (Counter(), Counter())
        yield from _counted(hits)
        yield pa.RecordBatch.from_arrays(
            [pa.array([b""]), pa.array([docs[1]]), pa.array([docs[0]])],
            names=["term", "toxic", "clean"],
        )

    totals = sample.mapInArrow(run, schema).groupBy("term").agg(
        F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")
    ).where(F.col("toxic") >= LEAST_ROWS)
    # The empty term counts the documents themselves and is the most frequent of all.
    whole = totals.where(F.length("term") == 0).first()
    if whole is None or not whole["clean"]:
        return []
    n1, n0 = float(whole["toxic"]), float(whole["clean"])
    pooled = (F.col("toxic") + F.col("clean") + 1) / (n1 + n0)
    z = (F.col("toxic") / n1 - F.col("clean") / n0) / F.sqrt(pooled * (1 / n1 + 1 / n0))
    best = totals.where(F.length("term") > 0).withColumn("z", z).where(F.col("z") >= LEAST_SCORE)
    return [bytes(r["term"]) for r in best.orderBy(F.desc("z"), "term").limit(TERMS).collect()]


def _counted(hits):
    names = sorted(hits[0].keys() | hits[1].keys())
    for at in range(0, len(names), 50_000):
        some = names[at : at + 50_000]
        yield pa.RecordBatch.from_arrays(
            [pa.array(some, pa.binary()), pa.array([hits[1][t] for t in some], pa.int64()),
             pa.array([hits[0][t] for t in some], pa.int64())],
            names=["term", "toxic", "clean"],
        )


def term_frequencies(docs: DataFrame, vocabulary: Vocabulary, text_column: str) -> tuple[np.ndarray, int]:
    """Documents that hold each term, over all documents, and their number."""

    def run(batches):
        seen, n = np.zeros(len(vocabulary.terms) + 1, np.int64), 0
        for b in batches:
            for _, texts in text_groups(b, "text"):
                for t in texts:
                    for i in vocabulary.counts(t or ""):
                        seen[i] += 1
                n += len(texts)
        seen[-1] = n
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(seen))), pa.array(seen)], names=["f", "n"])

    parts = docs.select(F.col(text_column).alias("text")).mapInArrow(run, "f long, n long")
    out = np.zeros(len(vocabulary.terms) + 1, np.int64)
    for r in parts.groupBy("f").agg(F.sum("n").alias("n")).collect():
        out[r["f"]] = r["n"]
    return out[:-1], int(out[-1])


@dataclass
class Index:
    """Block-max inverted index over unit vectors of labelled examples."""

    vocabulary: Vocabulary
    idf: np.ndarray
    ids: np.ndarray
    labels: np.ndarray
    pointers: np.ndarray  # [term, block]: where the block's postings of a term begin
    examples: np.ndarray  # of postings, numbered within their block
    weights: np.ndarray
    most: np.ndarray  # [term, block]: largest weight
    no_terms: float = 0.0
    curve: list[tuple[float, float]] = field(default_factory=list)

    def vector(self, counts: dict[int, int]) -> dict[int, float]:
        raw = {t: (1 + math.log(c)) * self.idf[t] for t, c in sorted(counts.items())}
        norm = math.sqrt(sum(x * x for x in raw.values()))
        return {t: x / norm for t, x in raw.items()}

    def nearest(self, vector: dict[int, float], k: int, but: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """The k most similar examples and their cosines; ties go to the smaller number."""
        terms = np.array(list(vector), np.int64)
        query = np.array(list(vector.values()))
        bound = query @ self.most[terms]
        best = np.zeros(0)
        which = np.zeros(0, np.int64)
        for block in np.argsort(-bound, kind="stable"):
            if bound[block] <= 0 or (len(best) == k and bound[block] < best[-1] - 1e-12):
                break
            scores = np.zeros(BLOCK)
            for t, q in zip(terms, query):
                lo, hi = self.pointers[t, block], self.pointers[t, block + 1]
                if hi > lo:
                    scores[self.examples[lo:hi]] += q * self.weights[lo:hi]
            hit = np.flatnonzero(scores > 0)
            number = hit + block * BLOCK
            if but >= 0:
                hit, number = hit[number != but], number[number != but]
            best = np.concatenate([best, scores[hit]])
            which = np.concatenate([which, number])
            order = np.lexsort((which, -np.round(best, 12)))[:k]
            best, which = best[order], which[order]
        return which, best

    def vote(self, which: np.ndarray, cosine: np.ndarray) -> float:
        """Toxic share of the neighbours, weighted by how near they are."""
        weight = 1 / (1.05 - np.clip(cosine, 0, 1))
        return float((weight * self.labels[which]).sum() / weight.sum())

    def score(self, counts: dict[int, int]) -> tuple[float, list[int], list[str]]:
        if not counts or not len(self.ids):
            return self.no_terms, [], []
        vector = self.vector(counts)
        which, cosine = self.nearest(vector, NEIGHBOURS)
        if not len(which):
            return self.no_terms, [], []
        score = float(np.interp(self.vote(which, cosine), *zip(*self.curve)))
        terms = sorted(vector, key=lambda t: (-vector[t], t))[:5]
        names = [self.vocabulary.terms[t].decode("utf-8", "replace") for t in terms]
        return min(max(score, 0.0), 1.0), self.ids[which[:3]].tolist(), names


def _isotonic(votes: np.ndarray, labels: np.ndarray) -> list[tuple[float, float]]:
    """Non-decreasing curve of label shares over votes, pooled from neighbours that disagree."""
    blocks: list[list[float]] = []  # labels, rows, sum of votes
    for i in np.argsort(votes, kind="stable"):
        blocks.append([float(labels[i]), 1.0, float(votes[i])])
        while len(blocks) > 1 and (
            blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]
            or blocks[-2][2] / blocks[-2][1] == blocks[-1][2] / blocks[-1][1]
        ):
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
    # Half a row of either label keeps shares off 0 and 1.
    return [(v / n, (y + 0.5 * v / n) / (n + 0.5)) for y, n, v in blocks]


def build_index(sample: DataFrame, vocabulary: Vocabulary, frequencies: np.ndarray, rows: int) -> Index:
    """The index over a bounded sample with `id`, `label`, `text`."""

    def run(batches):
        for b in batches:
            for part, texts in text_groups(b, "text"):
                made = [vocabulary.counts(t or "") for t in texts]
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), part.column("label"),
                     pa.array([list(c) for c in made], pa.list_(pa.int64())),
                     pa.array([list(c.values()) for c in made], pa.list_(pa.int64()))],
                    names=["id", "label", "t", "c"],
                )

    got = sample.mapInArrow(run, "id long, label int, t array<long>, c array<long>").collect()
    empty = [r["label"] for r in got if not r["t"]]
    # Examples that share their first terms stand together, so block bounds are tight.
    used = sorted((r for r in got if r["t"]), key=lambda r: (sorted(r["t"]), r["id"], r["label"]))
    idf = np.log((1 + rows) / (1 + frequencies)) + 1
    blocks = max(1, math.ceil(len(used) / BLOCK))
    n = len(vocabulary.terms)
    index = Index(
        vocabulary, idf, np.array([r["id"] for r in used], np.int64),
        np.array([r["label"] for r in used], np.float64), np.zeros((n, blocks + 1), np.int64),
        np.zeros(0, np.int64), np.zeros(0), np.zeros((n, blocks)),
    )
    vectors = [index.vector(dict(zip(r["t"], r["c"]))) for r in used]
    postings: list[list[tuple[int, float]]] = [[] for _ in range(n)]
    for i, v in enumerate(vectors):
        for t, w in v.items():
            postings[t].append((i, w))
            index.most[t, i // BLOCK] = max(index.most[t, i // BLOCK], w)
    flat = [p for ps in postings for p in ps]
    index.examples = np.array([i % BLOCK for i, _ in flat], np.int64)
    index.weights = np.array([w for _, w in flat])
    at = 0
    for t, ps in enumerate(postings):
        per_block = np.bincount([i // BLOCK for i, _ in ps], minlength=blocks) if ps else np.zeros(blocks, int)
        index.pointers[t] = at + np.concatenate([[0], np.cumsum(per_block)])
        at += len(ps)
    index.no_terms = (sum(empty) + 0.5 * bool(empty)) / (len(empty) + 1) if got else 0.0
    votes, own = [], []
    for i, v in enumerate(vectors):
        which, cosine = index.nearest(v, NEIGHBOURS, but=i)
        if len(which):
            votes.append(index.vote(which, cosine))
            own.append(index.labels[i])
    index.curve = _isotonic(np.array(votes), np.array(own)) if votes else [(0.0, 0.0), (1.0, 1.0)]
    return index


def score_toxicity(docs: DataFrame, labels: DataFrame, learn: Column, label: str = "toxic",
                   sample_rows: int = SAMPLE_ROWS, id_column: str = "doc_id",
                   text_column: str = "text") -> DataFrame:
    """id, `score` from 0 to 1, `neighbours` (ids of the nearest examples), `terms` found."""
    spark = docs.sparkSession
    sample = training_sample(labels, docs, label, learn, sample_rows, id_column, text_column)
    vocabulary = Vocabulary(select_terms(sample))
    frequencies, rows = term_frequencies(docs, vocabulary, text_column)
    index = spark.sparkContext.broadcast(build_index(sample, vocabulary, frequencies, rows))
    given = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text"))

    def run(batches):
        model = index.value
        for b in batches:
            for part, texts in text_groups(b, "text"):
                made = [model.score(model.vocabulary.counts(t or "")) for t in texts]
                score, near, terms = zip(*made)
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), pa.array(score, pa.float64()),
                     pa.array(near, pa.list_(pa.int64())), pa.array(terms, pa.list_(pa.string()))],
                    names=["id", "score", "neighbours", "terms"],
                )

    schema = "id long, score double, neighbours array<long>, terms array<string>"
    return given.mapInArrow(run, schema).withColumnRenamed("id", id_column)
