"""Quality classifier: votes of the nearest labelled documents (operator 5).

A text is counted as trigrams of character classes (letters of either case, digits, white
space and kinds of punctuation) and as the number of words that repeat the one before.
Counts become TF-IDF vectors with document frequencies over all documents. A
truncated singular value decomposition of a bounded sample of labelled documents gives a
latent space; the sample's vectors in it are broadcast, and every document meets all of them
in exact blocked cosine products. The nearest ones vote with a power of their similarity.

Bounds: at most `SAMPLE_ROWS` labelled documents, the ones with the smallest hash of the id,
are fitted and broadcast (1.5 MB). Document frequencies are 4097 numbers.

Null text counts as empty and is scored like any other text. Without any labelled document
the score is 0.5. Repeated rows get equal scores. Only the text is an input of a score.
"""

from __future__ import annotations

from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gradeloom.llm.batches import numbered, renamed, text_groups
from gradeloom.llm.labelled import training_sample

SAMPLE_ROWS = 6_000
DIMENSIONS = 48
NEIGHBOURS = 10
POWER = 32
# Documents of one cosine block.
BLOCK = 512

# Character classes of bytes; what is not named is class 0.
_KINDS = {
    4: b"0123456789", 5: b" ", 6: b"\n", 7: b"\t\r\x0b\x0c", 8: b".", 9: b",", 10: b"!",
    11: b"|", 12: b"*#&%$@~^", 13: b"'\"()[]{}", 14: b":;-_/", 15: b"=+<>\\",
}
_CLASS = np.zeros(256, np.int64)
_CLASS[128:] = 1
_CLASS[65:91] = 2
_CLASS[97:123] = 3
for _kind, _chars in _KINDS.items():
    _CLASS[list(_chars)] = _kind

FEATURES = 16**3 + 1


def counts(text: str) -> np.ndarray:
    """Counts of class trigrams, with a space on either side, and of repeated words."""
    raw = text.encode()
    kinds = _CLASS[np.frombuffer(b" " + raw + b" ", np.uint8)]
    out = np.zeros(FEATURES, np.int64)
    if raw:
        out[:-1] = np.bincount(kinds[:-2] * 256 + kinds[1:-1] * 16 + kinds[2:], minlength=16**3)
    words = raw.split()
    out[-1] = sum(map(eq, words, words[1:]))
    return out


def document_frequencies(docs: DataFrame, text_column: str = "text") -> tuple[np.ndarray, int]:
    """How many documents have each feature, and how many documents there are."""

    def run(batches):
        seen, n = np.zeros(FEATURES, np.int64), 0
        for b in batches:
            for _, texts in text_groups(b, "text"):
                for t in texts:
                    seen += counts(t or "") > 0
                n += len(texts)
        used = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays(
            [pa.array([*used.tolist(), -1]), pa.array([*seen[used].tolist(), n])], names=["f", "n"]
        )

    parts = docs.select(F.col(text_column).alias("text")).mapInArrow(run, "f long, n long")
    frequencies, rows = np.zeros(FEATURES, np.int64), 0
    # At most one row per feature.
    for r in parts.groupBy("f").agg(F.sum("n").alias("n")).collect():
        if r["f"] < 0:
            rows = r["n"]
        else:
            frequencies[r["f"]] = r["n"]
    return frequencies, rows


@dataclass
class Model:
    used: np.ndarray  # features of the sample
    idf: np.ndarray
    basis: np.ndarray
    vectors: np.ndarray  # labelled documents in the latent space
    labels: np.ndarray

    def project(self, rows: np.ndarray) -> np.ndarray:
        tfidf = np.log1p(rows[:, self.used]) * self.idf
        return _unit(_unit(tfidf) @ self.basis)

    def score(self, rows: np.ndarray) -> np.ndarray:
        if not len(self.labels):
            return np.full(len(rows), 0.5)
        cosine = self.project(rows) @ self.vectors.T
        k = min(NEIGHBOURS, len(self.labels))
        near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
        weight = np.clip(np.take_along_axis(cosine, near, axis=1), 0, 1) ** POWER
        total = weight.sum(axis=1)
        vote = (weight * self.labels[near]).sum(axis=1) / np.where(total > 0, total, 1)
        return np.clip(np.where(total > 0, vote, self.labels.mean()), 0.0, 1.0)


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(norm > 0, norm, 1)


def fit(sample: DataFrame, frequencies: np.ndarray, rows: int) -> Model:
    """Fits the latent space on a bounded sample with `label` and `text`."""

    def run(batches):
        for b in batches:
            for part, texts in text_groups(b, "text"):
                made = [counts(t or "") for t in texts]
                used = [np.flatnonzero(c) for c in made]
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), part.column("label"),
                     pa.array([u.tolist() for u in used], pa.list_(pa.int64())),
                     pa.array([c[u].tolist() for c, u in zip(made, used)], pa.list_(pa.int64()))],
                    names=["id", "label", "f", "c"],
                )

    got = sample.mapInArrow(run, "id long, label int, f array<long>, c array<long>").collect()
    got.sort(key=lambda r: (r["id"], r["f"], r["c"]))
    labels = np.array([r["label"] for r in got], np.float64)
    table = np.zeros((len(got), FEATURES), np.float32)
    for i, r in enumerate(got):
        table[i, r["f"]] = r["c"]
    used = np.flatnonzero(table.any(axis=0)) if len(got) else np.zeros(0, np.int64)
    idf = np.log((1 + rows) / (1 + frequencies[used])) + 1
    tfidf = _unit(np.log1p(table[:, used]) * idf)
    # Right singular vectors from the small matrix of features.
    _, vectors = np.linalg.eigh(tfidf.T @ tfidf)
    basis = vectors[:, ::-1][:, :DIMENSIONS]
    return Model(used, idf, basis, _unit(tfidf @ basis), labels)


def score_quality(docs: DataFrame, labels: DataFrame, learn: Column, label: str = "quality",
                  sample_rows: int = SAMPLE_ROWS, id_column: str = "doc_id",
                  text_column: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` (the id by default) with `score` from 0 to 1.

    `learn` tells the rows of `labels` that may be learnt from.
    """
    frequencies, rows = document_frequencies(docs, text_column)
    sample = training_sample(labels, docs, label, learn, sample_rows, id_column, text_column)
    model = docs.sparkSession.sparkContext.broadcast(fit(sample, frequencies, rows))
    keep = [id_column] if keep is None else keep
    place = keep.index(text_column) if text_column in keep else len(keep)
    names = [f"c{i}" for i in range(len(keep))]
    columns = [F.col(f"`{c}`").alias(n) for c, n in zip(keep, names)]
    if place == len(keep):
        columns.append(F.col(text_column).alias(f"c{place}"))
    given = docs.select(*columns)
    out = T.StructType([*(given.schema[n] for n in names), T.StructField("score", T.DoubleType())])

    def run(batches):
        for b in batches:
            for part, texts in text_groups(b, f"c{place}"):
                scores = []
                for at in range(0, len(texts), BLOCK):
                    made = np.stack([counts(t or "") for t in texts[at : at + BLOCK]])
                    scores.append(model.value.score(made))
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(n) for n in names), pa.array(np.concatenate(scores))],
                    names=[*names, "score"],
                )

    scored = given.mapInArrow(run, out)
    return scored.select(*[F.col(n).alias(c) for c, n in zip(keep, names)], F.col("score").alias("score"))


def drop_low_quality(docs: DataFrame, labels: DataFrame, learn: Column, least: float = 0.5,
                     id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The documents with a score of at least `least`; all columns stay as they are."""
    plain, names = numbered(docs)
    scored = score_quality(
        plain, labels, learn,
        id_column=names[id_column], text_column=names[text_column], keep=plain.columns,
    )
    return renamed(scored.where(F.col("score") >= least), names)
