"""Approximate nearest neighbours on shifted space-filling curves (operator 7).

Each curve turns the vectors (a random rotation), projects them on a few axes, shifts the
grid, and numbers its cells along a Hilbert curve. Curve keys are cut into ranges with about
equal rows, whose bounds are quantiles of a bounded sample; Spark shuffles by range. A query
visits the ranges in its window on every curve, its candidates are compared in blocks on the
original vectors, and the nearest of all windows and curves are merged.

The window is a share of the curve, fitted on the sample: the smallest share that finds
`TARGET` of the true neighbours there, but at least `LEAST_WINDOW` rows. Vectors without
structure (as random ones) need wide windows, clustered ones narrow ones.

Every row is indexed; the sample only places bounds and windows. At most `SAMPLE_ROWS`
vectors (smallest hash of the id) reach the driver. A range with more than `PART_ROWS` rows,
such as one that a single vector fills, is dealt out by hash of the id; a query meets all
its parts.

Vectors that are null, zero, of another length than most in the sample, or that hold null or
non-finite components take no part; rows with a null id neither. Repeated rows of one id
count once. Distances are sums of squares of differences in double precision; ties go to the
smaller id. No rows in, no rows out.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradeloom.llm.batches import written

CURVES = 16
AXES, BITS = 12, 4
SEED = 42
SAMPLE_ROWS = 4_096
SAMPLE_QUERIES = 64
TARGET = 0.97
LEAST_WINDOW = 4_096
# Ranges of a curve.
RANGES = 128
# Rows that one task compares with queries at a time.
PART_ROWS = 8_192
SHARES = (0.01, 0.02, 0.03, 0.05, 0.08, 0.11, 0.15, 0.2, 0.3, 0.5, 1.0)


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places of grid cells along a Hilbert curve, by Skilling's transform of the axes."""
    x = cells.astype(np.int64).copy()
    axes = x.shape[1]
    for b in range(bits - 1, 0, -1):
        bit, low = 1 << b, (1 << b) - 1
        for i in range(axes):
            on = (x[:, i] & bit) != 0
            swap = np.where(on, 0, (x[:, 0] ^ x[:, i]) & low)
            x[:, 0] ^= np.where(on, low, swap)
            x[:, i] ^= swap
    for i in range(1, axes):
        x[:, i] ^= x[:, i - 1]
    flip = np.zeros(len(x), np.int64)
    for b in range(bits - 1, 0, -1):
        flip ^= np.where(x[:, -1] & (1 << b), (1 << b) - 1, 0)
    x ^= flip[:, None]
    keys = np.zeros(len(x), np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(axes):
            keys = keys << 1 | (x[:, i] >> b & 1)
    return keys


class Curves:
    """Rotations, grids, range bounds and the window, fitted on a sample."""

    def __init__(self, sample: np.ndarray, rows: int):
        draw = np.random.default_rng(SEED)
        dim = sample.shape[1]
        axes = min(AXES, dim)
        self.mean = sample.mean(axis=0)
        centred = sample - self.mean
        self.bases, self.low, self.width, self.bounds = [], [], [], []
        places = []
        for _ in range(CURVES):
            basis = np.linalg.qr(draw.normal(size=(dim, dim)))[0][:, :axes]
            flat = centred @ basis
            spread = np.where(flat.std(axis=0) > 0, flat.std(axis=0), 1.0)
            # Six standard deviations and half a cell of shift.
            width = 6 * spread / (1 << BITS)
            low = -3 * spread - width * draw.random(axes)
            self.bases.append(basis), self.low.append(low), self.width.append(width)
            keys = self.keys(sample, len(self.bases) - 1)
            at = np.linspace(0, len(keys), RANGES + 1)[1:-1].astype(int)
            self.bounds.append(np.sort(keys)[np.minimum(at, len(keys) - 1)])
            places.append(np.argsort(np.argsort(keys, kind="stable"), kind="stable"))
        share = max(self._fitted(sample, np.array(places)), min(1.0, LEAST_WINDOW / max(rows, 1)))
        # Ranges to either side of the query's own.
        self.reach = RANGES if share >= 1 else math.ceil(share * RANGES / 2)

    @staticmethod
    def _fitted(sample: np.ndarray, places: np.ndarray) -> float:
        k = min(10, len(sample) - 1)
        if k < 1:
            return 1.0
        step = max(1, len(sample) // SAMPLE_QUERIES)
        found = dict.fromkeys(SHARES, 0.0)
        asked = range(0, len(sample), step)
        for q in asked:
            far = ((sample - sample[q]) ** 2).sum(axis=1)
            far[q] = np.inf
            true = np.argpartition(far, k - 1)[:k]
            gap = np.abs(places[:, true] - places[:, q][:, None]).min(axis=0)
            for s in SHARES:
                found[s] += (gap <= s * len(sample) / 2).mean() / len(asked)
        return min((s for s in SHARES if found[s] >= TARGET), default=1.0)

    def keys(self, vectors: np.ndarray, curve: int) -> np.ndarray:
        flat = (vectors - self.mean) @ self.bases[curve]
        cells = np.floor((flat - self.low[curve]) / self.width[curve])
        return hilbert_keys(np.clip(cells, 0, (1 << BITS) - 1), BITS)

    def ranges(self, vectors: np.ndarray, curve: int) -> np.ndarray:
        return np.searchsorted(self.bounds[curve], self.keys(vectors, curve), side="right")


def _matrix(raw: list[bytes]) -> np.ndarray:
    joined = np.frombuffer(b"".join(raw), dtype="<f8")
    return joined.reshape(len(raw), -1)


def clean_vectors(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """`id` and `v` (array of doubles) of the vectors that take part, one row per id."""
    v = F.col(vector_column).cast("array<double>")
    rows = vectors.select(F.col(id_column).cast("long").alias("id"), v.alias("v"))
    wrong = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    whole = rows.where("id is not null and v is not null and size(v) > 0").where(
        ~F.exists("v", wrong) & F.exists("v", lambda x: x != 0)
    )
    return whole.groupBy("id").agg(F.min("v").alias("v"))


def nearest(vectors: DataFrame, is_query: Column, k: int = 10, id_column: str = "vec_id",
            vector_column: str = "embedding") -> DataFrame:
    """`query_id`, `rank` from 1, the neighbour's id and `score`, its distance.

    `is_query` is a condition on the id column.
    """
    spark = vectors.sparkSession
    kept = clean_vectors(vectors, id_column, vector_column)
    sample = kept.orderBy(F.xxhash64("id"), "id").limit(SAMPLE_ROWS).collect()
    result = f"query_id long, rank int, {id_column} long, score double"
    if not sample:
        return spark.createDataFrame([], result)
    dim = Counter(len(r["v"]) for r in sample).most_common(1)[0][0]
    rows = kept.where(F.size("v") == dim)
    got = np.array([r["v"] for r in sample if len(r["v"]) == dim])
    fitted = spark.sparkContext.broadcast(Curves(got, rows.count()))

    def on_curves(batches):
        curves = fitted.value
        for b in batches:
            for at in range(0, b.num_rows, 2_000):
                part = b.slice(at, 2_000)
                flat = part.column("v").flatten().to_numpy(zero_copy_only=False)
                m = flat.reshape(part.num_rows, dim)
                packed = pa.array([x.astype("<f8").tobytes() for x in m], pa.binary())
                for c in range(CURVES):
                    yield pa.RecordBatch.from_arrays(
                        [part.column("id"), part.column("asks"),
                         pa.array(np.full(len(m), c, np.int32)),
                         pa.array(curves.ranges(m, c).astype(np.int32)), packed],
                        names=["id", "asks", "curve", "range", "v"],
                    )

    asks = rows.withColumn(id_column, F.col("id")).select("id", "v", is_query.alias("asks"))
    indexed = written(
        asks.mapInArrow(on_curves, "id long, asks boolean, curve int, range int, v binary"), "curves"
    )
    # At most CURVES * RANGES rows.
    sizes = indexed.groupBy("curve", "range").agg(
        F.ceil(F.count(F.lit(1)) / PART_ROWS).cast("int").alias("parts")
    )
    reach = fitted.value.reach
    candidates = indexed.join(F.broadcast(sizes), ["curve", "range"]).select(
        "curve", "range", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"), "id", "v"
    )
    windows = indexed.where("asks").select(
        "curve", "id", "v",
        F.explode(F.sequence(
            F.greatest(F.col("range") - reach, F.lit(0)),
            F.least(F.col("range") + reach, F.lit(RANGES - 1)),
        )).alias("range"),
    ).join(F.broadcast(sizes), ["curve", "range"]).select(
        F.col("curve").alias("q_curve"), F.col("range").alias("q_range"),
        F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("q_part"),
        F.col("id").alias("q_id"), F.col("v").alias("q_v"),
    )

    def meet(data: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(data) or not len(queries):
            return pd.DataFrame({"query_id": [], "found": [], "score": []})
        ids, m = data["id"].to_numpy(), _matrix(data["v"].tolist())
        squares = (m * m).sum(axis=1)
        out = []
        for at in range(0, len(queries), 256):
            q_ids = queries["q_id"].to_numpy()[at : at + 256]
            q = _matrix(queries["q_v"].tolist()[at : at + 256])
            near = squares[None, :] - 2 * (q @ m.T)
            near[q_ids[:, None] == ids[None, :]] = np.inf
            take = min(k, len(ids)) - 1
            cut = np.partition(near, take, axis=1)[:, take]
            slack = 1e-9 * (1 + (q * q).sum(axis=1) + squares.max())
            for i, q_id in enumerate(q_ids):
                hit = np.flatnonzero(near[i] <= cut[i] + slack[i])
                hit = hit[np.isfinite(near[i][hit])]
                score = np.sqrt(((m[hit] - q[i]) ** 2).sum(axis=1))
                best = np.lexsort((ids[hit], score))[:k]
                out.append((np.full(len(best), q_id), ids[hit][best], score[best]))
        if not out:
            return pd.DataFrame({"query_id": [], "found": [], "score": []})
        return pd.DataFrame(dict(zip(("query_id", "found", "score"), map(np.concatenate, zip(*out)))))

    met = candidates.groupBy("curve", "range", "part").cogroup(
        windows.groupBy("q_curve", "q_range", "q_part")
    ).applyInPandas(meet, "query_id long, found long, score double")
    # Each candidate once per query; a query has at most k rows per part that it visits.
    once = met.groupBy("query_id", "found").agg(F.min("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy("score", "found")
    return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", "rank", F.col("found").alias(id_column), "score"
    )
