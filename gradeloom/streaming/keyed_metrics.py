"""Run metrics with keyed state: rows delivered twice count once, late rows are left out, idle steps are closed.

The log may deliver a row again and out of order. Each (step, source) keeps the (uid, sample)
pairs it has seen and its sums in a state store. An event-time watermark bounds that state: rows
behind it are late and take no part, and a step that it has passed by is reported as closed and forgotten.
A key is dealt to `parts` states by a hash of the row, so that a step with much of the log
is not one task; the parts' sums are added when they are read.

Pairs are kept in buckets by their hash, and a batch asks for each bucket once, not for each row: a call to the
store costs far more than a row. Buckets double as pairs come in, so reading one does not grow with the step.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from gradeloom.session import scratch_path
from gradeloom.streaming.run_metrics import latest, run_available

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
KEYS = ["step", "data_source", "part", "opened"]
SUMS = ["n", "correct", "tokens"]
OUT = "step string, data_source string, part int, opened long, n long, correct long, tokens long, closed boolean"
# Pairs a bucket holds before the buckets are doubled, give or take chance.
BUCKET = 256


class StepState(StatefulProcessor):
    """Sums of one (step, source, part) over its distinct rows."""

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getMapState("seen", "bucket long", "pairs string")
        self.sums = handle.getValueState(
            "sums", "n long, correct long, tokens long, opened long, last long, timer long, bits int")

    def _pairs(self, bucket: int) -> tuple[list, list, list]:
        held = self.seen.getValue((bucket,))
        return json.loads(held[0]) if held else ([], [], [])

    def _put(self, bucket: int, pairs: tuple) -> None:
        self.seen.updateValue((bucket,), (json.dumps(pairs),))

    def _double(self, bits: int) -> None:
        """Twice as many buckets: pairs whose hash has the next bit set move up."""
        for bucket in range(1 << bits):
            pairs = list(zip(*self._pairs(bucket)))
            moved = [p for p in pairs if p[2] >> bits & 1]
            if moved:
                self._put(bucket, tuple(zip(*[p for p in pairs if not p[2] >> bits & 1])) or ([], [], []))
                self._put(bucket + (1 << bits), tuple(zip(*moved)))

    def _unseen(self, batch: pd.DataFrame, bits: int, asks: bool) -> np.ndarray:
        """Which rows have pairs that the buckets lack; those are put there. `asks` tells if there are any buckets yet."""
        uids = [None if u is None or u != u else u for u in batch["uid"]]
        samples, hashes = batch["sample"].astype(int).tolist(), batch["hash"].to_numpy()
        bucket = hashes & ((1 << bits) - 1)
        order = np.argsort(bucket, kind="stable")
        new = np.zeros(len(batch), bool)
        for rows in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1):
            at = int(bucket[rows[0]])
            held = self._pairs(at) if asks else ([], [], [])
            known = set(zip(held[0], held[1]))
            fresh = [i for i in rows.tolist() if (uids[i], samples[i]) not in known]
            if fresh:
                new[fresh] = True
                self._put(at, (
                    [*held[0], *(uids[i] for i in fresh)], [*held[1], *(samples[i] for i in fresh)],
                    [*held[2], *hashes[fresh].tolist()]))
        return new

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = self.sums.get() if self.sums.exists() else None
        n, correct, tokens, opened, last, timer, bits = known or (0, 0, 0, None, -1, -1, 0)
        for batch in rows:
            batch = batch.drop_duplicates(["uid", "sample"])
            if batch.empty:
                continue
            while BUCKET << bits < n + len(batch):
                if n:
                    self._double(bits)
                bits += 1
            new = self._unseen(batch, bits, n > 0)
            batch = batch[new]
            n += len(batch)
            correct += int((batch["reward"] == 1).sum())
            tokens += int(batch["n_tokens"].sum())
            if len(batch):
                at = batch["at_ms"]
                last = max(last, int(at.max()))
                opened = int(at.min()) if opened is None else opened
        if n:
            if timer >= 0 and timer != last + self.idle_ms:
                self.handle.deleteTimer(timer)
            if timer != last + self.idle_ms:
                timer = last + self.idle_ms
                self.handle.registerTimer(timer)
            self.sums.update((n, correct, tokens, opened, last, timer, bits))
            yield self._row(key, n, correct, tokens, opened, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        n, correct, tokens, opened = self.sums.get()[:4]
        self.sums.clear()
        self.seen.clear()
        yield self._row(key, n, correct, tokens, opened, True)

    @staticmethod
    def _row(key, n, correct, tokens, opened, closed) -> pd.DataFrame:
        return pd.DataFrame({
            "step": [key[0]], "data_source": [key[1]], "part": [key[2]], "opened": [opened], "n": [n],
            "correct": [correct], "tokens": [tokens], "closed": [closed]})

    def close(self) -> None:
        pass


def keyed_step_metrics(
    log: DataFrame, time: str, lateness: str = "10 minutes", idle_seconds: int = 0, parts: int = 8,
) -> DataFrame:
    """Changed sums per step, source and part of a rollout stream (`step`, `data_source`, `uid`, `sample`, `reward`, `n_tokens`).

    `lateness` bounds how far behind the newest row another may come; a step is closed once the
    watermark is `idle_seconds` past its last row. A step that gets rows again after that opens anew, and
    rows it had before would count again; both sums stay, told apart by `opened`.
    """
    part: Column = F.pmod(F.xxhash64("uid", "sample"), F.lit(parts)).cast("int")
    # What buckets go by: the upper half of a hash, since parts go by the rest.
    upper: Column = F.shiftrightunsigned(F.xxhash64(F.col("uid").cast("string"), F.col("sample").cast("long")), 32)
    log = log.withColumn(time, F.col(time).cast("timestamp"))
    rows = log.withWatermark(time, lateness).select(
        F.col("step").cast("string").alias("step"), F.col("data_source").cast("string").alias("data_source"),
        part.alias("part"), F.col("uid").cast("string").alias("uid"), F.col("sample").cast("long").alias("sample"),
        upper.alias("hash"), F.col("reward").cast("double").alias("reward"), F.col("n_tokens").cast("long").alias("n_tokens"),
        F.unix_millis(time).alias("at_ms"), F.col(time).alias("at"))
    return rows.groupBy("step", "data_source", "part").transformWithStateInPandas(
        statefulProcessor=StepState(idle_seconds * 1000), outputStructType=OUT, outputMode="Update", timeMode="EventTime")


def with_state_store(spark: SparkSession) -> None:
    """The store that keyed state needs."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)


def step_totals(spark: SparkSession, path: str) -> DataFrame:
    """The newest sums of all parts, added up; `closed` where every part is."""
    return latest(spark, path, KEYS).groupBy("step", "data_source").agg(
        *[F.sum(c).alias(c) for c in SUMS], F.bool_and("closed").alias("closed"))


def stream_keyed_metrics(spark: SparkSession, log: DataFrame, time: str, **settings) -> DataFrame:
    """Step totals of everything the log holds, by way of keyed state."""
    with_state_store(spark)
    path, checkpoint = scratch_path(spark, "keyed-metrics"), scratch_path(spark, "keyed-state")
    run_available(keyed_step_metrics(log, time, **settings), "update", path, checkpoint)
    return step_totals(spark, path)
