"""Keyed state: replayed rows count once, late rows never, idle steps are closed."""

import json

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from gradeloom.streaming import keyed_metrics as K
from gradeloom.streaming import run_metrics as M

SCHEMA = "step string, data_source string, uid string, sample long, reward double, n_tokens long, ts timestamp"


def rows(spark, step, minutes, uids, tokens=10):
    given = [(step, "s", f"u{u}", u % 2, float(u % 2), tokens, m) for m, u in zip(minutes, uids)]
    frame = spark.createDataFrame(given, "step string, data_source string, uid string, sample long, reward double, n_tokens long, m int")
    return frame.withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("m") * 60)).drop("m")


def test_replay_late_rows_and_closing(spark, tmp_path):
    K.with_state_store(spark)
    log, out, state = (str(tmp_path / n) for n in ("log", "out", "state"))

    def deliver(frame):
        frame.coalesce(1).write.mode("append").parquet(log)
        stream = M.read_rollout_log(spark, log, frame.schema)
        M.run_available(K.keyed_step_metrics(stream, "ts", "10 minutes", 0, 2), "update", out, state)
        return {r["step"]: (r["n"], r["correct"], r["tokens"], r["closed"]) for r in K.step_totals(spark, out).collect()}

    first = rows(spark, "1", range(6), range(6))
    assert deliver(first)["1"] == (6, 3, 60, False)
    # The same batch again, with a pair twice in itself, and two new rows.
    assert deliver(first.unionByName(first).unionByName(rows(spark, "1", [7, 8], [6, 7])))["1"] == (8, 4, 80, False)
    # Another step, an hour on: the watermark moves past the first step.
    assert deliver(rows(spark, "2", [60], [0]))["2"] == (1, 0, 10, False)
    # A row an hour late is left out; the first step is closed with what it had.
    got = deliver(rows(spark, "1", [9], [99], tokens=1000).unionByName(rows(spark, "2", [61], [1])))
    assert got["1"] == (8, 4, 80, True)
    assert got["2"] == (2, 1, 20, False)


class Held:
    """A map or value state in memory that counts calls."""

    def __init__(self):
        self.map, self.calls = {}, 0

    def called(self, given):
        self.calls += 1
        return given

    def getValue(self, key):  # noqa: N802
        return self.called(self.map.get(key))

    def containsKey(self, key):  # noqa: N802
        return self.called(key in self.map)

    def updateValue(self, key, value):  # noqa: N802
        self.called(self.map.__setitem__(key, value))

    def exists(self):
        return () in self.map

    def get(self):
        return self.map[()]

    def update(self, value):
        self.map[()] = value


class Handle:
    def getMapState(self, name, key, value):  # noqa: N802
        self.seen = Held()
        return self.seen

    def getValueState(self, name, kind):  # noqa: N802
        self.sums = Held()
        return self.sums

    def registerTimer(self, at):  # noqa: N802
        pass

    deleteTimer = registerTimer


def test_store_is_asked_per_bucket_not_per_row():
    """60,000 pairs in batches of 10,000, delivered twice in another order: counted once, with few calls, in small buckets."""
    n, size = 60_000, 10_000
    draw = np.random.default_rng(3)
    pairs = pd.DataFrame({"uid": [f"u{i // 2}" for i in range(n)], "sample": np.arange(n) % 2})
    pairs.loc[:1, "uid"] = None
    pairs = pairs.assign(hash=draw.integers(0, 2**32, n), reward=np.arange(n) % 3 / 2, n_tokens=2, at_ms=1_000)
    log = pd.concat([pairs.iloc[draw.permutation(n)], pairs.iloc[draw.permutation(n)]])
    state, handle = K.StepState(0), Handle()
    state.init(handle)
    for start in range(0, len(log), 3 * size):  # three batches of a key at a time
        batches = (log.iloc[at:at + size] for at in range(start, start + 3 * size, size))
        (out,) = state.handleInputRows(("1", "s", 0), batches, None)
    assert (out["n"][0], out["correct"][0], out["tokens"][0]) == (n, n // 3, 2 * n)
    assert handle.seen.calls < len(log) / 10
    assert max(len(json.loads(v[0])[0]) for v in handle.seen.map.values()) < 2 * K.BUCKET
    # One row more asks for one bucket.
    before = handle.seen.calls
    one = pairs.iloc[:1].assign(uid="another")
    (out,) = state.handleInputRows(("1", "s", 0), iter([one]), None)
    assert out["n"][0] == n + 1 and handle.seen.calls - before <= 2
