"""A scorer that hangs scores 0 within its limit, whatever it does about it."""

import os
import time

import pytest
from pyspark.sql import functions as F

from gradeloom.operators.deadlines import Guarded
from gradeloom.operators.grading import score_or_zero


def slow(kind):
    if kind == "sleeps":
        time.sleep(60)
    if kind == "loops":
        while True:
            pass
    if kind == "ignores":
        while True:
            try:
                time.sleep(60)
            except Exception:
                pass
    if kind == "dies":
        os._exit(3)
    if kind == "fails":
        raise ValueError
    return None if kind == "nothing" else 1.5


@pytest.mark.parametrize("kind", ["sleeps", "loops", "ignores", "dies", "fails", "nothing"])
def test_one_bad_call(kind):
    call = Guarded(slow, 0.3)
    start = time.time()
    assert [call(k) for k in ("fine", kind, "fine")] == [1.5, 0.0, 1.5]
    assert time.time() - start < 5
    call.close()


def test_rows_behind_a_hanging_one_are_scored(spark):
    kinds = ["fine", "sleeps", "fine", "ignores", "fine", "dies", None]
    rows = spark.createDataFrame(list(enumerate(kinds)), "id int, kind string").coalesce(1)
    start = time.time()
    got = score_or_zero(rows, slow, ["kind"], seconds=0.5).orderBy("id").collect()
    assert [r["score"] for r in got] == [1.5, 0.0, 1.5, 0.0, 1.5, 0.0, 1.5]
    assert time.time() - start < 30


def test_no_deadline_as_before(spark):
    rows = spark.range(10).withColumn("kind", F.when(F.col("id") < 5, "fails").otherwise("fine"))
    assert score_or_zero(rows, slow, ["kind"]).agg(F.sum("score")).first()[0] == 7.5
    given = spark.range(3).select("id", F.lit(2.0).alias("a"), F.lit(4.0).alias("b"))
    assert score_or_zero(given, lambda a, b: a / b, ["a", "b"], seconds=5).agg(F.sum("score")).first()[0] == 1.5
