"""Work on a row grows with the row, and files are written piece by piece."""

import json
import time

from pyspark.sql import functions as F

from gradeloom.functions import sequences
from gradeloom.operators import trees
from gradeloom.sources import results


def test_position_ids_of_a_long_mask(spark):
    """A search and a sum of the mask at each place would be billions of steps."""
    n = 40_000
    mask = F.concat(F.array_repeat(F.lit(0), 5), F.array_repeat(F.lit(1), n))
    start = time.time()
    got = spark.range(1).select(sequences.position_ids(mask).alias("p")).first()["p"]
    assert got == [0] * 5 + list(range(n)) and time.time() - start < 20
    none = spark.createDataFrame([(None,), ([],), ([0, 0],)], "m array<int>").select(sequences.position_ids(F.col("m")).alias("p"))
    assert [r["p"] for r in none.collect()] == [[], [], [0, 0]]


def test_segments_are_not_cut_to_be_counted(spark):
    """No filter over the segments, in which every segment would read the ids again."""
    rows = spark.range(3).select(
        F.col("id").alias("tree_id"), F.lit(0).alias("sample"),
        F.transform(F.split(F.repeat(F.lit("a bb "), 5), " "), F.length).alias("ids"), F.lit(1.0).alias("reward"))
    nodes = trees.responses_to_nodes(rows, 4, None, 9)
    plan = nodes._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Filter" in line and "slice(" in line]
    assert nodes.count() == 9


def test_json_arrays_piece_by_piece(spark, tmp_path, monkeypatch):
    """One array a file, whatever the pieces."""
    monkeypatch.setattr(results, "WRITTEN_ROWS", 2)
    rows = spark.range(7).select("id", F.lit('a "b"\né').alias("text")).coalesce(1)
    results.write_json_arrays(rows, f"{tmp_path}/a.json")
    files = [json.loads(p.read_text()) for p in (tmp_path / "a.json").glob("part-*")]
    assert files == [[{"id": i, "text": 'a "b"\né'} for i in range(7)]]
