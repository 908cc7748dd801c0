"""A stream must end where the batch query does, also when the log grows."""

from pyspark.sql import functions as F

from gradeloom.streaming import run_metrics as M


def log_rows(spark, start, stop):
    return spark.range(start, stop).select(
        (F.col("id") % 3).cast("string").alias("step"),
        (F.col("id") % 2).cast("string").alias("data_source"),
        (F.col("id") % 5 == 0).cast("double").alias("reward"),
        F.col("id").alias("n_tokens"),
    )


def test_two_runs_equal_one_batch(spark, tmp_path):
    log, out, state = (str(tmp_path / n) for n in ("log", "out", "state"))
    totals, totals_state = (str(tmp_path / n) for n in ("totals", "totals_state"))
    for start, stop in ((0, 50), (50, 120)):
        log_rows(spark, start, stop).coalesce(2).write.mode("append").parquet(log)
        stream = M.read_rollout_log(spark, log, log_rows(spark, 0, 1).schema, files_per_batch=1)
        M.run_available(M.step_metrics(stream), "update", out, state)
        M.run_available(M.running_totals(stream), "complete", totals, totals_state)
    got = M.with_means(M.latest(spark, out, ["step", "data_source"]))
    want = M.with_means(M.step_metrics(log_rows(spark, 0, 120)))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(got.columns).collect()))
    newest = spark.read.parquet(totals).orderBy(F.desc("batch")).first()
    assert (newest["n"], newest["total_tokens"]) == (120, sum(range(120)))
