"""Sources, sinks and streams: tables written to the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from gradeloom.operators import curation as C
from gradeloom.operators import evaluation as V
from gradeloom.plans.base import QuerySet, table
from gradeloom.plans.rollout_queries import rounded
from gradeloom.session import scratch_path
from gradeloom.sources import problems as P
from gradeloom.sources import results as R
from gradeloom.streaming import keyed_metrics as K
from gradeloom.streaming import run_metrics as M

QUERIES = QuerySet()


def _problems(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        "doc_id", "source", F.col("text").alias("problem"), F.col("lang").alias("solution"),
        F.col("n_chars").cast("string").alias("answer"),
    )


@QUERIES.add(
    "read_problem_json",
    "SELECT md5(text) AS problem, lang AS solution, CAST(n_chars AS VARCHAR) AS answer, source AS dataset FROM documents",
)
def read_problem_json(spark, sf_dir):
    root = scratch_path(spark, "problem_sets")
    rows = _problems(spark, sf_dir).withColumnRenamed("source", "dataset").drop("doc_id")
    R.write_json_arrays(rows, f"{root}/train/math/documents.json")
    found = P.read_problem_json(spark, root, "train", "math", "Documents")
    return found.select(F.md5("problem").alias("problem"), "solution", "answer", "dataset")


@QUERIES.add("read_jsonl", "SELECT doc_id, md5(text) AS problem, lang AS solution FROM documents")
def read_jsonl(spark, sf_dir):
    path = scratch_path(spark, "jsonl")
    R.write_json_records(_problems(spark, sf_dir), path)
    rows = P.read_jsonl(spark, path, "doc_id bigint, problem string, solution string")
    return rows.withColumn("problem", F.md5("problem"))


@QUERIES.add(
    "read_examples",
    """SELECT doc_id AS id, md5(text) AS text, lang FROM documents
       UNION ALL SELECT item_id, md5(text), NULL FROM benchmark""",
)
def read_examples(spark, sf_dir):
    first, second = scratch_path(spark, "examples"), scratch_path(spark, "examples")
    table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", "lang").write.parquet(first)
    table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text").write.json(second)
    rows = P.read_examples(spark, {first: "parquet", second: "json"})
    return rows.withColumn("text", F.md5("text"))


@QUERIES.add(
    "read_mixed_examples",
    """SELECT doc_id AS id, md5(text) AS text, lang FROM documents
       UNION ALL SELECT item_id, md5(text), NULL FROM benchmark
       UNION ALL SELECT conv_id, md5(text), role FROM conversations""",
)
def read_mixed_examples(spark, sf_dir):
    """Parquet, JSON lines and JSON arrays in one folder."""
    folder = scratch_path(spark, "mixed")
    conversations = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("id"), "text", F.col("role").alias("lang"))
    table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", "lang").write.parquet(f"{folder}/a")
    table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text").write.json(f"{folder}/b")
    R.write_json_arrays(conversations, f"{folder}/c")
    rows = P.read_mixed_examples(spark, [folder], "id bigint, text string, lang string")
    return rows.withColumn("text", F.md5("text"))


@QUERIES.add(
    "write_examples",
    """SELECT source AS data_source, CASE WHEN lang = 'fr' THEN 'test' ELSE 'train' END AS split, doc_id AS idx, md5(text) AS content
       FROM documents""",
)
def write_examples(spark, sf_dir):
    path = scratch_path(spark, "rl")
    rows = _problems(spark, sf_dir)
    for split, part in (("test", "solution = 'fr'"), ("train", "solution <> 'fr'")):
        examples = C.build_rl_examples(rows.where(part), split, F.col("doc_id"), F.col("source"), system=None)
        R.write_examples(examples, f"{path}/{split}")
    both = spark.read.parquet(f"{path}/test").unionByName(spark.read.parquet(f"{path}/train"))
    return both.select(
        "data_source", "split", F.col("extra_info.index").alias("idx"),
        F.md5(F.col("prompt")[0]["content"]).alias("content"),
    )


@QUERIES.add("write_records", "SELECT doc_id, source, n_chars FROM documents")
def write_records(spark, sf_dir):
    """JSON records, then the same rows as CSV with a header."""
    as_json, as_csv = scratch_path(spark, "records"), scratch_path(spark, "records")
    schema = "doc_id bigint, source string, n_chars bigint"
    R.write_json_records(table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars"), as_json)
    R.write_csv_records(P.read_jsonl(spark, as_json, schema), as_csv)
    return spark.read.schema(schema).option("header", True).csv(as_csv)


@QUERIES.add(
    "append_pass_csv",
    """WITH p AS (SELECT d.source, max(l.quality) AS best, avg(l.quality) AS m, count(*) AS n FROM labels l JOIN documents d ON d.doc_id = l.doc_id GROUP BY 1, d.lang)
       SELECT 'a' AS model, round(sum(m * n) / sum(n), 6) AS pass_at_1, round(avg(CAST(best = 1 AS INTEGER)), 6) AS pass_at_n FROM p
       UNION ALL SELECT 'b', round(sum(m * n) / sum(n), 6), round(avg(CAST(best = 1 AS INTEGER)), 6) FROM p""",
)
def append_pass_csv(spark, sf_dir):
    path = scratch_path(spark, "pass")
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat_ws("/", "source", "lang").alias("uid"))
    scored = table(spark, sf_dir, "labels").join(d, "doc_id").select("uid", F.col("quality").cast("double").alias("reward"))
    row = rounded(V.pass_at_k(scored)).select("pass_at_1", "pass_at_n")
    for model in ("a", "b"):
        R.append_pass_csv(row.select(F.lit(model).alias("model"), "*"), path)
    schema = "model string, pass_at_1 double, pass_at_n double"
    return R.read_pass_csv(spark, path, schema)


@QUERIES.add(
    "write_score_matrix",
    """SELECT doc_id, len(string_split(text, ' ')) AS n, len(list_filter(string_split(text, ' '), lambda w: length(w) > 6)) AS ones FROM documents""",
)
def write_score_matrix(spark, sf_dir):
    path = scratch_path(spark, "scores")
    scores = F.transform(F.split("text", " "), lambda w: F.length(w) > 6)
    R.write_score_matrix(
        R.score_matrix(table(spark, sf_dir, "documents").select("doc_id", scores.alias("scores"))), path
    )
    back = P.read_jsonl(spark, path, "doc_id bigint, scores array<double>")
    total = F.aggregate("scores", F.lit(0.0), lambda a, s: a + s)
    return back.select("doc_id", F.size("scores").cast("bigint").alias("n"), total.cast("bigint").alias("ones"))


@QUERIES.add("reuse_if_exists", "SELECT source, count(*) AS n FROM documents GROUP BY 1")
def reuse_if_exists(spark, sf_dir):
    path = scratch_path(spark, "reuse")

    def build():
        return table(spark, sf_dir, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"))

    def never():
        raise AssertionError("the table exists already")

    R.reuse_if_exists(spark, path, build)
    return R.reuse_if_exists(spark, path, never)


# --- streams over the event log ------------------------------------------------


def _log(spark, sf_dir):
    schema = table(spark, sf_dir, "events").schema
    events = M.read_rollout_log(spark, sf_dir, schema, "events.parquet")
    return events.select(
        F.to_date("ts").cast("string").alias("step"),
        F.col("event_type").alias("data_source"),
        F.when(F.col("user_id") % 3 == 0, 1.0).otherwise(0.0).alias("reward"),
        F.floor("value").cast("bigint").alias("n_tokens"),
    )


@QUERIES.add(
    "stream_step_metrics",
    """SELECT CAST(ts AS DATE)::VARCHAR AS step, event_type AS data_source, count(*) AS n, CAST(sum(floor(value)) AS BIGINT) AS tokens,
       round(avg(CAST(user_id % 3 = 0 AS INTEGER)), 6) AS accuracy, round(avg(floor(value)), 6) AS mean_length FROM events GROUP BY 1, 2""",
)
def stream_step_metrics(spark, sf_dir):
    return rounded(M.stream_step_metrics(spark, _log(spark, sf_dir)))


@QUERIES.add(
    "stream_running_totals",
    "SELECT count(*) AS n, CAST(sum(floor(value)) AS BIGINT) AS total_tokens FROM events",
)
def stream_running_totals(spark, sf_dir):
    return M.stream_running_totals(spark, _log(spark, sf_dir))


@QUERIES.add(
    "stream_keyed_metrics",
    """SELECT CAST(ts AS DATE)::VARCHAR AS step, event_type AS data_source, count(*) AS n, CAST(sum(CAST(user_id % 3 = 0 AS INTEGER)) AS BIGINT) AS correct,
       CAST(sum(floor(value)) AS BIGINT) AS tokens FROM events GROUP BY 1, 2""",
)
def stream_keyed_metrics(spark, sf_dir):
    """The event log twice over, as a source that delivers again gives it; each event counts once."""
    events = table(spark, sf_dir, "events")
    path = scratch_path(spark, "event-log")
    events.unionByName(events).write.parquet(path)
    log = M.read_rollout_log(spark, path, events.schema).select(
        F.to_date("ts").cast("string").alias("step"), F.col("event_type").alias("data_source"),
        F.col("event_id").alias("uid"), F.lit(0).alias("sample"),
        F.when(F.col("user_id") % 3 == 0, 1.0).otherwise(0.0).alias("reward"),
        F.floor("value").cast("bigint").alias("n_tokens"), "ts")
    return K.stream_keyed_metrics(spark, log, "ts", lateness="10 days").drop("closed")
