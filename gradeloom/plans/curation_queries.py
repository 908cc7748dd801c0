"""Problem curation over `documents`, `labels`, `benchmark`, `part`, `events`, `conversations`."""

from __future__ import annotations

from pyspark.sql import functions as F

from gradeloom.functions import code_text, text
from gradeloom.operators import curation as C
from gradeloom.operators.skew import with_group_index
from gradeloom.plans.base import QuerySet, table

QUERIES = QuerySet()

SYSTEM = "Work through the task and state the result."
SUFFIX = " Think step by step."


def problems(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select(
        "doc_id", "source", "lang", "n_chars",
        F.col("text").alias("problem"),
        F.col("lang").alias("solution"),
        F.col("n_chars").cast("string").alias("answer"),
    )


@QUERIES.add(
    "build_rl_examples",
    f"""SELECT source AS data_source, 2 AS turns, md5(text || '{SUFFIX}') AS user_md5,
      '{SYSTEM}' AS system, 'math' AS ability, 'rule' AS style,
      CAST(n_chars AS VARCHAR) AS truth, 'train' AS split,
      row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS idx, lang AS cot
      FROM documents""",
)
def build_rl_examples(spark, sf_dir):
    rows = with_group_index(problems(spark, sf_dir), ["source"], [F.col("doc_id")], "idx")
    ex = C.build_rl_examples(rows, "train", F.col("idx"), F.col("source"), SYSTEM, SUFFIX)
    return ex.select(
        "data_source",
        F.size("prompt").alias("turns"),
        F.md5(text.user_turn(F.col("prompt"))).alias("user_md5"),
        F.col("prompt")[0]["content"].alias("system"),
        "ability",
        F.col("reward_model.style").alias("style"),
        F.col("reward_model.ground_truth")[0].alias("truth"),
        F.col("extra_info.split").alias("split"),
        F.col("extra_info.index").alias("idx"),
        F.col("extra_info.ground_truth_cot").alias("cot"),
    )


@QUERIES.add(
    "build_choice_examples",
    """SELECT p_partkey AS idx, md5(replace(p_type || ': ' || p_name || '. ' ||
      upper(substr(p_brand, 1, 1)) || lower(substr(p_brand, 2)) || ' ', '  ', ' ')) AS query_md5,
      p_size % 4 AS truth, p_name || '|' || p_brand || ' ' AS choices
      FROM part WHERE length(CAST(p_size % 4 AS VARCHAR)) > 0""",
)
def build_choice_examples(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    rows = p.select(
        "p_partkey",
        F.col("p_type").alias("activity_label"),
        F.concat("p_name", F.lit(" [title]")).alias("ctx_a"),
        F.concat("p_brand", F.lit("  [step]")).alias("ctx_b"),
        F.array(
            F.concat(F.lit(" [a]"), "p_name"), F.concat("p_brand", F.lit(" [b][c]"))
        ).alias("endings"),
        (F.col("p_size") % 4).cast("string").alias("label"),
    )
    kept = C.filter_labelled(rows, "label")
    ex = C.build_choice_examples(kept, "train", F.col("p_partkey"), "parts")
    return ex.select(
        F.col("extra_info.index").alias("idx"),
        F.md5(F.col("prompt")[0]["content"]).alias("query_md5"),
        F.col("reward_model.ground_truth").alias("truth"),
        F.array_join("reward_model.choices", "|").alias("choices"),
    )


@QUERIES.add(
    "row_index",
    "SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS idx FROM documents",
)
def row_index(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "source")
    return with_group_index(d, ["source"], [F.col("doc_id")], "idx")


@QUERIES.add(
    "rename_flatten",
    "SELECT doc_id AS id, text[1:10] AS head, n_chars AS size FROM documents",
)
def rename_flatten(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    nested = d.select("doc_id", F.array(F.struct("text", "n_chars")).alias("parts"), "lang")
    first = F.col("parts").getItem(0)
    flat = nested.withColumns(
        {"head": F.left(first.getField("text"), F.lit(10)), "size": first.getField("n_chars")}
    )
    return flat.withColumnsRenamed({"doc_id": "id"}).drop("parts", "lang")


@QUERIES.add("column_subset", "SELECT doc_id, lang, source, n_chars FROM documents")
def column_subset(spark, sf_dir):
    return table(spark, sf_dir, "documents").drop("text")


@QUERIES.add("filter_source", "SELECT doc_id, n_chars FROM documents WHERE source = 'src6'")
def filter_source(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return C.filter_source(d, "source", "src6").select("doc_id", "n_chars")


@QUERIES.add(
    "filter_quality_rules",
    """SELECT doc_id FROM documents WHERE lang IN ('en', 'fr') AND source <> 'src1'
       AND n_chars % 12 < 9 AND n_chars / 3000.0 < 0.9
       AND length(text) - length(replace(text, 'th', 'h')) >= 8""",
)
def filter_quality_rules(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(
        "doc_id",
        F.col("lang").alias("subset"),
        F.when(F.col("source") != "src1", "instruct").otherwise("other").alias("style"),
        (F.col("n_chars") % 12).alias("pass_count"),
        (F.col("n_chars") / 3000.0).alias("benchmark_similarity"),
        F.col("text").alias("test_code"),
    )
    return C.filter_quality_rules(rows, subsets=["en", "fr"], marker="th").select("doc_id")


@QUERIES.add(
    "filter_bad_ids",
    """SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (3, 5, 8)
       AND NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = documents.doc_id AND l.toxic = 1)""",
)
def filter_bad_ids(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "lang")
    toxic = table(spark, sf_dir, "labels").where("toxic = 1")
    return C.filter_bad_ids(C.filter_bad_ids(d, "doc_id", [3, 5, 8]), "doc_id", toxic)


@QUERIES.add(
    "exclude_test_ids",
    "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT item_id FROM benchmark)",
)
def exclude_test_ids(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "source")
    test = table(spark, sf_dir, "benchmark").withColumnRenamed("item_id", "doc_id")
    return C.exclude_test_ids(d, test, "doc_id")


@QUERIES.add(
    "filter_difficulty_range",
    "SELECT p_partkey, p_size FROM part WHERE p_size BETWEEN 2 AND 5 OR p_size >= 10",
)
def filter_difficulty_range(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    return C.filter_difficulty_range(p, "p_size")


@QUERIES.add(
    "filter_min_tests",
    """SELECT p_partkey, len(string_split(p_name, ' ')) AS tests
       FROM part WHERE len(string_split(p_name, ' ')) > 1""",
)
def filter_min_tests(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.split("p_name", " ").alias("t"))
    return C.filter_min_tests(p, "t", 1).select("p_partkey", F.size("t").cast("bigint").alias("tests"))


@QUERIES.add(
    "filter_date_range",
    """SELECT o_orderkey, 'test' AS part FROM orders
         WHERE o_orderdate >= TIMESTAMP '1997-08-01' AND o_orderdate < TIMESTAMP '1998-02-01'
       UNION ALL SELECT o_orderkey, 'train' FROM orders
         WHERE o_orderdate >= TIMESTAMP '1996-05-01' AND o_orderdate < TIMESTAMP '1997-08-01'""",
)
def filter_date_range(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    iso = o.withColumn("day", F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"))
    test = C.filter_date_range(iso, "day", "1997-08-01", "1998-02-01")
    train = C.filter_date_range(o, "o_orderdate", "1996-05-01", "1997-08-01")
    return C.union_datasets({"test": test, "train": train}, "part").select("o_orderkey", "part")


@QUERIES.add(
    "filter_prompt_length",
    """SELECT doc_id, len(string_split(text, ' ')) AS words FROM documents
       WHERE len(string_split(text, ' ')) <= 256""",
)
def filter_prompt_length(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    words = d.select("doc_id", C.word_count("text").cast("bigint").alias("words"))
    return C.filter_prompt_length(words, F.col("words"), 256)


@QUERIES.add(
    "filter_labelled",
    """SELECT d.doc_id, CAST(l.quality AS VARCHAR) AS label FROM documents d
       JOIN labels l ON l.doc_id = d.doc_id WHERE l.quality IS NOT NULL""",
)
def filter_labelled(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id")
    rows = d.join(table(spark, sf_dir, "labels"), "doc_id", "left").select(
        "doc_id", F.coalesce(F.col("quality").cast("string"), F.lit("")).alias("label")
    )
    return C.filter_labelled(rows, "label")


@QUERIES.add(
    "filter_contains",
    """SELECT page_id, 'kept' AS part FROM pages WHERE NOT contains(url, 'page=2')
       UNION ALL SELECT page_id, 'dropped' FROM pages WHERE contains(url, 'page=2')""",
)
def filter_contains(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", "url")
    parts = {
        "kept": C.filter_contains(p, "url", "page=2", keep=False),
        "dropped": C.filter_contains(p, "url", "page=2"),
    }
    return C.union_datasets(parts, "part").select("page_id", "part")


@QUERIES.add(
    "filter_fenced_solution",
    """SELECT p_partkey FROM part WHERE p_size % 5 = 0 AND p_type <> 'ECONOMY'""",
)
def filter_fenced_solution(spark, sf_dir):
    fence = F.when(F.col("p_size") % 5 == 0, "```python\n").when(F.col("p_size") % 5 == 1, "```\n")
    end = F.when(F.col("p_type") != "ECONOMY", "\n```").otherwise("\n")
    p = table(spark, sf_dir, "part").select(
        "p_partkey", F.concat(fence, F.lit("print('"), "p_name", F.lit("')"), end).alias("s")
    )
    return C.filter_fenced_solution(p, "s").select("p_partkey")


@QUERIES.add(
    "filter_by_judge_votes",
    """SELECT l_orderkey, count(*) AS votes FROM lineitem GROUP BY l_orderkey
       HAVING bool_or(l_linenumber % 4 = 1)""",
)
def filter_by_judge_votes(spark, sf_dir):
    # Four verdicts exist, so the set kept per problem has at most four entries.
    verdict = F.concat(F.lit("verdict [["), (F.col("l_linenumber") % 4).cast("string"), F.lit("]]"))
    problems = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.collect_set(verdict).alias("verdicts"), F.count(F.lit(1)).alias("votes")
    )
    return C.filter_by_judge_votes(problems, "verdicts", "[[1]]").drop("verdicts")


@QUERIES.add(
    "fill_template",
    """SELECT p_partkey, md5(chr(10) || p_name || chr(10) || chr(10) || 'Tags:' || chr(10) || p_type
         || chr(10) || 'Limit: ' || p_size || ' ms' || chr(10)) AS statement,
       md5('Solve this.' || chr(10) || chr(10) || p_name ||
         CASE WHEN p_size > 25 THEN 'Complete this program:' || chr(10) || '```python' || chr(10) ||
           'def ' || p_brand || chr(10) || '```' || chr(10) || chr(10)
         ELSE 'Write a program:' || chr(10) || '```python' || chr(10) || 'pass' ||
           chr(10) || '```' || chr(10) || chr(10) END ||
         'Result:' || chr(10) || chr(10)) AS prompt
       FROM part""",
)
def fill_template(spark, sf_dir):
    statement = C.fill_template(
        "\n{name}\n\nTags:\n{tags}\nLimit: {limit} ms\n",
        {"name": F.col("p_name"), "tags": F.col("p_type"), "limit": F.col("p_size")},
    )
    starter = F.when(F.col("p_size") > 25, F.concat(F.lit("def "), F.col("p_brand")))
    prompt = C.starter_prompt(
        F.col("p_name"), starter, "Solve this.", "Complete this program:", "Write a program:", "pass", "Result:"
    )
    return table(spark, sf_dir, "part").select(
        "p_partkey", F.md5(statement).alias("statement"), F.md5(prompt).alias("prompt")
    )


@QUERIES.add(
    "promote_field",
    "SELECT doc_id, n_chars AS idx, lang AS question FROM documents",
)
def promote_field(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(
        "doc_id", F.struct("n_chars", F.struct("lang").alias("q")).alias("extra_info")
    )
    out = C.promote_field(C.promote_field(d, "extra_info.n_chars", "idx"), "extra_info.q.lang", "question")
    return out.drop("extra_info")


@QUERIES.add(
    "default_fill",
    """SELECT d.doc_id, '' AS solution, -1.0::DOUBLE AS difficulty,
       coalesce(CAST(l.quality AS VARCHAR), '') AS answer
       FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""",
)
def default_fill(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id")
    rows = d.join(table(spark, sf_dir, "labels"), "doc_id", "left").select(
        "doc_id", F.col("quality").cast("string").alias("answer")
    )
    filled = C.with_defaults(rows)
    return filled.select("doc_id", "solution", "difficulty", "answer")


@QUERIES.add(
    "reward_route",
    """SELECT doc_id, CASE WHEN source IN ('src1', 'src2', 'src3') THEN 'code'
         WHEN source IN ('src4', 'src5') THEN 'hash' ELSE 'math' END AS route
       FROM documents""",
)
def reward_route(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    route = C.reward_route(F.col("source"), ["src1", "src2", "src3"], ["src4", "src5"])
    return d.select("doc_id", route.alias("route"))


@QUERIES.add(
    "union_datasets",
    """SELECT 'documents' AS origin, doc_id AS id, md5(text) AS text_md5, lang FROM documents
       UNION ALL SELECT 'benchmark', item_id, md5(text), NULL FROM benchmark""",
)
def union_datasets(spark, sf_dir):
    parts = {
        "documents": table(spark, sf_dir, "documents").select(
            F.col("doc_id").alias("id"), F.md5("text").alias("text_md5"), "lang"
        ),
        "benchmark": table(spark, sf_dir, "benchmark").select(
            F.col("item_id").alias("id"), F.md5("text").alias("text_md5")
        ),
    }
    return C.union_datasets(parts)


@QUERIES.add(
    "unpivot_pairs",
    """WITH u AS (SELECT * FROM conversations WHERE role = 'user'),
       a AS (SELECT * FROM conversations WHERE role = 'assistant'),
       p AS (SELECT u.text AS prompt, a.text AS chosen, b.text AS rejected FROM u
         JOIN a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
         JOIN a AS b ON b.conv_id = u.conv_id + 1 AND b.turn = u.turn + 1)
       SELECT md5(prompt) AS prompt, 'chosen' AS kind, md5(chosen) AS response FROM p
       UNION ALL SELECT md5(prompt), 'rejected', md5(rejected) FROM p""",
)
def unpivot_pairs(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    users = c.where("role = 'user'").select(
        "conv_id", (F.col("turn") + 1).alias("turn"), F.md5("text").alias("prompt")
    )
    replies = c.where("role = 'assistant'").select("conv_id", "turn", F.md5("text").alias("chosen"))
    other = replies.select(
        (F.col("conv_id") - 1).alias("conv_id"), "turn", F.col("chosen").alias("rejected")
    )
    pairs = users.join(replies, ["conv_id", "turn"]).join(other, ["conv_id", "turn"])
    return C.unpivot_pairs(pairs.select("prompt", "chosen", "rejected"))


@QUERIES.add(
    "merge_tests",
    """SELECT p_partkey, array_to_string(string_split(p_name, ' ') || [p_brand, p_type], ',') AS tests,
       len(string_split(p_name, ' ')) + 2 AS n FROM part""",
)
def merge_tests(spark, sf_dir):
    tests = C.merge_tests(F.split("p_name", " "), F.array("p_brand", "p_type"))
    return table(spark, sf_dir, "part").select(
        "p_partkey", F.array_join(tests, ",").alias("tests"), F.size(tests).cast("bigint").alias("n")
    )


# --- text and label columns ----------------------------------------------


@QUERIES.add(
    "mean_of_judge_scores",
    """SELECT o_orderkey, round(CASE WHEN o_orderstatus = 'F' THEN NULL
         WHEN o_orderstatus = 'O' THEN (o_totalprice + o_custkey) / 2
         ELSE o_totalprice END, 4) AS difficulty FROM orders""",
)
def mean_of_judge_scores(spark, sf_dir):
    status = F.col("o_orderstatus")
    first = F.when(status == "F", "Error: 12").otherwise(F.col("o_totalprice").cast("string"))
    second = F.when(status == "O", F.col("o_custkey").cast("string")).when(
        status == "F", "an ERROR 3"
    ).otherwise("not a number")
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.array(first, second).alias("out"))
    return o.select(
        "o_orderkey", F.round(text.mean_of_judge_scores(F.col("out")), 4).alias("difficulty")
    )


@QUERIES.add(
    "distinct_candidate_answers",
    """SELECT p_partkey, CASE WHEN p_type = 'ECONOMY' AND p_size % 2 = 0 THEN NULL
         WHEN p_type = 'ECONOMY' THEN CAST(p_size AS VARCHAR)
         WHEN p_size % 2 = 0 THEN p_brand
         WHEN p_brand = CAST(p_size AS VARCHAR) THEN p_brand
         ELSE p_brand || '|' || p_size END AS answers FROM part""",
)
def distinct_candidate_answers(spark, sf_dir):
    economy, even = F.col("p_type") == "ECONOMY", F.col("p_size") % 2 == 0
    out = F.array(
        F.when(economy, "Solution not found").otherwise(F.col("p_brand")),
        F.when(even, "an error").otherwise(F.col("p_size").cast("string")),
        F.when(economy, "Error").otherwise(F.col("p_brand")),
    )
    answers = text.distinct_candidate_answers(out)
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(answers, "|").alias("answers"))


@QUERIES.add(
    "difficulty_code",
    """SELECT p_partkey,
       CASE p_type WHEN 'ECONOMY' THEN 2.5 WHEN 'STANDARD' THEN 5.5 WHEN 'PROMO' THEN 8.5 ELSE -1 END::DOUBLE AS by_label,
       CASE WHEN p_size % 7 = 0 THEN 0 ELSE p_size END::DOUBLE AS by_level,
       CASE WHEN p_size % 3 = 0 THEN p_size * 100 ELSE 0 END AS by_tag FROM part""",
)
def difficulty_code(spark, sf_dir):
    size = F.col("p_size")
    label = (
        F.when(F.col("p_type") == "ECONOMY", "introductory")
        .when(F.col("p_type") == "STANDARD", "interview")
        .when(F.col("p_type") == "PROMO", "competition")
        .otherwise(F.col("p_type"))
    )
    level = F.when(size % 7 == 0, "Level ?").otherwise(F.concat(F.lit("Level "), size.cast("string")))
    rating = F.when(size % 3 == 0, F.concat(F.lit("*"), (size * 100).cast("string"))).otherwise("x")
    tags = F.concat(F.lit("*easy,math,"), rating, F.lit(",*9"))
    # A last readable tag must not win over the first; without a rating none is kept.
    tags = F.when(size % 3 == 0, tags).otherwise(F.lit("*easy,math"))
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        text.difficulty_from_label(label, text.INTERVIEW_LEVELS).alias("by_label"),
        text.difficulty_from_level(level).alias("by_level"),
        text.difficulty_from_tags(tags).alias("by_tag"),
    )


@QUERIES.add(
    "clean_activity_text",
    """SELECT doc_id, md5(replace(regexp_replace(replace(
         regexp_replace(source || ' [title] ' || text || ' [step] end', '^\\s+|\\s+$', '', 'g'),
         ' [title]', '. '), '\\[[^\\n]*?\\]', '', 'g'), '  ', ' ')) AS cleaned FROM documents""",
)
def clean_activity_text(spark, sf_dir):
    raw = F.concat("source", F.lit(" [title] "), "text", F.lit(" [step] end"))
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.md5(text.clean_activity_text(raw)).alias("cleaned")
    )


@QUERIES.add(
    "parse_tests",
    """SELECT event_id, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) + 1 AS k
       FROM events WHERE event_type <> 'error'""",
)
def parse_tests(spark, sf_dir):
    k = F.get_json_object("props", "$.k")
    good = F.format_string('{"inputs": ["%s"], "outputs": ["1"]}', k)
    raw = F.when(F.col("event_type") == "error", F.lit("not json")).otherwise(good)
    e = table(spark, sf_dir, "events").select("event_id", code_text.parse_tests(raw).alias("t"))
    total = F.col("t.inputs")[0].cast("bigint") + F.col("t.outputs")[0].cast("bigint")
    return e.where(F.col("t").isNotNull()).select("event_id", total.alias("k"))


@QUERIES.add(
    "drop_import_lines",
    """SELECT doc_id,
       md5(array_to_string(list_filter(string_split(text, chr(10)),
         lambda x: NOT starts_with(regexp_replace(x, '^\\s+|\\s+$', '', 'g'), 'Th')), chr(10))) AS kept,
       len(list_filter(string_split(text, chr(10)),
         lambda x: starts_with(regexp_replace(x, '^\\s+|\\s+$', '', 'g'), 'Th'))) AS dropped
       FROM documents""",
)
def drop_import_lines(spark, sf_dir):
    t = F.col("text")
    gone = code_text.lines_with_prefix(t, "Th")
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        F.md5(code_text.lines_without_prefix(t, "Th")).alias("kept"),
        F.when(gone == "", 0).otherwise(F.size(F.split(gone, "\n"))).cast("bigint").alias("dropped"),
    )


@QUERIES.add(
    "tests_layout",
    """SELECT p_partkey, array_to_string(list_transform(string_split(p_name, ' '),
         lambda w: w || '>' || upper(w)), ';') AS pairs, p_name AS inputs FROM part""",
)
def tests_layout(spark, sf_dir):
    words = F.split("p_name", " ")
    tests = F.struct(words.alias("inputs"), F.transform(words, F.upper).alias("outputs"))
    p = table(spark, sf_dir, "part").select("p_partkey", code_text.tests_to_pairs(tests).alias("pairs"))
    shown = F.transform("pairs", lambda x: F.concat(x["input"], F.lit(">"), x["output"]))
    return p.select(
        "p_partkey",
        F.array_join(shown, ";").alias("pairs"),
        F.array_join(code_text.pairs_to_tests(F.col("pairs"))["inputs"], " ").alias("inputs"),
    )


@QUERIES.add(
    "longest_tests",
    """WITH w AS (SELECT doc_id, unnest(string_split(text, ' ')) AS w,
         generate_subscripts(string_split(text, ' '), 1) AS i FROM documents),
       r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY length(w) DESC, i) AS rn,
         count(*) OVER (PARTITION BY doc_id) AS n FROM w)
       SELECT doc_id, md5(string_agg(w, ' ' ORDER BY CASE WHEN n > 15 THEN rn ELSE i END)) AS tests
       FROM r WHERE n <= 15 OR rn <= 15 GROUP BY doc_id""",
)
def longest_tests(spark, sf_dir):
    words = F.transform(
        F.split("text", " "), lambda w: F.struct(w.alias("input"), F.lit("").alias("output"))
    )
    top = code_text.longest_tests(words, 15)
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.md5(F.array_join(F.transform(top, lambda t: t["input"]), " ")).alias("tests")
    )


@QUERIES.add(
    "split_problem_id",
    "SELECT p_partkey, p_partkey * 10 + 7 AS contest FROM part",
)
def split_problem_id(spark, sf_dir):
    pid = F.concat((F.col("p_partkey") * 10 + 7).cast("string"), F.lit("D1"))
    return table(spark, sf_dir, "part").select("p_partkey", text.split_problem_id(pid).alias("contest"))


@QUERIES.add(
    "parse_log_line",
    """SELECT CAST(day(ts) AS DOUBLE) AS step, event_id, CAST(round(value, 1) AS DOUBLE) AS reward, value * 2 AS loss
       FROM events""",
)
def parse_log_line(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    line = F.concat(
        F.lit("step:"), F.dayofmonth("ts").cast("string"),
        F.lit(" - critic/rewards/mean:"), F.round("value", 1).cast("string"),
        F.lit(" - loss:"), (F.col("value") * 2).cast("string"),
    )
    parsed = e.select("event_id", text.parse_log_line(line).alias("m"))
    return parsed.select(
        "event_id",
        F.col("m")["step"].alias("step"),
        F.col("m")["critic/rewards/mean"].alias("reward"),
        F.col("m")["loss"].alias("loss"),
    )


@QUERIES.add(
    "format_log_line",
    """SELECT event_id, printf('step:%d - value:%.3f - user:%.3f', day(ts), value / 7, user_id::DOUBLE) AS line
       FROM events""",
)
def format_log_line(spark, sf_dir):
    metrics = {"value": F.col("value") / 7, "user": F.col("user_id").cast("double")}
    line = text.format_log_line(F.dayofmonth("ts"), metrics)
    return table(spark, sf_dir, "events").select("event_id", line.alias("line"))


@QUERIES.add(
    "user_turn",
    """SELECT conv_id, md5(coalesce(
         arg_min(text, turn) FILTER (WHERE role = 'user'), arg_max(text, turn), '')) AS content
       FROM conversations GROUP BY conv_id""",
)
def user_turn(spark, sf_dir):
    """The column function needs a message list; over turn rows two extremes suffice."""
    c = table(spark, sf_dir, "conversations")
    message = F.struct("role", F.col("text").alias("content"))
    ends = c.groupBy("conv_id").agg(
        F.min_by(message, F.when(F.col("role") == "user", F.col("turn"))).alias("first_user"),
        F.max_by(message, "turn").alias("last"),
    )
    messages = F.array_compact(F.array("first_user", "last"))
    return ends.select("conv_id", F.md5(text.user_turn(messages)).alias("content"))


@QUERIES.add(
    "chat_mask",
    """WITH w AS (SELECT conv_id, turn, role, unnest(string_split(text, ' ')) AS w, generate_subscripts(string_split(text, ' '), 1) AS i FROM conversations),
       p AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, i) AS rn FROM w),
       f AS (SELECT conv_id, range + 1 AS rn FROM (SELECT DISTINCT conv_id FROM conversations), range(512)),
       t AS (SELECT f.conv_id, f.rn, coalesce(length(w), 0) AS id, CASE WHEN w IS NULL THEN 0 ELSE 1 END AS att,
         CASE WHEN role = 'assistant' THEN 1 ELSE 0 END AS m FROM f LEFT JOIN p ON p.conv_id = f.conv_id AND p.rn = f.rn)
       SELECT conv_id, md5(string_agg(id::VARCHAR, ',' ORDER BY rn)) AS input_ids, md5(string_agg(att::VARCHAR, ',' ORDER BY rn)) AS attention_mask,
         md5(string_agg(m::VARCHAR, ',' ORDER BY rn)) AS loss_mask,
         md5(string_agg(CASE WHEN m = 1 THEN id ELSE -100 END::VARCHAR, ',' ORDER BY rn)) AS labels FROM t GROUP BY 1""",
)
def chat_mask(spark, sf_dir):
    ids = F.transform(F.split("text", " "), lambda w: F.length(w))
    spans = C.chat_spans(table(spark, sf_dir, "conversations"), F.size(ids), 512)
    chats = C.chat_examples(spans, ids, 512)
    shown = lambda c: F.md5(F.array_join(F.col(c).cast("array<string>"), ",")).alias(c)
    return chats.select("conv_id", *[shown(c) for c in chats.columns if c != "conv_id"])
