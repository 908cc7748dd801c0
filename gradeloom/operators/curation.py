"""Curation of problem datasets: examples, filters, templates, unions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeloom.functions.answers import is_evaluable
from gradeloom.functions.sequences import attention_mask, chat_labels, chat_mask, pad_truncate
from gradeloom.functions.text import capitalized, clean_activity_text, has_vote
from gradeloom.operators.skew import with_group_running

RL_SCHEMA = (
    "data_source string, prompt array<struct<role:string,content:string>>, ability string, "
    "reward_model struct<style:string,ground_truth:array<string>>, "
    "extra_info struct<split:string,index:bigint,ground_truth_cot:string>"
)

# Defaults of a problem record.
PROBLEM_DEFAULTS = {"problem": "", "solution": "", "answer": "", "difficulty": -1.0}

# Subsets kept by the quality rules.
QUALITY_SUBSETS = ["Leetcode", "Codeforces", "Code_Contests", "Apps", "Taco"]

# Sources whose truth is a set of tests.
CODE_SOURCES = [
    "apps", "taco", "code_contests", "codeforces", "livecodebench", "kodcode",
    "leetcode", "primeintellect", "humanevalplus",
]
# Fixed value: the source whose answer follows a line of hashes.
HASH_SOURCES = ["openai/gsm8k"]


def _message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def build_rl_examples(
    problems: DataFrame,
    split: str,
    index: Column,
    source: Column,
    system: str | None = None,
    suffix: str = "",
    style: str = "rule",
    ability: str = "math",
    with_cot: bool = True,
) -> DataFrame:
    """Question and answer rows (`problem`, `answer`, `solution`) as RL examples."""
    user = _message("user", F.concat(F.col("problem"), F.lit(suffix)))
    turns = [user] if system is None else [_message("system", F.lit(system)), user]
    solution = F.col("solution") if with_cot else F.lit(None).cast("string")
    answer = F.col("answer")
    truths = answer if dict(problems.dtypes)["answer"].startswith("array") else F.array(answer)
    return problems.select(
        source.alias("data_source"),
        F.array(*turns).alias("prompt"),
        F.lit(ability).alias("ability"),
        F.struct(F.lit(style).alias("style"), truths.alias("ground_truth")).alias("reward_model"),
        F.struct(
            F.lit(split).alias("split"),
            index.cast("bigint").alias("index"),
            solution.alias("ground_truth_cot"),
        ).alias("extra_info"),
    )


def build_choice_examples(
    rows: DataFrame, split: str, index: Column, source: str, ability: str = "nlp"
) -> DataFrame:
    """Multiple-choice rows (`activity_label`, `ctx_a`, `ctx_b`, `endings`, `label`)."""
    query = F.concat(
        F.col("activity_label"), F.lit(": "), F.col("ctx_a"), F.lit(" "), capitalized(F.col("ctx_b"))
    )
    return rows.select(
        F.lit(source).alias("data_source"),
        F.array(_message("user", clean_activity_text(query))).alias("prompt"),
        F.lit(ability).alias("ability"),
        F.struct(
            F.lit("model").alias("style"),
            F.lit("multiple_choice").alias("eval"),
            F.col("label").cast("int").alias("ground_truth"),
            F.transform("endings", clean_activity_text).alias("choices"),
        ).alias("reward_model"),
        F.struct(F.lit(split).alias("split"), index.cast("bigint").alias("index")).alias(
            "extra_info"
        ),
    )


# --- filters --------------------------------------------------------------


def filter_source(df: DataFrame, column: str, value: str) -> DataFrame:
    return df.where(F.col(column) == value)


def filter_quality_rules(
    df: DataFrame,
    subsets: list[str] = QUALITY_SUBSETS,
    style: str = "instruct",
    max_passes: int = 9,
    max_similarity: float = 0.9,
    marker: str = "def",
    min_markers: int = 8,
) -> DataFrame:
    """Rows of known subsets in one style that are neither too easy nor near a benchmark."""
    return df.where(
        F.col("subset").isin(subsets)
        & (F.col("style") == style)
        & (F.col("pass_count") < max_passes)
        & (F.col("benchmark_similarity") < max_similarity)
        & (_occurrences(F.col("test_code"), marker) >= min_markers)
    )


def _occurrences(text: Column, part: str) -> Column:
    """How often a part occurs, overlaps not counted."""
    gone = F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))
    return gone / F.lit(len(part))


def filter_bad_ids(df: DataFrame, column: str, bad: list[str] | DataFrame) -> DataFrame:
    """Rows whose id is not listed, in a short list or in a table with that column."""
    if isinstance(bad, DataFrame):
        return df.join(bad.select(column), column, "left_anti")
    return df.where(~F.col(column).isin(bad))


def filter_difficulty_range(
    df: DataFrame, column: str, low: float = 2, high: float = 5, top: float = 10
) -> DataFrame:
    d = F.col(column)
    return df.where(d.between(low, high) | (d >= top))


def filter_min_tests(df: DataFrame, column: str, more_than: int) -> DataFrame:
    return df.where(F.size(column) > more_than)


def filter_date_range(df: DataFrame, column: str, start: str, end: str) -> DataFrame:
    """Half-open window; a text column is read as an ISO timestamp."""
    when = F.col(column)
    if dict(df.dtypes)[column] == "string":
        when = F.to_timestamp(when, "yyyy-MM-dd'T'HH:mm:ss")
    return df.where((when >= F.to_timestamp(F.lit(start))) & (when < F.to_timestamp(F.lit(end))))


def word_count(column: str) -> Column:
    return F.size(F.split(F.col(column), " "))


def filter_prompt_length(df: DataFrame, length: Column, limit: int) -> DataFrame:
    return df.where(length <= limit)


def filter_labelled(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.length(column) > 0)


def filter_evaluable_answers(df: DataFrame, column: str) -> DataFrame:
    return df.where(is_evaluable(F.col(column)))


def filter_fenced_solution(df: DataFrame, column: str) -> DataFrame:
    c = F.col(column)
    return df.where(F.startswith(c, F.lit("```python")) & F.endswith(c, F.lit("```")))


def filter_contains(df: DataFrame, column: str, text: str, keep: bool = True) -> DataFrame:
    found = F.contains(F.col(column), F.lit(text))
    return df.where(found if keep else ~found)


def filter_by_judge_votes(
    df: DataFrame, column: str, tag: str, keep_unjudged: bool = True
) -> DataFrame:
    """Rows where any verdict holds the tag, and those without verdicts if wanted."""
    votes = F.col(column)
    judged = F.coalesce(F.size(votes) > 0, F.lit(False))
    return df.where(F.when(judged, has_vote(votes, tag)).otherwise(F.lit(keep_unjudged)))


# --- projections ----------------------------------------------------------


def fill_template(template: str, fields: dict[str, Column]) -> Column:
    """Text with `{name}` places filled from columns; a null field reads as ''."""
    parts, rest = [], template
    while rest:
        before, _, tail = rest.partition("{")
        name, _, rest = tail.partition("}")
        if before:
            parts.append(F.lit(before))
        if name:
            parts.append(F.coalesce(fields[name].cast("string"), F.lit("")))
    return F.concat(*parts)


def starter_prompt(
    question: Column, starter: Column, header: str, with_code: str, without_code: str, blank: str,
    closing: str,
) -> Column:
    """Question under a header, with the starter program when there is one.

    All wording is the caller's: the lines above either kind of code, the `blank` program
    that stands in for a missing one, and the closing line.
    """
    has_starter = starter.isNotNull() & (starter != "")
    code = F.concat(
        F.lit(f"{with_code}\n```python\n"), starter, F.lit("\n```\n\n")
    )
    blank = F.lit(f"{without_code}\n```python\n{blank}\n```\n\n")
    return F.concat(
        F.lit(header + "\n\n"),
        question,
        F.when(has_starter, code).otherwise(blank),
        F.lit(closing + "\n\n"),
    )


def promote_field(df: DataFrame, path: str, name: str) -> DataFrame:
    """A nested field as a column of its own."""
    return df.withColumn(name, F.col(path))


def with_defaults(df: DataFrame, defaults: dict[str, object] = PROBLEM_DEFAULTS) -> DataFrame:
    """Missing columns and null values take their default."""
    present = set(df.columns)
    filled = {
        name: F.coalesce(F.col(name), F.lit(value)) if name in present else F.lit(value)
        for name, value in defaults.items()
    }
    return df.withColumns(filled)


def reward_route(
    source: Column, code_sources: list[str] = CODE_SOURCES, hash_sources: list[str] = HASH_SOURCES
) -> Column:
    """Which scorer a row needs: tests, `hash_answer_score`, or `reward_value` for the rest."""
    return (
        F.when(source.isin(code_sources), F.lit("code"))
        .when(source.isin(hash_sources), F.lit("hash"))
        .otherwise(F.lit("math"))
    )


# --- unions ---------------------------------------------------------------


def union_datasets(parts: dict[str, DataFrame], origin: str = "origin") -> DataFrame:
    """Bag union that remembers where each row came from."""
    tagged = [df.withColumn(origin, F.lit(name)) for name, df in parts.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def unpivot_pairs(pairs: DataFrame, prompt: str = "prompt") -> DataFrame:
    """Each (chosen, rejected) pair as two (prompt, response) rows."""
    return pairs.unpivot([prompt], ["chosen", "rejected"], "kind", "response")


def merge_tests(public: Column, private: Column) -> Column:
    return F.concat(public, private)


def exclude_test_ids(train: DataFrame, test: DataFrame, column: str) -> DataFrame:
    """Training rows whose id is not in the test set."""
    return train.join(test.select(column), column, "left_anti")


def chat_spans(
    turns: DataFrame, length: Column, limit: int, hot_rows: int | None = None
) -> DataFrame:
    """Where each turn of a conversation starts, and how many of its tokens `limit` leaves.

    `turns` has one row per turn (`conv_id`, `turn`). Turns beyond the limit go, so
    at most `limit` rows of a conversation remain.
    """
    sized = turns.withColumn("length", length)
    placed = with_group_running(
        sized, ["conv_id"], [F.col("turn")], {"start": F.col("length")}, hot_rows
    )
    kept = F.least(F.col("length"), F.greatest(F.lit(limit) - F.col("start"), F.lit(0)))
    return placed.withColumn("kept", kept.cast("int")).where(F.col("kept") > 0)


def chat_examples(spans: DataFrame, ids: Column, limit: int, pad: int = 0) -> DataFrame:
    """Token ids, attention, loss mask and labels of each conversation, `limit` long.

    Labels are the ids on assistant turns and -100 elsewhere.
    """
    turn = F.struct("turn", "role", "kept", F.slice(ids, F.lit(1), F.col("kept")).alias("ids"))
    chats = spans.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("t"))
    tokens = F.flatten(F.col("t.ids"))
    return chats.select(
        "conv_id",
        pad_truncate(tokens, limit, pad, "right", "right").alias("input_ids"),
        attention_mask(tokens, limit, "right").alias("attention_mask"),
        chat_mask(F.col("t.role"), F.col("t.kept"), limit).alias("loss_mask"),
    ).withColumn("labels", chat_labels(F.col("input_ids"), F.col("loss_mask")))
