"""Text, label and log-line columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Numeric difficulty of each label, by label set.
INTERVIEW_LEVELS = {"introductory": 2.5, "interview": 5.5, "competition": 8.5}
GRADED_LEVELS = {"EASY": 1.9, "MEDIUM": 3.7, "MEDIUM_HARD": 5.5, "HARD": 7.3, "VERY_HARD": 9.1}


def difficulty_from_label(label: Column, levels: dict[str, float]) -> Column:
    """Numeric difficulty of a label; -1 for an unknown one."""
    known = reduce(
        lambda c, kv: c.when(label == kv[0], F.lit(kv[1])), levels.items(), F.when(F.lit(False), 0.0)
    )
    return known.otherwise(F.lit(-1.0))


def difficulty_from_level(level: Column) -> Column:
    """Last word of a text such as "Level 4" as a number, else 0."""
    words = F.filter(F.split(level, r"\s+"), lambda w: w != "")
    return F.coalesce(F.try_element_at(words, F.lit(-1)).try_cast("double"), F.lit(0.0))


def difficulty_from_tags(tags: Column) -> Column:
    """Number of the first readable `*rating` tag of a comma list, else 0."""
    ratings = F.transform(
        F.filter(F.split(tags, ","), lambda t: F.contains(t, F.lit("*"))),
        lambda t: F.trim(F.replace(t, F.lit("*"), F.lit(""))).try_cast("int"),
    )
    first = F.try_element_at(F.filter(ratings, lambda r: r.isNotNull()), F.lit(1))
    return F.coalesce(first, F.lit(0))


def clean_activity_text(text: Column) -> Column:
    """Title marks become sentence ends, bracketed notes go, double spaces close."""
    out = F.regexp_replace(text, r"^\s+|\s+$", "")
    out = F.replace(out, F.lit(" [title]"), F.lit(". "))
    out = F.regexp_replace(out, r"\[.*?\]", "")
    return F.replace(out, F.lit("  "), F.lit(" "))


def capitalized(text: Column) -> Column:
    """First letter upper, all others lower."""
    return F.concat(F.upper(F.left(text, F.lit(1))), F.lower(F.substring(text, 2, 2**31 - 1)))


def split_problem_id(problem_id: Column) -> Column:
    """Contest number: the leading digits before the problem letter."""
    return F.regexp_extract(problem_id, r"^([0-9]+)[A-Z].*", 1).try_cast("bigint")


def user_turn(messages: Column) -> Column:
    """Content of the first user message, else of the last message, else ''."""
    users = F.filter(messages, lambda m: m["role"] == "user")
    return F.coalesce(
        F.try_element_at(users, F.lit(1))["content"],
        F.try_element_at(messages, F.lit(-1))["content"],
        F.lit(""),
    )


def parse_log_line(line: Column) -> Column:
    """Map of the `key:value` parts of a `step:1 - key:value - ...` line."""
    pairs = F.str_to_map(line, F.lit(" - "), F.lit(":"))
    return F.transform_values(pairs, lambda _, v: v.try_cast("double"))


def format_log_line(step: Column, metrics: dict[str, Column]) -> Column:
    """`step:1 - key:value - ...` with three decimals."""
    parts = [F.concat(F.lit("step:"), step.cast("string"))]
    parts += [F.format_string(f"{k}:%.3f", v) for k, v in metrics.items()]
    return F.concat_ws(" - ", *parts)


def mean_of_judge_scores(outputs: Column) -> Column:
    """Mean of the outputs that read as numbers; those naming an error are dropped."""
    kept = F.filter(outputs, lambda o: ~F.contains(F.lower(o), F.lit("error")))
    numbers = F.filter(
        F.transform(kept, lambda o: o.try_cast("double")), lambda v: v.isNotNull()
    )
    total = F.aggregate(numbers, F.lit(0.0), lambda a, v: a + v)
    return F.when(F.size(numbers) > 0, F.try_divide(total, F.size(numbers)))


def distinct_candidate_answers(outputs: Column) -> Column:
    """Distinct answers in first-seen order, null when all name an error."""
    kept = F.filter(
        outputs,
        lambda o: ~(
            F.contains(o, F.lit("error"))
            | F.contains(o, F.lit("Error"))
            | F.contains(o, F.lit("Solution not found"))
        ),
    )
    return F.when(F.size(kept) > 0, F.array_distinct(kept))


def has_vote(votes: Column, tag: str) -> Column:
    """True when any recorded verdict holds the tag."""
    return F.exists(votes, lambda v: F.contains(v, F.lit(tag)))
