"""Scoring recorded responses and combining verdicts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeloom.operators.deadlines import Guarded

Scorer = Callable[..., Column]


def score_with(
    df: DataFrame, scorer: Scorer, inputs: list[str], output: str = "score"
) -> DataFrame:
    """Scores rows with a function of columns; a score already there wins."""
    score = scorer(*[F.col(c) for c in inputs]).cast("double")
    if output in df.columns:
        score = F.coalesce(F.col(output), score)
    return df.withColumn(output, score)


def score_or_zero(
    df: DataFrame, fn: Callable[..., float], inputs: list[str], output: str = "score",
    seconds: float | None = None,
) -> DataFrame:
    """Scores rows with an opaque Python function; a failure or null scores 0.

    With `seconds`, so does a call that takes longer, and the next row follows; see `Guarded` for calls
    that ignore it. Rows travel in Arrow batches; use `score_with` where columns can say it.
    """

    def one(*values) -> float:
        try:
            score = fn(*values)
            return 0.0 if score is None else float(score)
        except Exception:
            return 0.0

    @F.pandas_udf("double")
    def scored(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        guarded = None if seconds is None else Guarded(fn, seconds)
        try:
            for columns in batches:
                columns = columns if isinstance(columns, tuple) else (columns,)
                yield pd.Series([(guarded or one)(*row) for row in zip(*columns)], dtype="float64")
        finally:
            if guarded is not None:
                guarded.close()

    return df.withColumn(output, scored(*[F.col(c) for c in inputs]))


def all_tests_pass(verdicts: DataFrame, key: str, verdict: str = "passed") -> DataFrame:
    """Per key: every verdict is true and there is at least one.

    The key table should hold every key; a row with a null verdict means "no test".
    """
    passed = F.bool_and(F.col(verdict)) & (F.count(verdict) == F.count(F.lit(1)))
    return verdicts.groupBy(key).agg(F.coalesce(passed, F.lit(False)).alias("all_passed"))
