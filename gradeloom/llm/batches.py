"""Small helpers around Arrow batches and written intermediate tables."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeloom.session import scratch_path

# Text handled at once inside a task.
GROUP_BYTES = 2_000_000


def batch(schema: pa.Schema, columns: Iterable) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(c, type=f.type) for c, f in zip(columns, schema)], schema=schema
    )


def text_groups(b: pa.RecordBatch, column: str) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Slices of a batch with their texts, each of about `GROUP_BYTES` at most or one row."""
    values = b.column(column)
    start = size = 0
    for i in range(b.num_rows):
        v = values[i]
        n = v.as_buffer().size if v.is_valid else 0
        if i > start and size + n > GROUP_BYTES:
            yield b.slice(start, i - start), values.slice(start, i - start).to_pylist()
            start, size = i, 0
        size += n
    if b.num_rows > start:
        yield b.slice(start), values.slice(start).to_pylist()


def numbered(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The frame with columns d0, d1, ..., which no helper column clashes with, and their names."""
    names = {c: f"d{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def renamed(df: DataFrame, names: dict[str, str], *more: str) -> DataFrame:
    """Back to the names of before, in their order; `more` are columns that stay as well."""
    return df.select(*[F.col(n).alias(c) for c, n in names.items()], *more)


def written(df: DataFrame, name: str) -> DataFrame:
    """The frame as a table in the shared folder: computed once, kept if executors are lost."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
