"""Data sources of the library's own: mixed example files, and a results table with one header.

Files are opened by the tasks through pyarrow's file systems (local, HDFS, S3, GCS), so a path must be of
one of them and reachable from all executors.
"""

from __future__ import annotations

import csv
import io
import json
import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage,
)
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

# First bytes of a parquet file.
PARQUET_MARK = b"PAR1"
ROWS_AT_ONCE = 4_096
TEXT_AT_ONCE = 1 << 20


def opened(path: str) -> tuple[fs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def _data_files(path: str) -> list[str]:
    """Files under a path, without those whose name or folder starts with `_` or a dot."""
    store, at = opened(path)
    info = store.get_file_info(at)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == fs.FileType.File:
        return [at]
    found = store.get_file_info(fs.FileSelector(at, recursive=True))
    names = [f.path for f in found if f.type == fs.FileType.File and f.size]
    return sorted(n for n in names if not any(p[:1] in "._" for p in posixpath.relpath(n, at).split("/")))


@dataclass
class FilePart(InputPartition):
    base: str
    path: str


def json_records(stream) -> Iterator[dict]:
    """Records of a JSON array or of JSON lines, a piece of the text at a time."""
    reader, decoder = io.TextIOWrapper(stream, "utf-8"), json.JSONDecoder()
    text, at, ended = "", 0, False
    while True:
        while at < len(text) and text[at] in " \t\r\n,[]":
            at += 1
        try:
            record, end = decoder.raw_decode(text, at)
        except json.JSONDecodeError:
            if ended:
                if text[at:].strip(" \t\r\n,[]"):
                    raise
                return
            more = reader.read(TEXT_AT_ONCE)
            ended = not more
            text, at = text[at:] + more, 0
        else:
            yield record
            at = end


class ExamplesReader(DataSourceReader):
    """One partition per file; the first bytes tell how to read it."""

    def __init__(self, paths: list[str], schema: StructType):
        self.paths, self.schema = paths, schema

    def partitions(self) -> list[InputPartition]:
        return [FilePart(p, f) for p in self.paths for f in _data_files(p)] or [FilePart("", "")]

    def read(self, partition: FilePart) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        wanted = to_arrow_schema(self.schema)
        store, _ = opened(partition.base)
        with store.open_input_file(partition.path) as file:
            mark = file.read(len(PARQUET_MARK))
            file.seek(0)
            if mark == PARQUET_MARK:
                yield from self._from_parquet(file, wanted)
            else:
                yield from self._from_json(file, wanted)

    def _from_parquet(self, file, wanted: pa.Schema) -> Iterator[pa.RecordBatch]:
        table = pq.ParquetFile(file)
        held = [n for n in wanted.names if n in table.schema_arrow.names]
        for batch in table.iter_batches(ROWS_AT_ONCE, columns=held):
            columns = [batch.column(n).cast(wanted.field(n).type) if n in held
                       else pa.nulls(batch.num_rows, wanted.field(n).type) for n in wanted.names]
            yield pa.RecordBatch.from_arrays(columns, schema=wanted)

    def _from_json(self, file, wanted: pa.Schema) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []
        for record in json_records(file):
            rows.append(record)
            if len(rows) == ROWS_AT_ONCE:
                yield pa.RecordBatch.from_pylist(rows, schema=wanted)
                rows = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=wanted)


class ExamplesSource(DataSource):
    """Parquet files and JSON records (an array or lines) side by side, whatever their names.

    Option `paths` is a JSON list of files or folders. The schema is the caller's; a column that
    a file lacks is null there.
    """

    @classmethod
    def name(cls) -> str:
        return "gradeloom_examples"

    def schema(self) -> StructType:
        raise ValueError("name the columns to read: .schema(...)")

    def reader(self, schema: StructType) -> DataSourceReader:
        return ExamplesReader(json.loads(self.options["paths"]), schema)


@dataclass
class PartWritten(WriterCommitMessage):
    path: str | None


class ResultsWriter(DataSourceArrowWriter):
    """Tasks write parts aside; the commit moves those of the attempts that counted, and a first one adds the header."""

    def __init__(self, path: str, names: list[str], overwrite: bool):
        if overwrite:
            raise ValueError("a results table is only appended to")
        self.path, self.names = path, names
        self.job = uuid.uuid4().hex

    def _aside(self) -> str:
        return posixpath.join(opened(self.path)[1], "_temporary", self.job)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        store, _ = opened(self.path)
        text = None
        for batch in iterator:
            if not batch.num_rows:
                continue
            if text is None:
                name = posixpath.join(self._aside(), f"part-{uuid.uuid4().hex}.csv")
                store.create_dir(self._aside(), recursive=True)
                raw = store.open_output_stream(name)
                text = io.TextIOWrapper(raw, "utf-8", newline="")
            csv.writer(text, lineterminator="\n").writerows(zip(*[c.to_pylist() for c in batch.columns]))
        if text is None:
            return PartWritten(None)
        text.close()
        return PartWritten(name)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        store, folder = opened(self.path)
        store.create_dir(folder, recursive=True)
        header = posixpath.join(folder, HEADER)
        if store.get_file_info(header).type == fs.FileType.NotFound:
            with io.TextIOWrapper(store.open_output_stream(header), "utf-8", newline="") as text:
                csv.writer(text, lineterminator="\n").writerow(self.names)
        for m in messages:
            if m is not None and m.path is not None:
                store.move(m.path, posixpath.join(folder, posixpath.basename(m.path)))
        self.abort(messages)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        store, _ = opened(self.path)
        if store.get_file_info(self._aside()).type == fs.FileType.Directory:
            store.delete_dir(self._aside())


# Sorts before all parts, so that the files in their order are one CSV table.
HEADER = "00-header.csv"


class ResultsSource(DataSource):
    """A folder of CSV parts that grows by appends, with one header for the whole table."""

    @classmethod
    def name(cls) -> str:
        return "gradeloom_results"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return ResultsWriter(self.options["path"], schema.names, overwrite)
