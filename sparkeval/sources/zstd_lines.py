"""Lines of zstd-compressed text files as a Spark data source (part of SRC19).

Spark's text reader needs a native zstd codec that its builds don't bring, so the files are read
by a Python data source: one partition per file, streamed through the decompressor in blocks,
all frames of a file in turn (files that were appended to have several), handed over as Arrow
batches.  Memory is bounded by a block and its longest line.

The writer streams each task's rows into a file of its own and reports it; only files of committed
tasks stay, those of failed or repeated attempts are deleted.  Folders may be local or on any
store that pyarrow can open (``file:``, ``hdfs:``, ``s3:``).

Defined cases: empty lines are lines; a last line needs no line end; a file without bytes has no
lines; a folder stands for its ``*.zst`` files in order of their names; no such file is an error.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

NAME = "zstd_lines"
BLOCK = 4 << 20                                            # bytes decompressed at a time
LEVEL = 3


@dataclass
class File(InputPartition):
    path: str


@dataclass
class Written(WriterCommitMessage):
    path: str | None


def _files(path: str) -> list[str]:
    where, inner = fs.FileSystem.from_uri(path)
    prefix = path[:len(path) - len(inner)] if path.endswith(inner) else ""
    info = where.get_file_info(inner)
    if info.type == fs.FileType.File:
        return [path]
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = where.get_file_info(fs.FileSelector(inner))
    return [prefix + f.path for f in sorted(found, key=lambda f: f.path) if f.type == fs.FileType.File and f.path.endswith(".zst")]


def lines_of(path: str) -> Iterator[list[bytes]]:
    """The lines of one file, a block at a time."""
    where, inner = fs.FileSystem.from_uri(path)
    with where.open_input_stream(inner, compression=None) as raw:
        reader = zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True)
        rest: list[bytes] = []                             # the line that goes on in the next block
        while block := reader.read(BLOCK):
            parts = block.split(b"\n")
            if len(parts) > 1:
                parts[0] = b"".join([*rest, parts[0]])
                rest = [parts.pop()]
                yield parts
            else:
                rest.append(block)
        last = b"".join(rest)
        if last:
            yield [last]


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[File]:
        return [File(p) for p in _files(self.path)]

    def read(self, partition: File) -> Iterator[pa.RecordBatch]:
        for lines in lines_of(partition.path):
            yield pa.RecordBatch.from_arrays([pa.array(lines, pa.binary()).cast(pa.string())], names=["value"])


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path.rstrip("/"), overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        where, inner = fs.FileSystem.from_uri(self.path)
        name = f"part-{uuid.uuid4().hex}.jsonl.zst"
        sink = stream = None
        try:
            for batch in iterator:
                if not batch.num_rows:
                    continue
                if sink is None:
                    where.create_dir(inner, recursive=True)
                    sink = where.open_output_stream(f"{inner}/{name}", compression=None)
                    stream = zstandard.ZstdCompressor(level=LEVEL).stream_writer(sink, closefd=False)
                for at in range(0, batch.num_rows, 1024):
                    stream.write(b"".join(x + b"\n" for x in batch.column(0).slice(at, 1024).cast(pa.binary()).to_pylist() if x is not None))
        finally:
            if stream is not None:
                stream.close()
                sink.close()
        return Written(f"{inner}/{name}" if sink is not None else None)

    def commit(self, messages: list[Written | None]) -> None:
        where, inner = fs.FileSystem.from_uri(self.path)
        new = {m.path for m in messages if m is not None and m.path}
        where.create_dir(inner, recursive=True)
        if self.overwrite:
            for f in where.get_file_info(fs.FileSelector(inner)):
                if f.path.endswith(".jsonl.zst") and f.path not in new:
                    where.delete_file(f.path)

    def abort(self, messages: list[Written | None]) -> None:
        where, _ = fs.FileSystem.from_uri(self.path)
        for m in messages:
            if m is not None and m.path:
                where.delete_file(m.path)


class ZstdLines(DataSource):
    """``value string``, one row per line."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "value string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options["path"], overwrite)


def _uri(spark: SparkSession, path: str) -> str:
    """The path with its store: what Hadoop would make of it."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return str(p.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(p).toString()).replace("file:/", "file:///", 1) if not path.startswith("file:///") else path


def read_zstd_lines(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(ZstdLines)
    return spark.read.format(NAME).load(_uri(spark, path))


def write_zstd_lines(lines: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write a DataFrame of one string column, one line per row that isn't null."""
    spark = lines.sparkSession
    spark.dataSource.register(ZstdLines)
    lines.select(lines.columns[0]).toDF("value").write.format(NAME).mode(mode).save(_uri(spark, path))
