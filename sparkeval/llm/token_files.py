"""Operator 8 - token ids in Arrow stream files of fixed-size lists.

Documents are dealt by ranges of their id, sorted inside each range, encoded and written as
one continuous run of ids, each document followed by the end id.  A file is an Arrow stream
of record batches that all have the same number of rows; a row is one sequence of
``seq_len`` ids and its mask (false on the padding that ends a file), both fixed-size lists.
All batches have the same byte size, so sequence i lies at a computed place and is read
without copying (``TokenFile``).  A second small stream holds the document index.

A task writes to a name of its own and reports it as a manifest row; files of lost or
repeated attempts are never named by the manifest.  Nothing passes through the driver.

Defined cases: null text = empty text: only its end id; null ids come first; rows with equal
ids follow each other; an empty table gives an empty manifest and no rows; ids are stored
as 16-bit numbers when the vocabulary fits, else as 32-bit.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs, ipc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import new_shared_path, write_shared
from .word_ids import byte_table, steps

MANIFEST = "part int, path string, n_docs bigint, n_tokens bigint, n_sequences bigint"
INDEX = pa.schema([("id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])


def file_schema(seq_len: int, wide: bool) -> pa.Schema:
    return pa.schema([("ids", pa.list_(pa.uint32() if wide else pa.uint16(), seq_len)), ("mask", pa.list_(pa.bool_(), seq_len))])


def _open(path: str):
    where, inner = fs.FileSystem.from_uri(path)
    return where, inner


class Writer:
    """One file: ids go in, equal batches go out."""

    def __init__(self, path: str, seq_len: int, rows: int, wide: bool):
        where, inner = _open(path)
        self.sink = where.open_output_stream(inner)
        self.schema, self.seq_len, self.rows = file_schema(seq_len, wide), seq_len, rows
        self.kind = np.uint32 if wide else np.uint16
        self.stream = ipc.new_stream(self.sink, self.schema)
        self.waiting, self.held, self.sequences = [], 0, 0

    def add(self, ids: np.ndarray) -> None:
        self.waiting.append(ids.astype(self.kind))
        self.held += len(ids)
        if self.held >= self.rows * self.seq_len:
            flat = np.concatenate(self.waiting)
            size = self.rows * self.seq_len
            for at in range(0, len(flat) - size + 1, size):
                self._batch(flat[at:at + size], size)
            rest = flat[len(flat) - len(flat) % size:]
            self.waiting, self.held = [rest], len(rest)

    def _batch(self, flat: np.ndarray, real: int) -> None:
        mask = np.arange(self.rows * self.seq_len) < real
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.seq_len) for x in (flat, mask)]
        self.stream.write_batch(pa.RecordBatch.from_arrays(lists, schema=self.schema))
        self.sequences += self.rows

    def close(self) -> None:
        flat = np.concatenate(self.waiting) if self.waiting else np.zeros(0, self.kind)
        if len(flat):
            self._batch(np.pad(flat, (0, self.rows * self.seq_len - len(flat))), len(flat))
        self.stream.close()
        self.sink.close()


class TokenFile:
    """Random access to the sequences of a file by memory mapping: the arrays returned are
    views of the file's pages."""

    def __init__(self, path: str):
        self.map = pa.memory_map(path.removeprefix("file://"), "r")
        self.buffer = self.map.read_buffer()
        reader = pa.BufferReader(self.buffer)
        self.schema = ipc.read_schema(reader)
        self.head = reader.tell()
        first = ipc.read_message(reader)                   # a stream without batches ends here
        self.stride = reader.tell() - self.head if first is not None and first.type == "record batch" else 0
        self.rows = ipc.read_record_batch(first, self.schema).num_rows if self.stride else 0
        self.seq_len = self.schema.field("ids").type.list_size

    def __len__(self) -> int:
        return (len(self.buffer) - self.head) // self.stride * self.rows if self.stride else 0

    def sequence(self, i: int) -> tuple[np.ndarray, pa.BooleanArray]:
        at = self.head + i // self.rows * self.stride
        batch = ipc.read_record_batch(ipc.read_message(self.buffer.slice(at, self.stride)), self.schema)
        k, n = i % self.rows, self.seq_len
        ids, mask = batch.column(0).values, batch.column(1).values
        return ids.slice(k * n, n).to_numpy(zero_copy_only=True), mask.slice(k * n, n)


def write_token_files(docs: DataFrame, tokenizer_file: str, out_dir: str, end_id: int = 0, seq_len: int = 1024, batch_rows: int = 32,
                      file_bytes: int = 32 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and write ``docs`` in ascending order of the integer id; returns the manifest
    (part, path, n_docs, n_tokens, n_sequences, start), start being the number of ids in
    all files before.  ``file_bytes`` is the text that one file aims to hold."""
    narrow = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    size = narrow.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-size // file_bytes), min(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), size >> 20))
    dealt = narrow.repartitionByRange(n, "id").sortWithinPartitions("id", F.xxhash64("text"))
    out_schema = pa.schema([("part", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("n_sequences", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, index, total = None, [], 0
        table = byte_table(tokenizer_file)
        part = TaskContext.get().partitionId()
        path = f"{out_dir}/part-{part:06d}-{uuid.uuid4().hex}.arrows"
        for batch in batches:
            for rows in steps(batch):
                if writer is None:
                    where, inner = _open(out_dir)
                    where.create_dir(inner, recursive=True)
                    writer = Writer(path, seq_len, batch_rows, table.coders[0].n_ids > 1 << 16)
                (flat, offsets), = table.encode(rows.column(1))
                ends = offsets[1:] + np.arange(rows.num_rows)            # places of the end ids
                ids = np.full(len(flat) + rows.num_rows, end_id, dtype=np.uint32)
                real = np.ones(len(ids), dtype=bool)
                real[ends] = False
                ids[real] = flat
                lens = np.diff(ends, prepend=-1)
                index.append((rows.column(0), total + ends + 1 - lens, lens))
                total += len(ids)
                writer.add(ids)
        if writer is None:
            return
        writer.close()
        where, inner = _open(path + ".index")
        table = pa.RecordBatch.from_arrays([pa.concat_arrays([i for i, _, _ in index]), *(pa.array(np.concatenate(x)) for x in list(zip(*index))[1:])], schema=INDEX)
        with where.open_output_stream(inner) as sink, ipc.new_stream(sink, INDEX) as stream:
            stream.write_batch(table)
        yield pa.RecordBatch.from_pydict({"part": [part], "path": [path], "n_docs": [table.num_rows], "n_tokens": [total], "n_sequences": [writer.sequences]}, schema=out_schema)

    manifest = write_shared(dealt.mapInArrow(run, MANIFEST), "manifest")
    before = F.sum("n_tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))   # one row a file
    return manifest.withColumn("start", F.coalesce(before, F.lit(0)).cast("bigint"))


def read_documents(manifest: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Read the files back: (id, start, n_tokens, ids_crc32) per document, start counted over
    all files; each file is streamed batch by batch by one task."""

    out_schema = pa.schema([("id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                where, inner = _open(path + ".index")
                with where.open_input_stream(inner) as source:
                    index = ipc.open_stream(source).read_all()
                begins, lengths = np.asarray(index.column("start")), np.asarray(index.column("n_tokens"))
                ends, crc, at, doc = begins + lengths, np.zeros(len(begins), dtype=np.int64), 0, 0
                where, inner = _open(path)
                with where.open_input_stream(inner) as source:
                    for rows in ipc.open_stream(source):
                        ids = rows.column(0).values.to_numpy()
                        real = rows.column(1).values.true_count
                        ids = ids[:real].astype("<u4")
                        while doc < len(begins) and begins[doc] < at + real:
                            a, b = max(0, begins[doc] - at), min(real, ends[doc] - at)
                            crc[doc] = zlib.crc32(ids[a:b].tobytes(), int(crc[doc]))
                            if ends[doc] > at + real:
                                break
                            doc += 1
                        at += real
                yield pa.RecordBatch.from_arrays([index.column("id").combine_chunks(), pa.array(begins + start), pa.array(lengths), pa.array(crc)], schema=out_schema)

    files = manifest.select("path", "start")
    dealt = files.repartition(max(1, min(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")), 10_000)), F.xxhash64("path"))
    return dealt.mapInArrow(run, "id bigint, start bigint, n_tokens bigint, ids_crc32 bigint").withColumnRenamed("id", id_col)


def encode_and_read(docs: DataFrame, tokenizer_file: str, **options) -> DataFrame:
    """Write ``docs`` to a fresh folder of the shared place and read the documents back."""
    out_dir = new_shared_path(docs.sparkSession, "tokens")
    return read_documents(write_token_files(docs, tokenizer_file, out_dir, **options), options.get("id_col", "doc_id"))
