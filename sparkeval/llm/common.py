"""Helpers shared by the training-data operators: words, shared tables, Arrow batches."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

# A word is a run of characters that are neither a space nor U+0009..U+000D.
WORD = r"[^\x20\x09-\x0D]+"
WORD_RE = re.compile(WORD)
GAP = r"[\x20\x09-\x0D]+"

# Texts handled by one step inside a task: bounds the memory of a Python worker.
ROWS_PER_STEP = 256


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session;
    a folder of this machine only where the session names none (tests)."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="sparkeval-llm-"))
        named = sc.getCheckpointDir()
    return named.rstrip("/")


def new_shared_path(spark: SparkSession, tag: str) -> str:
    """A fresh path in the shared folder, deleted by Hadoop when the driver ends."""
    path = f"{shared_folder(spark)}/llm-{tag}-{uuid.uuid4().hex}"
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    return path


def delete_shared(spark: SparkSession, path: str) -> None:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


def write_shared(df: DataFrame, tag: str) -> DataFrame:
    """Cut lineage: write ``df`` once as Parquet in the shared folder and read it back.
    A lost executor loses nothing of it."""
    path = new_shared_path(df.sparkSession, tag)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._shared_path = path
    return out


def delete_written(*tables: DataFrame) -> None:
    """Delete tables of ``write_shared`` whose last reader has been written."""
    for t in tables:
        delete_shared(t.sparkSession, t._shared_path)


def map_texts(df: DataFrame, schema: str, make: Callable[[], Callable[[list], dict]]) -> DataFrame:
    """Apply ``make()(columns) -> columns`` to slices of a narrow DataFrame, batch by batch.

    ``make`` runs once per task (models, caches); its function gets a dict of Python lists
    and returns a dict of lists with the columns of ``schema``."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_PER_STEP):
                part = batch.slice(at, ROWS_PER_STEP)
                out = step({n: part.column(i).to_pylist() for i, n in enumerate(part.schema.names)})
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, schema)


_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _M2
    return x ^ (x >> np.uint64(29))


def word_codes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(ids of all words, offsets by text, dictionary) of an array of texts."""
    parts = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))    # splits at U+0020, U+0009..U+000D
    flat = parts.flatten()
    real = np.asarray(pc.greater(pc.binary_length(flat), 0))
    owner = np.asarray(pc.list_parent_indices(parts))[real]
    coded = flat.filter(pa.array(real)).dictionary_encode()
    offsets = np.searchsorted(owner, np.arange(len(texts) + 1))
    return np.asarray(coded.indices).astype(np.int64), offsets, coded.dictionary


def word_hashes(dictionary: pa.Array, seed: int) -> np.ndarray:
    """64-bit hashes of the strings of an array, eight bytes of all strings at a time."""
    n = len(dictionary)
    if not n:
        return np.zeros(0, dtype=np.uint64)
    array = dictionary.cast(pa.large_binary())
    ends = np.frombuffer(array.buffers()[1], dtype=np.int64)[array.offset:array.offset + n + 1]
    data = np.concatenate([np.frombuffer(array.buffers()[2] or b"", dtype=np.uint8), np.zeros(8, dtype=np.uint8)])
    chunks = np.lib.stride_tricks.as_strided(data[:8].view("<u8"), shape=(len(data) - 7,), strides=(1,))    # eight bytes at any place
    start, left = ends[:-1].copy(), np.diff(ends)
    out = mix((left.astype(np.uint64) + np.uint64(seed)) * _M1)
    live = np.arange(n)
    while len(live):
        some = left[live]
        tail = np.where(some < 8, (np.uint64(1) << (np.minimum(some, 7).astype(np.uint64) * np.uint64(8))) - np.uint64(1), ~np.uint64(0))
        out[live] = mix((out[live] ^ (chunks[start[live]] & tail)) * _M1)
        start[live] += 8
        left[live] -= 8
        live = live[left[live] > 0]
    return out


def rolling_hash(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of ``n`` word hashes (as many entries as h, the last n-1 unused)."""
    out = np.zeros(len(h), dtype=np.uint64)
    for j in range(n):
        out[:len(h) - j] = out[:len(h) - j] * _M1 + h[j:]
    return mix(out)
