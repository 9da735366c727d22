"""Counting keys over a corpus, share by share.

A share is a bounded run of documents of one map task.  It lists its distinct keys with their
counts once, cut by hash into buckets; one row carries all keys of a share for a bucket, packed.
A bucket puts the lists of all shares together, decides, and answers each share in the order
of its list.  So a frequent key costs one entry a share, however many documents hold it, and a
share's answers come back to it without any row per occurrence.

The numbering of a share's keys is (bucket, key).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix

BUCKET_BYTES = 32 << 20                                    # text behind one bucket


def packed(x: np.ndarray) -> bytes:
    """The numbers of an array, compressed; sorted ones as differences."""
    x = np.ascontiguousarray(x)
    return len(x).to_bytes(8, "little") + x.dtype.char.encode() + pa.compress(x.tobytes(), "zstd", asbytes=True)


def unpacked(blob: bytes) -> np.ndarray:
    kind = np.dtype(blob[8:9].decode())
    size = int.from_bytes(blob[:8], "little") * kind.itemsize
    return np.frombuffer(pa.decompress(blob[9:], size, "zstd", asbytes=True), dtype=kind)


def buckets_for(texts: DataFrame, text: str = "text") -> int:
    """So many that one holds the keys of BUCKET_BYTES of text, and one a shuffle partition at least."""
    size = texts.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return max(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET_BYTES))


def share_ids() -> Iterator[int]:
    """Numbers that no other task of the stage gives."""
    base = TaskContext.get().partitionId() << 32
    while True:
        yield base
        base += 1


def bucket_of(keys: np.ndarray, n_buckets: int) -> np.ndarray:
    return ((mix(keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)) % np.uint64(n_buckets)).astype(np.int64)


def asked(bucket: np.ndarray, n_buckets: int) -> Iterator[tuple[int, slice]]:
    """Ranges of equal numbers in the sorted ``bucket``."""
    cut = np.searchsorted(bucket, np.arange(n_buckets + 1))
    for i in np.flatnonzero(np.diff(cut)):
        yield int(i), slice(int(cut[i]), int(cut[i + 1]))


def numbered(keys: np.ndarray, n_buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, bucket, rank): sorted distinct ``keys`` by (bucket, key), their buckets in that
    order, and the number of each key."""
    bucket = bucket_of(keys, n_buckets)
    order = np.argsort(bucket, kind="stable")
    rank = np.empty(len(order), dtype=np.int64)
    rank[order] = np.arange(len(order))
    return order, bucket[order], rank


def totals(key_blobs: list[bytes], n_blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(distinct keys, their counts over all lists, the place of each list's keys among them)."""
    keys = [unpacked(x) for x in key_blobs]
    flat = np.concatenate(keys) if keys else np.zeros(0, dtype=np.uint64)
    n = np.concatenate([unpacked(x).astype(np.int64) for x in n_blobs]) if keys else np.zeros(0, dtype=np.int64)
    distinct, place = np.unique(flat, return_inverse=True)
    count = np.zeros(len(distinct), dtype=np.int64)
    np.add.at(count, place, n)
    return distinct, count, np.split(place, np.cumsum([len(x) for x in keys])[:-1]) if keys else []


def answers_of(table: pa.Table, column: str) -> np.ndarray:
    """All answers to a share, in its own numbering."""
    by_bucket = dict(zip(table.column("bucket").to_pylist(), table.column(column).to_pylist()))
    parts = [unpacked(by_bucket[b]) for b in sorted(by_bucket)]
    return np.concatenate(parts) if parts else np.zeros(0, dtype=np.int64)


def arrow_schema(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def rows_of(schema: pa.Schema, rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r.get(f.name) for r in rows], type=f.type) for f in schema], schema=schema)
