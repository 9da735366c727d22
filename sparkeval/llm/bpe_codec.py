"""Operator 9 - byte-level BPE encoding and decoding in padded numpy matrices.

Distinct pattern pieces of a batch of texts are encoded together: pieces are bucketed by
length, every bucket is one padded matrix of token ids, and in each round every row merges
its leftmost minimum-rank pair.  Ranks of pairs come from an open-addressing hash table in
numpy; finished rows leave the matrix (compaction).  A piece that is itself a token is
taken as that token first, as the rank files' library does.

Pieces longer than a matrix row are cut into rows.  A sequence of tokens is the encoding of
its bytes exactly when each adjacent pair of tokens is the encoding of its own bytes, so
rows are joined by encoding a window around the cut again: when the window's first and last
tokens come out unchanged, every adjacent pair is proven; otherwise the window grows.

Defined cases: null text = empty text = no ids; texts without spaces take linear time.
"""

from __future__ import annotations

import base64
import hashlib
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts

ROW_BYTES = 64                 # longest matrix row
CACHED_PIECES = 600_000       # a worker process; emptied when full
_MIX = np.uint64(0x9E3779B97F4A7C15)


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class PairTable:
    """(left id, right id) -> rank of the joined bytes, by vectorised linear probing."""

    def __init__(self, ranks: dict[bytes, int]):
        keys, values = [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    keys.append(a << 32 | b)
                    values.append(rank)
        self.bits = max(4, int(len(keys) * 3).bit_length())
        size = 1 << self.bits
        self.keys, self.values = np.full(size, -1, dtype=np.int64), np.zeros(size, dtype=np.int64)
        key, value = np.array(keys, dtype=np.int64), np.array(values, dtype=np.int64)
        slot, self.probes = self.slot(key), 1
        while len(key):
            empty = self.keys[slot] < 0
            self.keys[slot[empty]], self.values[slot[empty]] = key[empty], value[empty]
            missed = self.keys[slot] != key  # taken by another key
            self.values[slot[~missed]] = value[~missed]
            key, value, slot = key[missed], value[missed], (slot[missed] + 1) & (size - 1)
            self.probes += 1

    def slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * _MIX) >> np.uint64(64 - self.bits)).astype(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray, none: int) -> np.ndarray:
        key = (left.astype(np.int64) << 32) | right
        slot = self.slot(key)
        found = self.keys[slot]
        out = np.where(found == key, self.values[slot], none)
        open_ = np.flatnonzero((found != key) & (found >= 0))
        for _ in range(self.probes):
            if not len(open_):
                break
            slot[open_] = (slot[open_] + 1) & (len(self.keys) - 1)
            found = self.keys[slot[open_]]
            hit = found == key[open_]
            out[open_[hit]] = self.values[slot[open_[hit]]]
            open_ = open_[~hit & (found >= 0)]
        return out


class MatrixBPE:
    """Encoder and decoder for one rank file and split pattern."""

    def __init__(self, path: str, pattern: str):
        import regex

        self.ranks = load_ranks(path)
        self.split = regex.compile(pattern)
        self.table = PairTable(self.ranks)
        self.none = max(self.ranks.values()) + 1
        self.byte_ids = np.array([self.ranks.get(bytes([b]), -1) for b in range(256)], dtype=np.int64)
        if (self.byte_ids < 0).any():
            raise ValueError("the rank file lacks single bytes")
        size = self.none
        self.token_bytes: list[bytes] = [b""] * size
        for token, rank in self.ranks.items():
            self.token_bytes[rank] = token
        self.shared = list(range(size))                     # one int object an id
        self.decimal = list(map(str, self.shared))
        self.pieces: dict[str, tuple[int, ...]] = {}

    # -- rows ---------------------------------------------------------------
    def merge_rows(self, rows: list[bytes]) -> list[list[int]]:
        """Plain merges (no whole-token shortcut) of byte strings up to a few rows long."""
        out: list[list[int]] = [[] for _ in rows]
        by_width: dict[int, list[int]] = {}
        for i, r in enumerate(rows):
            n = len(r)
            if n == 1:
                out[i] = [int(self.byte_ids[r[0]])]
            elif n:
                by_width.setdefault(n if n <= 16 else 1 << (n - 1).bit_length(), []).append(i)
        for width, members in by_width.items():
            for at in range(0, len(members), 65536 // width + 1):
                self._matrix(rows, members[at:at + 65536 // width + 1], width, out)
        return out

    def _matrix(self, rows, members, width, out) -> None:
        ids = np.full((len(members), width), -1, dtype=np.int64)
        length = np.array([len(rows[i]) for i in members])
        flat = self.byte_ids[np.frombuffer(b"".join(rows[i] for i in members), dtype=np.uint8)]
        ids[np.arange(width) < length[:, None]] = flat
        which = np.array(members)
        columns = np.arange(width)
        ranks = self._pair_ranks(ids)
        while True:
            at = ranks.argmin(axis=1)                      # argmin: leftmost of the minima
            best = ranks[np.arange(len(ids)), at]
            done = best >= self.none
            if done.any():
                for i in np.flatnonzero(done):
                    out[which[i]] = ids[i, :length[i]].tolist()
                keep = ~done
                if not keep.any():
                    return
                ids, length, which, at, best, ranks = ids[keep], length[keep], which[keep], at[keep], best[keep], ranks[keep]
            row = np.arange(len(ids))
            moved = columns[:-1] > at[:, None]             # compaction: close the gap after the pair
            ids[:, :-1] = np.where(moved, ids[:, 1:], ids[:, :-1])
            ids[:, -1] = -1
            ids[row, at] = best
            length = length - 1
            gap = columns[:ranks.shape[1] - 1] > at[:, None]
            ranks[:, :-1] = np.where(gap, ranks[:, 1:], ranks[:, :-1])
            ranks[:, -1] = self.none
            right = np.flatnonzero(at + 1 < length)
            ranks[row, at] = self.none
            ranks[right, at[right]] = self.table.ranks(ids[right, at[right]], ids[right, at[right] + 1], self.none)
            left = np.flatnonzero(at > 0)
            ranks[left, at[left] - 1] = self.table.ranks(ids[left, at[left] - 1], ids[left, at[left]], self.none)
            most = int(length.max())
            if most < ids.shape[1] - 4:                    # drop columns that no row uses
                ids, ranks, columns = ids[:, :most].copy(), ranks[:, :max(1, most - 1)].copy(), columns[:most]

    def _pair_ranks(self, ids: np.ndarray) -> np.ndarray:
        left, right = ids[:, :-1], ids[:, 1:]
        out = np.full(left.shape, self.none, dtype=np.int64)
        real = right >= 0
        out[real] = self.table.ranks(left[real], right[real], self.none)
        return out

    # -- pieces -------------------------------------------------------------
    def encode_pieces(self, pieces: list[bytes]) -> list[list[int]]:
        out: list[list[int] | None] = [None] * len(pieces)
        short, long_ = [], []
        for i, p in enumerate(pieces):
            whole = self.ranks.get(p)
            if whole is not None:
                out[i] = [whole]
            elif len(p) <= ROW_BYTES:
                short.append(i)
            else:
                long_.append(i)
        for i, ids in zip(short, self.merge_rows([pieces[i] for i in short])):
            out[i] = ids
        for i in long_:
            out[i] = self._long(pieces[i])
        return out

    def _long(self, piece: bytes) -> list[int]:
        parts = self.merge_rows([piece[a:a + ROW_BYTES] for a in range(0, len(piece), ROW_BYTES)])
        while len(parts) > 1:                              # join neighbours, all pairs of one level together
            parts = self._join([(parts[i], parts[i + 1]) for i in range(0, len(parts) - 1, 2)]) + ([parts[-1]] if len(parts) % 2 else [])
        return parts[0]

    def _join(self, pairs: list[tuple[list[int], list[int]]]) -> list[list[int]]:
        out: list[list[int] | None] = [None] * len(pairs)
        todo, reach = list(range(len(pairs))), 4
        while todo:
            windows = []
            for i in todo:
                a, b = pairs[i]
                windows.append(b"".join(self.token_bytes[t] for t in a[-reach:] + b[:reach]))
            again = []
            for i, w in zip(todo, self.merge_rows(windows)):
                a, b = pairs[i]
                head, tail = a[-reach:], b[:reach]
                left_ok = len(a) <= reach or w[0] == head[0]
                right_ok = len(b) <= reach or w[-1] == tail[-1]
                if left_ok and right_ok:
                    out[i] = a[:max(0, len(a) - reach)] + w + b[reach:]
                else:
                    again.append(i)
            todo, reach = again, reach * 2
        return out

    # -- texts --------------------------------------------------------------
    def encode_batch(self, texts: list[str]) -> list[list[int]]:
        """Ids of whole texts; the pieces not seen before are encoded together."""
        known = self.pieces
        split = [self.split.findall(t) if t else [] for t in texts]
        new = set().union(*split).difference(known)
        if len(known) + len(new) > CACHED_PIECES:
            known.clear()
            new = set().union(*split)
        new = list(new)
        for piece, ids in zip(new, self.encode_pieces([p.encode() for p in new])):
            known[piece] = tuple(map(self.shared.__getitem__, ids))
        out = [list(chain.from_iterable(map(known.__getitem__, pieces))) for pieces in split]
        for piece in new:
            if len(piece) > ROW_BYTES:
                del known[piece]
        return out

    def decode(self, ids) -> bytes:
        return b"".join(map(self.token_bytes.__getitem__, ids))


_CODECS: dict[tuple[str, str], MatrixBPE] = {}


def codec_for(rank_file: str, pattern: str) -> MatrixBPE:
    """One codec a worker process: later tasks find its pieces known."""
    if (rank_file, pattern) not in _CODECS:
        _CODECS[rank_file, pattern] = MatrixBPE(rank_file, pattern)
    return _CODECS[rank_file, pattern]


def bpe_encode(docs: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id and ``ids`` (array<int>) per row of ``docs``; map-only."""

    def make():
        codec = codec_for(rank_file, pattern)

        def step(rows):
            return {"id": rows["id"], "ids": codec.encode_batch([t or "" for t in rows["text"]])}

        return step

    out = map_texts(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")),
                    f"id {dict(docs.dtypes)[id_col]}, ids array<int>", make)
    return out.withColumnRenamed("id", id_col)


def bpe_decode(encoded: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Id and ``bytes`` (the decoded byte string) per row; null ids decode to no bytes."""

    def make():
        codec = codec_for(rank_file, pattern)
        return lambda rows: {"id": rows["id"], "bytes": [codec.decode(x or []) for x in rows["ids"]]}

    out = map_texts(encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids")),
                    f"id {dict(encoded.dtypes)[id_col]}, bytes binary", make)
    return out.withColumnRenamed("id", id_col)


def bpe_round_trip(docs: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode in one pass: id, n_tokens, ids_sha256 (decimal ids joined by
    commas) and decoded_sha256 (of the decoded bytes)."""

    def make():
        codec = codec_for(rank_file, pattern)

        def step(rows):
            ids = codec.encode_batch([t or "" for t in rows["text"]])
            return {
                "id": rows["id"], "n_tokens": [len(x) for x in ids],
                "ids_sha256": [hashlib.sha256(",".join(map(codec.decimal.__getitem__, x)).encode()).hexdigest() for x in ids],
                "decoded_sha256": [hashlib.sha256(codec.decode(x)).hexdigest() for x in ids],
            }

        return step

    out = map_texts(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")),
                    f"id {dict(docs.dtypes)[id_col]}, n_tokens bigint, ids_sha256 string, decoded_sha256 string", make)
    return out.withColumnRenamed("id", id_col)
