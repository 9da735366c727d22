"""Operator 12 - alignment of two tokenizers by galloping intersection.

The byte ends of a document's tokens are two ascending lists.  The shorter one drives: for each
of its ends an exponential search from its proportional place brackets the place in the longer
list and a binary search finds it.  Ends that are in both cut the document into groups; the
differences of the ranks of neighbouring common ends are the ranges of tokens that overlap.
All documents of a step are searched together, in numpy.

Two token occurrences of a group are a link.  The count of an id pair is the number of
documents that hold it linked: a share of documents lists its distinct pairs once with its
counts, buckets of pairs add them up and answer (``shares``).  The highest count by id is a
table bounded by the vocabulary.

Defined cases: a text that is null, empty, or not given back by the tokens' bytes has no tokens
(zeros, empty digest); special strings are ordinary text; repeated rows and null ids are
documents of their own; an empty table gives no rows; a long group's links are taken by
distinct ids, never listed one by one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import write_shared
from .shares import answers_of, arrow_schema, asked, buckets_for, numbered, packed, rows_of, share_ids, totals, unpacked
from .word_ids import pair_table, steps

SHARE_BYTES, STEP = 4 << 20, 1 << 20                       # text of a share, and of one step of the alignment
LISTED = 256                                               # links of a group that are listed one by one


def gallop(x: np.ndarray, long: np.ndarray, guess: np.ndarray) -> np.ndarray:
    """For each of ``x`` the first place in the ascending ``long`` that isn't less; the last of
    ``long`` is no less than any."""
    high = np.clip(guess, 0, len(long) - 1)
    low = high - 1                                         # long[low] < x <= long[high], as soon as both hold
    step, live = 1, np.flatnonzero(long[high] < x)
    while len(live):
        low[live] = high[live]
        high[live] = np.minimum(high[live] + step, len(long) - 1)
        live, step = live[long[high[live]] < x[live]], step * 2
    step, live = 1, np.flatnonzero(low >= 0)
    live = live[long[low[live]] >= x[live]]
    while len(live):
        high[live] = low[live]
        low[live] = np.maximum(low[live] - step, -1)
        live, step = live[low[live] >= 0], step * 2
        live = live[long[low[live]] >= x[live]]
    live = np.flatnonzero(high - low > 1)
    while len(live):
        middle = (low[live] + high[live]) >> 1
        less = long[middle] < x[live]
        low[live[less]], high[live[~less]] = middle[less], middle[~less]
        live = live[high[live] - low[live] > 1]
    return high


def common_ends(a: np.ndarray, a_off: np.ndarray, b: np.ndarray, b_off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places in a, places in b) of the ends that both have; documents are ranges of the lists,
    and those of one document lie above those of the documents before it."""
    n_a, n_b = np.diff(a_off), np.diff(b_off)
    out = []
    for short, s_off, long, l_off, drives in ((a, a_off, b, b_off, n_a <= n_b), (b, b_off, a, a_off, n_a > n_b)):
        n_short, n_long = np.diff(s_off), np.diff(l_off)
        docs = np.flatnonzero(drives & (n_short > 0))
        doc = np.repeat(docs, n_short[docs])
        place = np.arange(len(doc)) - np.repeat(np.cumsum(n_short[docs]) - n_short[docs], n_short[docs]) + s_off[doc]
        x = short[place]
        last = short[s_off[1:][docs] - 1] if len(docs) else short[:0]
        begin = np.concatenate([[0], short[:-1]])[s_off[:-1][docs]] if len(docs) else last
        size = np.repeat(np.maximum(last - begin, 1), n_short[docs])
        guess = l_off[doc] + (x - np.repeat(begin, n_short[docs])) * n_long[doc] // size
        at = gallop(x, long, guess) if len(x) else place
        same = long[at] == x if len(x) else np.zeros(0, dtype=bool)
        pair = (place[same], at[same])
        out.append(pair if short is a else pair[::-1])
    in_a, in_b = (np.concatenate([out[0][i], out[1][i]]) for i in range(2))
    order = np.argsort(in_a, kind="stable")
    return in_a[order], in_b[order]


class Groups:
    """The groups of a step's documents: ranges of both token lists."""

    def __init__(self, a: np.ndarray, a_off: np.ndarray, b: np.ndarray, b_off: np.ndarray, a_bytes: np.ndarray, b_bytes: np.ndarray):
        self.a, self.b, self.a_off, self.b_off = a, b, a_off, b_off
        last_a, last_b = common_ends(np.cumsum(a_bytes[a]), a_off, np.cumsum(b_bytes[b]), b_off)
        self.end_a, self.end_b = last_a + 1, last_b + 1
        self.n_a, self.n_b = np.diff(self.end_a, prepend=0), np.diff(self.end_b, prepend=0)
        self.doc = np.searchsorted(a_off, last_a, side="right") - 1

    def links(self, ids_b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, pair code a * ids_b + b, how many) of all links; a pair may come up again."""
        each = self.n_a * self.n_b
        few = np.flatnonzero(each <= LISTED)
        g = np.repeat(few, each[few])
        r = np.arange(len(g)) - np.repeat(np.cumsum(each[few]) - each[few], each[few])
        a = self.a[self.end_a[g] - self.n_a[g] + r // self.n_b[g]].astype(np.int64)
        b = self.b[self.end_b[g] - self.n_b[g] + r % self.n_b[g]]
        docs, codes, times = [self.doc[g].astype(np.int32)], [a * ids_b + b], [np.ones(len(g), dtype=np.int32)]
        for k in np.flatnonzero(each > LISTED):
            x, n = np.unique(self.a[self.end_a[k] - self.n_a[k]:self.end_a[k]].astype(np.int64), return_counts=True)
            y, m = np.unique(self.b[self.end_b[k] - self.n_b[k]:self.end_b[k]].astype(np.int64), return_counts=True)
            codes.append((x[:, None] * ids_b + y).ravel())
            times.append((n[:, None] * m).ravel())
            docs.append(np.full(len(codes[-1]), self.doc[k], dtype=np.int32))
        return np.concatenate(docs), np.concatenate(codes), np.concatenate(times)

    def digests(self, spelled: pa.Array, ids_a: int, ids_b: int) -> list[str]:
        """sha256 of each document's groups; ``spelled`` are the ids with what follows them."""
        text = np.empty(len(self.a) + len(self.b), dtype=np.int64)
        first_a, first_b = self.end_a - self.n_a, self.end_b - self.n_b
        group_a, group_b = np.repeat(np.arange(len(self.n_a)), self.n_a), np.repeat(np.arange(len(self.n_b)), self.n_b)
        kind_a, kind_b = self.a.astype(np.int64), self.b.astype(np.int64) + 2 * ids_a
        kind_a[self.end_a - 1] += ids_a
        kind_b[self.end_b - 1] += ids_b
        text[np.arange(len(self.a)) + first_b[group_a]] = kind_a
        text[np.arange(len(self.b)) + self.end_a[group_b]] = kind_b
        out = spelled.take(pa.array(text))
        ends = np.frombuffer(out.buffers()[1], dtype=np.int64)
        data = memoryview(out.buffers()[2] or b"")
        cut = ends[self.a_off + self.b_off]
        return [hashlib.sha256(data[s:e - 1]).hexdigest() if e > s else "" for s, e in zip(cut[:-1].tolist(), cut[1:].tolist())]


@cache
def spellings(ids_a: int, ids_b: int) -> pa.Array:
    """Ids as text: a inside a group, a before |, b inside a group, b before ;"""
    text = [f"{i}," for i in range(ids_a)] + [f"{i}|" for i in range(ids_a)] + [f"{i}," for i in range(ids_b)] + [f"{i};" for i in range(ids_b)]
    return pa.array(text, pa.large_string())


def align(docs: DataFrame, byte_file: str, piece_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_a, n_b, n_groups, n_links, n_best, count_sum and
    groups_sha256."""
    kind = dict(docs.dtypes)[id_col]
    ddl = (f"share bigint, bucket int, keys binary, n binary, id array<{kind}>, n_a array<bigint>, n_b array<bigint>, n_groups array<bigint>, "
           "n_links array<bigint>, groups_sha256 array<string>, held binary, place binary, times binary")
    schema = arrow_schema(ddl)
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    n_buckets = buckets_for(narrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pair_table(byte_file, piece_file)
        coder_a, coder_b = table.coders
        spelled, span = spellings(coder_a.n_ids, coder_b.n_ids), coder_a.n_ids * coder_b.n_ids
        numbers, held, size = share_ids(), [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            each, code, many = (np.concatenate([h[i] for h in held]) for i in range(3))
            pairs, place, n = np.unique(code, return_inverse=True, return_counts=True)
            order, bucket, rank = numbered(pairs.astype(np.uint64), n_buckets)
            pairs, n, share = pairs[order].astype(np.uint64), n[order].astype(np.uint32), next(numbers)
            columns = {name: [x for h in held for x in h[3][name]] for name in held[0][3]}
            rows = [{"share": share, "keys": packed(pairs), "held": packed(each),
                     "place": packed(rank[place].astype(np.uint32)), "times": packed(many), **columns}]
            rows += [{"share": share, "bucket": b, "keys": packed(pairs[s]), "n": packed(n[s])} for b, s in asked(bucket, n_buckets)]
            yield rows_of(schema, rows)

        for batch in batches:
            for rows in steps(batch, most=STEP):
                (a, a_off), (b, b_off) = table.encode(rows.column(1))
                a, a_off, b, b_off = both_or_none(a, a_off, b, b_off)
                groups = Groups(a, a_off, b, b_off, coder_a.n_bytes, coder_b.n_bytes)
                doc, code, times = groups.links(coder_b.n_ids)
                key, at = np.unique(doc.astype(np.int64) * span + code, return_inverse=True)    # pairs of a document
                many = np.zeros(len(key), dtype=np.uint32)
                np.add.at(many, at, times.astype(np.uint32))
                each = np.zeros(rows.num_rows, dtype=np.int64)
                np.add.at(each, groups.doc, groups.n_a * groups.n_b)
                columns = {"id": rows.column(0).to_pylist(), "n_a": np.diff(a_off).tolist(), "n_b": np.diff(b_off).tolist(), "n_links": each.tolist(),
                           "n_groups": np.bincount(groups.doc, minlength=rows.num_rows).tolist(), "groups_sha256": groups.digests(spelled, coder_a.n_ids, coder_b.n_ids)}
                held.append((np.bincount(key // span, minlength=rows.num_rows).astype(np.uint32), key % span, many, columns))
                size += pc.sum(pc.binary_length(rows.column(1))).as_py() or 0
                if size >= SHARE_BYTES:
                    yield from flush()
                    held, size = [], 0
        if held:
            yield from flush()

    level = write_shared(narrow.mapInArrow(run, ddl), "links")
    tally_ddl = "share bigint, bucket int, found binary, a array<int>, most array<bigint>"
    tally_schema = arrow_schema(tally_ddl)
    ids_b = pair_table(byte_file, piece_file).coders[1].n_ids

    def tally(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        keys, n, places = totals(table.column("keys").to_pylist(), table.column("n").to_pylist())
        a = (keys // np.uint64(ids_b)).astype(np.int64)    # keys are sorted, so equal ids stand together
        first = np.flatnonzero(np.diff(a, prepend=-1))
        rows = [{"share": s, "bucket": bucket, "found": packed(n[p])} for s, p in zip(table.column("share").to_pylist(), places)]
        rows.append({"bucket": bucket, "a": a[first].tolist(), "most": np.maximum.reduceat(n, first).tolist()})
        return pa.Table.from_batches([rows_of(tally_schema, rows)])

    found = write_shared(level.filter("bucket is not null").select("share", "bucket", "keys", "n").groupBy("bucket").applyInArrow(tally, tally_ddl), "pair-counts")
    highest = found.filter("share is null").select(F.inline(F.arrays_zip("a", "most"))).groupBy("a").agg(F.max("most").alias("most")).toArrow()
    best = np.zeros(pair_table(byte_file, piece_file).coders[0].n_ids, dtype=np.int64)    # one number an id: bounded by the vocabulary
    best[np.asarray(highest.column("a").combine_chunks())] = np.asarray(highest.column("most").combine_chunks())
    shared = docs.sparkSession.sparkContext.broadcast(best)
    out_ddl = f"id {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"
    out_schema = arrow_schema(out_ddl)

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.Table.from_batches([], schema=out_schema)
        row = {n: left.column(n).combine_chunks() for n in left.schema.names}
        blob = lambda name: unpacked(row[name][0].as_py())
        count, a = answers_of(right, "found"), (blob("keys") // np.uint64(ids_b)).astype(np.int64)
        top = count == shared.value[a]
        held, place, times = blob("held").astype(np.int64), blob("place"), blob("times").astype(np.int64)
        doc = np.repeat(np.arange(len(held)), held)
        n_best, count_sum = np.zeros(len(held), dtype=np.int64), np.zeros(len(held), dtype=np.int64)
        np.add.at(n_best, doc, times * top[place])
        np.add.at(count_sum, doc, times * count[place])
        more = {"n_best": pa.array(n_best), "count_sum": pa.array(count_sum)}
        return pa.Table.from_arrays([more[f.name] if f.name in more else row[f.name].flatten() for f in out_schema], schema=out_schema)

    shares = level.filter("bucket is null").drop("bucket", "n")
    answers = found.filter("share is not null").select("share", "bucket", "found")
    return shares.groupBy("share").cogroup(answers.groupBy("share")).applyInArrow(score, out_ddl).withColumnRenamed("id", id_col)


def both_or_none(a: np.ndarray, a_off: np.ndarray, b: np.ndarray, b_off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Documents that have tokens of one kind only lose them: their bytes are not the text's."""
    n_a, n_b = np.diff(a_off), np.diff(b_off)
    lone = (n_a > 0) != (n_b > 0)
    if not lone.any():
        return a, a_off, b, b_off
    a, b = a[np.repeat(~lone, n_a)], b[np.repeat(~lone, n_b)]
    return a, np.concatenate([[0], np.cumsum(np.where(lone, 0, n_a))]), b, np.concatenate([[0], np.cumsum(np.where(lone, 0, n_b))])
