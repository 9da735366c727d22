"""Operator 11 - documents packed into sequences by linear grouping.

The packing is worked out on the number of pieces of each length, at most ``capacity`` numbers
however many documents there are; the pieces themselves stay distributed.

1. One map over the documents encodes them, cuts those longer than a sequence (only the first
   piece may be shorter than one) and numbers the pieces of each length inside its task.
2. ``plan``, from the counts by length: lengths over ``LARGE`` of a sequence are rounded up to
   the largest of their group, the groups being of equal cardinality; the few sizes that are
   left make a cutting-stock program, solved by column generation; each configuration of sizes
   is filled with actual lengths of its groups, largest first; then the rest, longest first,
   goes where it leaves least room.  All steps handle equal sequences together, as runs, so the
   plan's size depends on ``capacity`` only.
3. Runs of (length, number in its length) name the sequence and the place of each piece; the
   plan's runs go to the tasks, the numbers before each task's pieces come by a join.

Defined cases: null text = empty text: only its end id; repeated rows and null ids are
documents of their own; pieces of equal length are interchangeable, their order follows the
written pieces; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import write_shared
from .shares import arrow_schema
from .word_ids import byte_table, steps

GROUPS, LARGE = 160, 0.45                                 # large: over this share of a sequence
ROUNDS, GAIN = 20_000, 1e-4                                # column generation ends; every round keeps a valid packing


def cut_lengths(n: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, start, length) of the pieces of documents of ``n`` tokens."""
    k = -(-n // capacity)
    first = n - (k - 1) * capacity
    doc = np.repeat(np.arange(len(n)), k)
    piece = np.arange(len(doc)) - np.repeat(np.cumsum(k) - k, k)
    start = np.where(piece == 0, 0, first[doc] + (piece - 1) * capacity)
    return doc, start, np.where(piece == 0, first[doc], capacity)


def numbers_within(length: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """The number of each piece among those of its length; ``seen`` counts the earlier ones."""
    order = np.argsort(length, kind="stable")
    sorted_ = length[order]
    number = np.empty(len(length), dtype=np.int64)
    number[order] = np.arange(len(length)) - np.searchsorted(sorted_, sorted_) + seen[sorted_]
    seen += np.bincount(length, minlength=len(seen))
    return number


def pieces_of(docs: DataFrame, tokenizer_file: str, end_id: int, capacity: int, with_ids: bool, id_col: str, text_col: str) -> DataFrame:
    """(id, piece, start, length, ids_crc32, part, number[, ids]); ``ids`` are little-endian
    32-bit numbers."""
    kind = dict(docs.dtypes)[id_col]
    ddl = f"id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, part int, number bigint" + (", ids binary" if with_ids else "")
    schema = arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, part, seen = byte_table(tokenizer_file), TaskContext.get().partitionId(), np.zeros(capacity + 1, dtype=np.int64)
        for batch in batches:
            for rows in steps(batch):
                (flat, offsets), = table.encode(rows.column(1))
                ends = offsets[1:] + np.arange(rows.num_rows)            # places of the end ids
                ids = np.full(len(flat) + rows.num_rows, end_id, dtype="<u4")
                real = np.ones(len(ids), dtype=bool)
                real[ends] = False
                ids[real] = flat
                n = np.diff(ends, prepend=-1)
                doc, start, length = cut_lengths(n, capacity)
                at = (ends - n + 1)[doc] + start
                view = memoryview(ids).cast("B")
                chunks = [view[4 * a:4 * b] for a, b in zip(at.tolist(), (at + length).tolist())]
                columns = [rows.column(0).take(pa.array(doc)), pa.array(np.arange(len(doc)) - np.searchsorted(doc, doc), pa.int32()), pa.array(start), pa.array(length),
                           pa.array([zlib.crc32(c) for c in chunks], pa.int64()), pa.array(np.full(len(doc), part, dtype=np.int32)), pa.array(numbers_within(length, seen))]
                if with_ids:
                    columns.append(pa.array([bytes(c) for c in chunks], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, ddl)


def best_configuration(sizes: np.ndarray, value: np.ndarray, capacity: int) -> np.ndarray:
    """How many of each (ascending) size fill a sequence with the greatest value (unbounded knapsack)."""
    best, choice = np.zeros(capacity + 1), [-1] * (capacity + 1)
    fits = np.searchsorted(sizes, np.arange(capacity + 1), side="right").tolist()
    for room in range(int(sizes[0]), capacity + 1):
        gain = value[:fits[room]] + best[room - sizes[:fits[room]]]
        k = int(gain.argmax())
        if gain[k] > best[room - 1] + 1e-12:
            best[room], choice[room] = gain[k], k
        else:
            best[room] = best[room - 1]
    out, room = np.zeros(len(sizes)), capacity
    while room > 0:
        if choice[room] < 0:
            room -= 1
            continue
        out[choice[room]] += 1
        room -= int(sizes[choice[room]])
    return out


def configurations(sizes: np.ndarray, need: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """(how many of each size, sequences): whole sequences of the cutting-stock program whose
    sizes are all needed; fewer than len(sizes) sequences' worth is left over."""
    basis = np.diag((capacity // sizes).astype(float))     # a column is a configuration
    inverse, need_ = np.linalg.inv(basis), need.astype(float)
    used = inverse @ need_
    for k in range(ROUNDS):
        price = inverse.sum(axis=0)
        column = best_configuration(sizes, price, capacity)
        if price @ column <= 1 + GAIN:
            break
        step = inverse @ column
        can = step > 1e-9
        ratio = np.where(can, np.maximum(used, 0) / np.where(can, step, 1), np.inf)
        out = int(np.argmin(ratio))
        basis[:, out] = column
        row = inverse[out] / step[out]                     # the exchange of one column
        inverse -= np.outer(step, row)
        inverse[out] = row
        if k % 200 == 199:
            inverse = np.linalg.inv(basis)
        used = inverse @ need_
    left, out = need.copy(), []
    for j in np.argsort(-used):
        column = basis[:, j].astype(np.int64)
        held = column > 0
        n = min(int(used[j] + 1e-6), int((left[held] // column[held]).min()))
        if n > 0:
            left -= n * column
            out.append((column, n))
    return out


def equal_groups(counts: np.ndarray, lengths: np.ndarray, groups: int) -> tuple[np.ndarray, np.ndarray]:
    """(sizes, need): the pieces of ``lengths`` (ascending), sorted by length and cut into groups of
    equal cardinality, each rounded up to its largest length."""
    total = int(counts[lengths].sum())
    ends = np.cumsum(counts[lengths])                      # pieces up to each length, ascending
    marks = -(-total * np.arange(1, groups + 1) // groups)
    sizes = lengths[np.searchsorted(ends, marks)]
    need = np.diff(marks, prepend=0)
    sizes, first = np.unique(sizes, return_index=True)
    return sizes, np.add.reduceat(need, first)


def plan(counts: np.ndarray, capacity: int, groups: int = GROUPS) -> tuple[np.ndarray, int]:
    """(runs, sequences) for counts[length] pieces.  A run (length, number, n, sequence, offset)
    puts pieces number .. number + n - 1 of its length into n sequences from ``sequence`` on."""
    counts, done = counts.astype(np.int64).copy(), np.zeros(len(counts), dtype=np.int64)
    runs: list[tuple[int, int, int, int, int]] = []
    free: dict[int, list[tuple[int, int]]] = {}            # room left -> runs of equal sequences
    made = 0

    def put(length: int, n: int, sequence: int, offset: int) -> None:
        runs.append((length, int(done[length]), n, sequence, offset))
        done[length] += n

    if counts[capacity]:
        put(capacity, int(counts[capacity]), 0, 0)
        made = int(counts[capacity])
    lengths = np.flatnonzero(counts[:capacity])
    lengths = lengths[lengths > LARGE * capacity]
    if len(lengths):
        sizes, need = equal_groups(counts, lengths, min(groups, int(counts[lengths].sum())))
        # The pieces of each size, longest first: (length, how many); a length may lie in two sizes.
        waiting: list[list[list[int]]] = [[] for _ in sizes]
        left, room = counts.copy(), need.copy()
        for length in lengths[::-1]:
            for j in range(len(sizes) - 1, -1, -1):
                if sizes[j] >= length and room[j] and left[length]:
                    n = int(min(room[j], left[length]))
                    waiting[j].append([int(length), n])
                    room[j] -= n
                    left[length] -= n
        for column, n in configurations(sizes, need, capacity):
            held = [(made, n, 0)]                          # (first sequence, sequences, filled)
            made += n
            for j in np.flatnonzero(column)[::-1]:
                for _ in range(int(column[j])):
                    after = []
                    for first, k, filled in held:
                        while k:
                            length, there = waiting[j][0]
                            m = min(k, there)
                            put(length, m, first, filled)
                            after.append((first, m, filled + length))
                            first, k = first + m, k - m
                            waiting[j][0][1] -= m
                            if not waiting[j][0][1]:
                                waiting[j].pop(0)
                    held = after
            for first, k, filled in held:
                free.setdefault(capacity - filled, []).append((first, k))
    for length in np.flatnonzero(counts[:capacity] > done[:capacity])[::-1].tolist():
        n = int(counts[length] - done[length])
        while n:
            room = next((r for r in range(length, capacity + 1) if free.get(r)), None)
            if room is None:                               # new sequences
                k = -(-n // (capacity // length))
                free.setdefault(capacity, []).append((made, k))
                made, room = made + k, capacity
            first, k = free[room].pop()
            each = room // length                          # the fullest sequence that fits takes all it can
            full = min(k, n // each)
            for i in range(each if full else 0):
                put(length, full, first, capacity - room + i * length)
            n -= full * each
            if full:
                free.setdefault(room - each * length, []).append((first, full))
            first, k = first + full, k - full
            if k and n:                                    # fewer than one sequence takes
                for i in range(n):
                    put(length, 1, first, capacity - room + i * length)
                free.setdefault(room - n * length, []).append((first, 1))
                first, k, n = first + 1, k - 1, 0
            if k:
                free.setdefault(room, []).append((first, k))
    return np.array(sorted(runs), dtype=np.int64).reshape(-1, 5), made


def pack_documents(docs: DataFrame, tokenizer_file: str, end_id: int, capacity: int = 1024, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset[, ids]."""
    pieces = write_shared(pieces_of(docs, tokenizer_file, end_id, capacity, with_ids, id_col, text_col), "pieces")
    by_part = write_shared(pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")), "piece-counts")
    counts = np.zeros(capacity + 1, dtype=np.int64)        # at most ``capacity`` rows come back
    for row in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect():
        counts[row.length] = row.n
    runs, _ = plan(counts, capacity)
    shared = docs.sparkSession.sparkContext.broadcast(runs)    # its size depends on ``capacity`` only
    kept = [f for f in pieces.schema.fields if f.name not in ("part", "number")]
    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept) + ", sequence_id bigint, offset bigint"
    schema = arrow_schema(ddl)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = shared.value
        starts = runs[:, 0] << 40 | runs[:, 1]
        for batch in batches:
            number, length = np.asarray(batch.column("number")), np.asarray(batch.column("length"))
            at = np.searchsorted(starts, length << 40 | number, side="right") - 1
            sequence = runs[at, 3] + number - runs[at, 1]
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), pa.array(sequence), pa.array(runs[at, 4])], schema=schema)

    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)    # one row a task and length
    base = by_part.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    numbered = pieces.join(base, ["part", "length"]).withColumn("number", F.col("number") + F.col("base"))
    return numbered.select(*(f.name for f in kept), "number").mapInArrow(place, ddl).withColumnRenamed("id", id_col)


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences of ``pack_documents(..., with_ids=True)``: sequence_id, ids
    (little-endian 32-bit numbers) and the lengths of the pieces, in their order.  A group is
    one sequence, at most ``capacity`` ids."""
    held = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "length", "ids"))).alias("p"))
    ids = F.unhex(F.array_join(F.transform("p", lambda x: F.hex(x["ids"])), ""))
    return held.select("sequence_id", ids.alias("ids"), F.col("p.length").alias("lengths"))
