"""n-grams of whole texts counted with Arrow and NumPy inside Spark's tasks.

The texts of some rows become codes once; an n-gram is the number whose digits are its codes
(made dense where it would not fit 62 bits), so equal numbers are equal n-grams and nothing
rests on hashes.  One sort by (row, n-gram, text) per order gives the counts of every text."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import WS, WS_RUN, col

ROWS = 64                       # rows counted by one sort
_LONG = pa.int64()


def _strings(texts: pa.Array) -> pa.Array:
    return pc.fill_null(texts.cast(pa.large_string()), "")


def word_codes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(codes of all words, number of words by text, dictionary) of texts whose words are parted
    by spaces."""
    parts = pc.split_pattern(_strings(texts), " ")
    flat, parent = parts.flatten(), np.asarray(pc.list_parent_indices(parts))
    real = np.asarray(pc.not_equal(flat, ""))
    coded = flat.filter(pa.array(real)).dictionary_encode()
    return np.asarray(coded.indices).astype(np.int64), np.bincount(parent[real], minlength=len(texts)), coded.dictionary


def char_codes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(codes of all characters, number of characters by text)."""
    texts = _strings(texts)
    points = np.frombuffer("".join(texts.to_pylist()).encode("utf-32-le"), dtype=np.uint32)
    seen = np.zeros(0x110000, dtype=np.int64)
    seen[points] = 1
    return (np.cumsum(seen) - 1)[points], np.asarray(pc.utf8_length(texts)).astype(np.int64)


def side_counts(codes: np.ndarray, lens: np.ndarray, row: np.ndarray, side: np.ndarray, rows: int, max_n: int):
    """Per order 1..max_n: (matrix of counts by n-gram of a row and side, first line of each row).
    ``lens``, ``row`` and ``side`` describe the texts, in the order of their codes."""
    width, sides = int(codes.max(initial=0)) + 1, int(side.max(initial=0)) + 1
    left = np.repeat(np.cumsum(lens), lens) - np.arange(len(codes))     # codes from here to the text's end
    of = np.repeat(side, lens)
    key, floor, span = np.repeat(row, lens) * width + codes, np.arange(rows + 1) * width, rows * width
    for n in range(1, max_n + 1):
        if n > 1:
            if span * width * sides >= 1 << 62:
                dense, key = np.unique(key, return_inverse=True)
                floor, span = np.searchsorted(dense, floor), len(dense)
            key = key[:-1] * width + codes[n - 1:] if len(key) else key
            floor, span = floor * width, span * width
        here = left[:len(key)] >= n
        found = np.sort(key[here] * sides + of[:len(key)][here])
        first = np.flatnonzero(np.concatenate([[True], found[1:] != found[:-1]])) if len(found) else np.zeros(0, dtype=np.int64)
        gram, which = np.divmod(found[first], sides)
        line = np.cumsum(np.concatenate([[0], gram[1:] != gram[:-1]])) if len(gram) else gram
        counts = np.zeros((int(line[-1]) + 1 if len(line) else 0, sides), dtype=np.int64)
        counts[line, which] = np.diff(np.append(first, len(found)))
        once = gram[np.concatenate([[True], gram[1:] != gram[:-1]])] if len(gram) else gram
        yield counts, np.searchsorted(once, floor)


def _sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values)])
    return total[at[1:]] - total[at[:-1]]


def _parts(hyp: pa.Array, refs: pa.Array):
    """Slices of rows: (texts of the hypotheses, then the references; row and side of each text)."""
    for at in range(0, max(1, len(hyp)), ROWS):
        h, r = hyp.slice(at, ROWS), refs.slice(at, ROWS)
        flat, parent = r.flatten(), np.asarray(pc.list_parent_indices(r)).astype(np.int64)
        place = np.arange(len(flat)) - np.searchsorted(parent, parent)
        yield h, r, pa.concat_arrays([h, flat.cast(h.type)]), np.concatenate([np.arange(len(h)), parent]), np.concatenate([np.zeros(len(h), dtype=np.int64), place + 1])


def _lists(values: dict, lens: np.ndarray, valid: pa.Array) -> pa.ListArray:
    """A list of structs per row from columns in row order; null where ``valid`` is false."""
    at = pa.array(np.concatenate([[0], np.cumsum(lens)]).astype(np.int32))
    flat = pa.StructArray.from_arrays([v if isinstance(v, pa.Array) else pa.array(v, _LONG) for v in values.values()], list(values))
    return pa.ListArray.from_arrays(at, flat, mask=pc.invert(valid))


def _overlaps(max_n: int, chars: bool):
    def run(hyp: pa.Array, refs: pa.Array) -> pa.Array:
        out = []
        for h, r, texts, row, side in _parts(hyp, refs):
            codes, lens = char_codes(texts) if chars else word_codes(texts)[:2]
            total = np.zeros((3, len(h), max_n), dtype=np.int64)
            for n, (counts, at) in enumerate(side_counts(codes, lens, row, side, len(h), max_n)):
                most = counts[:, 1:].max(axis=1, initial=0)
                total[:, :, n] = _sums(counts[:, 0], at), _sums(np.minimum(counts[:, 0], most), at), _sums(most, at)
            known = np.asarray(texts.is_valid())
            words = pa.array(lens, _LONG, mask=~known)
            out.append(pa.StructArray.from_arrays([
                _lists({k: v.ravel() for k, v in zip(("total", "correct", "ref_total"), total)}, np.full(len(h), max_n), pa.array(np.ones(len(h), dtype=bool))),
                words.slice(0, len(h)),
                pa.ListArray.from_arrays(pa.array(np.searchsorted(row[len(h):], np.arange(len(h) + 1)).astype(np.int32)), words.slice(len(h)), mask=pc.invert(r.is_valid()))],
                ["orders", "len", "ref_lens"]))
        return pa.concat_arrays(out)

    return F.arrow_udf(run, "orders array<struct<total:bigint,correct:bigint,ref_total:bigint>>, len bigint, ref_lens array<bigint>")


def overlaps(hyp, refs, max_n: int, chars: bool = False) -> Column:
    """struct<orders, len, ref_lens>: by order 1..max_n of one row struct<total, correct, ref_total>
    (n-grams of ``hyp``, clipped matches, union of the references), and the lengths of the texts
    (null: null).  Words parted by whitespace or, with ``chars``, characters without whitespace;
    ``refs`` is an array of texts."""
    plain = lambda c: F.regexp_replace(c, WS if chars else WS_RUN, "" if chars else " ")
    return _overlaps(max_n, chars)(plain(col(hyp)), F.transform(col(refs), plain))


def _bags():
    names = ("n_pred", "n_ref", "once_pred", "once_ref", "once", "bag")

    def run(pred: pa.Array, refs: pa.Array) -> pa.Array:
        out = []
        for p, r, texts, row, side in _parts(pred, refs):
            codes, lens, _ = word_codes(texts)
            n = len(p)
            counts, at = next(side_counts(codes, lens, row, side, n, 1))
            known, sides = np.asarray(texts.is_valid()), counts.shape[1]
            h = counts[:, 0]
            by_side = [(_sums(c > 0, at), _sums((c > 0) & (h > 0), at), _sums(np.minimum(c, h), at)) for c in counts.T]
            zeros = np.zeros(n, dtype=np.int64)
            pick = lambda k: np.stack([by_side[s][k] if s < sides else zeros for s in range(int(side.max(initial=0)) + 1)])[side[n:], row[n:]]
            of, lost_p, lost_r = row[n:], ~known[:n][row[n:]], ~known[n:]
            cols = (lens[:n][of], lens[n:], by_side[0][0][of], pick(0), pick(1), pick(2))
            lost = (lost_p, lost_r, lost_p, lost_r, lost_p | lost_r, lost_p | lost_r)
            values = {k: pa.array(v, _LONG, mask=m) for k, v, m in zip(names, cols, lost)} | {"same": pc.equal(p.take(pa.array(of)), r.flatten().cast(p.type))}
            out.append(_lists(values, np.bincount(of, minlength=n), r.is_valid()))
        return pa.concat_arrays(out)

    return F.arrow_udf(run, "array<struct<" + ",".join(f"{k}:bigint" for k in names) + ",same:boolean>>")


def bag_overlaps(pred, refs) -> Column:
    """Per reference of an array: words and different words of both texts, different words and
    occurrences in common, and whether the texts are the same.  Words are parted by one space."""
    return _bags()(col(pred), col(refs))


# ------------------------------------------------------------------ windows of words
_STEP, _ODD, _MIX = 256, np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _windows(n: int, distinct: bool):
    def run(texts: pa.Array) -> pa.Array:
        out = []
        for at in range(0, max(1, len(texts)), _STEP):
            part = texts.slice(at, _STEP)
            parts = pc.split_pattern(_strings(part), " ")
            coded = parts.flatten().dictionary_encode()
            codes = np.asarray(coded.indices).astype(np.int64)
            some = np.asarray(pc.greater(pc.binary_length(_strings(part)), 0))      # a text of no words has one empty piece
            lens = np.asarray(pc.list_value_length(parts))
            words = pd.util.hash_array(coded.dictionary.to_numpy(zero_copy_only=False), categorize=False)[codes] if len(codes) else np.zeros(0, dtype=np.uint64)
            width, key, h = len(coded.dictionary) + 1, np.repeat(np.arange(len(part)), lens), np.zeros(len(codes), dtype=np.uint64)
            place = np.arange(len(codes)) - np.repeat(np.cumsum(lens) - lens, lens)
            full = np.flatnonzero((np.repeat(lens, lens) - place >= n) & np.repeat(some, lens))
            span = len(part)
            for j in range(n if len(full) else 0):
                h[:len(h) - j] = h[:len(h) - j] * _ODD + words[j:]
                if distinct:                                 # equal numbers are equal windows of one text
                    if span * width >= 1 << 62:
                        dense, key = np.unique(key, return_inverse=True)
                        span = len(dense)
                    key, span = (key[:-1] if j else key) * width + codes[j:], span * width
            if distinct:
                full = full[np.sort(np.unique(key[full], return_index=True)[1])]
            h = (h[full] ^ (h[full] >> np.uint64(31))) * _MIX
            found = np.bincount(np.repeat(np.arange(len(part)), lens)[full], minlength=len(part))
            out.append(_lists({"pos": pa.array(place[full], pa.int32()), "h": (h ^ (h >> np.uint64(29))).view(np.int64)}, found, part.is_valid()))
        return pa.concat_arrays(out)

    return F.arrow_udf(run, "array<struct<pos:int,h:bigint>>")


def window_hashes(text, n: int, distinct: bool = False) -> Column:
    """array<struct<pos, h>>: 64-bit hash of every window of ``n`` words (parted by one space; two
    spaces have an empty word between them), with ``distinct`` of each different window's first."""
    return _windows(n, distinct)(col(text))
