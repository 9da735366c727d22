"""Operator 2 - exact substring dedup with super-k-mer partitioning.

A window is ``k`` consecutive words of one document.  A window's minimiser is the least hash
of its ``m``-word parts; consecutive windows that share a minimiser travel as one packed
string (a super-k-mer) to the minimiser's bucket.  Equal windows have equal minimisers, so
one bucket sees every copy of a window: it numbers its words, sorts the windows and compares
equal hashes word by word, which counts windows exactly.

Jobs:
1. Documents are dealt to *shares* by a hash of their id (a share holds about ``share_bytes``
   of text).  Each share lists its distinct minimisers; a minimiser that only one document
   holds can't belong to a repeated window.
2. Each share packs its distinct super-k-mers of the other minimisers, once, with the least
   and greatest document id that holds them - so a passage copied into a third of all
   documents reaches a bucket at most once per share, whatever its frequency.
3. Each bucket finds windows that start in more than one document and answers the shares
   that hold them: (share, window hashes, least document id).
4. Documents and answers meet by share (steps 1, 2 and 4 read one and the same exchange of
   the documents); words covered by a window of a smaller document id go.

No group is larger than a share or a bucket; both counts follow the measured text size.

Defined cases: a null or empty text, or fewer than ``k`` words, has no windows and loses
nothing; a null id is never smaller or greater than another; rows with the same id never
remove each other's words and each row gives a row; words are compared unchanged.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import rolling_hash, mix, word_codes, word_hashes

def _rolling_min(x: np.ndarray, n: int) -> np.ndarray:
    out, have = x.copy(), 1
    while have < n:
        step = min(have, n - have)
        out[:len(out) - step] = np.minimum(out[:len(out) - step], out[step:])
        have += step
    return out


def _window_places(offsets: np.ndarray, n_words: int, k: int) -> np.ndarray:
    """Whether a window of k words of one text starts at each word."""
    length = np.diff(offsets)
    left = np.repeat(offsets[1:], length) - np.arange(n_words)   # words from here to the text's end
    return left >= k


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Concatenated ranges start..start+length-1 and their offsets."""
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    return np.arange(offsets[-1]) - np.repeat(offsets[:-1] - starts, lengths), offsets


def _super_kmers(ids: np.ndarray, texts: pa.Array, k: int, m: int):
    """(word ids, dictionary, starts, words, minimisers, documents) of the super-k-mers."""
    coded, offsets, dictionary = word_codes(texts)
    if not len(coded):
        none = np.zeros(0, dtype=np.int64)
        return coded, dictionary, none, none, none.astype(np.uint64), none
    good = _window_places(offsets, len(coded), k)
    low = _rolling_min(rolling_hash(word_hashes(dictionary, 0)[coded], m), k - m + 1)
    doc = np.repeat(np.arange(len(ids)), np.diff(offsets))
    first = good.copy()
    first[1:] &= ~(good[:-1] & (low[1:] == low[:-1]) & (doc[1:] == doc[:-1]))
    at = np.flatnonzero(first)
    ends = np.flatnonzero(good & ~np.concatenate([(good[1:] & ~first[1:]), [False]]))
    return coded, dictionary, at, ends - at + k, low[at], doc[at]


def list_minimisers(share: int, ids: np.ndarray, texts: pa.Array, k: int, m: int) -> pa.RecordBatch:
    """Distinct minimisers of a share and whether several of its documents hold them."""
    *_, low, doc = _super_kmers(ids, texts, k, m)
    minis, which = np.unique(low, return_inverse=True)
    least, most = np.full(len(minis), np.iinfo(np.int64).max), np.full(len(minis), np.iinfo(np.int64).min)
    np.minimum.at(least, which, ids[doc])
    np.maximum.at(most, which, ids[doc])
    return pa.RecordBatch.from_arrays([pa.array(minis.view(np.int64)), pa.array(np.full(len(minis), share)), pa.array(least < most)], names=["mini", "share", "several"])


def pack_share(share: int, ids: np.ndarray, texts: pa.Array, k: int, m: int, n_buckets: int, wanted: np.ndarray | None = None) -> pa.RecordBatch:
    """The distinct super-k-mers of a share, of the ``wanted`` minimisers (all if None)."""
    coded, dictionary, at, length, low, doc = _super_kmers(ids, texts, k, m)
    if wanted is not None:
        take = np.isin(low, wanted)
        at, length, low, doc = at[take], length[take], low[take], doc[take]
    places, cuts = _ranges(at, length)
    words = dictionary.take(pa.array(coded[places])) if len(at) else pa.array([], pa.large_string())
    code = pc.binary_join(pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), words), pa.scalar(" ", pa.large_string())).dictionary_encode()
    which, n = np.asarray(code.indices), len(code.dictionary)
    least, most, bucket = np.full(n, np.iinfo(np.int64).max), np.full(n, np.iinfo(np.int64).min), np.zeros(n, dtype=np.int64)
    np.minimum.at(least, which, ids[doc])
    np.maximum.at(most, which, ids[doc])
    bucket[which] = (mix(low) % np.uint64(n_buckets)).astype(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(np.full(n, share)), code.dictionary.cast(pa.string()), pa.array(least), pa.array(most)],
                                      names=["bucket", "share", "packed", "least", "most"])


MINIMISERS = "mini bigint, share bigint, several boolean"
PACKED = "bucket bigint, share bigint, packed string, least bigint, most bigint"
ANSWER = "share bigint, hash1 binary, hash2 binary, least binary"


def count_bucket(table: pa.Table, k: int) -> pa.RecordBatch:
    """Answers of one bucket: for each share the windows it holds that also start in another
    document with a smaller id, as two hashes (64 and 32 bits) and that least id."""
    table = table.combine_chunks()
    share, least, most = (np.asarray(table.column(c)) for c in ("share", "least", "most"))
    coded, offsets, dictionary = word_codes(pa.concat_arrays(table.column("packed").chunks))
    at = np.flatnonzero(_window_places(offsets, len(coded), k))
    string = np.repeat(np.arange(len(share)), np.diff(offsets))[at]
    h1 = rolling_hash(word_hashes(dictionary, 0)[coded], k)[at]
    order = np.argsort(h1, kind="stable")
    run = np.cumsum(np.diff(h1[order], prepend=~h1[order[:1]]) != 0) - 1          # equal hashes are one run
    group = np.empty(len(at), dtype=np.int64)
    group[order] = run
    many = np.flatnonzero((np.bincount(run)[group] > 1) | (least < most)[string])  # in several strings, or in one of several documents
    if not len(many):
        return pa.RecordBatch.from_pydict({"share": [], "hash1": [], "hash2": [], "least": []}, schema=_answer_schema())
    rows = coded[at[many][:, None] + np.arange(k)]                                # their words, to count exactly
    head = np.full(run[-1] + 1, -1, dtype=np.int64)
    head[group[many][::-1]] = np.arange(len(many))[::-1]                          # first window of each run
    exact = group[many].copy()
    if (rows != rows[head[exact]]).any():                                         # two texts with one hash: number them apart
        exact = np.unique(np.column_stack([exact, rows]), axis=0, return_inverse=True)[1].reshape(-1)
    _, exact = np.unique(exact, return_inverse=True)
    lo = np.full(exact.max() + 1, np.iinfo(np.int64).max)
    np.minimum.at(lo, exact, least[string[many]])
    tell = lo[exact] < most[string[many]]                                         # the share holds it in a later document
    many, exact = many[tell], exact[tell]
    h2 = _second(rolling_hash(word_hashes(dictionary, 1)[coded], k)[at[many]])
    out_share, h1, lo = share[string[many]], h1[many], lo[exact]
    out = {"share": [], "hash1": [], "hash2": [], "least": []}
    order = np.lexsort((h2, h1, out_share))
    out_share, h1, h2, lo = out_share[order], h1[order], h2[order], lo[order]
    fresh = np.ones(len(order), dtype=bool)
    fresh[1:] = (out_share[1:] != out_share[:-1]) | (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
    out_share, h1, h2, lo = out_share[fresh], h1[fresh], h2[fresh], lo[fresh]
    edges = np.flatnonzero(np.diff(out_share, prepend=-1)) if len(out_share) else np.zeros(0, dtype=np.int64)
    for a, b in zip(edges, np.append(edges[1:], len(out_share))):
        out["share"].append(int(out_share[a]))
        out["hash1"].append(h1[a:b].tobytes())
        out["hash2"].append(h2[a:b].tobytes())
        out["least"].append(lo[a:b].tobytes())
    return pa.RecordBatch.from_pydict(out, schema=_answer_schema())


def _second(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(32)).astype(np.uint32)


def _answer_schema() -> pa.Schema:
    return pa.schema([("share", pa.int64()), ("hash1", pa.binary()), ("hash2", pa.binary()), ("least", pa.binary())])


def removed_words(ids: np.ndarray, has_id: np.ndarray, texts: pa.Array, answers: pa.Table, k: int):
    """(offsets by text, removed mask of all words, the words) of one share."""
    coded, offsets, dictionary = word_codes(texts)
    gone = np.zeros(len(coded), dtype=bool)
    if len(coded) and answers.num_rows:
        k1 = np.frombuffer(b"".join(answers.column("hash1").to_pylist()), dtype=np.uint64)
        k2 = np.frombuffer(b"".join(answers.column("hash2").to_pylist()), dtype=np.uint32)
        least = np.frombuffer(b"".join(answers.column("least").to_pylist()), dtype=np.int64)
        order = np.lexsort((k2, k1))
        k1, k2, least = k1[order], k2[order], least[order]
        at = np.flatnonzero(_window_places(offsets, len(coded), k))
        h1 = rolling_hash(word_hashes(dictionary, 0)[coded], k)[at]
        place = np.searchsorted(k1, h1)
        near = np.minimum(place, len(k1) - 1)
        hit = k1[near] == h1
        at, place, h1 = at[hit], place[hit], h1[hit]
        if len(at):
            h2 = _second(rolling_hash(word_hashes(dictionary, 1)[coded], k)[at])
            doc = np.repeat(np.arange(len(ids)), np.diff(offsets))[at]
            while len(at):                                                        # equal first hashes lie side by side
                ok = (place < len(k1))
                ok[ok] = k1[place[ok]] == h1[ok]
                at, place, h1, h2, doc = at[ok], place[ok], h1[ok], h2[ok], doc[ok]
                same = (k2[place] == h2) & has_id[doc]
                starts = at[same & (least[place] < ids[doc])]
                for j in range(k):
                    gone[starts + j] = True
                place = place + 1
    return offsets, gone, dictionary, coded


def substring_dedup(docs: DataFrame, k: int = 13, m: int = 6, id_col: str = "doc_id", text_col: str = "text",
                    share_bytes: int = 6 << 20, with_text: bool = False) -> DataFrame:
    """id, n_words, n_removed, kept_sha256 (kept words joined by one space) per row of
    ``docs``; ``with_text`` adds kept_text.  ids must be integers."""
    spark = docs.sparkSession
    narrow = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    size = narrow.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_shares = max(1, -(-size // share_bytes), int(spark.conf.get("spark.sql.shuffle.partitions")) if size > share_bytes else 1)
    n_buckets = 2 * n_shares
    dealt = narrow.withColumn("share", F.pmod(F.xxhash64("id"), F.lit(n_shares)).cast("bigint"))

    def named(table: pa.Table) -> tuple[int, np.ndarray, pa.Array]:
        """Share, ids and texts of the rows that have an id."""
        mine = table.filter(pc.is_valid(table.column("id"))).combine_chunks()
        if not mine.num_rows:
            return 0, np.zeros(0, dtype=np.int64), pa.array([], pa.string())
        return mine.column("share")[0].as_py(), np.asarray(mine.column("id")), pa.concat_arrays(mine.column("text").chunks)

    def minimisers(table: pa.Table) -> pa.Table:
        return pa.Table.from_batches([list_minimisers(*named(table), k, m)])

    def pack(left: pa.Table, right: pa.Table) -> pa.Table:
        wanted = np.asarray(right.column("mini").combine_chunks()).view(np.uint64) if right.num_rows and left.num_rows else np.zeros(0, dtype=np.uint64)
        return pa.Table.from_batches([pack_share(*(named(left) if len(wanted) else named(left.slice(0, 0))), k, m, n_buckets, wanted)])

    def answer(table: pa.Table) -> pa.Table:
        return pa.Table.from_batches([count_bucket(table, k)])

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        out = {"id": left.column("id").to_pylist(), "n_words": [], "n_removed": [], "kept_sha256": []} | ({"kept_text": []} if with_text else {})
        if left.num_rows:
            column = left.column("id").combine_chunks()
            texts = pa.concat_arrays(left.column("text").chunks)
            offsets, gone, dictionary, coded = removed_words(np.asarray(column.fill_null(0)), np.asarray(column.is_valid()), texts, right, k)
            words = np.array(dictionary.to_pylist(), dtype=object)
            for a, b in zip(offsets[:-1], offsets[1:]):
                text = " ".join(words[coded[a:b][~gone[a:b]]])
                out["n_words"].append(int(b - a))
                out["n_removed"].append(int(gone[a:b].sum()))
                out["kept_sha256"].append(hashlib.sha256(text.encode()).hexdigest())
                if with_text:
                    out["kept_text"].append(text)
        types = [("id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())] + [("kept_text", pa.string())] * with_text
        return pa.Table.from_pydict(out, schema=pa.schema(types))

    held = dealt.groupBy("share").applyInArrow(minimisers, MINIMISERS)
    shared = held.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("mini"))).filter("n > 1 or several").select("mini", "share")
    packed = dealt.groupBy("share").cogroup(shared.groupBy("share")).applyInArrow(pack, PACKED)
    answers = packed.groupBy("bucket").applyInArrow(answer, ANSWER)
    done = dealt.groupBy("share").cogroup(answers.groupBy("share")).applyInArrow(
        cut, "id bigint, n_words bigint, n_removed bigint, kept_sha256 string" + ", kept_text string" * with_text)
    return done.withColumnRenamed("id", id_col)
