"""Operator 13 - phrase collocations by SETM relational mining.

The occurrence relation (piece, position, word) of a share of documents is kept in text order,
one packed row a share.  Each round group-counts phrases over all shares, semi-joins the
relation with the frequent ones, writes it, and merge-joins it with itself by piece and adjacent
position, which lengthens every phrase by a word:

1. words: every share lists its distinct words with counts (``shares``); words of at least
   ``min_count`` occurrences in their language get a number; other words leave the relation.
2. pairs: neighbours that both stayed, counted the same way; frequent pairs get a number.
3. triples: pairs at neighbouring positions that both stayed, counted the same way.

A phrase is exact at every step: words are compared as strings, pairs and triples as two
numbers.  Scores, the drop of contained phrases and the ranking are joins of the three small
tables of frequent phrases.

Defined cases: null texts have no words; null language is ``und``; rows with the same id are
documents of their own; ties are ranked by the phrase's bytes; an empty table gives no rows; a
language without a frequent phrase gives none.  At most 2^32 words or pairs may be frequent
(else an error, never a wrong count).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import delete_written, word_hashes, write_shared
from .shares import answers_of, arrow_schema, asked, buckets_for, numbered, packed, rows_of, share_ids, totals, unpacked
from .word_ids import steps

SHARE_BYTES = 8 << 20
WORDS = "share bigint, lang string, bucket int, words array<string>, n array<bigint>, n_words bigint, relation binary, breaks binary"
WORD_ANSWERS = "share bigint, bucket int, found binary, lang string, words array<string>, ids array<bigint>, f array<bigint>"
PHRASES = "share bigint, bucket int, keys binary, n binary, relation binary, places binary"
PHRASE_ANSWERS = "share bigint, bucket int, found binary, ids array<bigint>, x array<bigint>, y array<bigint>, f array<bigint>"

# Of a byte: 0 in a word, 1 between words, 2 between pieces.
_KIND = np.zeros(256, dtype=np.uint8)
_KIND[[0x20, 0x09]] = 1
_KIND[[*b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D]] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def occurrences(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(codes of all words in text order, whether a word starts another piece, dictionary)."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if not len(texts):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=bool), pa.array([], pa.large_string())
    ends = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = _LOWER[np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[ends[0]:ends[-1]]]
    ends = ends - ends[0]
    kind = _KIND[data]
    word = kind == 0
    start = word.copy()
    start[1:] &= ~word[:-1]
    first = ends[:-1][ends[:-1] < ends[1:]]                # a text's first byte begins a word of its own
    start[first] = word[first]
    at = np.flatnonzero(start)
    piece = np.cumsum(kind == 2, dtype=np.int64)[at] + np.searchsorted(ends, at, side="right")
    letters = data[word]
    offsets = np.append(np.cumsum(word)[at] - 1, len(letters)).astype(np.int64)
    words = pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(offsets), pa.py_buffer(letters))
    coded = words.dictionary_encode()
    return np.asarray(coded.indices).astype(np.int64), np.diff(piece, prepend=-1) != 0, coded.dictionary


def word_relation(docs: DataFrame, n_buckets: int) -> DataFrame:
    """Rows of WORDS: for each share its relation (bucket null) and its words by bucket."""
    schema = arrow_schema(WORDS)

    def share(ids, lang: str, texts: pa.Array) -> Iterator[pa.RecordBatch]:
        codes, breaks, words = occurrences(texts)
        if not len(codes):
            return
        bucket = (word_hashes(words, 7) % np.uint64(n_buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        rank = np.empty(len(order), dtype=np.int64)
        rank[order] = np.arange(len(order))
        count = np.bincount(codes, minlength=len(words))[order]
        words, bucket, number = words.take(pa.array(order)), bucket[order], next(ids)
        rows = [{"share": number, "lang": lang, "n_words": len(codes), "relation": packed(rank[codes].astype(np.uint32)), "breaks": packed(np.packbits(breaks))}]
        rows += [{"share": number, "lang": lang, "bucket": b, "words": words[s].to_pylist(), "n": count[s].tolist()} for b, s in asked(bucket, n_buckets)]
        yield rows_of(schema, rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, held, size = share_ids(), [], 0

        def flush():
            table = pa.Table.from_batches(held)
            langs, texts = table.column(0).combine_chunks(), table.column(1).combine_chunks()
            for lang in pc.unique(langs).to_pylist():
                yield from share(ids, lang, texts.filter(pc.equal(langs, lang)))

        for batch in batches:
            for part in steps(batch):
                held.append(part)
                size += pc.sum(pc.binary_length(part.column(1))).as_py() or 0
                if size >= SHARE_BYTES:
                    yield from flush()
                    held, size = [], 0
        if held:
            yield from flush()

    return docs.mapInArrow(run, WORDS)


def frequent_words(asks: DataFrame, min_count: int, n_buckets: int) -> DataFrame:
    """Rows of WORD_ANSWERS: answers to the shares, and each bucket's frequent words."""
    schema = arrow_schema(WORD_ANSWERS)

    def tally(table: pa.Table) -> pa.Table:
        bucket, made, rows = table.column("bucket")[0].as_py(), 0, []
        for lang in pc.unique(table.column("lang")).to_pylist():
            part = table.filter(pc.equal(table.column("lang"), lang))
            lists = part.column("words").combine_chunks()
            coded = lists.flatten().dictionary_encode()
            codes = np.asarray(coded.indices).astype(np.int64)
            f = np.zeros(len(coded.dictionary), dtype=np.int64)
            np.add.at(f, codes, np.asarray(part.column("n").combine_chunks().flatten()))
            often = f >= min_count
            number = np.where(often, (made + np.cumsum(often) - 1) * n_buckets + bucket, -1)
            made += int(often.sum())
            if made * n_buckets >= 1 << 32:
                raise ValueError("more than 2^32 frequent words")
            cuts = np.cumsum(np.asarray(lists.value_lengths()))[:-1]
            rows += [{"share": s, "bucket": bucket, "found": packed(x)} for s, x in zip(part.column("share").to_pylist(), np.split(number[codes], cuts))]
            keep = np.flatnonzero(often)
            rows.append({"bucket": bucket, "lang": lang, "words": coded.dictionary.take(pa.array(keep)).to_pylist(), "ids": number[keep].tolist(), "f": f[keep].tolist()})
        return pa.Table.from_batches([rows_of(schema, rows)])

    return asks.groupBy("bucket").applyInArrow(tally, WORD_ANSWERS)


def longer(shares: DataFrame, answers: DataFrame, n_buckets: int, last: bool) -> DataFrame:
    """Rows of PHRASES: the relation without what is rare, merge-joined with itself by adjacent
    position.  ``places`` are word positions, ``relation`` the share's phrase there; the last
    round keeps the counts only."""
    schema = arrow_schema(PHRASES)

    def extend(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = []
        if left.num_rows:
            one = left.to_pylist()[0]
            found = answers_of(right, "found")[unpacked(one["relation"])]
            if one["places"] is None:                      # words: every position, cut by pieces
                places = np.arange(len(found))
                joins = ~np.unpackbits(unpacked(one["breaks"]), count=len(found)).astype(bool)
            else:
                places = np.cumsum(unpacked(one["places"]).astype(np.int64))
                joins = np.diff(places, prepend=-2) == 1
            both = np.flatnonzero((found[1:] >= 0) & (found[:-1] >= 0) & joins[1:])
            keys = found[both].astype(np.uint64) << np.uint64(32) | found[both + 1].astype(np.uint64)
            keys, place, n = np.unique(keys, return_inverse=True, return_counts=True)
            order, bucket, rank = numbered(keys, n_buckets)
            keys, n = keys[order], n[order].astype(np.uint32)
            if not last:
                rows.append({"share": one["share"], "relation": packed(rank[place].astype(np.uint32)), "places": packed(np.diff(places[both], prepend=0).astype(np.uint32))})
            rows += [{"share": one["share"], "bucket": b, "keys": packed(keys[s]), "n": packed(n[s])} for b, s in asked(bucket, n_buckets)]
        return pa.Table.from_batches([rows_of(schema, rows)])

    return shares.groupBy("share").cogroup(answers.groupBy("share")).applyInArrow(extend, PHRASES)


def frequent_phrases(asks: DataFrame, min_count: int, n_buckets: int, last: bool) -> DataFrame:
    """Rows of PHRASE_ANSWERS: answers to the shares (not in the last round), and each bucket's
    frequent phrases as the numbers of their two parts."""
    schema = arrow_schema(PHRASE_ANSWERS)

    def tally(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        keys, f, places = totals(table.column("keys").to_pylist(), table.column("n").to_pylist())
        often = f >= min_count
        number = np.where(often, (np.cumsum(often) - 1) * n_buckets + bucket, -1)
        if len(number) and number.max() >= 1 << 32:
            raise ValueError("more than 2^32 frequent pairs")
        keep = np.flatnonzero(often)
        rows = [] if last else [{"share": s, "bucket": bucket, "found": packed(number[p])} for s, p in zip(table.column("share").to_pylist(), places)]
        x, y = keys[keep] >> np.uint64(32), keys[keep] & np.uint64(0xFFFFFFFF)
        rows.append({"bucket": bucket, "ids": number[keep].tolist(), "x": x.astype(np.int64).tolist(), "y": y.astype(np.int64).tolist(), "f": f[keep].tolist()})
        return pa.Table.from_batches([rows_of(schema, rows)])

    return asks.groupBy("bucket").applyInArrow(tally, PHRASE_ANSWERS)


def phrase_counts(docs: DataFrame, min_count: int, text_col: str = "text", lang_col: str = "lang") -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(words, pairs, triples, sizes) with at least ``min_count`` occurrences: words (id, lang,
    word, f), pairs (id, x, y, f) of word numbers, triples (x, y, f) of the numbers of their
    pairs, and sizes (lang, n) of all word occurrences."""
    narrow = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).cast("string").alias("text"))
    n_buckets = buckets_for(narrow)
    asks, shares = F.col("bucket").isNotNull(), F.col("bucket").isNull()

    level1 = write_shared(word_relation(narrow, n_buckets), "words")
    found1 = write_shared(frequent_words(level1.filter(asks).select("share", "lang", "bucket", "words", "n"), min_count, n_buckets), "word-answers")
    relation = level1.filter(shares).select("share", "relation", "breaks", F.lit(None).cast("binary").alias("places"))
    level2 = write_shared(longer(relation, found1.filter("share is not null").select("share", "bucket", "found"), n_buckets, last=False), "pairs")
    sizes = write_shared(level1.filter(shares).groupBy("lang").agg(F.sum("n_words").alias("n")), "sizes")
    delete_written(level1)
    found2 = write_shared(frequent_phrases(level2.filter(asks).select("share", "bucket", "keys", "n"), min_count, n_buckets, last=False), "pair-answers")
    relation = level2.filter(shares).select("share", "relation", F.lit(None).cast("binary").alias("breaks"), "places")
    level3 = longer(relation, found2.filter("share is not null").select("share", "bucket", "found"), n_buckets, last=True)
    found3 = write_shared(frequent_phrases(level3.select("share", "bucket", "keys", "n"), min_count, n_buckets, last=True), "triple-answers")
    delete_written(level2)

    def rows(found: DataFrame, *arrays: str) -> DataFrame:
        return found.filter("share is null").select("lang" if "words" in arrays else F.lit(0), F.inline(F.arrays_zip(*arrays)))

    words = rows(found1, "ids", "words", "f").select(F.col("ids").alias("id"), "lang", F.col("words").alias("word"), "f")
    pairs = rows(found2, "ids", "x", "y", "f").select(F.col("ids").alias("id"), "x", "y", "f")
    return words, pairs, rows(found3, "x", "y", "f").select("x", "y", "f"), sizes


def collocations(docs: DataFrame, min_count: int = 10, contained: int = 50, most: int = 2000, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The first ``most`` phrases of two or three words of each language by score: lang, rank,
    phrase, a, l, r, n, score.  A phrase goes when a longer candidate that holds it has at least
    ``contained`` hundredths of its occurrences."""
    words, pairs, triples, sizes = phrase_counts(docs, min_count, text_col, lang_col)

    def word(name: str) -> DataFrame:
        return words.select(F.col("id").alias(name), F.col("lang").alias(f"lang_{name}"), F.col("word").alias(f"word_{name}"), F.col("f").alias(f"f_{name}"))

    def score(left: str, right: str):                      # exact: the products of counts have up to 38 digits
        return F.expr(f"(cast(1000000 as decimal(7,0)) * (cast(a as decimal(19,0)) * cast(a as decimal(19,0)))) div (cast({left} as decimal(19,0)) * cast({right} as decimal(19,0)))")

    named = pairs.join(word("x"), "x").join(word("y"), "y")
    held = triples.select(F.explode(F.array("x", "y")).alias("id"), "f").groupBy("id").agg(F.max("f").alias("longer"))
    two = (named.join(held, "id", "left").filter(F.col("longer").isNull() | (100 * F.col("longer") < contained * F.col("f")))
           .select(F.col("lang_x").alias("lang"), F.concat_ws(" ", "word_x", "word_y").alias("phrase"), F.col("f").alias("a"), F.col("f_x").alias("l"), F.col("f_y").alias("r"))
           .withColumn("score", score("l", "r")))
    left = named.select(F.col("id").alias("x"), F.col("lang_x").alias("lang"), F.concat_ws(" ", "word_x", "word_y").alias("head"), F.col("f_x").alias("l1"), F.col("f").alias("l2"))
    right = named.select(F.col("id").alias("y"), F.col("word_y").alias("tail"), F.col("f").alias("r1"), F.col("f_y").alias("r2"))
    three = (triples.withColumnRenamed("f", "a").join(left, "x").join(right, "y").withColumn("s1", score("l1", "r1")).withColumn("s2", score("l2", "r2"))
             .select("lang", F.concat_ws(" ", "head", "tail").alias("phrase"), "a", F.when(F.col("s1") <= F.col("s2"), F.col("l1")).otherwise(F.col("l2")).alias("l"),
                     F.when(F.col("s1") <= F.col("s2"), F.col("r1")).otherwise(F.col("r2")).alias("r"), F.least("s1", "s2").alias("score")))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = two.unionByName(three).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)    # each task ranks its own first
    return ranked.join(sizes, "lang").select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")
