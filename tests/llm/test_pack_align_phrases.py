"""Packing, alignment and phrases against brute-force versions: nulls, empty and long texts, ties,
repeated rows, empty tables, clashing column names."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest

from sparkeval.llm import alignment, collocations, packing, shares
from sparkeval.llm.word_ids import ByteLevelCoder, PieceCoder, WordTable

JSON, PIECE = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
SCHEMA = "doc_id bigint, text string, lang string, id string, share bigint, bucket int, piece string, length string, part string, words string, n string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, "a", 1, 2, "b", "c", "d", "e", "f") for i, t, lang in rows], SCHEMA)


@pytest.fixture(scope="module")
def texts():
    import duckdb
    real = [r[0] for r in duckdb.sql("SELECT text FROM '/root/testdata/sf0.001/documents.parquet' ORDER BY doc_id LIMIT 80").fetchall()]
    rng = random.Random(3)
    parts = ["a", "b", "the", " ", "  ", "\n", "\t", " \n", "　", "é", "日本", "😀", "<|endoftext|>", "'s", "12", "▁", "\x00", "\x1c", "\u0085", "<s>", ".", "-", "ﬁ", "é"]
    odd = ["".join(rng.choice(parts) for _ in range(rng.randrange(0, 14))) for _ in range(300)]
    return real + odd + ["", " ", "  ", "a" * 6000, " a" * 3000, "中" * 700, "x<|endoftext|>y <|endoftext|>"]


# -- word table ---------------------------------------------------------------

def test_word_table_equals_the_libraries_also_when_it_forgets(texts):
    plain, special, pieces = ByteLevelCoder(JSON), ByteLevelCoder(JSON, plain_specials=True), PieceCoder(PIECE)
    small, pair = WordTable(plain, most=50), WordTable(special, pieces, lead=True, most=50)
    for at in range(0, len(texts), 7):
        some = texts[at:at + 7]
        (flat, off), = small.encode(pa.array(some, pa.string()))
        (a, a_off), (b, b_off) = pair.encode(pa.array(some, pa.string()))
        for i, t in enumerate(some):
            assert flat[off[i]:off[i + 1]].tolist() == plain.tokenizer.encode(t, add_special_tokens=False).ids
            assert a[a_off[i]:a_off[i + 1]].tolist() == (special.tokenizer.encode(" " + t, add_special_tokens=False).ids if t else [])
            ids = pieces.sp.encode(t)
            exact = t and b"".join(pieces.bytes[j] for j in ids) == (" " + t).encode()
            assert b[b_off[i]:b_off[i + 1]].tolist() == (ids if exact else [])


# -- 11 -----------------------------------------------------------------------

def unrolled(counts, capacity, groups):
    """Every piece of a plan, checked: all pieces once, gapless places, numbered sequences."""
    runs, made = packing.plan(counts, capacity, groups)
    rows = [(s + k, o, length, number + k) for length, number, n, s, o in runs.tolist() for k in range(n)]
    rows.sort()
    assert Counter((length, number) for _, _, length, number in rows) == Counter((length, k) for length in range(capacity + 1) for k in range(counts[length]))
    end = defaultdict(int)
    for s, o, length, _ in rows:
        assert o == end[s]
        end[s] += length
    assert sorted(end) == list(range(made)) and max(end.values(), default=0) <= capacity
    return made


def fewest(lengths, capacity):
    """The least number of sequences, by sets of pieces."""
    n = len(lengths)
    best = {0: (0, capacity)}
    for mask in range(1, 1 << n):
        best[mask] = min(((q + 1, lengths[i]) if fill + lengths[i] > capacity else (q, fill + lengths[i])) for i in range(n) if mask >> i & 1 for q, fill in [best[mask ^ 1 << i]])
    return best[(1 << n) - 1][0]


def best_fit(counts, capacity):
    """Sequences that best fit, piece by piece from the longest, takes."""
    room = [0] * (capacity + 1)
    made = 0
    for length in range(capacity, 0, -1):
        for _ in range(counts[length]):
            k = next((r for r in range(length, capacity + 1) if room[r]), None)
            if k is None:
                made += 1
                k = capacity
            else:
                room[k] -= 1
            room[k - length] += 1
    return made


def test_plans_are_packings_and_close_to_the_least():
    rng = np.random.default_rng(5)
    for capacity in (1, 2, 3, 7, 20, 100):
        for groups in (1, 3, 160):
            for _ in range(8):
                counts = np.zeros(capacity + 1, dtype=np.int64)
                counts[1:] = rng.integers(0, rng.integers(1, 25), capacity)
                unrolled(counts, capacity, groups)
    for _ in range(12):
        lengths = rng.integers(1, 21, 9).tolist()
        assert unrolled(np.bincount(lengths, minlength=21), 20, 160) <= fewest(lengths, 20) + 1
    counts = np.zeros(1025, dtype=np.int64)
    counts[60:1024] = rng.integers(0, 60, 964)
    assert unrolled(counts, 1024, 160) <= 1.005 * best_fit(counts, 1024)
    # Small-scale and large-scale plans are of the same size.
    runs = [len(packing.plan(counts * k, 1024)[0]) for k in (1, 1000)]
    assert runs[1] < 2 * runs[0] < 20_000


def brute_pieces(doc_id, text, capacity, tokenizer):
    ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
    first = (len(ids) - 1) % capacity + 1
    cuts = [0, *range(first, len(ids) + 1, capacity)]
    return [(doc_id, k, a, b - a, zlib.crc32(np.array(ids[a:b], dtype="<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))], ids


@pytest.mark.parametrize("capacity", [32, 1024])
def test_packed_documents(spark, texts, capacity):
    rows = [(i, t, "en") for i, t in enumerate(texts)] + [(-1, None, None), (None, "null id", "en"), (0, texts[0], "en")]
    packed = packing.pack_documents(frame(spark, rows).repartition(5), JSON, 2, capacity, with_ids=True).cache()
    got = packed.collect()
    tokenizer, want, ids = ByteLevelCoder(JSON).tokenizer, [], Counter()
    for i, t, _ in rows:
        pieces, all_ids = brute_pieces(i, t, capacity, tokenizer)
        want += pieces
        ids.update([tuple(all_ids[a:a + n]) for _, _, a, n, _ in pieces])
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == Counter(want)
    by_sequence = defaultdict(list)
    for r in got:
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for places in by_sequence.values():
        places.sort()
        assert [o for o, _ in places] == [0, *np.cumsum([n for _, n in places])[:-1].tolist()] and sum(n for _, n in places) <= capacity
    total = sum(r.length for r in got)
    assert len(by_sequence) <= 1.05 * -(-total // capacity) + 2
    back = Counter()
    for r in packing.sequences(packed).collect():
        flat = np.frombuffer(r.ids, dtype="<u4")
        assert len(flat) == sum(r.lengths) <= capacity
        back.update(tuple(x.tolist()) for x in np.split(flat, np.cumsum(r.lengths)[:-1]))
    assert back == ids
    packed.unpersist()


def test_nothing_to_pack(spark):
    out = packing.pack_documents(frame(spark, []), JSON, 2)
    assert out.count() == 0 and out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]


# -- 12 -----------------------------------------------------------------------

def brute_groups(text, a_tok, pieces):
    if not text:
        return []
    a, b = a_tok.tokenizer.encode(" " + text, add_special_tokens=False).ids, pieces.sp.encode(text)
    if b"".join(pieces.bytes[i] for i in b) != (" " + text).encode():
        return []
    ends = [np.cumsum([t.n_bytes[i] for i in x]).tolist() for t, x in ((a_tok, a), (pieces, b))]
    out, i, j = [], 0, 0
    for end in sorted(set(ends[0]) & set(ends[1])):
        k, m = ends[0].index(end) + 1, ends[1].index(end) + 1
        out.append((a[i:k], b[j:m]))
        i, j = k, m
    return out


def test_alignment_equals_brute_force(spark, texts):
    rows = [(i, t, "en") for i, t in enumerate(texts)] + [(-1, None, None), (None, "null id", "en"), (0, texts[0], "en")]
    a_tok, pieces = ByteLevelCoder(JSON, plain_specials=True), PieceCoder(PIECE)
    groups = [brute_groups(t, a_tok, pieces) for _, t, _ in rows]
    count = Counter(pair for g in groups for pair in {(x, y) for a, b in g for x in a for y in b})
    best = defaultdict(int)
    for (x, _), n in count.items():
        best[x] = max(best[x], n)
    want = []
    for (i, _, _), g in zip(rows, groups):
        links = [(x, y) for a, b in g for x in a for y in b]
        spelled = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in g)
        want.append((i, sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), len(links), sum(count[p] == best[p[0]] for p in links),
                     sum(count[p] for p in links), hashlib.sha256(spelled.encode()).hexdigest() if g else ""))
    got = alignment.align(frame(spark, rows).repartition(4), JSON, PIECE).collect()
    assert Counter(map(tuple, got)) == Counter(want)
    assert alignment.align(frame(spark, []), JSON, PIECE).count() == 0
    only_empty = alignment.align(frame(spark, [(1, None, "x"), (2, "", "x"), (3, "▁", "x")]), JSON, PIECE).collect()
    assert sorted(map(tuple, only_empty)) == [(i, 0, 0, 0, 0, 0, 0, "") for i in (1, 2, 3)]


def test_gallop_finds_the_first_place_from_any_guess():
    rng = np.random.default_rng(2)
    for _ in range(60):
        long = np.unique(rng.integers(0, 400, rng.integers(1, 120)))
        x = np.sort(rng.integers(0, long[-1] + 1, 30))
        assert np.array_equal(alignment.gallop(x, long, rng.integers(-5, len(long) + 5, 30)), np.searchsorted(long, x))


def test_long_groups_are_linked_by_distinct_ids():
    a, b = np.array([1, 2, 1] * 40, dtype=np.uint32), np.array([0, 1] * 30, dtype=np.uint32)
    groups = alignment.Groups(a, np.array([0, len(a)]), b, np.array([0, len(b)]), np.array([1, 1, 1]), np.array([2, 2]))
    whole = alignment.Groups(a, np.array([0, len(a)]), b, np.array([0, len(b)]), np.array([0, 7, 7]), np.array([14, 14]))
    for g in (groups, whole):
        got = Counter()
        for _, code, times in zip(*g.links(5)):
            got[int(code)] += int(times)
        want = Counter()
        for k in range(len(g.n_a)):
            for x in a[g.end_a[k] - g.n_a[k]:g.end_a[k]]:
                for y in b[g.end_b[k] - g.n_b[k]:g.end_b[k]]:
                    want[int(x) * 5 + int(y)] += 1
        assert got == want


# -- 13 -----------------------------------------------------------------------

def brute_phrases(rows, min_count, contained, most):
    f, n = defaultdict(Counter), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in (1, 2, 3):
                f[lang].update(tuple(words[i:i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, count in f.items():
        found, candidates = [], {p: a for p, a in count.items() if len(p) > 1 and a >= min_count}
        for p, a in candidates.items():
            if any(len(q) > len(p) and 100 * b >= contained * a and any(q[i:i + len(p)] == p for i in range(len(q))) for q, b in candidates.items()):
                continue
            score, cut = min((1_000_000 * a * a // (count[p[:k]] * count[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), count[p[:cut]], count[p[cut:]]))
        out += [(lang, k, p.decode(), -a, left, right, n[lang], -s) for k, (s, a, p, left, right) in enumerate(sorted(found)[:most], 1)]
    return out


def test_phrases_equal_brute_force(spark):
    rng = random.Random(11)
    words = ["a", "A", "b", "New", "york", "é", "É", "日本", "x y", "the", "\x00"]
    gaps = [" ", " ", " ", "  ", "\t", ". ", "\n", ",", "\x0b", " ;"]
    rows = [(i, "".join(rng.choice(words) + rng.choice(gaps) for _ in range(rng.randrange(0, 60))), rng.choice(["en", "de", None, "", "und"])) for i in range(250)]
    rows += [(-1, None, "en"), (-2, "", "fr"), (None, "new york " * 30, "en"), (0, *rows[0][1:]), (7, "only few words", "fr"), (8, "a " * 40_000 + "b", "long")]
    docs = frame(spark, rows).repartition(6)
    for min_count, contained, most in ((10, 50, 2000), (3, 90, 5), (1, 1, 10 ** 6)):
        some = rows if min_count > 1 else rows[:40]
        got = collocations.collocations(docs if min_count > 1 else frame(spark, some), min_count, contained, most).collect()
        assert Counter(map(tuple, got)) == Counter(brute_phrases(some, min_count, contained, most))
    assert collocations.collocations(frame(spark, [])).count() == 0


def test_scores_are_exact_beyond_64_bits(spark, monkeypatch):
    """Counts whose products need more than 64 bits, through the operator's own joins."""
    words = spark.createDataFrame([(0, "en", "p", 3_000_000_019), (1, "en", "q", 2_999_999_957)], "id bigint, lang string, word string, f bigint")
    pairs = spark.createDataFrame([(0, 0, 1, 2_999_999_929)], "id bigint, x bigint, y bigint, f bigint")
    none = spark.createDataFrame([], "x bigint, y bigint, f bigint")
    sizes = spark.createDataFrame([("en", 10 ** 12)], "lang string, n bigint")
    monkeypatch.setattr(collocations, "phrase_counts", lambda *_: (words, pairs, none, sizes))
    row, = collocations.collocations(frame(spark, [])).collect()
    assert row.score == 1_000_000 * 2_999_999_929 ** 2 // (3_000_000_019 * 2_999_999_957)


def test_shares_answer_in_the_order_they_asked():
    rng = np.random.default_rng(1)
    lists = [np.unique(rng.integers(0, 500, 200)).astype(np.uint64) for _ in range(4)]
    counts = [rng.integers(1, 9, len(x)).astype(np.uint32) for x in lists]
    want = Counter()
    for x, n in zip(lists, counts):
        for k, c in zip(x.tolist(), n.tolist()):
            want[k] += c
    asks, order = defaultdict(list), []
    for s, (x, n) in enumerate(zip(lists, counts)):
        o, bucket, rank = shares.numbered(x, 7)
        assert np.array_equal(x[o][rank], x)
        order.append(x[o])
        for b, cut in shares.asked(bucket, 7):
            asks[b].append((s, shares.packed(x[o][cut]), shares.packed(n[o][cut])))
    got = defaultdict(list)
    for b, rows in asks.items():
        _, total, places = shares.totals([k for _, k, _ in rows], [n for _, _, n in rows])
        for (s, _, _), place in zip(rows, places):
            got[s].append((b, shares.packed(total[place])))
    for s, keys in enumerate(order):
        table = pa.table({"bucket": [b for b, _ in got[s]], "found": [x for _, x in got[s]]})
        assert shares.answers_of(table, "found").tolist() == [want[k] for k in keys.tolist()]
