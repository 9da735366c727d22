"""Counts of n-grams inside Arrow batches against counting one row at a time."""

import random
from collections import Counter

from pyspark.sql import functions as F

from sparkeval.functions.grams import bag_overlaps, overlaps, window_hashes
from sparkeval.operators import decontam as D
from sparkeval.operators import scoring as S
from sparkeval.operators import textmetrics as TM


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def texts(seed, n):
    rng = random.Random(seed)
    make = lambda: rng.choice([None, "", " ", "é 😀 x", *(" ".join(rng.choice(["a", "b", "ç", "lua", "😀"]) for _ in range(rng.randrange(1, 40))) for _ in range(9))])
    return [(i, make(), [make() for _ in range(rng.randrange(0, 4))] if i % 17 else None) for i in range(n)]


def test_overlaps_equal_counters(spark):
    rows = texts(1, 300)
    df = spark.createDataFrame(rows, "id long, hyp string, refs array<string>").repartition(3)
    for max_n, chars in ((4, False), (6, True)):
        got = {r.id: r.x for r in df.select("id", overlaps("hyp", "refs", max_n, chars).alias("x")).collect()}
        for i, hyp, refs in rows:
            split = (lambda t: [c for c in t or "" if not c.isspace()]) if chars else (lambda t: (t or "").split())
            assert got[i].len == (None if hyp is None else len(split(hyp)))
            assert got[i].ref_lens == (None if refs is None else [None if t is None else len(split(t)) for t in refs])
            for n in range(1, max_n + 1):
                grams = lambda t: Counter(tuple(split(t)[k:k + n]) for k in range(len(split(t)) - n + 1))
                union = Counter()
                for t in refs or []:
                    union |= grams(t)
                x = got[i].orders[n - 1]
                assert (x.total, x.correct, x.ref_total) == (sum(grams(hyp).values()), sum((grams(hyp) & union).values()), sum(union.values()))


def test_bags_equal_counters(spark):
    rows = [(i, h and " ".join(h.split()), r and [t and " ".join(t.split()) for t in r]) for i, h, r in texts(2, 300)]
    df = spark.createDataFrame(rows, "id long, hyp string, refs array<string>")
    got = {r.id: r.x for r in df.select("id", bag_overlaps("hyp", "refs").alias("x")).collect()}
    assert df.filter("id < 0").select(bag_overlaps("hyp", "refs")).count() == 0
    for i, hyp, refs in rows:
        assert (got[i] is None) == (refs is None)
        for t, x in zip(refs or [], got[i] or []):
            a, b = Counter((hyp or "").split()), Counter((t or "").split())
            want = (None if hyp is None else sum(a.values()), None if t is None else sum(b.values()), None if None in (hyp, t) else len(a & b), None if None in (hyp, t) else sum((a & b).values()))
            assert (x.n_pred, x.n_ref, x.once, x.bag) == want
            assert x.same == (None if None in (hyp, t) else hyp == t)


def test_windows(spark):
    """Places of all windows, of the first of equal ones; equal windows have equal hashes in any text."""
    df = spark.createDataFrame([(0, "a b a b a"), (1, "b a b"), (2, "a  b"), (3, ""), (4, None), (5, "a")], "id int, t string")
    at = {r.id: r.w for r in df.select("id", window_hashes("t", 2).alias("w")).collect()}
    assert [x.pos for x in at[0]] == [0, 1, 2, 3] and at[0][0].h == at[0][2].h != at[0][1].h
    assert [x.h for x in at[1]] == [at[0][1].h, at[0][0].h]
    assert len(at[2]) == 2 and at[3] == [] and at[4] is None and at[5] == []
    first = {r.id: r.w for r in df.select("id", window_hashes("t", 2, distinct=True).alias("w")).collect()}
    assert [x.pos for x in first[0]] == [0, 1]
    assert df.filter("id in (4, 5)").repartition(1).select(F.coalesce(F.size(window_hashes("t", 13, distinct=True)), F.lit(0)).alias("n")).agg(F.sum("n")).first()[0] == 0
    long = spark.createDataFrame([(" ".join(f"w{i % 700}" for i in range(5000)),)], "t string")        # numbers pass 62 bits
    assert long.select(F.size(window_hashes("t", 13, distinct=True))).first()[0] == 700


def test_text_metrics_count_in_batches(spark):
    """No interpreted n-gram arrays per row."""
    df = spark.createDataFrame([(1, "a b", ["a b"], "a b")], "id long, p string, refs array<string>, r string")
    for out in (TM.corpus_chrf(df, "id", "p", "r"), TM.corpus_bleu(df, "id", "p", "refs"), df.select(S.score_qa("p", "refs").alias("s"))):
        assert "ArrowEvalPython" in plan(out) and "array_intersect" not in plan(out)


def test_windows_count_in_batches(spark):
    docs = spark.createDataFrame([(1, "a b c d " * 9)], "doc_id long, text string")
    assert "ArrowEvalPython" in plan(D.find_matches(docs, D.register_contaminants(docs.withColumnRenamed("doc_id", "item_id"))))
    assert "ArrowEvalPython" in plan(D.frequent_ngrams(docs, 2, 0))


def test_chunks_are_built_once(spark):
    docs = spark.createDataFrame([(1, "a b c d " * 99), (2, "z " * 300), (3, "")], "doc_id long, text string")
    out = D.clean_documents(docs, docs.filter("doc_id = 1").select(F.col("doc_id").alias("item_id"), "text"))
    assert "Filter" not in plan(out).split("posexplode")[1].split("BroadcastExchange")[0]
    assert [(r.doc_id, r.chunk_idx) for r in out.collect()] == [(2, 0)]
