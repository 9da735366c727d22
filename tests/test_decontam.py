"""Decontamination traps and properties, checked against a brute-force reimplementation
of the cut rule written here from its specification."""

import re
import string

from pyspark.sql import functions as F

from sparkeval.operators import decontam as D

TABLE = str.maketrans(string.ascii_uppercase, string.ascii_lowercase, string.punctuation)


def _norm(s):
    return s.translate(TABLE)


def _brute(doc, bench_texts, n=13, window=200, cutoff=10, min_slice=200):
    """Specification, written independently of the Spark job: contaminant windows from
    the normalised benchmark text; matching windows of the raw text (normalised per
    token); more than ``cutoff`` matches drop the document; otherwise the text between
    consecutive widened windows is kept when longer than ``min_slice``, and the tail
    after the last widened window (one past its inclusive end) likewise."""
    grams = set()
    for b in bench_texts:
        toks = _norm(b).split()
        grams |= {" ".join(toks[i:i + n]) for i in range(len(toks) - n + 1)}
    spans = [(m.start(), m.end() - 1, _norm(m.group(0))) for m in re.finditer(r"\S+", doc)]
    hits = [(spans[i][0], spans[i + n - 1][1]) for i in range(len(spans) - n + 1)
            if " ".join(t for _, _, t in spans[i:i + n]) in grams]
    if len(hits) > cutoff:
        return len(hits), []
    widened = [(max(0, a - window), min(len(doc), z + window)) for a, z in hits]
    previous_ends = [0] + [z for _, z in widened[:-1]]
    kept = [doc[p:lo] for p, (lo, _) in zip(previous_ends, widened) if lo - p > min_slice]
    last_end = widened[-1][1] if widened else -1
    if len(doc) - min_slice > last_end:
        kept.append(doc[last_end + 1:])
    return len(hits), kept


WORDS = ("alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau "
         "upsilon phi chi psi omega").split()


def _make_docs():
    bench = " ".join(WORDS[:16]) + "."
    filler = lambda k: " ".join(f"w{j}" for j in range(k))
    docs = [
        (1, filler(60) + " " + " ".join(WORDS[:16]) + " " + filler(80)),          # one cut
        (2, "short text without any match"),                                          # < 200 chars: dropped
        (3, " ".join([" ".join(WORDS[:16])] * 3)),                                    # many matches: dropped
        (4, filler(40) + " " + " ".join(WORDS[:6]) + " -- " + " ".join(WORDS[6:16]) + " " + filler(60)),  # punct token
        (5, filler(100)),                                                             # clean, long
        (6, " ".join(WORDS[:13]).upper() + " " + filler(70)),                         # case folded match
    ]
    return bench, docs


def test_cut_rule_matches_bruteforce(spark):
    bench, docs = _make_docs()
    b = spark.createDataFrame([(0, bench)], "item_id long, text string")
    d = spark.createDataFrame(docs, "doc_id long, text string")
    out = {r["doc_id"]: (r["n_matches"], list(r["chunks"])) for r in D.decontaminate(d, b).collect()}
    for doc_id, text in docs:
        assert out[doc_id] == _brute(text, [bench]), doc_id


def test_traps(spark):
    bench, docs = _make_docs()
    b = spark.createDataFrame([(0, bench)], "item_id long, text string")
    d = spark.createDataFrame(docs, "doc_id long, text string")
    rep = {r["doc_id"]: r for r in D.contamination_report(d, b).collect()}
    assert rep[2]["status"] == "clean" and rep[2]["n_chunks"] == 0       # short clean doc disappears
    assert rep[3]["status"] == "dropped"                                  # > 10 matches
    assert rep[4]["n_matches"] == 0                                       # punctuation-only token blocks
    assert rep[6]["n_matches"] == 1                                       # ASCII case folding


def test_no_registered_ngram_left_in_chunks(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    chunks = D.clean_documents(docs, bench).select(F.col("doc_id"), F.col("chunk").alias("text"))
    dirt = D.register_contaminants(bench)
    left = D.find_matches(chunks.withColumn("doc_id", F.monotonically_increasing_id()), dirt)
    assert left.count() == 0


def test_expected_shape_sf0001(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    rep = D.contamination_report(docs, bench)
    assert rep.count() == 200
    assert rep.filter("n_matches > 0").count() == 3
    assert rep.filter("status = 'dropped'").count() == 3


def test_frequent_ngrams_exact_against_bruteforce(spark):
    rows = [(i, " ".join(["common words here"] * 2 + [f"u{i}"])) for i in range(15)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["ngram"]: r["n_docs"] for r in D.frequent_ngrams(d, n=3, min_docs=10).collect()}
    assert got == {"common words here": 15, "words here common": 15, "here common words": 15}


def test_cut_rule_property_random_documents(spark):
    """Random documents built from a small vocabulary (so windows repeat), punctuation
    tokens and whitespace runs: the Spark job equals the specification on every one."""
    from hypothesis import HealthCheck, given, settings
    from hypothesis import strategies as st

    vocab = WORDS[:8] + ["--", "X.", "Alpha,", " ".join(WORDS[:8] * 2), " ".join(WORDS[:8] * 2).upper()]
    bench_text = " ".join(WORDS[:8] * 3)
    sep = st.sampled_from([" ", "  ", "\n", " \n "])
    doc = st.lists(st.tuples(st.sampled_from(vocab), sep), min_size=0, max_size=160).map(
        lambda xs: "".join(w + s for w, s in xs))

    b = spark.createDataFrame([(0, bench_text)], "item_id long, text string")
    dirt = D.register_contaminants(b).collect()      # warm and reuse the contaminant set

    @settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
    @given(st.lists(doc, min_size=1, max_size=8))
    def check(texts):
        d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        got = {r["doc_id"]: (r["n_matches"], list(r["chunks"])) for r in D.decontaminate(d, b).collect()}
        for i, t in enumerate(texts):
            assert got[i] == _brute(t, [bench_text]), (i, t)

    assert dirt
    check()
