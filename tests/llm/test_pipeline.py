"""The pipeline against a brute-force version that runs its five steps over plain lists, and
the registered queries against their SQL."""

import hashlib
import os
import re
import sys

import duckdb
import public_tokenizers as P
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

import corpus_pipeline  # noqa: E402
from sparkeval.llm import decontaminate, near_dedup, quality_rules  # noqa: E402
from sparkeval.llm.bpe_codec import load_ranks  # noqa: E402
from sparkeval.llm.queries import ORACLES, QUERIES  # noqa: E402

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(docs, items):
    """docs: {doc_id: text}."""
    import tiktoken
    judged = {i: quality_rules.judge(t, quality_rules.LineRules()) for i, t in docs.items()}
    docs = {i: judged[i]["clean_text"] for i in docs if judged[i]["kept"]}
    first, out = set(), {}
    for i in sorted(docs):                                  # first occurrences in order
        lines = docs[i].split("\n")
        at = [j for j, x in enumerate(lines) if WORD.search(x)]
        gone = set()
        for a, b, c in zip(at, at[1:], at[2:]):
            w = (lines[a], lines[b], lines[c])
            if w in first:
                gone |= set(range(a, c + 1))
            first.add(w)
        if not gone or any(j not in gone for j in at):
            out[i] = "\n".join(x for j, x in enumerate(lines) if j not in gone)
    ids = sorted(out)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    words = {i: WORD.findall(out[i]) for i in ids}
    for n, i in enumerate(ids):
        for j in ids[:n]:
            longest = max(len(words[i]), len(words[j]))
            band = int(0.2 * longest + 1e-9)
            if longest and abs(len(words[i]) - len(words[j])) <= band and near_dedup.banded_distance(words[i], words[j], band) <= band:
                x, y = sorted((find(i), find(j)))
                root[y] = x
    out = {i: out[i] for i in ids if find(i) == i}
    bench = [x for x in decontaminate.normalise([t for _, t in items]) if len(x) >= decontaminate.MIN_CHARS]
    clean = dict(zip(out, decontaminate.normalise(list(out.values()))))
    masks = [(decontaminate.masks(x), len(x)) for x in bench]
    out = {i: t for i, t in out.items() if not any(decontaminate.best_occurrence(m, n, clean[i])[0] <= int(decontaminate.ERROR_RATE * n) for m, n in masks)}
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=load_ranks(P.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    rows = set()
    for i, t in out.items():
        ids = own.encode_ordinary(t)
        rows.add((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))
    return rows


def test_pipeline_equals_brute_force(spark):
    docs = dict(duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall())
    items = duckdb.sql(f"SELECT item_id, text FROM '{SF}/benchmark.parquet'").fetchall()
    got = corpus_pipeline.run(spark, SF)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert {tuple(r) for r in got.collect()} == brute(docs, items)


def test_stages_keep_the_columns_and_take_odd_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (9001, "", "en", "s", 0), (9002, None, "en", "s", None)], docs.schema)
    rows = docs.limit(60).unionByName(odd).unionByName(docs.limit(60).filter("doc_id < 5"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        for given in (rows, docs.limit(0)):
            out = stage(spark, given, SF)
            assert out.columns == docs.columns and out.schema.simpleString() == docs.schema.simpleString(), name
            assert out.count() <= given.count()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "near_dedup", "decontaminate", "bpe_codec"]


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "labels", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    res = con.execute(ORACLES[name])
    cols = [c[0] for c in res.description]
    df = QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(cols)
    assert sorted([tuple(r[c] for c in cols) for r in df.collect()], key=str) == sorted(res.fetchall(), key=str)
