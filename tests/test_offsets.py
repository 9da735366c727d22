"""Word offsets and match spans against Python's own."""

import re

from pyspark.sql import functions as F

from sparkeval.operators import decontam as D


def test_word_offsets(spark):
    texts = ["", " ", "a", " a", "a  bc\n\td ", "日本 😀😀 é", "x y z", "word " * 5000, None, "😀"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    for r in rows.select("id", "text", D.word_offsets("text").alias("at")).collect():
        if r.text is None:
            assert r["at"] is None
            continue
        assert [(x["start"], x["end"]) for x in r["at"]] == [(m.start(), m.end() - 1) for m in re.finditer(r"\S+", r.text)]


def test_match_spans_point_at_the_windows(spark):
    item = "One two, three four five"
    docs = spark.createDataFrame([(1, f"😀 intro  {item}\ttail {item}"), (2, "nothing here at all to be found"), (3, item), (4, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = D.match_spans(docs, bench, n=4)
    text = {r.doc_id: r.text for r in docs.collect()}
    found = sorted((r.doc_id, r.pos, text[r.doc_id][r.start:r.end + 1]) for r in got.collect())
    a, b = "One two, three four", "two, three four five"
    assert found == [(1, 2, a), (1, 3, b), (1, 8, a), (1, 9, b), (3, 0, a), (3, 1, b)]
    plan = got._jdf.queryExecution().toString()
    assert "Window" not in plan
