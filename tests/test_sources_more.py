"""Remaining readers / sinks and small Column helpers on hand-written inputs."""

import json
import os

from pyspark.sql import functions as F

from sparkeval.functions import clean as C
from sparkeval.operators import bootstrap as BS
from sparkeval.operators import npm as N
from sparkeval.sources import readers as R
from sparkeval.sources import sinks as SK


def _w(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)


def test_xml_rows_and_attributes(spark, tmp_dir):
    _w(f"{tmp_dir}/exam.xml", '<exam><question id="q1" IC="No"><statement>S1</statement></question>'
                              '<question id="q2" IC="Yes"><statement>S2</statement></question></exam>')
    df = R.read_exam_xml(spark, f"{tmp_dir}/exam.xml")
    got = sorted((r["_id"], r["_IC"], r["statement"]) for r in df.collect())
    assert got == [("q1", "No", "S1"), ("q2", "Yes", "S2")]


def test_fixed_groups_and_routes(spark):
    df = spark.range(0, 23).withColumn("v", F.col("id") * 2)
    g = R.tag_fixed_groups(df, 5, [F.col("id")])
    assert {r["id"]: r["group_id"] for r in g.collect()} == {i: i // 5 for i in range(23)}
    r = R.route_splits(df.withColumn("p", (F.col("id") % 2).cast("string")), "p", {"0": "train", "1": "test"})
    assert {x["split"] for x in r.collect()} == {"train", "test"}


def test_json_dir_rekey_and_meta(spark, tmp_dir):
    _w(f"{tmp_dir}/math/a.json", json.dumps({"problem": "Q: 1+1", "solution": "2"}))
    _w(f"{tmp_dir}/math/b.json", "")
    _w(f"{tmp_dir}/math/c.txt", json.dumps({"problem": "skip", "solution": "x"}))
    df = R.scan_json_dir(spark, f"{tmp_dir}/math", "problem string, solution string")
    assert df.count() == 1
    rk = R.rekey_jsonl(df, {"problem": "question"}, {"question": [("Q:", "Question:")]})
    assert rk.first()["question"] == "Question: 1+1"
    m = spark.createDataFrame([("t1", ("A",)), ("t2", ("B",))], "text string, meta struct<pile_set_name:string>")
    assert [r["text"] for r in R.subset_by_meta(m, "meta.pile_set_name", "B").collect()] == ["t2"]


def test_map_and_exam_flatten(spark):
    sec = spark.createDataFrame([({"s1": ("passage", [("q?", "id1", "ans", None)])},)],
                                "sections map<string, struct<passage:string, qa_pairs:array<struct<question:string, query_id:string, answer:string, validated_answers:array<string>>>>>")
    r = R.flatten_map_qa(sec).first()
    assert (r["section_id"], r["query_id"], list(r["validated_answers"])) == ("s1", "id1", [])
    ex = spark.createDataFrame([({"2013": [(7, " text ", "3", ["a", "b"])]},)],
                               "exams map<string, array<struct<qid:int, qtext:string, ra:string, answers:array<string>>>>")
    e = R.flatten_exam_map(ex).first()
    assert (e["id"], e["question"], e["answer"]) == ("2013_7", "text", 3)


def test_sinks(spark, tmp_dir):
    s = spark.createDataFrame([("t", "m", 1, "A"), ("t", "m", 2, ""), ("u", "m", 3, None)],
                              "task string, prompt_mode string, doc_id long, pred string")
    SK.write_samples(s, f"{tmp_dir}/samples")
    SK.write_samples(s.filter("task = 't'"), f"{tmp_dir}/samples")   # replaces only task=t
    assert spark.read.json(f"{tmp_dir}/samples").count() == 3
    bad = SK.audit_failures(s, f"{tmp_dir}/audit")
    assert bad.count() == 2 and spark.read.parquet(f"{tmp_dir}/audit").count() == 2
    series = spark.createDataFrame([(1, "a", "all", 0.5), (2, "a", "all", 0.7), (1, "b", "all", 0.1)],
                                   "step long, prompt_mode string, subset string, npm double")
    N.write_npm_series(series, f"{tmp_dir}/npm")
    assert spark.read.option("header", True).csv(f"{tmp_dir}/npm").count() == 2


def test_model_tags_and_stops(spark):
    df = spark.createDataFrame([("Meta-Llama-3.1-8B-Instruct-Q4_K_M.gguf",), ("qwen2.5-7b-q8_0",), ("sabia-7b-Q5_1",)], "n string")
    out = df.select(C.model_family("n").alias("f"), C.quant_tag("n").alias("q"),
                    C.stop_tokens("n", F.lit("sabia7"), F.array(F.lit("###"), F.lit("Fim"))).alias("s")).collect()
    assert [(r["f"], r["q"]) for r in out] == [("llama3", "Q4_K_M"), ("qwen", "Q8_0"), ("sabia", "Q5_1")]
    assert list(out[2]["s"]) == ["###", "Fim", "</s>", "### Instrução:", "### Resposta:"]
    assert list(out[1]["s"])[0] == "<|im_end|>"


def test_stderr_dispatch(spark):
    df = spark.range(0, 200).select(F.col("id").alias("doc_id"), F.lit("t").alias("task"),
                                    (F.col("id") % 3 == 0).cast("double").alias("v"),
                                    (F.col("id") % 2).alias("gold"), (F.col("id") % 5 == 0).cast("int").alias("pred"))
    assert BS.metric_stderr(df, "task", "f1_macro") is None
    a = BS.metric_stderr(df, "task", "acc", value="v").first()["stderr"]
    b = BS.metric_stderr(df, "task", "f1", iters=50, gold="gold", pred="pred").first()["stderr"]
    assert a > 0 and b > 0
