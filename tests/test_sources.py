"""File sources and sinks on small files written here (own text)."""

import gzip
import json
import os

from pyspark.sql import functions as F

from sparkeval.operators import mkqa as MK
from sparkeval.operators import runs as RU
from sparkeval.sources import readers as R
from sparkeval.sources import sinks as SK
from sparkeval.sources.pages import segment_pages


def _w(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)
    return path


def test_jsonl_stem_and_family(spark, tmp_dir):
    _w(f"{tmp_dir}/exams/y2022.jsonl", '{"question": "q1", "label": "A"}\n\n{"question": "q2", "label": "B"}\n')
    _w(f"{tmp_dir}/exams/y2023.jsonl", '{"question": "q3", "label": "C"}\n')
    df = R.scan_by_stem(spark, f"{tmp_dir}/exams/*.jsonl", "question string, label string")
    assert sorted((r["dataset"], r["question"]) for r in df.collect()) == [("y2022", "q1"), ("y2022", "q2"), ("y2023", "q3")]
    fam = R.load_eval_family({"a": df.select("question"), "b": df.select("label")})
    assert fam.count() == 6 and set(fam.columns) == {"question", "label", "dataset"}


def test_squad_and_dialog_flatten(spark, tmp_dir):
    doc = {"data": [{"title": "t", "paragraphs": [{"context": "c", "qas": [
        {"id": "1", "question": "q", "answers": [{"text": "x", "answer_start": 0}, {"text": "y", "answer_start": 2}]}]}]}]}
    _w(f"{tmp_dir}/squad.json", json.dumps(doc))
    df = spark.read.schema(R.SQUAD_SCHEMA).option("multiLine", True).json(f"{tmp_dir}/squad.json")
    r = R.flatten_squad(df).first()
    assert r["id"] == "1" and list(r["answers"]) == ["x", "y"]
    d = spark.createDataFrame([("s1", "story", ["q1", "q2"], ["a1", "a2"])], "id string, story string, questions array<string>, answers array<string>")
    assert [(x["turn_id"], x["answer"]) for x in R.flatten_dialog_qa(d).collect()] == [(1, "a1"), (2, "a2")]


def test_block_and_tail_records(spark, tmp_dir):
    _w(f"{tmp_dir}/logic.txt", "a\nctx.one\nquest.\nA.opt.1\nB.opt2\n\nb\nc2\nq2\nA.x\nB.y\n")
    rows = R.parse_block_records(spark, f"{tmp_dir}/logic.txt").collect()
    assert rows[0]["label"] == "a" and rows[0]["context"] == "ctx. one" and list(rows[0]["options"]) == ["opt. 1", "opt2"]
    _w(f"{tmp_dir}/sat.txt", "# comment\nsrc\nstem\nc1\nc2\nc3\nc4\nc5\nsol\n\nx\nsrc2\nstem2\nd1\nd2\nd3\nd4\nd5\ns2\n")
    t = R.parse_tail_records(spark, f"{tmp_dir}/sat.txt").orderBy("source").collect()
    assert [x["solution"] for x in t] == ["sol", "s2"] and t[1]["stem"] == "stem2"


def test_corpus_and_failure_logs(spark, tmp_dir):
    with gzip.open(f"{tmp_dir}/corpus.jsonl.gz", "wt", encoding="utf-8") as f:
        f.write('{"text": "plain", "meta": {"pile_set_name": "A"}}\n{"text": ["p1", "p2"]}\n"bare string"\n')
    got = sorted(r["text"] for r in R.read_corpus(spark, f"{tmp_dir}/corpus.jsonl.gz").collect())
    assert got == ["bare string", "p1\n\np2", "plain"]
    rule = "=" * 50
    _w(f"{tmp_dir}/logs/FAIL_x.txt", f"MODEL: m | FAMILY: qwen\nDATASET: enem\n{rule}\nPROMPT:\nhello\n{rule}\nRAW OUTPUT:\nraw\n{rule}\nCLEAN OUTPUT:\n\n")
    r = R.ingest_failure_logs(spark, f"{tmp_dir}/logs/*.txt").first()
    assert (r["model"], r["family"], r["dataset"], r["prompt"], r["raw_output"]) == ("m", "qwen", "enem", "hello", "raw")


def test_choices_from_map_and_ref_lists(spark):
    df = spark.createDataFrame([('{"yes": 0, "no": 1, "maybe": 0}',)], "j string")
    r = df.select(R.choices_from_map(F.from_json("j", "map<string,int>")).alias("c")).first()["c"]
    assert list(r["choices"]) == ["yes", "no", "maybe"] and r["gold"] == 1 and r["gold_letter"] == "B"
    d = spark.createDataFrame([("a; b ;c", "x"), ("", "y")], "ok string, bad string")
    assert [list(x["ok"]) for x in R.parse_ref_lists(d, ["ok"]).collect()] == [["a", "b", "c"]]


def test_segment_pages(spark):
    lines = ["intro", " = Title = ", "body", "", " = = Sub = = ", "more", " = Next = ", "  "]
    df = spark.createDataFrame([(1, i, l) for i, l in enumerate(lines)], "file long, line_no long, line string")
    pages = [r["page"] for r in segment_pages(df).orderBy("page_no").collect()]
    assert pages == ["intro", " = Title = \nbody\n\n = = Sub = = \nmore", " = Next = \n  "]


def test_perf_logs_and_gold_answers(spark):
    lines = [(1, 0, "llama_print_timings: eval time = 10 ms / 5 runs ( 2,0 ms per token, 12,5 tokens per second)"),
             (1, 1, "llama_print_timings: prompt eval time = 5 ms / 5 tokens ( 1.5 ms / token)"),
             (2, 0, "generation: 7.5 t/s"), (2, 1, "generation: 9.0 t/s")]
    df = spark.createDataFrame(lines, "run_id long, line_no long, line string")
    out = {r["run_id"]: (r["tokens_per_second"], r["ttft_ms"]) for r in RU.parse_perf_logs(df).collect()}
    assert out[1] == (12.5, 1.5) and out[2] == (7.5, 1000 / 7.5)
    ann = spark.createDataFrame([("e1", "pt", [("entity", "Rio", ["rio", "Rio"])]), ("e2", "pt", [("unanswerable", None, None)])],
                                "example_id string, lang string, answers array<struct<type:string,text:string,aliases:array<string>>>")
    g = MK.gold_answers(ann).collect()
    assert len(g) == 1 and list(g[0]["gold"]) == ["Rio", "rio"]


def test_results_table_blanks_repeats(spark, tmp_dir):
    res = spark.createDataFrame([("t", "m", "acc", 0.5, 0.01, 10), ("t", "m", "f1", 0.25, None, 10)],
                                "task string, prompt_mode string, metric string, value double, stderr double, n long")
    lines = [r["line"] for r in SK.results_table(res).orderBy("line_no").collect()]
    assert lines == ["|t|m|acc|0.5000|±|0.0100|", "|||f1|0.2500|||"]
    SK.write_results(res.withColumn("model", F.lit("x")), f"{tmp_dir}/res")
    assert spark.read.json(f"{tmp_dir}/res").count() == 1
