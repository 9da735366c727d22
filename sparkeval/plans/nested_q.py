"""Nested-source queries (SRC05-SRC08, SRC13-SRC16, SRC18, SRC20, FLT08, FLT09, FLT11, PRJ04,
SCR13, JN02, SET05).  The nested input is JSON text made row by row from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import prompts as P
from ..operators import mkqa as MK
from ..operators import sampling as SM
from ..sources import readers as R
from .mkqa_q import FX_NOANS
from .registry import load, query, sql


def _json(df, schema, **fields):
    """One JSON object per row, read back with the schema a file reader would use."""
    text = F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()]))
    return df.select(F.from_json(text, schema).alias("_j")).select("_j.*")


@query("flatten_squad", """SELECT lang AS title, text AS context, 'q' || CAST(doc_id AS VARCHAR) || s AS id, source || s AS question, lang AS answer, n_chars AS answer_start
FROM documents, (SELECT unnest(['a', 'b']) AS s)""")
def q_flatten_squad(spark, sf_dir):
    d = load(spark, sf_dir, "documents")
    qa = lambda s: F.struct(F.concat(F.lit("q"), F.col("doc_id").cast("string"), F.lit(s)).alias("id"), F.concat("source", F.lit(s)).alias("question"),
                            F.array(F.struct(F.col("lang").alias("text"), F.col("n_chars").alias("answer_start"))).alias("answers"))
    article = F.struct(F.col("lang").alias("title"), F.array(F.struct(F.col("text").alias("context"), F.array(qa("a"), qa("b")).alias("qas"))).alias("paragraphs"))
    src = _json(d, R.SQUAD_SCHEMA, data=F.array(article))
    out = R.flatten_squad(src)
    return out.select("title", "context", "id", "question", F.element_at("answers", 1).alias("answer"), F.element_at("answer_starts", 1).alias("answer_start"))


@query("flatten_map_qa", """SELECT source AS section_id, text AS passage, CAST(doc_id AS VARCHAR) AS query_id, lang AS question, CAST(n_chars AS VARCHAR) AS answer,
  CAST(CASE WHEN lang = 'en' THEN 1 ELSE 0 END AS INT) AS n_validated FROM documents""")
def q_flatten_map_qa(spark, sf_dir):
    d = load(spark, sf_dir, "documents")
    pair = F.struct(F.col("lang").alias("question"), F.col("doc_id").cast("string").alias("query_id"), F.col("n_chars").cast("string").alias("answer"),
                    F.when(F.col("lang") == "en", F.array("source")).alias("validated_answers"))
    src = _json(d, "sections map<string,struct<passage:string,qa_pairs:array<struct<question:string,query_id:string,answer:string,validated_answers:array<string>>>>>",
                sections=F.create_map(F.col("source"), F.struct(F.col("text").alias("passage"), F.array(pair).alias("qa_pairs"))))
    out = R.flatten_map_qa(src)
    return out.select("section_id", "passage", "query_id", "question", "answer", F.size("validated_answers").alias("n_validated"))


@query("flatten_dialog_qa", """SELECT CAST(doc_id AS VARCHAR) AS id, text AS story, CAST(t AS INT) AS turn_id, CASE t WHEN 1 THEN lang ELSE source END AS question,
  CASE t WHEN 1 THEN source ELSE lang END AS answer FROM documents, (SELECT unnest([1, 2]) AS t)""")
def q_flatten_dialog_qa(spark, sf_dir):
    d = load(spark, sf_dir, "documents")
    src = _json(d, "id string, story string, questions array<string>, answers array<string>", id=F.col("doc_id"), story=F.col("text"),
                questions=F.array("lang", "source"), answers=F.array("source", "lang"))
    return R.flatten_dialog_qa(src).withColumn("turn_id", F.col("turn_id").cast("int"))


@query("flatten_exam_map", """SELECT source || '_' || CAST(doc_id AS VARCHAR) AS id, source AS exam, regexp_replace(regexp_replace(text, '^\\s+', ''), '\\s+$', '') AS question,
  CAST(n_chars % 5 AS INT) AS answer, lang || '|' || source AS choices FROM documents""")
def q_flatten_exam_map(spark, sf_dir):
    d = load(spark, sf_dir, "documents")
    q = F.struct(F.col("doc_id").alias("qid"), F.concat(F.lit(" \n"), "text", F.lit("\t ")).alias("qtext"), (F.col("n_chars") % 5).cast("string").alias("ra"), F.array("lang", "source").alias("answers"))
    src = _json(d, "exams map<string,array<struct<qid:bigint,qtext:string,ra:string,answers:array<string>>>>", exams=F.create_map(F.col("source"), F.array(q)))
    return R.flatten_exam_map(src).withColumn("choices", F.array_join("choices", "|"))


@query("parse_ref_lists", """SELECT doc_id, trim(lang) || '|' || trim(source) AS refs FROM documents WHERE n_chars % 3 <> 0""")
def q_parse_ref_lists(spark, sf_dir):
    d = load(spark, sf_dir, "documents").select("doc_id", F.when(F.col("n_chars") % 3 != 0, F.concat(F.lit(" "), "lang", F.lit(" ; "), "source", F.lit(" "))).otherwise(" ").alias("refs"))
    return R.parse_ref_lists(d, ["refs"]).withColumn("refs", F.array_join("refs", "|"))


@query("choices_from_map", """SELECT doc_id, 'x|y' || CASE WHEN lang = 'en' THEN '|z' ELSE '' END AS choices,
  CAST(CASE WHEN n_chars % 2 = 0 THEN 0 ELSE 1 END AS BIGINT) AS gold, CASE WHEN n_chars % 2 = 0 THEN 'A' ELSE 'B' END AS letter, lang = 'en' AS three FROM documents""")
def q_choices_from_map(spark, sf_dir):
    d = load(spark, sf_dir, "documents")
    even = F.col("n_chars") % 2 == 0
    text = F.concat(F.lit('{"x": '), F.when(even, "1").otherwise("0"), F.lit(', "y": '), F.when(even, "0").otherwise("1"), F.when(F.col("lang") == "en", ', "z": 0').otherwise(""), F.lit("}"))
    m = d.select("doc_id", F.from_json(text, "map<string,int>").alias("m"))
    c = m.select("doc_id", R.choices_from_map("m").alias("c"), P.min_alternatives("m", 3).alias("three"))
    return c.select("doc_id", F.array_join("c.choices", "|").alias("choices"), F.col("c.gold").cast("bigint").alias("gold"), F.col("c.gold_letter").alias("letter"), "three")


@query("subset_by_meta", "SELECT CAST(doc_id AS BIGINT) AS doc_id, source AS subset FROM documents WHERE source = 'src1'")
def q_subset_by_meta(spark, sf_dir):
    d = load(spark, sf_dir, "documents")
    src = _json(d, "doc_id bigint, meta struct<subset:string>", doc_id=F.col("doc_id"), meta=F.struct(F.col("source").alias("subset")))
    return R.subset_by_meta(src, "meta.subset", "src1").select("doc_id", F.col("meta.subset").alias("subset"))


@query("rekey_jsonl", "SELECT doc_id, 'Question: ' || text || ' Answer: ' || lang AS prompt FROM documents")
def q_rekey_jsonl(spark, sf_dir):
    d = load(spark, sf_dir, "documents")
    src = _json(d, "doc_id bigint, input string", doc_id=F.col("doc_id"), input=F.concat(F.lit("Q: "), "text", F.lit(" A: "), "lang"))
    return R.rekey_jsonl(src, {"input": "prompt"}, {"prompt": [("Q:", "Question:"), ("A:", "Answer:")]})


@query("gold_answers", """SELECT doc_id AS example_id, lang, CASE WHEN lang < source THEN lang || '|' || source ELSE source || '|' || lang END AS gold, 'entity' AS first_type
FROM documents WHERE n_chars % 3 = 0""")
def q_gold_answers(spark, sf_dir):
    d = load(spark, sf_dir, "documents")
    kind = F.when(F.col("n_chars") % 3 == 0, "entity").when(F.col("n_chars") % 3 == 1, "long_answer").otherwise("unanswerable")
    src = _json(d, "example_id bigint, lang string, answers array<struct<type:string,text:string,aliases:array<string>>>", example_id=F.col("doc_id"), lang=F.col("lang"),
                answers=F.array(F.struct(kind.alias("type"), F.col("source").alias("text"), F.array("lang", "source").alias("aliases"))))
    out = MK.gold_answers(src)
    return out.select("example_id", "lang", F.array_join("gold", "|").alias("gold"), F.element_at("types", 1).alias("first_type"))


@query("fewshot_candidates", "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT item_id FROM benchmark)")
def q_fewshot_candidates(spark, sf_dir):
    excluded = load(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"))
    return SM.fewshot_candidates(load(spark, sf_dir, "documents").select("doc_id", "source"), excluded)


@query("join_predictions", f"""WITH fx AS ({FX_NOANS})
SELECT fx.id, fx.lang, round(exp(-na_prob), 6) AS no_answer_prob, d.source AS prediction FROM fx JOIN documents d ON d.doc_id = fx.id""")
def q_join_predictions(spark, sf_dir):
    """Gold answers of the labelled documents joined to predictions for every document."""
    gold = sql(spark, sf_dir, FX_NOANS).select("id", "lang", F.round(MK.no_answer_prob(-F.col("na_prob")), 6).alias("no_answer_prob"))
    preds = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("prediction"))
    return MK.join_predictions(gold, preds, "id").select("id", "lang", "no_answer_prob", "prediction")


@query("tag_fixed_groups", """SELECT doc_id, source, CAST(floor((row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) / 3) AS BIGINT) AS group_id FROM documents""")
def q_tag_fixed_groups(spark, sf_dir):
    d = load(spark, sf_dir, "documents").select("doc_id", "source")
    return R.tag_fixed_groups(d, 3, [F.col("doc_id")], ["source"]).withColumn("group_id", F.col("group_id").cast("bigint"))
