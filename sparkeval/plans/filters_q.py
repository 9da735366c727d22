"""Row filter and prompt projection queries (FLT01-FLT07, FLT10, PRJ01-PRJ03, PRJ05-PRJ08)."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..functions import prompts as P
from ..functions import templates as TP
from .registry import load, query, sql, sql_str

AREAS = ["linguagens", "humanas", "natureza", "matematica"]  # area names by question block


@query("squeeze_text", """SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '\\s*\\n+\\s*', ' ', 'g'),
  ' {2,}', ' ', 'g'), '^\\s+', '') AS squeezed FROM documents""")
def q_squeeze_text(spark, sf_dir):
    """PRJ01.  (The oracle spells rule 2 as ' {2,}': after rule 1 the driver text holds no
    whitespace but spaces.)"""
    return load(spark, sf_dir, "documents").select("doc_id", P.squeeze_text("text").alias("squeezed"))


FX_SENT = """SELECT d.doc_id, d.text, CASE WHEN l.toxic = 1 AND l.quality = 0 THEN '-' ELSE CAST(l.quality - l.toxic AS STRING) END AS sentiment
FROM documents d JOIN labels l ON d.doc_id = l.doc_id"""


@query("clean_sentiment_rows", f"""SELECT doc_id, CAST(sentiment AS INT) + 1 AS sentiment,
  regexp_replace(regexp_replace(text, ' +', ' ', 'g'), '\\n+', ' ', 'g') AS text FROM ({FX_SENT}) WHERE text IS NOT NULL AND sentiment <> '-'""")
def q_clean_sentiment_rows(spark, sf_dir):
    return P.clean_sentiment_rows(sql(spark, sf_dir, FX_SENT)).select("doc_id", "sentiment", "text")


@query("filter_markup", """SELECT page_id, NOT regexp_matches(html, 'http|lt\\s*;|gt\\s*;') AND length(html) < 4000 AS keep,
  NOT regexp_matches(title, 'http|lt\\s*;|gt\\s*;') AND length(title) < 298 AS keep_title
FROM (SELECT page_id, html, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages)""")
def q_filter_markup(spark, sf_dir):
    p = load(spark, sf_dir, "pages").withColumn("title", F.regexp_extract("html", "<title>([^<]*)</title>", 1))
    return p.select("page_id", P.filter_markup("html", 4000).alias("keep"), P.filter_markup("title", 298).alias("keep_title"))


@query("fit_lengths", """SELECT doc_id, length(text) < 1544 AS keep_train,
  length(regexp_replace(text, '<br />|<BR />|<Br />', ' ', 'g')) AS train_len,
  regexp_replace(substr(text, 1, 2095), '<br />|<BR />|<Br />', ' ', 'g') AS test_text FROM documents""")
def q_fit_lengths(spark, sf_dir):
    d = load(spark, sf_dir, "documents")
    keep, cleaned = P.fit_train("text", 1544)
    return d.select("doc_id", keep.alias("keep_train"), F.length(cleaned).cast("bigint").alias("train_len"),
                    P.fit_test("text", 2095).alias("test_text"))


FX_EXAM = """SELECT doc_id, concat('enem_', CAST(2018 + doc_id % 7 AS STRING), '_', CAST(doc_id AS STRING)) AS id,
  CASE WHEN doc_id % 11 = 0 THEN NULL ELSE substr('ABCDE', CAST(1 + doc_id % 5 AS INT), 1) END AS answer,
  doc_id % 9 = 0 AS has_images,
  CASE WHEN doc_id % 2 = 1 THEN 'Yes' ELSE 'No' END AS IC, CASE WHEN doc_id % 3 = 1 THEN 'Yes' ELSE 'No' END AS MR,
  CASE WHEN doc_id % 5 = 1 THEN 'Yes' ELSE 'No' END AS CE, CASE WHEN doc_id % 4 < 2 THEN 'Yes' ELSE 'No' END AS TC,
  CASE WHEN doc_id % 6 < 3 THEN 'Yes' ELSE 'No' END AS EK, CASE WHEN doc_id % 8 < 4 THEN 'Yes' ELSE 'No' END AS DS,
  doc_id % 13 = 0 AS IU, doc_id % 17 = 0 AS ML, CAST(doc_id % 180 + 1 AS INT) AS q_no, lang, source FROM documents"""


def _d_attrs(tag):
    f = P.exam_attr_filter(tag)
    return " AND ".join(f"coalesce({k} = {sql_str(v)}, false)" for k, v in f.items())


_AREAS_SQL = "[" + ", ".join(sql_str(a) for a in AREAS) + "]"


@query("exam_filters", f"""SELECT doc_id, {_d_attrs(None)} AS keep_base, {_d_attrs('TC')} AS keep_tc,
  {_d_attrs('EK_only')} AS keep_ek_only, {_d_attrs(None)} AND NOT coalesce(IU, false) AND NOT coalesce(ML, false) AS keep_flags,
  answer IS NOT NULL AND NOT coalesce(has_images, false) AND CAST(string_split(id, '_')[2] AS INT) IN (2022, 2023) AS keep_item,
  {_AREAS_SQL}[CAST(ceil(q_no / 45) AS INT)] AS area,
  CASE WHEN instr('ABCDE', answer) > 0 THEN instr('ABCDE', answer) - 1 END AS gold_idx,
  len(list_filter([lang, source, 'x1'], lambda x: NOT regexp_matches(x, '^\\p{{L}}+$'))) = 0 AS valid_labels
FROM ({FX_EXAM})""")
def q_exam_filters(spark, sf_dir):
    fx = sql(spark, sf_dir, FX_EXAM)
    return fx.select("doc_id", P.filter_by_attrs(P.exam_attr_filter(None)).alias("keep_base"),
                     P.filter_by_attrs(P.exam_attr_filter("TC")).alias("keep_tc"),
                     P.filter_by_attrs(P.exam_attr_filter("EK_only")).alias("keep_ek_only"),
                     P.filter_by_attrs(P.exam_attr_filter(None), ["IU", "ML"]).alias("keep_flags"),
                     P.filter_exam_items("id", "answer", "has_images", [2022, 2023]).alias("keep_item"),
                     P.exam_area("q_no", AREAS).alias("area"),
                     P.gold_index("answer").cast("bigint").alias("gold_idx"),
                     P.filter_valid_choices(F.array("lang", "source", F.lit("x1"))).alias("valid_labels"))


@query("keep_by_index", """SELECT d.doc_id, d.source FROM documents d WHERE d.doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)""")
def q_keep_by_index(spark, sf_dir):
    keep = load(spark, sf_dir, "labels").filter("quality = 1").select("doc_id")
    return P.keep_by_index(load(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id", keep)


@query("decode_onehot", """SELECT doc_id,
  CASE WHEN quality = 1 THEN 'quality' WHEN toxic = 1 THEN 'toxic' END AS first_class,
  CASE WHEN toxic = 1 THEN 'toxic' WHEN quality = 1 THEN 'quality' END AS last_class FROM labels""")
def q_decode_onehot(spark, sf_dir):
    lb = load(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 1).alias("q"), (F.col("toxic") == 1).alias("t"))
    return lb.select("doc_id", P.decode_onehot(["q", "t"], ["quality", "toxic"], "first").alias("first_class"),
                     P.decode_onehot(["q", "t"], ["quality", "toxic"], "last").alias("last_class"))


# The second sentence is the whole text with its last word replaced: the walk goes to the end.
FX_PAIRS = """SELECT doc_id AS qid, text AS correct, concat(regexp_replace(text, '[^ ]*$', ''), 'zz') AS incorrect FROM documents"""
FX_PAIRS_SPARK = FX_PAIRS


@query("split_at_divergence", f"""WITH p AS ({FX_PAIRS}),
t AS (SELECT qid, correct, incorrect, list_filter(string_split_regex(correct, '\\s+'), lambda x: x <> '') AS a,
             list_filter(string_split_regex(incorrect, '\\s+'), lambda x: x <> '') AS b FROM p),
k AS (SELECT *, coalesce(list_min(list_filter(range(1, least(len(a), len(b)) + 1), lambda i: a[i] <> b[i])) - 1,
                          least(len(a), len(b))) AS m FROM t),
s AS (SELECT *, CAST(greatest(0, coalesce(list_sum(list_transform(a[1:m], lambda x: len(x) + 1)), 0) - 1) AS BIGINT) AS pos FROM k)
SELECT qid, CAST(pos AS INT) AS pos,
  substr(correct, 1, pos) || chr(10) || 'A.' || (CASE WHEN qid % 2 = 0 THEN substr(correct, pos + 1) ELSE substr(incorrect, pos + 1) END)
  || chr(10) || 'B.' || (CASE WHEN qid % 2 = 0 THEN substr(incorrect, pos + 1) ELSE substr(correct, pos + 1) END) || chr(10) || 'Resposta:' AS prompt
FROM s""")
def q_split_at_divergence(spark, sf_dir):
    p = sql(spark, sf_dir, FX_PAIRS_SPARK)
    p = p.withColumn("pos", P.split_at_divergence("correct", "incorrect"))
    return p.select("qid", "pos", P.parity_choices("qid", "correct", "incorrect", "pos").alias("prompt"))


@query("runner_prompts", f"""SELECT doc_id,
  {sql_str(P.RUNNER_EXAM_PROMPT)} || (CASE WHEN trim(source) <> '' THEN 'Contexto:' || chr(10) || trim(source) || chr(10) || chr(10) ELSE '' END)
    || 'Questão:' || chr(10) || text || chr(10) || chr(10) || 'Alternativas:' || chr(10)
    || 'A) ' || lang || chr(10) || 'B) ' || source || chr(10) || 'C) ' || CAST(n_chars AS STRING)
    || chr(10) || chr(10) || 'Resposta final (uma letra):' AS exam_prompt,
  {sql_str(P.RUNNER_BIAS_PROMPT)} || 'Context: ' || source || chr(10) || 'Question: ' || text || chr(10) || '0: ' || lang
    || chr(10) || '1: ' || source || chr(10) || '2: ' || CAST(n_chars AS STRING) || chr(10) || chr(10) || 'Answer:' AS bias_prompt,
  {sql_str(P.RUNNER_GSM_PROMPT)} || 'Problema:' || chr(10) || text || chr(10) || chr(10) || 'Resposta final:' AS gsm_prompt,
  CASE WHEN regexp_matches(lang || ') x', '^[a-zA-Z]\\)') THEN upper(substr(lang || ') x', 1, 1)) || '.' || substr(lang || ') x', 3) ELSE lang || ') x' END AS relabelled
FROM documents""")
def q_runner_prompts(spark, sf_dir):
    d = load(spark, sf_dir, "documents").withColumn("alts", F.array("lang", "source", F.col("n_chars").cast("string")))
    return d.select("doc_id", P.runner_exam_prompt("source", "text", "alts").alias("exam_prompt"),
                    P.runner_bias_prompt("source", "text", "lang", "source", F.col("n_chars").cast("string")).alias("bias_prompt"),
                    P.runner_gsm_prompt("text").alias("gsm_prompt"),
                    P.relabel_choice(F.concat("lang", F.lit(") x"))).alias("relabelled"))


# ----------------------------------------------------------------- PRJ02 / PRJ03 (task registry)
@query("registry_prompts", """SELECT doc_id,
  'Cabeçalho: ' || source || chr(10) || 'Enunciado: ' || text || chr(10) || 'Alternativas:' || chr(10) || 'A. ' || lang || chr(10) || 'B. ' || source
    || chr(10) || 'C. ' || CAST(n_chars AS VARCHAR) || chr(10) || 'Resposta:' AS headed,
  'Enunciado: ' || text || chr(10) || 'Alternativas:' || chr(10) || 'A. ' || lang || chr(10) || 'B. ' || source || ' a)' || chr(10) || 'Resposta:' AS statement,
  text || chr(10) || '1. ' || lang || chr(10) || '2. ' || source || chr(10) || 'Answer:' AS lettered,
  'Pergunta: Dado que "' || text || '", é verdade que "' || source || '"?' || chr(10) || 'Resposta:' AS entailment,
  CASE WHEN n_chars % 2 = 0 THEN ' Não' ELSE ' Sim' END AS target,
  CASE WHEN lang = 'en' AND letter = 'e' THEN NULL ELSE CAST(instr('abcde', letter) - 1 AS INT) END AS gold
FROM (SELECT *, substr('abcde', CAST(n_chars % 5 AS INT) + 1, 1) AS letter FROM documents)""")
def q_registry_prompts(spark, sf_dir):
    d = load(spark, sf_dir, "documents")
    letter = F.substring(F.lit("abcde"), (F.col("n_chars") % 5 + 1).cast("int"), F.lit(1))
    item = F.when(F.col("lang") == "en", F.lit("UNICAMP_2020")).otherwise(F.lit("USP_2020"))
    return d.select(
        "doc_id", P.headed_exam_prompt("source", "text", F.array("lang", "source", F.col("n_chars").cast("string"))).alias("headed"),
        P.statement_exam_prompt("text", F.array(F.concat(F.lit("a) "), "lang"), F.concat(F.lit("b) "), "source", F.lit(" a)")))).alias("statement"),
        P.lettered_question_prompt("text", F.array(F.lit("1"), F.lit("2")), F.array("lang", "source"), "en").alias("lettered"),
        P.entailment_prompt("text", "source").alias("entailment"), P.entailment_target(F.col("n_chars") % 2).alias("target"),
        P.university_gold_index(item, letter).alias("gold"))


# ----------------------------------------------------------------- PRJ02: templates as rows
_TASKS = list(TP.TEMPLATES)
# The fields of every item, as SQL over documents; label runs through the classes of the task.
_FIELDS = {"title": "source", "text": "text", "premise": "text", "hypothesis": "source", "score": "CAST(n_chars % 6 AS STRING)", "question": "source", "passage": "text",
           "context": "text", "target": "lang", "query": "concat(source, CASE WHEN n_chars % 2 = 0 THEN '?' ELSE '' END)",
           "answer": "CASE WHEN n_chars % 3 = 0 THEN 'yes' WHEN n_chars % 3 = 1 THEN 'no' ELSE lang END", "sentence_1": "source", "sentence_2": "lang", "sentence_3": "text",
           "sentence_4": "source", "ending_1": "lang", "ending_2": "source", "right": "source", "before": "lang", "after": "text", "first": "source", "second": "lang",
           "letter": "CASE WHEN n_chars % 2 = 0 THEN 'A' ELSE 'B' END"}
_LABELS = {t: [*c, "other"] for t, c in TP.CLASSES.items() if "*" not in c}       # the last one has no word


def _label_sql(task: str) -> str:
    words = _LABELS[task]
    return "CASE " + " ".join(f"WHEN n_chars % {len(words)} = {i} THEN {sql_str(w)}" for i, w in enumerate(words)) + " END"


def _rendered(task: str, template: str) -> str:
    """One template as a DuckDB expression, written out place by place."""
    out = []
    for i, part in enumerate(re.split(r"\{([^{}]+)\}", template)):
        name, _, rule = part.partition("|")
        if i % 2 == 0:
            out.append(sql_str(part).replace("\n", "' || chr(10) || '"))
        elif rule == "classes" and task == "open_question":
            out.append(f"(CASE {_FIELDS[name]} WHEN 'yes' THEN 'sim' WHEN 'no' THEN 'não' ELSE {_FIELDS[name]} END)")
        elif rule == "classes":
            out.append(f"(CASE {_label_sql(task)} " + " ".join(f"WHEN {sql_str(k)} THEN {sql_str(v)}" for k, v in TP.CLASSES[task].items()) + " END)")
        elif rule == "question":
            out.append(f"(CASE WHEN {_FIELDS[name]} LIKE '%?' THEN {_FIELDS[name]} ELSE {_FIELDS[name]} || '?' END)")
        elif rule == "first":
            out.append("lang")
        else:
            out.append(f"({_FIELDS[name]})")
    return " || ".join(out)


def _by_task(which: int) -> str:
    return "CASE " + " ".join(f"WHEN doc_id % {len(_TASKS)} = {i} THEN {_rendered(t, TP.TEMPLATES[t][which])}" for i, t in enumerate(_TASKS)) + " END"


_TASK_SQL = "CASE " + " ".join(f"WHEN doc_id % {len(_TASKS)} = {i} THEN {sql_str(t)}" for i, t in enumerate(_TASKS)) + " END"


@query("build_prompts", f"""SELECT doc_id, {_TASK_SQL} AS task, {_by_task(0).replace(" STRING)", " VARCHAR)")} AS prompt, {_by_task(1).replace(" STRING)", " VARCHAR)")} AS target FROM documents""")
def q_build_prompts(spark, sf_dir):
    """Prompts and targets of all task families, from template rows."""
    label = "CASE " + " ".join(f"WHEN doc_id % {len(_TASKS)} = {i} THEN {_label_sql(t)}" for i, t in enumerate(_TASKS) if t in _LABELS) + " END"
    pairs = [x for k, v in _FIELDS.items() for x in (F.lit(k), F.expr(v))]
    fields = F.create_map(*pairs, F.lit("label"), F.expr(label), F.lit("answers"), F.to_json(F.array("lang", "source")))
    items = load(spark, sf_dir, "documents").select("doc_id", F.expr(_TASK_SQL).alias("task"), fields.alias("fields"))
    return TP.build_prompts(items, TP.template_rows(spark)).select("doc_id", "task", "prompt", "target")
