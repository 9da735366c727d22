"""Scoring and metric queries (SCR01-04, SCR06-12, AGG01-AGG19, AGG28, AGG30, JN03)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import clean as C
from ..functions import extract as X
from ..functions.text import ASCII_PUNCTUATION, PT_ARTICLES
from ..operators import metrics as M
from ..operators import scoring as S
from .registry import load, query, sql, sql_str
from .text_q import FX_RAW, STOPS, d_model_answer, d_sanitize_ctes, d_strip

R6 = 6  # oracle comparison rounds float metrics to 6 digits (both sides)

FX_CLS = """SELECT d.source AS task, d.lang AS prompt_mode, concat('m', CAST(d.doc_id % 4 AS STRING)) AS model,
       d.doc_id, l.quality AS gold,
       CASE WHEN d.doc_id % 7 = 0 THEN 1 - l.quality ELSE l.quality END AS pred,
       l.quality + l.toxic AS gold3,
       (l.quality + l.toxic + CASE WHEN d.doc_id % 5 = 0 THEN 1 ELSE 0 END) % 3 AS pred3
FROM documents d JOIN labels l ON d.doc_id = l.doc_id"""

FX_MC = """SELECT item_id, CAST(rn - 1 AS BIGINT) AS choice_idx, loglik, choice_len, item_id % 3 AS gold FROM (
  SELECT l_orderkey AS item_id, -l_extendedprice / 1000 AS loglik,
         CAST(l_quantity AS INT) AS choice_len,
         row_number() OVER (PARTITION BY l_orderkey
           ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS rn
  FROM lineitem) t"""

# Whole texts: the prediction is a document without its first word, the references are the
# document itself and its neighbour.
FX_QA = """SELECT a.doc_id AS id, a.lang, regexp_replace(a.text, '^[^ ]* ', '') AS pred,
       a.text AS ref1, b.text AS ref2
FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1"""

FX_SLICES = """SELECT doc_id, CAST(2018 + doc_id % 7 AS INT) AS exam,
       CAST(ceil((doc_id % 180 + 1) / 45.0) AS INT) AS area_no, source AS university,
       lang AS subject, doc_id % 6 = 0 AS knowledge,
       CAST(CASE WHEN doc_id % 3 = 0 THEN 1.0 ELSE 0.0 END AS DOUBLE) AS acc FROM documents"""


def r(c, n=R6):
    return F.round(c, n)


def rd(e: str, n=R6) -> str:
    return f"round({e}, {n})"


def rcols(df, keep):
    return df.select(*[F.col(c) if c in keep else r(F.col(c)).alias(c) for c in df.columns])


# ----------------------------------------------------------------- AGG02
@query("mean_stderr", f"""WITH fx AS ({FX_CLS})
SELECT task, {rd('avg(acc)')} AS mean, {rd('coalesce(stddev_samp(acc), 0)')} AS sd,
       {rd('coalesce(stddev_pop(acc), 0)')} AS sd_pop, count(acc) AS n,
       {rd('coalesce(stddev_samp(acc), 0) / sqrt(count(acc))')} AS stderr
FROM (SELECT task, CAST(pred = gold AS DOUBLE) AS acc FROM fx) GROUP BY task""")
def q_mean_stderr(spark, sf_dir):
    fx = sql(spark, sf_dir, FX_CLS).withColumn("acc", (F.col("pred") == F.col("gold")).cast("double"))
    return rcols(M.mean_stderr(fx, "task", "acc"), {"task", "n"})


# ----------------------------------------------------------------- AGG04-AGG07
_CELLS = f"""fx AS ({FX_CLS}),
cells AS (SELECT task, gold3 AS gold, pred3 AS pred, count(*) AS cnt FROM fx GROUP BY ALL),
g AS (SELECT task, gold AS label, sum(cnt) AS support, sum(CASE WHEN gold = pred THEN cnt ELSE 0 END) AS tp
      FROM cells GROUP BY ALL),
p AS (SELECT task, pred AS label, sum(cnt) AS predicted FROM cells GROUP BY ALL),
lab AS (SELECT g.*, coalesce(p.predicted, 0) AS predicted FROM g LEFT JOIN p USING (task, label))"""


@query("f1_macro", f"""WITH {_CELLS}
SELECT task, {rd('avg(2 * tp / (predicted + support))')} AS f1_macro FROM lab GROUP BY task""")
def q_f1_macro(spark, sf_dir):
    fx = sql(spark, sf_dir, FX_CLS)
    return rcols(M.f1_macro(fx, "task", "gold3", "pred3"), {"task"})


@query("f1_weighted", f"""WITH {_CELLS}
SELECT task, {rd('sum(2 * tp / (predicted + support) * support) / sum(support)')} AS f1_weighted
FROM lab GROUP BY task""")
def q_f1_weighted(spark, sf_dir):
    fx = sql(spark, sf_dir, FX_CLS)
    return rcols(M.f1_weighted(fx, "task", "gold3", "pred3"), {"task"})


@query("f1_binary", f"""WITH fx AS ({FX_CLS}),
c AS (SELECT task, sum(CASE WHEN gold = 1 AND pred = 1 THEN 1 ELSE 0 END) AS tp,
             sum(CASE WHEN gold <> 1 AND pred = 1 THEN 1 ELSE 0 END) AS fp,
             sum(CASE WHEN gold = 1 AND pred <> 1 THEN 1 ELSE 0 END) AS fn FROM fx GROUP BY task)
SELECT task, {rd('CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE 2 * tp / (2 * tp + fp + fn) END')} AS f1 FROM c""")
def q_f1_binary(spark, sf_dir):
    fx = sql(spark, sf_dir, FX_CLS)
    return rcols(M.f1_binary(fx, "task", "gold", "pred"), {"task"})


@query("matthews_corr", f"""WITH {_CELLS},
t AS (SELECT task, gold AS k, sum(cnt) AS t FROM cells GROUP BY ALL),
pp AS (SELECT task, pred AS k, sum(cnt) AS p FROM cells GROUP BY ALL),
tp AS (SELECT coalesce(t.task, pp.task) AS task, sum(coalesce(t, 0) * coalesce(p, 0)) AS pt,
              sum(coalesce(p, 0) ^ 2) AS p2, sum(coalesce(t, 0) ^ 2) AS t2
       FROM t FULL JOIN pp USING (task, k) GROUP BY 1),
tot AS (SELECT task, CAST(sum(cnt) AS DOUBLE) AS s, sum(CASE WHEN gold = pred THEN cnt ELSE 0 END) AS c FROM cells GROUP BY task)
SELECT task, {rd('CASE WHEN sqrt((s ^ 2 - p2) * (s ^ 2 - t2)) = 0 THEN 0.0 ELSE (c * s - pt) / sqrt((s ^ 2 - p2) * (s ^ 2 - t2)) END')} AS mcc
FROM tot JOIN tp USING (task)""")
def q_matthews_corr(spark, sf_dir):
    fx = sql(spark, sf_dir, FX_CLS)
    return rcols(M.matthews_corr(fx, "task", "gold3", "pred3"), {"task"})


# ----------------------------------------------------------------- AGG08
@query("acc_all", f"""WITH fx AS (SELECT *, doc_id % 13 AS q, pred = gold AS ok FROM ({FX_CLS})),
a AS (SELECT task, avg(CAST(ok AS DOUBLE)) AS acc_all FROM (SELECT task, prompt_mode, q, bool_and(ok) AS ok FROM fx GROUP BY ALL) GROUP BY task),
s AS (SELECT task, coalesce(stddev_samp(ok), 0) / sqrt(count(ok)) AS se
      FROM (SELECT task, q, CAST(bool_and(ok) AS DOUBLE) AS ok FROM fx GROUP BY ALL) GROUP BY task)
SELECT task, {rd('acc_all')} AS acc_all, {rd('se')} AS acc_all_stderr FROM a JOIN s USING (task)""")
def q_acc_all(spark, sf_dir):
    fx = (sql(spark, sf_dir, FX_CLS).withColumn("q", F.col("doc_id") % 13)
          .withColumn("ok", F.col("pred") == F.col("gold")))
    return rcols(M.acc_all(fx, "task", "prompt_mode", "q", "ok"), {"task"})


# ----------------------------------------------------------------- AGG03
@query("positional_median", f"""WITH fx AS (SELECT task, doc_id, gold3 * 10 + doc_id % 10 AS v FROM ({FX_CLS}))
SELECT task, v AS median FROM (SELECT task, v, row_number() OVER (PARTITION BY task ORDER BY doc_id) - 1 AS rn,
                                      count(*) OVER (PARTITION BY task) AS n FROM fx) WHERE rn = n // 2""")
def q_positional_median(spark, sf_dir):
    fx = sql(spark, sf_dir, FX_CLS).withColumn("v", F.col("gold3") * 10 + F.col("doc_id") % 10)
    return M.positional_median(fx, "task", "v", "doc_id")


# ----------------------------------------------------------------- SCR12 / AGG09
_PPL_FX = """SELECT doc_id, source, text, CAST(-(doc_id % 17 + 1) / 10.0 AS DOUBLE) AS loglik FROM documents"""


@query("score_perplexity", """SELECT doc_id, CAST(len(string_split_regex(text, '\\s+')) AS INT) AS words,
       CAST(octet_length(encode(text)) AS INT) AS bytes FROM documents""")
def q_score_perplexity(spark, sf_dir):
    d = load(spark, sf_dir, "documents")
    return d.select("doc_id", S.word_count("text").alias("words"), S.byte_count("text").alias("bytes"))


@query("perplexity", f"""WITH fx AS ({_PPL_FX}),
w AS (SELECT source, loglik, len(string_split_regex(text, '\\s+')) AS words, octet_length(encode(text)) AS nbytes FROM fx)
SELECT source, {rd('exp(-avg(loglik))')} AS perplexity, {rd('exp(-(sum(loglik) / sum(words)))')} AS word_perplexity,
       {rd('exp(-(sum(loglik) / sum(nbytes)))')} AS byte_perplexity,
       {rd('-(sum(loglik) / sum(nbytes)) / ln(2)')} AS bits_per_byte FROM w GROUP BY source""")
def q_perplexity(spark, sf_dir):
    fx = sql(spark, sf_dir, _PPL_FX).select("source", "loglik", S.word_count("text").alias("words"),
                                            S.byte_count("text").alias("nbytes"))
    return rcols(M.perplexity_metrics(fx, "source", "loglik", "words", "nbytes"), {"source"})


# ----------------------------------------------------------------- SCR11 / AGG10
@query("pearson", f"""WITH fx AS ({FX_CLS})
SELECT task, {rd('CASE WHEN stddev_pop(pred3) > 0 AND stddev_pop(gold3) > 0 THEN corr(CAST(pred3 AS DOUBLE), CAST(gold3 AS DOUBLE)) END')} AS pearson,
       {rd('avg((gold3 - pred3) ^ 2)')} AS mse FROM fx GROUP BY task""")
def q_pearson(spark, sf_dir):
    fx = sql(spark, sf_dir, FX_CLS).withColumn("se", S.score_sts("gold3", "pred3"))
    out = M.pearson(fx, "task", "pred3", "gold3").join(fx.groupBy("task").agg(F.avg("se").alias("mse")), "task")
    return rcols(out, {"task"})


# ----------------------------------------------------------------- SCR01-04
@query("score_multiple_choice", f"""WITH fx AS ({FX_MC}),
a AS (SELECT item_id, arg_max(choice_idx, struct_pack(l := loglik, i := -choice_idx)) AS pred,
             arg_max(choice_idx, struct_pack(l := loglik / choice_len, i := -choice_idx)) AS pred_norm,
             first(gold) AS gold FROM fx GROUP BY item_id)
SELECT item_id, pred, pred_norm, gold, CAST(pred = gold AS DOUBLE) AS acc, CAST(pred_norm = gold AS DOUBLE) AS acc_norm FROM a""")
def q_score_multiple_choice(spark, sf_dir):
    return S.score_multiple_choice(sql(spark, sf_dir, FX_MC))


@query("score_classification", f"""WITH fx AS ({FX_CLS})
SELECT doc_id, CAST(-gold3 AS DOUBLE) > CAST(-pred3 AS DOUBLE) AS binary_ll,
       lower(trim(CAST(gold AS STRING))) = lower(trim(CAST(pred AS STRING))) AS label_match,
       CAST(CAST(pred3 = gold3 AS INT) * 100 AS DOUBLE) AS acc100 FROM fx""")
def q_score_classification(spark, sf_dir):
    fx = sql(spark, sf_dir, FX_CLS)
    return fx.select("doc_id",
                     S.score_binary_ll((-F.col("gold3")).cast("double"), (-F.col("pred3")).cast("double")).alias("binary_ll"),
                     S.score_label_match(F.col("gold").cast("string"), F.col("pred").cast("string")).alias("label_match"),
                     ((F.col("pred3") == F.col("gold3")).cast("int") * 100).cast("double").alias("acc100"))


# ----------------------------------------------------------------- SCR06-SCR10, AGG13
_ARTS = "[" + ", ".join(sql_str(a) for a in PT_ARTICLES) + "]"


def d_tokens(e: str) -> str:
    return (f"list_filter(string_split_regex(translate(lower({e}), {sql_str(ASCII_PUNCTUATION)}, ''), '\\s+'), "
            f"lambda t: t <> '' AND NOT list_contains({_ARTS}, t))")


def d_norm(e: str) -> str:
    return f"array_to_string({d_tokens(e)}, ' ')"


def _bag_join(ref: str) -> str:
    """Distinct and bag overlap of the prediction's tokens with one reference's, per id."""
    return f"""(SELECT a.id, count(*) AS d, sum(least(a.c, b.c)) AS m
  FROM (SELECT id, w, count(*) AS c FROM (SELECT id, unnest(a) AS w FROM t) GROUP BY ALL) a
  JOIN (SELECT id, w, count(*) AS c FROM (SELECT id, unnest({ref}) AS w FROM t) GROUP BY ALL) b ON a.id = b.id AND a.w = b.w GROUP BY a.id)"""


def _f1_of(common: str, na: str, nb: str) -> str:
    return f"(CASE WHEN {common} = 0 THEN 0.0 ELSE 2 * ({common} / {na}) * ({common} / {nb}) / ({common} / {na} + {common} / {nb}) END)"


def _f1_set(i: int) -> str:
    c, na, nb = f"d{i}", "len(list_distinct(a))", f"len(list_distinct(b{i}))"
    return f"(CASE WHEN {nb} = 0 THEN (CASE WHEN {na} = 0 THEN 1.0 ELSE 0.0 END) ELSE {_f1_of(c, na, nb)} END)"


def _f1_bag(i: int, mixed: bool) -> str:
    f1 = _f1_of(f"m{i}", "len(a)", f"len(b{i})")
    return f"(CASE WHEN len(a) = 0 OR len(b{i}) = 0 THEN CAST(a = b{i} AS DOUBLE) ELSE {f1} END)" if mixed else f1


_QA_TOK = f"""fx AS ({FX_QA}),
t AS (SELECT id, lang, pred, {d_tokens('pred')} AS a, {d_tokens('ref1')} AS b1, {d_tokens('ref2')} AS b2 FROM fx),
j AS (SELECT t.*, a = b1 OR a = b2 AS em, CAST(coalesce(x1.d, 0) AS DOUBLE) AS d1, CAST(coalesce(x1.m, 0) AS DOUBLE) AS m1,
             CAST(coalesce(x2.d, 0) AS DOUBLE) AS d2, CAST(coalesce(x2.m, 0) AS DOUBLE) AS m2
      FROM t LEFT JOIN {_bag_join('b1')} x1 ON x1.id = t.id LEFT JOIN {_bag_join('b2')} x2 ON x2.id = t.id)"""


@query("score_token_f1", f"""WITH {_QA_TOK}
SELECT id, em,
  {rd(f"greatest({_f1_set(1)}, {_f1_set(2)})")} AS f1_set,
  {rd(f"greatest({_f1_bag(1, False)}, {_f1_bag(2, False)})")} AS f1_multiset,
  {rd(f"greatest({_f1_bag(1, True)}, {_f1_bag(2, True)})")} AS f1_mixed FROM j""")
def q_score_token_f1(spark, sf_dir):
    fx = sql(spark, sf_dir, FX_QA).withColumn("refs", F.array("ref1", "ref2"))
    s = fx.select("id", S.score_qa("pred", "refs").alias("s"))
    return s.select("id", "s.em", *[r(F.col(f"s.{n}")).alias(n) for n in ("f1_set", "f1_multiset", "f1_mixed")])


@query("squad_metrics", f"""WITH {_QA_TOK}
SELECT lang, {rd('avg(CAST(em AS DOUBLE))')} AS exact_match, {rd(f"avg(greatest({_f1_set(1)}, {_f1_set(2)}))")} AS f1 FROM j GROUP BY lang""")
def q_squad_metrics(spark, sf_dir):
    fx = sql(spark, sf_dir, FX_QA).withColumn("refs", F.array("ref1", "ref2"))
    s = fx.select("lang", S.score_qa("pred", "refs").alias("s")).select("lang", F.col("s.em").cast("double").alias("em"), F.col("s.f1_set").alias("f1"))
    return rcols(s.groupBy("lang").agg(F.avg("em").alias("exact_match"), F.avg("f1").alias("f1")), {"lang"})


@query("score_extractive_qa", f"""WITH {_QA_TOK}
SELECT id, CASE WHEN id NOT IN (SELECT doc_id FROM labels) THEN 0.0 ELSE CAST(em AS DOUBLE) * 100 END AS em,
       {rd(f"CASE WHEN id NOT IN (SELECT doc_id FROM labels) THEN 0.0 ELSE greatest({_f1_bag(1, False)}, {_f1_bag(2, False)}) * 100 END")} AS f1
FROM j""")
def q_score_extractive_qa(spark, sf_dir):
    fx = sql(spark, sf_dir, FX_QA)
    gold = fx.select("id", F.array("ref1", "ref2").alias("refs"))
    # predictions exist for the labelled documents only; the others count as missing
    preds = fx.join(load(spark, sf_dir, "labels").select(F.col("doc_id").alias("id")), "id", "left_semi").select("id", "pred")
    out = S.score_extractive_qa(gold, preds)
    return out.select("id", "em", r(F.col("f1")).alias("f1"))


# ----------------------------------------------------------------- AGG19 / AGG30 / PRJ08
@query("sliced_metrics", f"""WITH fx AS ({FX_SLICES})
SELECT CASE WHEN grouping(exam) = 0 THEN 'exam' WHEN grouping(area_no) = 0 THEN 'area_no'
            WHEN grouping(university) = 0 THEN 'university' WHEN grouping(subject) = 0 THEN 'subject'
            WHEN grouping(knowledge) = 0 THEN 'knowledge' ELSE 'overall' END AS slice,
       coalesce(CAST(exam AS STRING), CAST(area_no AS STRING), CAST(university AS STRING), CAST(subject AS STRING),
                CAST(knowledge AS STRING), 'all') AS slice_value,
       {rd('avg(acc)')} AS mean, {rd('sum(acc)')} AS total, count(*) AS n
FROM fx GROUP BY GROUPING SETS ((), (exam), (area_no), (university), (subject), (knowledge))""")
def q_sliced_metrics(spark, sf_dir):
    fx = sql(spark, sf_dir, FX_SLICES)
    out = M.sliced_metrics(fx, "acc", ["exam", "area_no", "university", "subject", "knowledge"])
    return rcols(out, {"slice", "slice_value", "n"})


# ----------------------------------------------------------------- AGG01 / AGG20 / AGG28
_SCORES = f"""SELECT model, task, prompt_mode, doc_id, 'acc' AS metric, CAST(pred = gold AS DOUBLE) AS value,
       CAST(1.0 AS DOUBLE) AS weight FROM ({FX_CLS}) c
UNION ALL SELECT model, task, prompt_mode, doc_id, 'ppl', CAST(-(doc_id % 5 + 1) / 10.0 AS DOUBLE), CAST(1.0 AS DOUBLE) FROM ({FX_CLS}) c
UNION ALL SELECT model, task, prompt_mode, doc_id, 'bpb', CAST(-(doc_id % 9 + 1) AS DOUBLE), CAST(doc_id % 4 + 1 AS DOUBLE) FROM ({FX_CLS}) c
UNION ALL SELECT model, task, prompt_mode, doc_id, 'debug_info', CAST(0.0 AS DOUBLE), CAST(1.0 AS DOUBLE) FROM ({FX_CLS}) c"""
_KINDS = "SELECT * FROM (VALUES ('acc', 'mean'), ('ppl', 'perplexity'), ('bpb', 'bits_per_byte')) AS k(metric, kind)"
# The same with pair metrics and a positional median.
_PAIR_SCORES = " UNION ALL ".join(
    f"SELECT model, task, prompt_mode, doc_id, '{m}' AS metric, CAST({v} AS DOUBLE) AS value, CAST(1.0 AS DOUBLE) AS weight, gold, pred FROM ({FX_CLS}) c"
    for m, v in (("acc", "pred = gold"), ("f1", "0.0"), ("mcc", "0.0"), ("len", "gold3 * 10 + doc_id % 10"), ("total", "gold3"), ("debug_info", "0.0")))
_PAIR_KINDS = "SELECT * FROM (VALUES ('acc', 'mean'), ('f1', 'f1'), ('mcc', 'mcc'), ('len', 'median'), ('total', 'sum')) AS k(metric, kind)"


@query("aggregate_pair_scores", f"""WITH s AS ({_PAIR_SCORES}), k AS ({_PAIR_KINDS}),
c AS (SELECT model, task, prompt_mode, metric, kind, count(*) AS n, avg(value) AS mean, sum(value) AS total, coalesce(stddev_samp(value), 0) / sqrt(count(*)) AS se,
             list(value ORDER BY doc_id) AS vs,
             CAST(count_if(gold = 1 AND pred = 1) AS DOUBLE) AS tp, CAST(count_if(gold <> 1 AND pred = 1) AS DOUBLE) AS fp,
             CAST(count_if(gold = 1 AND pred <> 1) AS DOUBLE) AS fn, CAST(count_if(gold <> 1 AND pred <> 1) AS DOUBLE) AS tn
      FROM s JOIN k USING (metric) GROUP BY ALL)
SELECT model, task, prompt_mode, metric,
  {rd("CASE kind WHEN 'mean' THEN mean WHEN 'sum' THEN total WHEN 'median' THEN vs[n // 2 + 1] WHEN 'f1' THEN coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0.0) WHEN 'mcc' THEN coalesce((tp * tn - fp * fn) / nullif(sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 0), 0.0) END")} AS value,
  {rd("CASE WHEN kind = 'mean' THEN se END")} AS stderr, n FROM c""")
def q_aggregate_pair_scores(spark, sf_dir):
    out = M.aggregate_scores(sql(spark, sf_dir, _PAIR_SCORES), spark.sql(_PAIR_KINDS))
    return rcols(out, {"model", "task", "prompt_mode", "metric", "n"})


@query("aggregate_scores", f"""WITH s AS ({_SCORES}), k AS ({_KINDS})
SELECT model, task, prompt_mode, metric,
  {rd("CASE first(kind) WHEN 'mean' THEN avg(value) WHEN 'perplexity' THEN exp(-avg(value)) WHEN 'bits_per_byte' THEN -(sum(value) / sum(weight)) / ln(2) END")} AS value,
  {rd("CASE WHEN first(kind) = 'mean' THEN coalesce(stddev_samp(value), 0) / sqrt(count(value)) END")} AS stderr,
  count(value) AS n
FROM s JOIN k USING (metric) GROUP BY model, task, prompt_mode, metric""")
def q_aggregate_scores(spark, sf_dir):
    scores = sql(spark, sf_dir, _SCORES)
    kinds = spark.sql(_KINDS)
    out = M.aggregate_scores(scores, kinds)
    return rcols(out, {"model", "task", "prompt_mode", "metric", "n"})


@query("num_examples", f"""WITH fx AS ({FX_CLS})
SELECT a.task, a.prompt_mode, a.num_examples_mode, b.num_examples FROM
 (SELECT task, prompt_mode, count(DISTINCT doc_id) AS num_examples_mode FROM fx GROUP BY ALL) a JOIN
 (SELECT task, count(DISTINCT (prompt_mode, doc_id)) AS num_examples FROM fx GROUP BY ALL) b USING (task)""")
def q_num_examples(spark, sf_dir):
    return M.num_examples(sql(spark, sf_dir, FX_CLS))


# ----------------------------------------------------------------- AGG15-AGG18 (runner metrics)
FX_RUNNER = f"""SELECT doc_id, raw, gold,
  CASE doc_id % 8 WHEN 0 THEN 'enem_2022' WHEN 1 THEN 'enem_2023' WHEN 2 THEN 'bbq_gender_identity'
       WHEN 3 THEN 'bbq_physical_appearance' WHEN 4 THEN 'bbq_race_ethnicity' WHEN 5 THEN 'arith_gsm8k'
       WHEN 6 THEN 'enem_2022' ELSE 'other' END AS dataset,
  concat('m', CAST(doc_id % 3 AS STRING)) AS model,
  CASE WHEN doc_id % 2 = 0 THEN 'ambig' ELSE 'disambig' END AS context_condition
FROM ({FX_RAW}) r"""


def _runner_scored(spark, sf_dir):
    fx = sql(spark, sf_dir, FX_RUNNER)
    fx = fx.withColumn("clean", C.sanitize_output("raw", STOPS))
    fx = fx.withColumn("pred", X.extract_model_answer("dataset", "clean"))
    ds = F.col("dataset")
    label = (F.when(ds.startswith("bbq"), (F.col("doc_id") % 3).cast("string"))
              .when(ds == "arith_gsm8k", F.concat(F.lit("= "), F.col("doc_id").cast("string"), F.lit(",5")))
              .otherwise(F.col("gold")))
    s = S.score_runner_sample("dataset", label, "pred")
    cc = F.lower(X.py_strip("context_condition"))
    return fx.select("model", "dataset", s["correct"].alias("correct"), s["valid"].alias("valid"),
                     (cc == "ambig").cast("double").alias("is_ambig"), (cc == "disambig").cast("double").alias("is_disambig"),
                     F.when(ds == "arith_gsm8k", s["correct"]).alias("exact"))


_RUNNER_SQL = f"""WITH fx AS ({FX_RUNNER}), {d_sanitize_ctes('fx', STOPS)},
p AS (SELECT *, {d_model_answer('dataset', 'clean')} AS pred,
             CASE WHEN starts_with(dataset, 'bbq') THEN CAST(doc_id % 3 AS STRING)
                  WHEN dataset = 'arith_gsm8k' THEN concat('= ', CAST(doc_id AS STRING), ',5') ELSE gold END AS label FROM s7),
n AS (SELECT *, TRY_CAST(replace(regexp_extract_all(label, {sql_str('(' + X.NUMBER + ')')}, 1)[-1], ',', '.') AS DOUBLE) AS e_num,
                TRY_CAST(replace(regexp_extract_all(pred, {sql_str('(' + X.NUMBER + ')')}, 1)[-1], ',', '.') AS DOUBLE) AS p_num FROM p),
sc AS (SELECT model, dataset,
  CAST(CASE WHEN starts_with(dataset, 'enem') THEN (pred = upper({d_strip('label')}))::INT
            WHEN starts_with(dataset, 'bbq') THEN (pred = {d_strip('label')})::INT
            WHEN dataset = 'arith_gsm8k' THEN coalesce((e_num IS NOT NULL AND p_num IS NOT NULL
                 AND abs(e_num - p_num) <= 1e-9 * greatest(abs(e_num), abs(p_num))), false)::INT END AS DOUBLE) AS correct,
  CAST(CASE WHEN starts_with(dataset, 'enem') THEN (pred IN ('A','B','C','D','E'))::INT
            WHEN starts_with(dataset, 'bbq') THEN (pred IN ('0','1','2'))::INT
            WHEN dataset = 'arith_gsm8k' THEN (p_num IS NOT NULL)::INT
            ELSE ({d_strip('pred')} <> '')::INT END AS DOUBLE) AS valid,
  CAST(lower(context_condition) = 'ambig' AS DOUBLE) AS is_ambig, CAST(lower(context_condition) = 'disambig' AS DOUBLE) AS is_disambig
  FROM n),
ag AS (SELECT model, dataset, avg(valid) AS valid_rate, avg(correct) AS acc,
              coalesce(avg(CASE WHEN is_ambig = 1.0 THEN correct END), 0.0) AS acc_ambig,
              coalesce(avg(CASE WHEN is_disambig = 1.0 THEN correct END), 0.0) AS acc_disambig FROM sc GROUP BY ALL),
rows AS (
  SELECT model, concat('accuracy_', dataset) AS metric, acc AS value FROM ag WHERE starts_with(dataset, 'enem_')
  UNION ALL SELECT model, 'invalid_answer_rate_enem', 1.0 - valid_rate FROM ag WHERE starts_with(dataset, 'enem_')
  UNION ALL SELECT model, concat('accuracy_', dataset), acc FROM ag WHERE starts_with(dataset, 'bbq_')
  UNION ALL SELECT model, 'accuracy_bbq_ambig', acc_ambig FROM ag WHERE starts_with(dataset, 'bbq_')
  UNION ALL SELECT model, 'accuracy_bbq_disambig', acc_disambig FROM ag WHERE starts_with(dataset, 'bbq_')
  UNION ALL SELECT model, 'exact_match_arith_gsm8k', acc FROM ag WHERE dataset = 'arith_gsm8k'
  UNION ALL SELECT model, 'valid_rate', valid_rate FROM ag WHERE dataset = 'other'),
merged AS (SELECT model, metric, avg(value) AS value FROM rows GROUP BY ALL),
years AS (SELECT DISTINCT model, unnest(['accuracy_enem_2022', 'accuracy_enem_2023', 'accuracy_enem_2024']) AS metric FROM merged),
macro AS (SELECT y.model, 'accuracy_enem_macro' AS metric, avg(coalesce(m.value, 0.0)) AS value
          FROM years y LEFT JOIN merged m USING (model, metric) GROUP BY y.model),
bias AS (SELECT model, 'bias_score' AS metric,
                max(CASE WHEN metric = 'accuracy_bbq_disambig' THEN value END) - max(CASE WHEN metric = 'accuracy_bbq_ambig' THEN value END) AS value
         FROM merged GROUP BY model)
SELECT model, metric, {rd('value')} AS value FROM (SELECT * FROM merged UNION ALL SELECT * FROM macro UNION ALL SELECT * FROM bias)"""


@query("run_metrics", _RUNNER_SQL)
def q_run_metrics(spark, sf_dir):
    scored = _runner_scored(spark, sf_dir)
    rows = M.dataset_metrics(scored, "model")
    merged = M.merge_metrics(rows, "model")
    out = (merged.unionByName(M.exam_macro(merged, "model"))
                 .unionByName(M.bias_score(merged, "model")))
    return out.select("model", "metric", r(F.col("value")).alias("value"))


# Kinds with a job of their own: macro and weighted F1 of three labels, all answers of a question.
_OWN_SCORES = f"""SELECT task, doc_id, m.metric, CASE WHEN pred = gold THEN 1.0 ELSE 0.0 END AS value, 1.0 AS weight, gold3 AS gold, pred3 AS pred, doc_id % 9 AS paragraph, doc_id % 5 AS question
FROM ({FX_CLS}) c, (SELECT * FROM (VALUES ('macro'), ('weighted'), ('all'), ('acc')) AS v(metric)) m"""
_OWN_KINDS = "SELECT * FROM (VALUES ('macro', 'f1_macro'), ('weighted', 'f1_weighted'), ('all', 'acc_all'), ('acc', 'mean')) AS k(metric, kind)"


@query("aggregate_own_kinds", f"""WITH {_CELLS},
n AS (SELECT task, count(*) AS n, avg(CAST(pred = gold AS DOUBLE)) AS acc, coalesce(stddev_samp(CAST(pred = gold AS DOUBLE)), 0) / sqrt(count(*)) AS se FROM fx GROUP BY task),
f AS (SELECT task, avg(2 * tp / (predicted + support)) AS macro, sum(2 * tp / (predicted + support) * support) / sum(support) AS weighted FROM lab GROUP BY task),
pq AS (SELECT task, avg(ok) AS a FROM (SELECT task, CAST(bool_and(pred = gold) AS DOUBLE) AS ok FROM fx GROUP BY task, doc_id % 9, doc_id % 5) GROUP BY task),
q AS (SELECT task, coalesce(stddev_samp(ok), 0) / sqrt(count(*)) AS se FROM (SELECT task, CAST(bool_and(pred = gold) AS DOUBLE) AS ok FROM fx GROUP BY task, doc_id % 5) GROUP BY task)
SELECT task, 'macro' AS metric, {rd('macro')} AS value, CAST(NULL AS DOUBLE) AS stderr, n FROM f JOIN n USING (task)
UNION ALL SELECT task, 'weighted', {rd('weighted')}, NULL, n FROM f JOIN n USING (task)
UNION ALL SELECT task, 'all', {rd('a')}, {rd('q.se')}, n FROM pq JOIN q USING (task) JOIN n USING (task)
UNION ALL SELECT task, 'acc', {rd('acc')}, {rd('se')}, n FROM n""")
def q_aggregate_own_kinds(spark, sf_dir):
    out = M.aggregate_scores(sql(spark, sf_dir, _OWN_SCORES), spark.sql(_OWN_KINDS), ("task",))
    return rcols(out, {"task", "metric", "n"})
