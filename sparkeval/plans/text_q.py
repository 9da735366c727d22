"""Output cleaning and answer-extraction queries (CLN01-05, EXT01-12, SCR05, SCR14)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import clean as C
from ..functions import extract as X
from .registry import load, query, sql, sql_str

# fx_raw: raw model outputs, one template per branch (same SQL text in both engines).
FX_RAW = """SELECT doc_id, CASE doc_id % 8
   WHEN 0 THEN concat('FINAL_ANSWER: ', letter)
   WHEN 1 THEN concat('<think>', text, '</think> Resposta final: ', letter)
   WHEN 2 THEN concat('A alternativa ', letter, ') porque ', text)
   WHEN 3 THEN concat('opção 3 ', text)
   WHEN 4 THEN concat('<|im_start|>assistant', letter, '.<|im_end|>')
   WHEN 5 THEN concat('FINAL_ANSWER: ', CAST(doc_id % 3 AS STRING))
   WHEN 6 THEN concat('Total = ', CAST(doc_id AS STRING), ',5')
   ELSE text END AS raw, letter AS gold,
   CASE doc_id % 4 WHEN 0 THEN 'enem_2023' WHEN 1 THEN 'bbq_age' WHEN 2 THEN 'arith_gsm8k'
        ELSE 'other' END AS dataset
FROM (SELECT doc_id, text, substr('ABCDE', CAST(1 + doc_id % 5 AS INT), 1) AS letter FROM documents) t"""

STOPS = C.FAMILY_STOPS["qwen"]


# ---------------------------------------------------------------- DuckDB spellings
def d_strip(e: str) -> str:
    return f"regexp_replace({e}, '^\\s+|\\s+$', '', 'g')"


def d_after_marker(e: str, markers) -> str:
    parts = " ".join(f"WHEN instr({e}, {sql_str(m)}) > 0 THEN string_split({e}, {sql_str(m)})[-1]"
                     for m in markers)
    return f"(CASE {parts} ELSE {e} END)"


def d_cut_stops(e: str, stops) -> str:
    arr = "[" + ", ".join(sql_str(s) for s in stops) + "]"
    pos = (f"list_min(list_filter(list_transform({arr}, lambda t: CASE WHEN t <> '' THEN instr({e}, t) "
           f"ELSE 0 END), lambda p: p > 0))")
    return f"(CASE WHEN {pos} IS NOT NULL THEN substring({e}, 1, {pos} - 1) ELSE {e} END)"


def d_sanitize_ctes(src: str, stops) -> str:
    """CTE chain computing column ``clean`` from column ``raw`` of relation ``src``."""
    logs = "c4"
    for rx in C.LOG_LINE_PATTERNS:
        logs = f"regexp_replace({logs}, {sql_str('(?i)' + rx)}, '', 'g')"
    return f"""s1 AS (SELECT *, {d_after_marker('raw', C.ASSISTANT_MARKERS)} AS c1 FROM {src}),
s2 AS (SELECT *, regexp_replace(c1, {sql_str(C.THINK_BLOCK)}, ' ', 'g') AS c2 FROM s1),
s3 AS (SELECT *, CASE WHEN instr(lower(c2), '<think>') > 0
                      THEN substring(c2, 1, instr(lower(c2), '<think>') - 1) ELSE c2 END AS c3 FROM s2),
s4 AS (SELECT *, regexp_replace(regexp_replace(c3, {sql_str(C.CHAT_TAG_IM)}, ' ', 'g'),
                                {sql_str(C.CHAT_TAG_ANY)}, ' ', 'g') AS c4 FROM s3),
s5 AS (SELECT *, {logs} AS c5 FROM s4),
s6 AS (SELECT *, {d_after_marker('c5', C.ANSWER_MARKERS)} AS c6 FROM s5),
s7 AS (SELECT *, {d_strip(d_cut_stops('c6', stops))} AS clean FROM s6)"""


D_LINE_BREAK = X.RX_LINE_BREAK


def d_tail(e: str) -> str:
    return f"right({d_strip(e)}, {X.TAIL_CHARS})"


def d_source(e: str) -> str:
    fin = d_strip(f"coalesce(regexp_extract_all({d_tail(e)}, {sql_str(X.RX_FINAL)}, 1)[-1], '')")
    return f"(CASE WHEN {fin} <> '' THEN {fin} ELSE {d_tail(e)} END)"


def d_letter(e: str) -> str:
    src = d_source(e)
    cue = f"upper(regexp_extract({src}, {sql_str(X.RX_LAST_CUE_LETTER)}, 1))"
    num = f"regexp_extract({src}, {sql_str(X.RX_LAST_OPTION_NUMBER)}, 1)"
    let = f"regexp_extract(upper({src}), {sql_str(X.RX_LAST_LETTER)}, 1)"
    return (f"(CASE WHEN {cue} <> '' THEN {cue} WHEN {num} <> '' THEN substr('ABCDE', CAST({num} AS INT), 1) "
            f"ELSE {let} END)")


def d_index(e: str) -> str:
    return f"regexp_extract({d_source(e)}, {sql_str(X.RX_LAST_INDEX)}, 1)"


def d_number(e: str) -> str:
    return f"coalesce(replace(regexp_extract_all({d_source(e)}, {sql_str('(' + X.NUMBER + ')')}, 1)[-1], ',', '.'), '')"


def d_last_line(e: str) -> str:
    return d_strip(f"string_split_regex({d_tail(e)}, {sql_str(D_LINE_BREAK)})[-1]")


def d_model_answer(ds: str, e: str) -> str:
    return (f"(CASE WHEN {d_strip(e)} = '' THEN '' WHEN starts_with({ds}, 'enem') THEN {d_letter(e)} "
            f"WHEN starts_with({ds}, 'bbq') THEN {d_index(e)} WHEN {ds} = 'arith_gsm8k' THEN {d_number(e)} "
            f"ELSE {d_last_line(e)} END)")


# ---------------------------------------------------------------- queries
@query("sanitize_outputs", f"WITH fx AS ({FX_RAW}), {d_sanitize_ctes('fx', STOPS)} SELECT doc_id, clean FROM s7")
def q_sanitize_outputs(spark, sf_dir):
    fx = sql(spark, sf_dir, FX_RAW)
    return fx.select("doc_id", C.sanitize_output("raw", STOPS).alias("clean"))


_EXTRACT_SQL = f"""WITH fx AS ({FX_RAW}), {d_sanitize_ctes('fx', STOPS)}
SELECT doc_id, {d_letter('clean')} AS letter, {d_index('clean')} AS idx, {d_number('clean')} AS number,
       {d_last_line('clean')} AS last_line, {d_model_answer('dataset', 'clean')} AS answer FROM s7"""


@query("extract_answers", _EXTRACT_SQL)
def q_extract_answers(spark, sf_dir):
    fx = sql(spark, sf_dir, FX_RAW).select("doc_id", "dataset", C.sanitize_output("raw", STOPS).alias("clean"))
    return fx.select("doc_id", X.extract_letter("clean").alias("letter"), X.extract_index("clean").alias("idx"),
                     X.extract_number("clean").alias("number"), X.extract_last_line("clean").alias("last_line"),
                     X.extract_model_answer("dataset", "clean").alias("answer"))


# SCR05 + SCR14: runner scoring of extracted answers against the gold letter / index / number.
_SCORE_SQL = f"""WITH fx AS ({FX_RAW}), {d_sanitize_ctes('fx', STOPS)},
p AS (SELECT doc_id, dataset, raw, gold, clean, {d_model_answer('dataset', 'clean')} AS pred FROM s7),
g AS (SELECT *, CASE WHEN dataset = 'bbq_age' THEN CAST(doc_id % 3 AS STRING)
                     WHEN dataset = 'arith_gsm8k' THEN concat('A conta dá ', CAST(doc_id AS STRING), ',5')
                     ELSE gold END AS label FROM p),
n AS (SELECT *, TRY_CAST(replace(regexp_extract_all(label, {sql_str('(' + X.NUMBER + ')')}, 1)[-1], ',', '.') AS DOUBLE) AS e_num,
                TRY_CAST(replace(regexp_extract_all(pred, {sql_str('(' + X.NUMBER + ')')}, 1)[-1], ',', '.') AS DOUBLE) AS p_num
      FROM g)
SELECT doc_id,
  CAST(CASE WHEN starts_with(dataset, 'enem') THEN (pred = upper({d_strip('label')}))::INT
            WHEN starts_with(dataset, 'bbq') THEN (pred = {d_strip('label')})::INT
            WHEN dataset = 'arith_gsm8k' THEN coalesce((e_num IS NOT NULL AND p_num IS NOT NULL
                 AND abs(e_num - p_num) <= 1e-9 * greatest(abs(e_num), abs(p_num))), false)::INT END AS DOUBLE) AS correct,
  CAST(CASE WHEN starts_with(dataset, 'enem') THEN (pred IN ('A','B','C','D','E'))::INT
            WHEN starts_with(dataset, 'bbq') THEN (pred IN ('0','1','2'))::INT
            WHEN dataset = 'arith_gsm8k' THEN (p_num IS NOT NULL)::INT
            ELSE ({d_strip('pred')} <> '')::INT END AS DOUBLE) AS valid,
  contains(upper(right(raw, 100)), gold) AS contains_gold
FROM n"""


@query("score_samples", _SCORE_SQL)
def q_score_samples(spark, sf_dir):
    from ..operators.scoring import score_runner_sample, score_contains
    fx = sql(spark, sf_dir, FX_RAW)
    fx = fx.select("doc_id", "dataset", "raw", "gold", C.sanitize_output("raw", STOPS).alias("clean"))
    fx = fx.withColumn("pred", X.extract_model_answer("dataset", "clean"))
    label = (F.when(F.col("dataset") == "bbq_age", (F.col("doc_id") % 3).cast("string"))
              .when(F.col("dataset") == "arith_gsm8k", F.concat(F.lit("A conta dá "), F.col("doc_id").cast("string"), F.lit(",5")))
              .otherwise(F.col("gold")))
    s = score_runner_sample("dataset", label, "pred")
    return fx.select("doc_id", s["correct"].alias("correct"), s["valid"].alias("valid"),
                     score_contains("raw", "gold").alias("contains_gold"))


_TASK_SQL = f"""WITH fx AS ({FX_RAW})
SELECT doc_id,
  coalesce(regexp_extract_all(raw, '([ABCDE])\\.', 1)[-1], upper(regexp_extract_all(raw, '([ABCDEabcde])\\)', 1)[-1]),
           regexp_extract_all(raw, '([ABCDE])', 1)[-1], '') AS choice,
  coalesce(coalesce(regexp_extract_all(raw, '(?:[Ll]etra |[Aa]lternativa )?([AB])\\.', 1)[-1], regexp_extract_all(raw, '([AB])', 1)[-1]) || '.',
           {d_strip('raw')}) AS choice_ab,
  regexp_extract({d_strip('raw')}, '([A-Z]\\))', 1) AS paren,
  (raw = gold OR lower({d_strip('raw')}) = lower({d_strip('gold')})
     OR (regexp_extract(lower({d_strip('raw')}), '([a-d])\\.', 1) <> ''
         AND regexp_extract(lower({d_strip('raw')}), '([a-d])\\.', 1) = lower({d_strip('gold')}))) AS lenient,
  CASE WHEN regexp_matches(raw, '(?i)^\\s*sim') THEN 'yes' WHEN regexp_matches(raw, '(?i)^\\s*(nao|não)') THEN 'no' END AS yes_no,
  CASE WHEN regexp_extract(lower({d_strip('raw')}), '(1|2)', 1) = '' THEN 'unknown'
       ELSE regexp_extract(lower({d_strip('raw')}), '(1|2)', 1) END AS digit,
  coalesce(TRY_CAST({d_strip("replace(raw, 'Total = ', '')")} AS DOUBLE), 1.0) AS score,
  CASE WHEN TRY_CAST({d_strip("replace(raw, 'Total = ', '')")} AS DOUBLE) IS NULL THEN 5.0::DOUBLE ELSE CAST(doc_id % 5 AS DOUBLE) END AS score_gold,
  CASE WHEN TRY_CAST({d_strip("replace(raw, 'Total = ', '')")} AS DOUBLE) IS NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS score_unknown
FROM fx"""


@query("extract_task_answers", _TASK_SQL)
def q_extract_task_answers(spark, sf_dir):
    fx = sql(spark, sf_dir, FX_RAW)
    return fx.select("doc_id", X.extract_choice("raw").alias("choice"),
                     X.extract_choice_ab("raw").alias("choice_ab"),
                     X.extract_paren_letter("raw").alias("paren"),
                     X.match_letter_lenient("gold", "raw").alias("lenient"),
                     X.extract_yes_no("raw").alias("yes_no"),
                     X.extract_digit_class("raw").alias("digit"),
                     X.extract_score(F.replace(F.col("raw"), F.lit("Total = "), F.lit("")), F.col("doc_id") % 5).alias("_s")
                     ).select("*", F.col("_s.pred").alias("score"), F.col("_s.gold").alias("score_gold"), F.col("_s.unknown").alias("score_unknown")).drop("_s")


# EXT08: class list as a column — the document's language names in a fixed order.
_CLASSES_SQL = """SELECT doc_id, text, ['english', 'en', 'fr', 'de', 'es'] AS classes FROM documents"""


@query("extract_class", f"""WITH fx AS ({_CLASSES_SQL}),
h AS (SELECT doc_id, unnest(classes) AS cls, generate_subscripts(classes, 1) AS i, lower({d_strip('text')}) AS p FROM fx),
k AS (SELECT doc_id, lower({d_strip('cls')}) AS c, i, instr(p, lower({d_strip('cls')})) AS pos FROM h)
SELECT f.doc_id, coalesce((SELECT arg_min(c, pos * 100 + i) FROM k WHERE k.doc_id = f.doc_id AND pos > 0 AND c <> ''), '') AS cls
FROM fx f""")
def q_extract_class(spark, sf_dir):
    d = load(spark, sf_dir, "documents")
    classes = F.array(*[F.lit(x) for x in ["english", "en", "fr", "de", "es"]])
    return d.select("doc_id", X.extract_class("text", classes).alias("cls"))


@query("flag_loops", f"""WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), {sql_str(C.TOKEN_RX)}, 0) AS toks FROM documents),
u AS (SELECT doc_id, toks, CASE WHEN len(toks) > 14 * n THEN toks[len(toks) - 14 * n + 1:] ELSE toks END AS tail, n
      FROM t, (SELECT unnest([1, 2, 4]) AS n))
SELECT doc_id, CAST(n AS INT) AS n,
  CASE WHEN len(toks) < 4 * n THEN false WHEN len(tail) - 3 * n <= 0 THEN false
       ELSE len(list_filter(range(0, len(tail) - 3 * n),
              lambda i: tail[i + 1:i + n] = tail[i + 1 + n:i + 2 * n] AND tail[i + 1 + n:i + 2 * n] = tail[i + 1 + 2 * n:i + 3 * n])) > 0
  END AS is_loop
FROM u""")
def q_flag_loops(spark, sf_dir):
    d = load(spark, sf_dir, "documents")
    return d.select("doc_id", F.explode(C.flag_loops_all("text", [1, 2, 4])).alias("_x")).select("doc_id", "_x.n", "_x.is_loop")


@query("detokenize", """SELECT doc_id, regexp_replace(replace(replace(replace(replace(replace(text, ' n''t', 'n''t'),
  ' )', ')'), '( ', '('), '" ', '"'), ' "', '"'), ' ([''.,])', '\\1', 'g') AS detok FROM documents""")
def q_detokenize(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", C.detokenize("text").alias("detok"))


@query("truncate_at_stops", """SELECT doc_id, string_split(string_split(text, chr(10))[1], '.')[1] AS cut FROM documents""")
def q_truncate_at_stops(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", C.truncate_at_stops("text", ["\n", "."]).alias("cut"))


# CLN04: outcome labels on the run-telemetry stand-in.
FX_OUTCOMES = """SELECT event_id AS id, user_id AS run_id, value AS total_time_s,
       CASE event_id % 17 WHEN 0 THEN 137 WHEN 1 THEN 1 WHEN 2 THEN 139 ELSE 0 END AS rc,
       event_id % 13 = 0 AS timed_out, event_id % 19 = 0 AS loop_abort FROM events"""


@query("label_outcomes", f"""WITH fx AS ({FX_OUTCOMES})
SELECT id, CASE WHEN rc IN (137, -9, 139) THEN 'oom' WHEN timed_out THEN 'timeout' WHEN loop_abort THEN 'loop'
                WHEN rc <> 0 THEN 'error' ELSE 'success' END AS outcome FROM fx""")
def q_label_outcomes(spark, sf_dir):
    fx = sql(spark, sf_dir, FX_OUTCOMES)
    return fx.select("id", C.label_outcome("rc", "timed_out", "loop_abort").alias("outcome"))
