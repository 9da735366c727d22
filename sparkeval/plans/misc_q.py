"""Model tagging, stop tokens, key disjointness and the results table
(PRJ12, PRJ13, SET02, SET06, SNK03, WIN09)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import clean as C
from ..operators import metrics as M
from ..operators import tasks as TK
from ..session import shared_path
from ..sources import readers as RD
from ..sources import sinks as SK
from .metrics_q import _KINDS, _SCORES
from .registry import load, query, sql, sql_str

# Every family and quantisation tag over the parts: the name of a part, a family by its size
# and a tag by the number in its brand.
_NAMES = """SELECT p_partkey, concat(CASE WHEN p_size <= 8 THEN 'Mistral-7B-' WHEN p_size <= 16 THEN 'qwen2.5-' WHEN p_size <= 24 THEN 'Llama-3.1-8B-'
    WHEN p_size <= 32 THEN 'Sabia-7b-' ELSE '' END, p_name,
  CASE substr(p_brand, 7, 1) WHEN '1' THEN '-Q4_K_M' WHEN '2' THEN '-q8_0' WHEN '3' THEN '-Q5_1.gguf' ELSE '' END) AS name FROM part"""


def _d_family(e: str) -> str:
    parts = " ".join(f"WHEN contains(lower({e}), {sql_str(n)}) THEN {sql_str(f)}" for n, f in C.FAMILY_ORDER)
    return f"(CASE {parts} ELSE 'generic' END)"


_FAM_STOPS = "CASE " + " ".join(
    f"WHEN fam = {sql_str(k)} THEN [{', '.join(sql_str(s) for s in v)}]" for k, v in C.FAMILY_STOPS.items()) + \
    f" ELSE [{', '.join(sql_str(s) for s in C.FAMILY_STOPS['generic'])}] END"


@query("tag_models", f"""WITH n AS ({_NAMES}), f AS (SELECT *, {_d_family('name')} AS fam FROM n)
SELECT p_partkey, fam AS family,
  coalesce(nullif(regexp_extract(upper(name), {sql_str(C.QUANT_RX)}, 1), ''), 'unknown') AS quant,
  array_to_string(list_distinct_ordered, '|') AS stops FROM (
    SELECT *, list_filter(list_transform(range(1, len(l) + 1), lambda i: CASE WHEN list_position(l, l[i]) = i THEN l[i] END),
                          lambda x: x IS NOT NULL) AS list_distinct_ordered
    FROM (SELECT *, CASE WHEN contains(lower(name), 'sabia') THEN ['###', 'User:'] ELSE [] END || ({_FAM_STOPS}) AS l FROM f))""")
def q_tag_models(spark, sf_dir):
    n = sql(spark, sf_dir, _NAMES).withColumn("configured", F.array(F.lit("###"), F.lit("User:")))
    return n.select("p_partkey", C.model_family("name").alias("family"), C.quant_tag("name").alias("quant"),
                    F.array_join(C.stop_tokens("name", F.lit("sabia7"), "configured"), "|").alias("stops"))


@query("assert_disjoint", """SELECT doc_id FROM labels INTERSECT SELECT item_id AS doc_id FROM benchmark""")
def q_assert_disjoint(spark, sf_dir):
    """Ids of the labelled documents vs ids of the benchmark items: the shared ones."""
    lab = load(spark, sf_dir, "labels").select("doc_id")
    return M.assert_disjoint(lab, load(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id")), "doc_id")


@query("results_table", f"""WITH s AS ({_SCORES}), k AS ({_KINDS}),
r AS (SELECT model, task, prompt_mode, metric,
        CASE first(kind) WHEN 'mean' THEN avg(value) WHEN 'perplexity' THEN exp(-avg(value))
             WHEN 'bits_per_byte' THEN -(sum(value) / sum(weight)) / ln(2) END AS value,
        CASE WHEN first(kind) = 'mean' THEN coalesce(stddev_samp(value), 0) / sqrt(count(value)) END AS stderr
      FROM s JOIN k USING (metric) GROUP BY model, task, prompt_mode, metric),
o AS (SELECT *, row_number() OVER (ORDER BY model, task, prompt_mode, metric) AS line_no,
             lag(model) OVER (ORDER BY model, task, prompt_mode, metric) AS pmo,
             lag(task) OVER (ORDER BY model, task, prompt_mode, metric) AS pt,
             lag(prompt_mode) OVER (ORDER BY model, task, prompt_mode, metric) AS pm FROM r)
SELECT line_no, concat_ws('|', '', CASE WHEN pmo = model THEN '' ELSE model END, CASE WHEN pt = task THEN '' ELSE task END, CASE WHEN pm = prompt_mode THEN '' ELSE prompt_mode END,
       metric, printf('%.4f', round(value, 6)), CASE WHEN stderr IS NOT NULL THEN '±' ELSE '' END,
       CASE WHEN stderr IS NOT NULL THEN printf('%.4f', round(stderr, 6)) ELSE '' END, '') AS line FROM o""")
def q_results_table(spark, sf_dir):
    from ..operators.metrics import aggregate_scores
    res = aggregate_scores(sql(spark, sf_dir, _SCORES), spark.sql(_KINDS))
    res = res.withColumn("value", F.round("value", 6)).withColumn("stderr", F.round("stderr", 6))
    return SK.results_table(res, ("model", "task", "prompt_mode"))


# ----------------------------------------------------------------- SRC19
@query("zstd_corpus", """SELECT CAST(doc_id AS VARCHAR) AS doc_id, lang, source, CAST(length(text) AS BIGINT) AS n_chars, md5(text) AS text_md5
FROM documents WHERE text IS NOT NULL""")
def q_zstd_corpus(spark, sf_dir):
    """All documents written as zstd-compressed JSON lines to the shared folder and read back."""
    meta = F.create_map(F.lit("doc_id"), F.col("doc_id").cast("string"), F.lit("lang"), F.col("lang"), F.lit("source"), F.col("source"))
    path = shared_path(spark, "corpus", ".jsonl.zst")
    RD.write_corpus(load(spark, sf_dir, "documents").withColumn("meta", meta), path, meta="meta")
    back = RD.read_corpus(spark, path)
    return back.select(F.col("meta.doc_id").alias("doc_id"), F.col("meta.lang").alias("lang"), F.col("meta.source").alias("source"),
                       F.length("text").cast("bigint").alias("n_chars"), F.md5("text").alias("text_md5"))


# ----------------------------------------------------------------- EXTN: tasks as declarations
_QUALITY = TK.TaskSpec("quality", "Texto de {q}: bom{q|question}\nResposta:", " {label|classes}", "text", {"acc": ("equal", "mean"), "f1": ("one", "f1")},
                       {"1": "sim", "0": "não"}, positive="sim")
_ORIGIN = TK.TaskSpec("origin", "Q: {q}\nA:", " {a}", "last_line", {"acc": ("equal", "mean"), "total": ("one", "sum")}, lower_is_better=("total",))
_TASK_ITEMS = """SELECT 'quality' AS task, d.doc_id, d.source AS q, CAST(l.quality AS STRING) AS label, CASE WHEN l.quality = 1 THEN 'sim' ELSE 'não' END AS gold,
  CASE WHEN d.doc_id % 11 = 0 THEN NULL WHEN (l.quality = 1) = (d.doc_id % 7 > 0) THEN ' Sim ' ELSE 'NÃO' END AS response FROM documents d JOIN labels l ON d.doc_id = l.doc_id
UNION ALL SELECT 'origin', doc_id, lang, source, source, concat('talvez', chr(10), CASE WHEN doc_id % 3 = 0 THEN source ELSE lang END) FROM documents"""


@query("run_task", f"""WITH i AS ({_TASK_ITEMS.replace("STRING", "VARCHAR")}),
s AS (SELECT task, coalesce(CASE WHEN task = 'quality' THEN lower(trim(response)) = gold ELSE string_split(response, chr(10))[2] = gold END, false) AS ok,
             coalesce(gold = 'sim', false) AS g, coalesce(lower(trim(response)) = 'sim', false) AS p FROM i),
c AS (SELECT task, count(*) AS n, avg(CAST(ok AS DOUBLE)) AS acc, coalesce(stddev_samp(CAST(ok AS DOUBLE)), 0) / sqrt(count(*)) AS se,
             CAST(count_if(g AND p) AS DOUBLE) AS tp, CAST(count_if(NOT g AND p) AS DOUBLE) AS fp, CAST(count_if(g AND NOT p) AS DOUBLE) AS fn FROM s GROUP BY task)
SELECT task, 'acc' AS metric, round(acc, 6) AS value, round(se, 6) AS stderr, n, true AS higher_is_better FROM c
UNION ALL SELECT task, 'f1', round(CASE WHEN tp + fp + fn = 0 THEN 0.0 ELSE 2 * tp / (2 * tp + fp + fn) END, 6), NULL, n, true FROM c WHERE task = 'quality'
UNION ALL SELECT task, 'total', CAST(n AS DOUBLE), NULL, n, false FROM c WHERE task = 'origin'""")
def q_run_task(spark, sf_dir):
    """Two declared tasks over all documents in one plan: prompts, extraction, scores, aggregation."""
    rows = sql(spark, sf_dir, _TASK_ITEMS)
    fields = F.create_map(F.lit("q"), F.col("q"), F.lit("label"), F.col("label"), F.lit("a"), F.col("label"))
    out = TK.run_task(rows.select("task", "doc_id", fields.alias("fields"), "gold"), rows.select("task", "doc_id", "response"), [_QUALITY, _ORIGIN])
    return out.withColumn("value", F.round("value", 6)).withColumn("stderr", F.round("stderr", 6))
