"""File readers and sinks over the driver tables: written to the shared folder and read back
(SRC01, SRC03, SRC04, SET01, SNK01, SNK02, SNK05)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics as M
from ..session import shared_path
from ..sources import readers as RD
from ..sources import sinks as SK
from .metrics_q import _KINDS, _SCORES, FX_CLS, rd
from .registry import load, query, sql

_FIELDS = "doc_id bigint, text string, source string"


@query("eval_family", """SELECT doc_id, md5(text) AS text_md5, CASE WHEN doc_id % 2 = 0 THEN source END AS source, CASE WHEN doc_id % 2 = 0 THEN 'even' ELSE 'odd' END AS dataset,
  CASE WHEN lang = 'en' THEN 'english' ELSE lang END AS split FROM documents WHERE text IS NOT NULL""")
def q_eval_family(spark, sf_dir):
    """JSON lines of two datasets with different fields, read with declared schemas, united and
    routed to splits."""
    docs, parts = load(spark, sf_dir, "documents").filter("text is not null"), {}
    for name, rest, fields in (("even", 0, _FIELDS + ", lang string"), ("odd", 1, "doc_id bigint, text string, lang string")):
        path = shared_path(spark, f"eval-{name}")
        docs.filter(F.pmod("doc_id", F.lit(2)) == rest).select("doc_id", "text", "source", "lang").write.json(path)
        parts[name] = RD.read_eval_jsonl(spark, path, fields)
    out = RD.route_splits(RD.load_eval_family(parts), "lang", {"en": "english"})
    return out.select("doc_id", F.md5("text").alias("text_md5"), "source", "dataset", "split")


@query("write_samples", f"SELECT task, prompt_mode, doc_id, gold, pred FROM ({FX_CLS})")
def q_write_samples(spark, sf_dir):
    """Per-sample log partitioned by task and prompt mode; a second write replaces its partitions."""
    samples = sql(spark, sf_dir, FX_CLS).select("task", "prompt_mode", "doc_id", F.col("gold").cast("int").alias("gold"), F.col("pred").cast("int").alias("pred"))
    path = shared_path(spark, "samples")
    for _ in range(2):
        SK.write_samples(samples, path)
    back = spark.read.schema("doc_id bigint, gold int, pred int, task string, prompt_mode string").json(path)
    return back.select("task", "prompt_mode", "doc_id", *[F.col(c).cast(dict(sql(spark, sf_dir, FX_CLS).dtypes)[c]) for c in ("gold", "pred")])


@query("write_results", f"""WITH s AS ({_SCORES}), k AS ({_KINDS})
SELECT model, task, prompt_mode, metric,
  {rd("CASE first(kind) WHEN 'mean' THEN avg(value) WHEN 'perplexity' THEN exp(-avg(value)) WHEN 'bits_per_byte' THEN -(sum(value) / sum(weight)) / ln(2) END")} AS value, count(value) AS n
FROM s JOIN k USING (metric) GROUP BY model, task, prompt_mode, metric""")
def q_write_results(spark, sf_dir):
    """Results as nested JSON lines, read back metric by metric."""
    path = shared_path(spark, "results")
    SK.write_results(M.aggregate_scores(sql(spark, sf_dir, _SCORES), spark.sql(_KINDS)), path)
    back = spark.read.schema("model string, task string, prompt_mode string, metrics map<string, struct<value: double, stderr: double, n: bigint>>").json(path)
    each = back.select("model", "task", "prompt_mode", F.explode("metrics").alias("metric", "m"))
    return each.select("model", "task", "prompt_mode", "metric", F.round("m.value", 6).alias("value"), "m.n")


_ANSWERS = "SELECT doc_id, lang, CASE WHEN n_chars % 5 = 0 THEN NULL WHEN n_chars % 5 = 1 THEN '   ' ELSE source END AS pred FROM documents"


@query("audit_failures", f"SELECT doc_id, lang, pred FROM ({_ANSWERS}) WHERE pred IS NULL OR trim(pred) = ''")
def q_audit_failures(spark, sf_dir):
    """Rows without an extracted prediction, appended language by language to one audit table."""
    rows, path = sql(spark, sf_dir, _ANSWERS), shared_path(spark, "audit")
    english = F.coalesce(F.col("lang") == "en", F.lit(False))
    for part in (english, ~english):
        SK.audit_failures(rows.filter(part), path)
    return spark.read.parquet(path).select("doc_id", "lang", "pred")
