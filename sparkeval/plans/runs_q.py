"""Run roll-up, throughput, trade-off and leaderboard queries
(CLN04, AGG22-AGG26, AGG29, JN06, JN10, JN11, CLN06)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import clean as C
from ..operators import npm as N
from ..operators import runs as RU
from .metrics_q import rcols, rd
from .registry import query, sql, sql_str

FX_RECORDS = """SELECT event_id AS id, user_id AS run_id, value AS total_time_s, value / 100 AS rss_gb,
  CAST(CASE WHEN event_type = 'error' THEN 0.0 ELSE 30.0 + event_id % 50 END AS DOUBLE) AS temp_c,
  CASE event_id % 17 WHEN 0 THEN 137 WHEN 1 THEN 1 WHEN 2 THEN 139 ELSE 0 END AS rc,
  event_id % 13 = 0 AS timed_out, event_id % 19 = 0 AS loop_abort,
  event_type AS dataset, concat('m', CAST(user_id % 5 AS STRING)) AS model FROM events"""
FX_EXPECTED = """SELECT user_id AS run_id, count(*) + user_id % 3 AS n_expected FROM events GROUP BY user_id"""

FX_BENCH = """SELECT concat('m', CAST(l_suppkey AS STRING)) AS model,
       CASE WHEN l_linenumber % 2 = 1 THEN 256 ELSE 0 END AS n_prompt,
       CASE WHEN l_linenumber % 2 = 1 THEN 0 ELSE 128 END AS n_gen,
       l_extendedprice * 1000000 AS avg_ns, l_quantity AS avg_ts,
       row_number() OVER (PARTITION BY l_suppkey
         ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity) AS ord FROM lineitem"""

FX_RUNS = """SELECT p_brand AS model, p_type AS quant, CAST(avg(p_retailprice) / 100 AS DOUBLE) AS avg_tps,
       CAST(avg(p_size) / 50 AS DOUBLE) AS quality, CAST(min(p_retailprice) / 100 AS DOUBLE) AS ppl,
       CAST(max(p_size) / 4.0 AS DOUBLE) AS size_gb
FROM part GROUP BY p_brand, p_type"""

FX_STEPS = """SELECT CAST(year(o_orderdate) AS BIGINT) AS step, o_orderstatus AS prompt_mode, o_orderpriority AS dataset,
       CAST(avg(o_totalprice) / 500000 AS DOUBLE) AS raw, count(*) AS num_examples
FROM orders GROUP BY year(o_orderdate), o_orderstatus, o_orderpriority"""
# Inline mapping of the five order priorities onto reference task keys.
PRIORITY_KEYS = [("1-URGENT", "enem-acc"), ("2-HIGH", "imdb_pt-acc"), ("3-MEDIUM", "bat-acc"),
                 ("4-NOT SPECIFIED", "boolq_pt-acc"), ("5-LOW", "assin_sts-pearson")]
FX_HISTORY = (f"SELECT s.step, s.prompt_mode, k.key, s.raw FROM ({FX_STEPS}) s JOIN (VALUES "
              + ", ".join(f"({sql_str(a)}, {sql_str(b)})" for a, b in PRIORITY_KEYS)
              + ") AS k(dataset, key) ON s.dataset = k.dataset")
D_MAPPING = ("(VALUES " + ", ".join(f"({sql_str(k)}, CAST({r} AS DOUBLE), CAST({m} AS DOUBLE), {str(t).lower()})"
                                    for k, r, m, t in N.TASK_SCORE_MAPPING)
             + ") AS mp(key, random_score, max_score, translated)")


# ----------------------------------------------------------------- AGG22
_ROLLUP_SQL = f"""WITH fx AS ({FX_RECORDS}), ex AS ({FX_EXPECTED}),
o AS (SELECT *, CASE WHEN rc IN (137, -9, 139) THEN 'oom' WHEN timed_out THEN 'timeout' WHEN loop_abort THEN 'loop'
                     WHEN rc <> 0 THEN 'error' ELSE 'success' END AS outcome FROM fx),
a AS (SELECT run_id, count(*) AS n_records, sum(CASE WHEN outcome = 'success' THEN 1 ELSE 0 END) AS n_success,
        coalesce(avg(CASE WHEN total_time_s > 0 THEN total_time_s END), 0.0) AS inference_avg_time_s,
        coalesce(sum(CASE WHEN total_time_s > 0 THEN total_time_s END), 0.0) AS inference_total_time_s,
        coalesce(quantile_cont(CASE WHEN total_time_s > 0 THEN total_time_s END, 0.95), 0.0) AS inference_p95_time_s,
        coalesce(max(rss_gb), 0.0) AS ram_peak_gb,
        coalesce(avg(CASE WHEN outcome = 'success' AND temp_c > 0 THEN temp_c END), 0.0) AS thermal_avg_c,
        count_if(outcome = 'timeout') AS timeout_count, count_if(outcome = 'loop') AS loop_count,
        count_if(outcome = 'error') AS error_count, count_if(outcome = 'oom') AS oom_count FROM o GROUP BY run_id),
b AS (SELECT a.*, CASE WHEN coalesce(n_expected, n_records) > 0 THEN n_success / coalesce(n_expected, n_records) ELSE 0.0 END AS rate
      FROM a LEFT JOIN ex USING (run_id))
SELECT run_id, n_records, CAST(n_success AS BIGINT) AS n_success, {rd('inference_avg_time_s')} AS inference_avg_time_s,
       {rd('inference_total_time_s')} AS inference_total_time_s, {rd('inference_p95_time_s')} AS inference_p95_time_s,
       {rd('ram_peak_gb')} AS ram_peak_gb, {rd('thermal_avg_c')} AS thermal_avg_c,
       CAST(timeout_count AS BIGINT) AS timeout_count, CAST(loop_count AS BIGINT) AS loop_count,
       CAST(error_count AS BIGINT) AS error_count, CAST(oom_count AS BIGINT) AS oom_count, {rd('rate')} AS inference_success_rate,
       CASE WHEN rate = 0 THEN 'failed' WHEN rate < 1 THEN 'partial' ELSE 'completed' END AS status FROM b"""


@query("run_rollup", _ROLLUP_SQL)
def q_run_rollup(spark, sf_dir):
    fx = sql(spark, sf_dir, FX_RECORDS)
    ex = sql(spark, sf_dir, FX_EXPECTED)
    out = RU.run_rollup(fx, "run_id", expected=ex).drop("n_expected")
    keep = {"run_id", "n_records", "n_success", "timeout_count", "loop_count", "error_count", "oom_count", "status"}
    return rcols(out, keep)


# ----------------------------------------------------------------- AGG23
@query("bench_rollup", f"""WITH fx AS ({FX_BENCH})
SELECT model,
  {rd('coalesce(avg(CASE WHEN n_prompt > 0 AND n_gen = 0 AND avg_ts > 0 THEN avg_ts END), 0.0)')} AS prompt_tps,
  {rd('coalesce(avg(CASE WHEN n_gen > 0 THEN avg_ts END), 0.0)')} AS gen_tps,
  {rd('coalesce(max(CASE WHEN n_gen > 0 THEN avg_ts END), 0.0)')} AS peak_gen_tps,
  {rd('coalesce(arg_min(CASE WHEN n_prompt > 0 AND n_gen = 0 THEN avg_ns END, CASE WHEN n_prompt > 0 AND n_gen = 0 THEN ord END) / 1e6, 0.0)')} AS ttft_ms,
  {rd('coalesce(arg_min(CASE WHEN n_gen > 0 THEN avg_ns / n_gen END, CASE WHEN n_gen > 0 THEN ord END) / 1e6, 0.0)')} AS tbt_ms
FROM fx GROUP BY model""")
def q_bench_rollup(spark, sf_dir):
    return rcols(RU.bench_rollup(sql(spark, sf_dir, FX_BENCH)), {"model"})


# ----------------------------------------------------------------- AGG24 / JN10 / JN11
@query("mbu", f"""WITH fx AS ({FX_RUNS})
SELECT model, quant, {rd("CASE WHEN (CASE WHEN quant = 'PROMO' THEN 0.0 ELSE 100.0 END) <= 0 THEN 0.0 ELSE size_gb * greatest(avg_tps, 0.0) / (CASE WHEN quant = 'PROMO' THEN 0.0 ELSE 100.0 END) END")} AS mbu FROM fx""")
def q_mbu(spark, sf_dir):
    fx = sql(spark, sf_dir, FX_RUNS)
    bw = F.when(F.col("quant") == "PROMO", F.lit(0.0)).otherwise(F.lit(100.0))
    return fx.select("model", "quant", F.round(RU.mbu("size_gb", "avg_tps", bw), 6).alias("mbu"))


@query("quant_tradeoff", f"""WITH fx AS ({FX_RUNS}), b AS (SELECT model, quality AS bq, avg_tps AS bt FROM fx WHERE quant = 'STANDARD')
SELECT model, quant, {rd('(bq - quality) * 100')} AS quality_drop_pts, {rd('avg_tps / bt')} AS speedup,
       (bq - quality) * 100 <= 5.0 AND avg_tps / bt >= 1.5 AS accepted FROM fx JOIN b USING (model)""")
def q_quant_tradeoff(spark, sf_dir):
    out = RU.quant_tradeoff(sql(spark, sf_dir, FX_RUNS), "STANDARD")
    return rcols(out, {"model", "quant", "accepted"})


@query("pareto_frontier", f"""WITH fx AS ({FX_RUNS})
SELECT model, quant, avg_tps, quality, ppl, size_gb FROM fx a WHERE NOT EXISTS (
  SELECT 1 FROM fx b WHERE b.avg_tps >= a.avg_tps AND b.quality >= a.quality AND b.ppl <= a.ppl
    AND (b.avg_tps > a.avg_tps OR b.quality > a.quality OR b.ppl < a.ppl))""")
def q_pareto_frontier(spark, sf_dir):
    return RU.pareto_frontier(sql(spark, sf_dir, FX_RUNS))


# ----------------------------------------------------------------- AGG29
@query("failure_breakdown", f"""WITH fx AS ({FX_RECORDS}),
o AS (SELECT *, CASE WHEN rc IN (137, -9, 139) THEN 'oom' WHEN timed_out THEN 'timeout' WHEN loop_abort THEN 'loop'
                     WHEN rc <> 0 THEN 'error' ELSE 'success' END AS outcome FROM fx)
SELECT dataset, model, count(*) AS n, CAST(count_if(outcome <> 'success') AS BIGINT) AS n_failed,
       CAST(count_if(outcome = 'timeout') AS BIGINT) AS n_timeout, CAST(count_if(outcome = 'oom') AS BIGINT) AS n_oom
FROM o GROUP BY CUBE (dataset, model)""")
def q_failure_breakdown(spark, sf_dir):
    fx = sql(spark, sf_dir, FX_RECORDS).withColumn("outcome", C.label_outcome("rc", "timed_out", "loop_abort"))
    return RU.failure_breakdown(fx, ("dataset", "model"))


# ----------------------------------------------------------------- AGG25 / AGG26 / JN06
@query("npm", f"""WITH h AS ({FX_HISTORY}), j AS (SELECT *, 100 * (raw - random_score) / (max_score - random_score) AS n
                                          FROM h JOIN {D_MAPPING} USING (key))
SELECT step, prompt_mode, {rd('avg(n)')} AS npm_all, {rd('avg(CASE WHEN translated THEN n END)')} AS npm_translated,
       {rd('avg(CASE WHEN NOT translated THEN n END)')} AS npm_native, count(*) AS n_tasks FROM j GROUP BY step, prompt_mode""")
def q_npm(spark, sf_dir):
    h = sql(spark, sf_dir, FX_HISTORY)
    out = N.npm(h, N.score_mapping(spark), keys=("step", "prompt_mode"))
    return rcols(out, {"step", "prompt_mode", "n_tasks"})


@query("npm_series", f"""WITH h AS ({FX_HISTORY}), j AS (SELECT *, (raw - random_score) / (max_score - random_score) AS n
                                          FROM h JOIN {D_MAPPING} USING (key)),
x AS (SELECT step, prompt_mode, key, n, 'all' AS subset FROM j
      UNION ALL SELECT step, prompt_mode, key, n, CASE WHEN translated THEN 'translated' ELSE 'native' END FROM j)
SELECT step, prompt_mode, subset, {rd('avg(n)')} AS npm, count(DISTINCT key) AS n_datasets FROM x GROUP BY ALL""")
def q_npm_series(spark, sf_dir):
    h = sql(spark, sf_dir, FX_HISTORY)
    return rcols(N.npm_series(h, N.score_mapping(spark)), {"step", "prompt_mode", "subset", "n_datasets"})


# ----------------------------------------------------------------- CLN06
_NAMES = f"""SELECT DISTINCT concat(replace(h.key, '-acc', ''), '/',
         CASE h.prompt_mode WHEN 'F' THEN 'dinamic-random' WHEN 'O' THEN 'fixed' ELSE 'dynamic-similar' END, '.', 'acc') AS name
FROM ({FX_HISTORY}) h WHERE h.key LIKE '%-acc'"""


@query("parse_metric_names", f"""WITH n AS ({_NAMES}),
p AS (SELECT name, string_split(name, '/') AS parts FROM n),
q AS (SELECT name, parts[1] AS dataset, array_to_string(parts[2:], '_') AS rest FROM p)
SELECT name, dataset, replace(string_split(rest, '.')[1], 'dinamic', 'dynamic') AS prompt_mode,
       string_split(rest, '.')[-1] AS metric, concat(dataset, '-', string_split(rest, '.')[-1]) AS key FROM q""")
def q_parse_metric_names(spark, sf_dir):
    return N.parse_metric_names(sql(spark, sf_dir, _NAMES))


# ----------------------------------------------------------------- SRC22 (tool output)
FX_OUTPUT_LINES = """SELECT user_id AS run_id, event_id, CASE event_id % 6
    WHEN 0 THEN concat('CUDA0 model buffer size = ', CAST(event_id AS STRING), '.50 MiB')
    WHEN 1 THEN concat('host buffer size = ', CAST(event_id AS STRING), ' MiB')
    WHEN 2 THEN concat('[1] ppl so far: ', CAST(event_id % 90 AS STRING), '.25')
    WHEN 3 THEN concat(CASE WHEN user_id % 2 = 0 THEN 'Final estimate: PPL = ' ELSE 'estimate ' END, CAST(event_id % 70 AS STRING), '.125 +/- 0.04')
    WHEN 4 THEN concat('VRAM free ', CAST(event_id AS STRING), ' MiB of ', CAST(event_id + 7 AS STRING), 'MiB')
    ELSE event_type END AS line FROM events"""


@query("run_outputs", f"""WITH l AS ({FX_OUTPUT_LINES}),
o AS (SELECT run_id, string_agg(line, chr(10) ORDER BY event_id) AS output FROM l GROUP BY run_id),
g AS (SELECT run_id, max(CAST(regexp_extract(m, '[0-9.]+') AS DOUBLE)) / 1024 AS gb FROM (
        SELECT run_id, unnest(regexp_extract_all(lower(line), '\\d+(\\.\\d+)?\\s*mib')) AS m FROM l
        WHERE regexp_matches(lower(line), 'cuda|rocm|vram|gpu')) GROUP BY run_id)
SELECT o.run_id, {rd('coalesce(g.gb, 0.0)')} AS vram_peak_gb,
  TRY_CAST(coalesce(nullif(regexp_extract(output, '(?i)Final estimate:\\s*PPL\\s*=\\s*([\\d.]+)', 1), ''),
                    nullif(regexp_extract(output, '(?i)\\bppl\\b[^0-9]*([\\d.]+)', 1), '')) AS DOUBLE) AS ppl
FROM o LEFT JOIN g USING (run_id)""")
def q_run_outputs(spark, sf_dir):
    lines = sql(spark, sf_dir, FX_OUTPUT_LINES)
    out = lines.groupBy("run_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "line"))), lambda x: x["line"]), "\n").alias("output"))
    return out.select("run_id", F.round(RU.vram_peak_gb("output"), 6).alias("vram_peak_gb"), RU.parse_ppl("output").alias("ppl"))
