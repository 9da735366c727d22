"""Run telemetry roll-ups, throughput, trade-offs (AGG22-AGG24, AGG29, JN10-JN11, SRC22)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.clean import label_outcome
from ..functions.text import col
from .metrics import _keys, exact_percentile
from .skyline import skyline

# Fixed value: ARM runner OOM exit codes (see functions.clean.OOM_CODES), percentile used.
P95 = 0.95


def run_rollup(records: DataFrame, keys=("run_id",), expected: DataFrame | None = None,
               time_col: str = "total_time_s", ram_col: str = "rss_gb", temp_col: str = "temp_c",
               rc: str = "rc", timed_out: str = "timed_out", loop_abort: str = "loop_abort") -> DataFrame:
    """AGG22: per run — mean / exact p95 (linear) / total inference time over positive
    times, peak RAM, thermal mean over successful samples with a positive reading,
    success rate over the *expected* sample count (``expected``: keys + n_expected; the
    record count when absent), timeout / loop / error / OOM counts and the status
    completed / partial / failed."""
    ks = _keys(keys)
    outcome = label_outcome(rc, timed_out, loop_abort)
    r = records.withColumn("_outcome", outcome)
    ok = F.col("_outcome") == "success"
    t = col(time_col)
    agg = r.groupBy(*ks).agg(
        F.count(F.lit(1)).alias("n_records"),
        F.sum(ok.cast("long")).alias("n_success"),
        F.coalesce(F.avg(F.when(t > 0, t)), F.lit(0.0)).alias("inference_avg_time_s"),
        F.coalesce(F.sum(F.when(t > 0, t)), F.lit(0.0)).alias("inference_total_time_s"),
        F.coalesce(F.max(col(ram_col)), F.lit(0.0)).alias("ram_peak_gb"),
        F.coalesce(F.avg(F.when(ok & (col(temp_col) > 0), col(temp_col))), F.lit(0.0)).alias("thermal_avg_c"),
        F.count_if(F.col("_outcome") == "timeout").alias("timeout_count"),
        F.count_if(F.col("_outcome") == "loop").alias("loop_count"),
        F.count_if(F.col("_outcome") == "error").alias("error_count"),
        F.count_if(F.col("_outcome") == "oom").alias("oom_count"))
    p95 = exact_percentile(records.filter(t > 0), ks, time_col, P95)
    out = agg.join(p95, ks, "left").withColumn("inference_p95_time_s", F.coalesce("percentile", F.lit(0.0))).drop("percentile")
    if expected is not None:
        out = out.join(expected.select(*ks, "n_expected"), ks, "left")
        n_exp = F.coalesce(F.col("n_expected"), F.col("n_records"))
    else:
        n_exp = F.col("n_records")
    rate = F.when(n_exp > 0, F.col("n_success") / n_exp).otherwise(F.lit(0.0))
    out = out.withColumn("inference_success_rate", rate)
    status = (F.when(F.col("inference_success_rate") == 0.0, "failed")
               .when(F.col("inference_success_rate") < 1.0, "partial").otherwise("completed"))
    return out.withColumn("status", status)


def bench_rollup(rows: DataFrame, keys=("model",), order: str = "ord") -> DataFrame:
    """AGG23: throughput rows -> prompt tps (mean of positive prompt rows), generation tps
    (mean) and peak, ttft (first prompt row avg_ns / 1e6) and tbt (first generation row
    avg_ns / n_gen / 1e6).  "First" is by ``order``; min over a struct keeps it exact."""
    ks = _keys(keys)
    is_prompt = (F.col("n_prompt") > 0) & (F.col("n_gen") == 0)
    is_gen = F.col("n_gen") > 0
    first_p = F.min(F.when(is_prompt, F.struct(col(order).alias("o"), F.col("avg_ns").alias("ns"))))
    first_g = F.min(F.when(is_gen, F.struct(col(order).alias("o"), F.col("avg_ns").alias("ns"),
                                            F.col("n_gen").alias("ng"))))
    return rows.groupBy(*ks).agg(
        F.coalesce(F.avg(F.when(is_prompt & (F.col("avg_ts") > 0), F.col("avg_ts"))), F.lit(0.0)).alias("prompt_tps"),
        F.coalesce(F.avg(F.when(is_gen, F.col("avg_ts"))), F.lit(0.0)).alias("gen_tps"),
        F.coalesce(F.max(F.when(is_gen, F.col("avg_ts"))), F.lit(0.0)).alias("peak_gen_tps"),
        F.coalesce(first_p["ns"] / 1e6, F.lit(0.0)).alias("ttft_ms"),
        F.coalesce(first_g["ns"] / first_g["ng"] / 1e6, F.lit(0.0)).alias("tbt_ms"))


def mbu(size_gb, tps, bandwidth_gbs) -> Column:
    """AGG24: memory-bandwidth utilisation, 0 when the bandwidth is not positive."""
    bw = col(bandwidth_gbs) if not isinstance(bandwidth_gbs, (int, float)) else F.lit(float(bandwidth_gbs))
    return F.when(bw <= 0, F.lit(0.0)).otherwise(col(size_gb) * F.greatest(col(tps), F.lit(0.0)) / bw)


def quant_tradeoff(runs: DataFrame, baseline_quant: str, model: str = "model", quant: str = "quant",
                   quality: str = "quality", tps: str = "avg_tps", max_drop_pts: float = 5.0,
                   min_speedup: float = 1.5, success: str | None = None, min_success: float = 0.95) -> DataFrame:
    """JN10: each quantisation against the baseline row of the same model (equi-join on
    the model): quality drop in points, speed-up, and the acceptance rule."""
    base = runs.filter(col(quant) == baseline_quant).select(
        col(model).alias(model), col(quality).alias("_bq"), col(tps).alias("_bt"))
    j = runs.join(base, model, "inner")
    drop = (F.col("_bq") - col(quality)) * 100
    speed = F.try_divide(col(tps), F.col("_bt"))      # null for a baseline without throughput
    ok = (drop <= max_drop_pts) & (speed >= min_speedup)
    if success is not None:
        ok = ok & (col(success) >= min_success)
    return j.select(model, quant, drop.alias("quality_drop_pts"), speed.alias("speedup"), F.coalesce(ok, F.lit(False)).alias("accepted"))


def pareto_frontier(runs: DataFrame, up=("avg_tps", "quality"), down=("ppl",), keys=()) -> DataFrame:
    """JN11: rows not dominated by another row (>= on every "up" metric, <= on every
    "down" metric, strictly better on one) within the same ``keys`` group."""
    return skyline(runs, up, down, keys)


def failure_breakdown(records: DataFrame, dims=("dataset", "model")) -> DataFrame:
    """AGG29: outcome counts over every combination of the dimensions (CUBE)."""
    r = records.withColumn("_fail", F.col("outcome") != "success")
    return (r.cube(*dims).agg(F.count(F.lit(1)).alias("n"), F.count_if("_fail").alias("n_failed"),
                              F.count_if(F.col("outcome") == "timeout").alias("n_timeout"),
                              F.count_if(F.col("outcome") == "oom").alias("n_oom")))


# ----------------------------------------------------------------------- SRC22
RX_EVAL_TPS = r"([\d.,]+)\s*tokens per second"
RX_PROMPT_MS = r"([\d.,]+)\s*ms\s*/\s*token"
RX_GEN_TPS = r"generation:\s*([\d.,]+)\s*t/s"


def parse_perf_logs(lines: DataFrame, keys=("run_id",), line_no: str = "line_no", text: str = "line") -> DataFrame:
    """SRC22: tool-log lines -> (tokens/s, ttft ms).  The last matching line wins for the
    'eval time … tokens per second' and 'prompt eval time … ms / token' lines; a
    'generation: … t/s' line only counts when no eval line exists; ttft falls back to
    1000 / tps."""
    ks = _keys(keys)
    low = F.lower(col(text))
    num = lambda rx: F.replace(F.regexp_extract(low, rx, 1), F.lit(","), F.lit(".")).try_cast("double")
    eval_tps = F.when(((low.contains("eval time") | low.contains("eval_time")) & low.contains("tokens per second"))
                      & (F.regexp_extract(low, RX_EVAL_TPS, 1) != ""), num(RX_EVAL_TPS))
    ttft = F.when(low.contains("prompt eval time") & low.contains("ms / token")
                  & (F.regexp_extract(low, RX_PROMPT_MS, 1) != ""), num(RX_PROMPT_MS))
    gen = F.when(low.contains("generation:") & low.contains("t/s")
                 & (F.regexp_extract(low, RX_GEN_TPS, 1) != ""), num(RX_GEN_TPS))
    o = col(line_no)
    t = lines.select(*ks, o.alias("_o"), eval_tps.alias("_e"), ttft.alias("_t"), gen.alias("_g"))
    last = lambda c: F.max(F.when(F.col(c).isNotNull(), F.struct(F.col("_o").alias("o"), F.col(c).alias("v"))))["v"]
    first = lambda c: F.min(F.when(F.col(c).isNotNull(), F.struct(F.col("_o").alias("o"), F.col(c).alias("v"))))["v"]
    agg = t.groupBy(*ks).agg(last("_e").alias("_e"), last("_t").alias("_t"), first("_g").alias("_g"))
    tps = F.coalesce(F.col("_e"), F.col("_g"), F.lit(0.0))
    return agg.select(*ks, tps.alias("tokens_per_second"),
                      F.coalesce(F.col("_t"), F.when(tps > 0, 1000.0 / tps), F.lit(0.0)).alias("ttft_ms"))


# Marks of GPU lines and the perplexity lines in the tools' output.
GPU_MARKS = ["cuda", "rocm", "vram", "gpu"]
RX_MIB = r"(\d+(?:\.\d+)?)\s*mib"
RX_PPL = r"(?i)Final estimate:\s*PPL\s*=\s*([\d.]+)"
RX_PPL_FALLBACK = r"(?i)\bppl\b[^0-9]*([\d.]+)"


def vram_peak_gb(output) -> Column:
    """SRC22: largest 'n MiB' on a line that names a GPU, in GiB; 0 when there is none."""
    gpu = F.filter(F.split(F.lower(col(output)), "\\R"), lambda x: F.exists(F.array(*[F.lit(m) for m in GPU_MARKS]), lambda m: x.contains(m)))
    sizes = F.flatten(F.transform(gpu, lambda x: F.regexp_extract_all(x, F.lit(RX_MIB), F.lit(1))))
    return F.coalesce(F.array_max(F.transform(sizes, lambda x: x.cast("double") / 1024.0)), F.lit(0.0))


def parse_ppl(output) -> Column:
    """SRC22: the final perplexity estimate of a run's output, else the first number after a
    lone 'ppl'; null when neither is there."""
    first = lambda rx: F.nullif(F.regexp_extract(col(output), rx, 1), F.lit(""))
    return F.coalesce(first(RX_PPL), first(RX_PPL_FALLBACK)).try_cast("double")
