"""Result sinks (SNK01-SNK03, SNK05; SNK04 in operators.npm, SNK06 in streaming.jobs)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def write_results(results: DataFrame, path: str, keys=("model", "task", "prompt_mode")) -> None:
    """SNK01: results as JSON lines, one object per (keys) with its metrics nested."""
    ks = list(keys)
    nested = results.groupBy(*ks).agg(F.map_from_entries(F.collect_list(F.struct(
        "metric", F.struct("value", "stderr", "n")))).alias("metrics"))
    nested.write.mode("overwrite").json(path)


def write_samples(samples: DataFrame, path: str, partition_by=("task", "prompt_mode")) -> None:
    """SNK02: per-sample log, old files of the same (task, prompt mode) replaced."""
    (samples.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
            .partitionBy(*partition_by).json(path))


def results_table(results: DataFrame, keys=("task", "prompt_mode"), metric: str = "metric") -> DataFrame:
    """SNK03: markdown table lines 'task | mode | metric | value | ± | stderr' with
    repeated keys blanked (lag over the sort order) and '%.4f' numbers.  Row order is
    given by ``line_no``; the table is small (one line per metric)."""
    ks = list(keys)
    order = [F.col(k) for k in ks] + [F.col(metric)]
    w = W.orderBy(*order)
    blank = [F.when(F.lag(k).over(w) == F.col(k), F.lit("")).otherwise(F.col(k).cast("string")).alias(k) for k in ks]
    value = F.format_string("%.4f", F.col("value"))
    se = F.when(F.col("stderr").isNotNull(), F.format_string("%.4f", F.col("stderr"))).otherwise(F.lit(""))
    pm = F.when(F.col("stderr").isNotNull(), F.lit("±")).otherwise(F.lit(""))
    rows = results.select(F.row_number().over(w).cast("bigint").alias("line_no"), *blank, F.col(metric), value.alias("v"),
                          pm.alias("pm"), se.alias("se"))
    return rows.select("line_no", F.concat_ws("|", F.lit(""), *ks, metric, "v", "pm", "se", F.lit("")).alias("line"))


def audit_failures(samples: DataFrame, path: str, pred: str = "pred") -> DataFrame:
    """SNK05: rows whose extracted prediction is empty, appended to an audit table."""
    bad = samples.filter(F.col(pred).isNull() | (F.trim(F.col(pred)) == ""))
    bad.write.mode("append").parquet(path)
    return bad
