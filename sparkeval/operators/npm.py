"""Normalised preferred metric (NPM) leaderboards (AGG25, AGG26, CLN06, SNK04)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import col
from ..session import checked_broadcast

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference): per "<dataset>-<metric>" key, the random
# score, the maximum score and whether the dataset was translated.
TASK_SCORE_MAPPING = [
    ("faquad-f1", 0.0, 100.0, False),
    ("smallmkqa-best_f1", 0.0, 100.0, True),
    ("tweetsentbr-f1-macro", 32.4, 100.0, False),
    ("assin_rte-f1", 50.0, 100.0, False),
    ("enem-acc", 0.20, 1.0, False),
    ("agnews_pt-acc", 25.0, 100.0, True),
    ("imdb_pt-acc", 0.5, 1.0, True),
    ("smallmassive-f1-macro", 0.5847, 100.0, True),
    ("sst2_pt-acc", 0.5, 1.0, True),
    ("boolq_pt-acc", 0.5, 1.0, True),
    ("bat-acc", 0.25, 1.0, False),
    ("enem_2022-acc", 0.20, 1.0, False),
    ("wsc285_pt-acc", 0.50, 1.0, True),
    ("assin_sts-pearson", 0.0, 1.0, False),
]
GREEDY_TASK_SCORE_MAPPING = [
    ("faquad-f1", 0.0, 100.0, False),
    ("smallmkqa_greedy-best_f1", 0.0, 100.0, True),
    ("tweetsentbr_greedy-f1-macro", 32.4, 100.0, False),
    ("assin_rte_greedy-f1", 50.0, 100.0, False),
    ("enem_greedy-acc", 0.20, 1.0, False),
    ("agnews_pt_greedy-acc", 25.0, 100.0, True),
    ("imdb_pt_greedy-acc", 0.5, 1.0, True),
    ("smallmassive_greedy-f1-macro", 0.5847, 100.0, True),
    ("sst2_pt_greedy-acc", 0.5, 1.0, True),
    ("boolq_pt_greedy-acc", 0.5, 1.0, True),
    ("bat_greedy-acc", 0.25, 1.0, False),
    ("enem_2022_greedy-acc", 0.20, 1.0, False),
    ("wsc285_pt_greedy-acc", 0.50, 1.0, True),
    ("assin_sts_greedy-pearson", 0.0, 1.0, False),
]
# Run-name formats: dataset separator, and prefixes whose dataset name has two parts.
COMPOSED_PREFIXES = ["assin", "imdb", "agnews"]
# ---------------------------------------------------------------------------


def score_mapping(spark: SparkSession, rows=None) -> DataFrame:
    """The (key, random_score, max_score, translated) dimension (tiny; broadcast)."""
    return spark.createDataFrame(rows or TASK_SCORE_MAPPING,
                                 "key string, random_score double, max_score double, translated boolean")


def normalize_score(raw, random_score, max_score, scale: float = 100.0):
    """Null where the maximum equals the random score."""
    return F.try_divide(scale * (col(raw) - col(random_score)), col(max_score) - col(random_score))


def npm(results: DataFrame, mapping: DataFrame, keys=("model",), key: str = "key", raw: str = "raw") -> DataFrame:
    """AGG25: per ``keys``: NPM over all / translated / native tasks, where each task's
    preferred metric is normalised as 100·(raw − random)/(max − random)."""
    ks = list(keys)
    j = results.join(checked_broadcast(mapping)[0], key)
    n = normalize_score(raw, "random_score", "max_score")
    return j.groupBy(*ks).agg(F.avg(n).alias("npm_all"),
                              F.avg(F.when(F.col("translated"), n)).alias("npm_translated"),
                              F.avg(F.when(~F.col("translated"), n)).alias("npm_native"),
                              F.count(F.lit(1)).alias("n_tasks"))


def npm_series(history: DataFrame, mapping: DataFrame, step: str = "step", mode: str = "prompt_mode",
               key: str = "key", raw: str = "raw") -> DataFrame:
    """AGG26: per (step, prompt mode, subset all / translated / native): mean of
    (raw − random)/(max − random) over the mapped datasets (NaN propagates) and the number
    of datasets."""
    j = history.join(checked_broadcast(mapping)[0], key)
    n = normalize_score(raw, "random_score", "max_score", scale=1.0)
    subset = F.explode(F.array(F.lit("all"), F.when(F.col("translated"), F.lit("translated"))
                               .otherwise(F.lit("native"))))
    return (j.select(step, mode, key, n.alias("npm"), subset.alias("subset"))
             .groupBy(step, mode, "subset")
             .agg(F.avg("npm").alias("npm"), F.count_distinct(key).alias("n_datasets")))


def parse_metric_names(names: DataFrame, name: str = "name", recommended: bool = True) -> DataFrame:
    """CLN06: '<dataset><sep><prompt_mode>.<metric>' run-history column names ->
    (dataset, prompt_mode, metric, key); 'dinamic' is read as 'dynamic'.  The
    'recommended' format separates with '/', the other with '_' and knows two-part
    dataset prefixes."""
    c = col(name)
    parts = F.split(c, "/" if recommended else "_")
    first = F.element_at(parts, 1)
    if recommended:
        dataset = first
        rest = F.array_join(F.slice(parts, 2, F.size(parts)), "_")
    else:
        composed = first.isin(COMPOSED_PREFIXES)
        dataset = F.when(composed, F.array_join(F.slice(parts, 1, 2), "_")).otherwise(first)
        rest = F.when(composed, F.array_join(F.slice(parts, 3, F.size(parts)), "_")).otherwise(
            F.array_join(F.slice(parts, 2, F.size(parts)), "_"))
    metric = F.element_at(F.split(rest, r"\."), -1)
    prompt_mode = F.replace(F.element_at(F.split(rest, r"\."), 1), F.lit("dinamic"), F.lit("dynamic"))
    return names.select(c.alias(name), dataset.alias("dataset"), prompt_mode.alias("prompt_mode"),
                        metric.alias("metric"), F.concat(dataset, F.lit("-"), metric).alias("key"))


def write_npm_series(series: DataFrame, path: str) -> None:
    """SNK04: one CSV per subset, one column per prompt mode, rows sorted by step."""
    wide = series.groupBy("subset", "step").pivot("prompt_mode").agg(F.first("npm"))
    wide.orderBy("subset", "step").write.mode("overwrite").partitionBy("subset").option("header", True).csv(path)
