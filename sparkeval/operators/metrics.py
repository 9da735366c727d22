"""Metric aggregation (AGG01-AGG19, AGG28, AGG30).

Every metric is computed from sufficient statistics that aggregate partially map-side:
counts / sums for means and errors, a (gold, pred) confusion table (tiny: labels²) for
F1 and MCC.  No per-group lists are collected.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.extract import ARITH_DATASET
from ..functions.text import col
from ..session import checked_broadcast, equi_join
from .sampling import dense_index, distributed_cumsum


def _keys(keys) -> list[str]:
    return [keys] if isinstance(keys, str) else list(keys)


# ------------------------------------------------------------------ AGG02 / AGG09 / AGG10

def mean_stderr(df: DataFrame, keys, value: str) -> DataFrame:
    """AGG02: mean, sample sd (0 for one item), population sd and standard error of the mean."""
    v = col(value).cast("double")
    sd = F.coalesce(F.stddev_samp(v), F.lit(0.0))
    return (df.groupBy(*_keys(keys))
              .agg(F.avg(v).alias("mean"), sd.alias("sd"), F.coalesce(F.stddev_pop(v), F.lit(0.0)).alias("sd_pop"),
                   F.count(v).alias("n"))
              .withColumn("stderr", F.try_divide(F.col("sd"), F.sqrt(F.col("n")))))


def perplexity_metrics(df: DataFrame, keys, loglik: str, words: str, nbytes: str) -> DataFrame:
    """AGG09: perplexity exp(-mean), word perplexity exp(-Σll/Σwords), bytes perplexity,
    bits per byte -(Σll/Σbytes)/ln 2."""
    ll = col(loglik).cast("double")
    return (df.groupBy(*_keys(keys))
              .agg(F.exp(-F.avg(ll)).alias("perplexity"),
                   F.exp(-(F.sum(ll) / F.sum(col(words)))).alias("word_perplexity"),
                   F.exp(-(F.sum(ll) / F.sum(col(nbytes)))).alias("byte_perplexity"),
                   (-(F.sum(ll) / F.sum(col(nbytes))) / F.lit(math.log(2))).alias("bits_per_byte")))


def pearson(df: DataFrame, keys, x: str, y: str) -> DataFrame:
    """AGG10: Pearson correlation per group (built-in ``corr``); null when either side is
    constant (undefined correlation)."""
    a, b = col(x).cast("double"), col(y).cast("double")
    r = F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))
    return df.groupBy(*_keys(keys)).agg(r.alias("pearson"))


# ------------------------------------------------------------------ AGG03

def positional_median(df: DataFrame, keys, value: str, order: str) -> DataFrame:
    """AGG03: the reference's "median" = the element at position n//2 in input order
    (no sorting by value).  ``order`` gives the input order (unique inside a group); a
    group of any size is spread over range partitions (``dense_index``)."""
    ks = _keys(keys)
    rows = df.select(*ks, col(value).alias("_value"), col(order).alias("_order"))
    n = rows.groupBy(*ks).agg(F.count(F.lit(1)).alias("_n"))
    placed = dense_index(rows, ks, [F.col("_order")], "_pos")
    return equi_join(placed, n, ks).filter(F.col("_pos") == F.floor(F.col("_n") / 2)).select(*ks, F.col("_value").alias("median"))


def exact_percentile(df: DataFrame, keys, value: str, p: float) -> DataFrame:
    """Exact percentile with linear interpolation between the two neighbouring ranks
    (same definition as Spark's ``percentile`` / DuckDB's ``quantile_cont``).

    One aggregate by (key, value) collapses ties; a running count over the distinct values
    (range partitions, so a hot group is never held by one task) gives every value its
    ranks, and the two wanted ranks are picked from it."""
    ks = _keys(keys)
    v = col(value)
    counts = df.filter(v.isNotNull()).groupBy(*ks, v.alias("_val")).agg(F.count(F.lit(1)).alias("_c"))
    run = distributed_cumsum(counts, ks, [F.col("_val")], F.col("_c"), "_upto")
    n = counts.groupBy(*ks).agg(F.sum("_c").alias("_n"))
    j = equi_join(run, n, ks)
    pos = (F.col("_n") - 1) * p
    lo, hi = F.floor(pos), F.least(F.floor(pos) + 1, F.col("_n") - 1)
    holds = lambda r: F.max(F.when((F.col("_upto") - F.col("_c") <= r) & (r < F.col("_upto")), F.col("_val")))
    w = F.first(pos - F.floor(pos))
    return j.groupBy(*ks).agg((holds(lo) * (1 - w) + holds(hi) * w).alias("percentile"))


# ------------------------------------------------------------------ AGG04-AGG07

def confusion_counts(df: DataFrame, keys, gold: str, pred: str) -> DataFrame:
    """(keys, gold, pred, cnt) — the only table the classification metrics read."""
    return df.groupBy(*_keys(keys), col(gold).alias("gold"), col(pred).alias("pred")).agg(
        F.count(F.lit(1)).alias("cnt"))


def _per_label(cells: DataFrame, ks: list[str]) -> DataFrame:
    g = cells.groupBy(*ks, F.col("gold").alias("_lab")).agg(
        F.sum("cnt").alias("support"), F.sum(F.when(F.col("gold") == F.col("pred"), F.col("cnt")).otherwise(0)).alias("tp"))
    p = cells.groupBy(*ks, F.col("pred").alias("_lab")).agg(F.sum("cnt").alias("predicted"))
    return equi_join(g, p, ks + ["_lab"], "left").fillna(0, ["predicted"])


def f1_macro(df: DataFrame, keys, gold: str, pred: str, scale: float = 1.0) -> DataFrame:
    """AGG05: macro F1 over the labels present in gold (F1_l = 2tp / (predicted + support))."""
    ks = _keys(keys)
    lab = _per_label(confusion_counts(df, ks, gold, pred), ks)
    f1 = 2 * F.col("tp") / (F.col("predicted") + F.col("support"))
    return lab.groupBy(*ks).agg((F.avg(f1) * scale).alias("f1_macro"))


def f1_weighted(df: DataFrame, keys, gold: str, pred: str, scale: float = 1.0) -> DataFrame:
    """AGG06: support-weighted F1 over the labels present in gold."""
    ks = _keys(keys)
    lab = _per_label(confusion_counts(df, ks, gold, pred), ks)
    f1 = 2 * F.col("tp") / (F.col("predicted") + F.col("support"))
    return lab.groupBy(*ks).agg((F.sum(f1 * F.col("support")) / F.sum("support") * scale).alias("f1_weighted"))


def f1_binary(df: DataFrame, keys, gold: str, pred: str, positive=1) -> DataFrame:
    """AGG04: F1 of the positive class, 0 when undefined."""
    g, p = col(gold) == positive, col(pred) == positive
    tp = F.sum((g & p).cast("long"))
    fp = F.sum((~g & p).cast("long"))
    fn = F.sum((g & ~p).cast("long"))
    den = 2 * tp + fp + fn
    return df.groupBy(*_keys(keys)).agg(
        F.when(den == 0, F.lit(0.0)).otherwise(2 * tp / den).alias("f1"))


def matthews_corr(df: DataFrame, keys, gold: str, pred: str) -> DataFrame:
    """AGG07: multiclass Matthews correlation from confusion counts; 0 when undefined."""
    ks = _keys(keys)
    cells = confusion_counts(df, ks, gold, pred)
    t = cells.groupBy(*ks, F.col("gold").alias("_lab")).agg(F.sum("cnt").alias("t"))
    p = cells.groupBy(*ks, F.col("pred").alias("_lab")).agg(F.sum("cnt").alias("p"))
    tp = (equi_join(t, p, ks + ["_lab"], "full").fillna(0, ["t", "p"])
           .groupBy(*ks).agg(F.sum(F.col("t") * F.col("p")).alias("pt"), F.sum(F.col("p") ** 2).alias("pp"),
                             F.sum(F.col("t") ** 2).alias("tt")))
    tot = cells.groupBy(*ks).agg(F.sum("cnt").cast("double").alias("s"),
                                 F.sum(F.when(F.col("gold") == F.col("pred"), F.col("cnt")).otherwise(0)).alias("c"))
    j = equi_join(tot, tp, ks)
    den = F.sqrt((F.col("s") ** 2 - F.col("pp")) * (F.col("s") ** 2 - F.col("tt")))
    return j.select(*ks, F.when(den == 0, F.lit(0.0)).otherwise(
        (F.col("c") * F.col("s") - F.col("pt")) / den).alias("mcc"))


# ------------------------------------------------------------------ AGG08

def acc_all(df: DataFrame, keys, paragraph: str, question: str, correct: str) -> DataFrame:
    """AGG08: a question is right only if all its answers are; mean over (paragraph,
    question) groups, and the reference's stderr grouped by question only."""
    ks = _keys(keys)
    by_pq = df.groupBy(*ks, paragraph, question).agg(F.bool_and(col(correct)).cast("double").alias("ok"))
    by_q = df.groupBy(*ks, question).agg(F.bool_and(col(correct)).cast("double").alias("ok"))
    a = by_pq.groupBy(*ks).agg(F.avg("ok").alias("acc_all"))
    s = (by_q.groupBy(*ks).agg((F.coalesce(F.stddev_samp("ok"), F.lit(0.0)) / F.sqrt(F.count("ok")))
                               .alias("acc_all_stderr")))
    return equi_join(a, s, ks)


# ------------------------------------------------------------------ AGG16-AGG18, AGG15

# Exam years seeded with 0.0 in the runner's metric dict.
EXAM_YEARS = ["2022", "2023", "2024"]


def dataset_metrics(scored: DataFrame, keys=("model",), dataset: str = "dataset", arith_dataset: str = ARITH_DATASET) -> DataFrame:
    """AGG16: per (keys, dataset) the runner's metric dict as rows (keys, dataset, metric,
    value): exam accuracy + invalid rate, bias-set accuracy overall / ambiguous /
    disambiguated (0.0 when empty), gsm8k exact match, otherwise valid rate."""
    ks = _keys(keys)
    ds = F.col(dataset)
    amb = F.col("is_ambig") == 1.0
    dis = F.col("is_disambig") == 1.0
    agg = scored.groupBy(*ks, dataset).agg(
        F.avg("valid").alias("valid_rate"), F.avg("correct").alias("acc"),
        F.coalesce(F.avg(F.when(amb, F.col("correct"))), F.lit(0.0)).alias("acc_ambig"),
        F.coalesce(F.avg(F.when(dis, F.col("correct"))), F.lit(0.0)).alias("acc_disambig"),
        F.avg("exact").alias("exact"))
    year = F.regexp_replace(ds, "^enem_", "")
    entries = (F.when(ds.startswith("enem_"), F.array(
                   F.struct(F.concat(F.lit("accuracy_enem_"), year).alias("metric"), F.col("acc").alias("value")),
                   F.struct(F.lit("invalid_answer_rate_enem").alias("metric"), (1.0 - F.col("valid_rate")).alias("value"))))
                .when(ds.isin("bbq_gender_identity", "bbq_physical_appearance", "bbq_race_ethnicity"), F.array(
                   F.struct(F.concat(F.lit("accuracy_"), ds).alias("metric"), F.col("acc").alias("value")),
                   F.struct(F.lit("accuracy_bbq_ambig").alias("metric"), F.col("acc_ambig").alias("value")),
                   F.struct(F.lit("accuracy_bbq_disambig").alias("metric"), F.col("acc_disambig").alias("value"))))
                .when(ds == arith_dataset, F.array(
                   F.struct(F.lit(f"exact_match_{arith_dataset}").alias("metric"), F.col("exact").alias("value"))))
                .otherwise(F.array(F.struct(F.lit("valid_rate").alias("metric"), F.col("valid_rate").alias("value")))))
    return agg.select(*ks, dataset, F.explode(entries).alias("e")).select(*ks, dataset, "e.metric", "e.value")


def merge_metrics(rows: DataFrame, keys=("model",)) -> DataFrame:
    """AGG15: unweighted mean of each metric key over the merged dicts."""
    ks = _keys(keys)
    return rows.groupBy(*ks, "metric").agg(F.avg("value").alias("value"))


def exam_macro(merged: DataFrame, keys=("model",), years=EXAM_YEARS, seed_missing: bool = True) -> DataFrame:
    """AGG17: mean of all per-year exam accuracies present; with ``seed_missing`` a seeded
    year without data counts as 0.0, as in the runner's pre-seeded dict."""
    ks = _keys(keys)
    exam = merged.filter(F.col("metric").startswith("accuracy_enem_") & (F.col("metric") != "accuracy_enem_macro"))
    if seed_missing:
        seeded = F.array(*[F.lit(f"accuracy_enem_{y}") for y in years])
        base = merged.select(*ks).distinct().select(*ks, F.explode(seeded).alias("metric"))
        absent = equi_join(base, exam, ks + ["metric"], "left_anti").withColumn("value", F.lit(0.0))
        exam = exam.select(*ks, "metric", "value").unionByName(absent)
    return exam.groupBy(*ks).agg(F.avg("value").alias("value")).withColumn("metric", F.lit("accuracy_enem_macro"))


def bias_score(merged: DataFrame, keys=("model",)) -> DataFrame:
    """AGG18: (merged) disambiguated accuracy − ambiguous accuracy; a missing one counts 0."""
    ks = _keys(keys)
    return (merged.groupBy(*ks).agg(
        (F.coalesce(F.max(F.when(F.col("metric") == "accuracy_bbq_disambig", F.col("value"))), F.lit(0.0))
         - F.coalesce(F.max(F.when(F.col("metric") == "accuracy_bbq_ambig", F.col("value"))), F.lit(0.0))).alias("value"))
        .withColumn("metric", F.lit("bias_score")))


# ------------------------------------------------------------------ AGG19 / AGG30

def sliced_metrics(df: DataFrame, value: str, slices: list[str], keys=()) -> DataFrame:
    """AGG19 / AGG30: each sample counts toward the overall figure and toward every slice
    it belongs to — one GROUPING SETS aggregate (mean and correct-count sum)."""
    ks = _keys(keys)
    sets = [[F.col(k) for k in ks]] + [[F.col(k) for k in ks] + [F.col(s)] for s in slices]
    g = df.groupingSets(sets, *[F.col(c) for c in ks + slices]).agg(
        F.avg(col(value)).alias("mean"), F.sum(col(value)).alias("total"), F.count(F.lit(1)).alias("n"),
        *[F.grouping(s).alias(f"_g_{s}") for s in slices])
    name = None
    for s in slices:
        name = (F.when(F.col(f"_g_{s}") == 0, F.lit(s)) if name is None
                else name.when(F.col(f"_g_{s}") == 0, F.lit(s)))
    name = name.otherwise(F.lit("overall"))
    value_col = None                                 # a null slice value stays null, apart from "all"
    for s in slices:
        here = F.col(f"_g_{s}") == 0
        value_col = F.when(here, F.col(s).cast("string")) if value_col is None else value_col.when(here, F.col(s).cast("string"))
    value_col = value_col.otherwise(F.lit("all"))
    return g.select(*ks, name.alias("slice"), value_col.alias("slice_value"), "mean", "total", "n")


# ------------------------------------------------------------------ AGG28 / AGG01

def num_examples(scores: DataFrame, task: str = "task", mode: str = "prompt_mode", doc: str = "doc_id") -> DataFrame:
    """AGG28: the reference counts docs over all prompt modes of a task (``num_examples``);
    the per-mode count is returned next to it."""
    per_task = scores.groupBy(task).agg(F.count_distinct(mode, doc).alias("num_examples"))
    per_mode = scores.groupBy(task, mode).agg(F.count_distinct(doc).alias("num_examples_mode"))
    return equi_join(per_mode, per_task, [task])


# Aggregator kinds the dispatcher knows, with their stderr rule.
AGG_KINDS = {"mean": "analytic", "perplexity": "bootstrap", "weighted_perplexity": "none", "bits_per_byte": "none", "sum": "none",
             "f1": "bootstrap", "mcc": "bootstrap", "median": "bootstrap", "f1_macro": "none", "f1_weighted": "none", "acc_all": "analytic",
             "bleu": "bootstrap_text", "chrf": "bootstrap_text"}
# Kinds that one grouped aggregate can't give, with the columns they read besides the keys.
OWN_JOBS = {"median": (), "f1_macro": ("gold", "pred"), "f1_weighted": ("gold", "pred"), "acc_all": ("paragraph", "question"), "bleu": ("hyp", "refs"), "chrf": ("hyp", "refs")}


def _own_job(rows: DataFrame, by: list[str], kind: str, order: str) -> DataFrame:
    """(by, value, stderr) of the rows of one kind."""
    none = F.lit(None).cast("double").alias("stderr")
    if kind == "median":
        return positional_median(rows, by, "value", order).select(*by, F.col("median").cast("double").alias("value"), none)
    if kind in ("f1_macro", "f1_weighted"):
        return (f1_macro if kind == "f1_macro" else f1_weighted)(rows, by, "gold", "pred").select(*by, F.col(kind).cast("double").alias("value"), none)
    if kind == "acc_all":
        out = acc_all(rows.withColumn("_ok", F.col("value") == 1), by, "paragraph", "question", "_ok")
        return out.select(*by, F.col("acc_all").alias("value"), F.col("acc_all_stderr").alias("stderr"))
    from .textmetrics import corpus_bleu, corpus_chrf
    if kind == "bleu":
        return corpus_bleu(rows, order, "hyp", "refs", by).select(*by, F.col("bleu").alias("value"), none)
    return corpus_chrf(rows.withColumn("_ref", F.get("refs", 0)), order, "hyp", "_ref", by).select(*by, F.col("chrf").alias("value"), none)


def aggregate_scores(scores: DataFrame, kinds: DataFrame, keys=("model", "task", "prompt_mode"), order: str = "doc_id",
                     iters: int = 0, seed: int = 1234) -> DataFrame:
    """AGG01 / AGG20: long scores (keys, metric, value, weight[, gold, pred]) + a (metric,
    kind) dimension -> results (keys, metric, value, stderr, n).  Metrics without a kind are
    skipped (inner join), like metrics without an aggregator in the reference.

    Kinds: mean, sum, perplexity, weighted_perplexity, bits_per_byte; f1 and mcc of binary
    (gold, pred); f1_macro and f1_weighted of their labels; median, the element at position
    n//2 of ``order``; acc_all of ``value`` by (paragraph, question); bleu and chrf of (hyp, refs).
    A kind needs its columns only where ``kinds`` names it.  ``iters`` > 0 adds the bootstrap error
    of the kinds that have one (text metrics at most 1,000 replicates); means and acc_all have
    the analytic error."""
    ks = _keys(keys)
    kinds_side, _ = checked_broadcast(kinds.select("metric", "kind"))
    named = {r[0] for r in kinds.select("kind").filter(F.col("kind").isin(*AGG_KINDS)).distinct().collect()}    # at most AGG_KINDS
    own = [k for k in OWN_JOBS if k in named]
    for k in own:
        if not set(OWN_JOBS[k]) <= set(scores.columns):
            raise ValueError(f"{k} needs the columns {OWN_JOBS[k]}")
    j = scores.join(kinds_side, "metric")
    v = F.col("value").cast("double")
    w = F.coalesce(F.col("weight").cast("double"), F.lit(1.0))
    k = F.first("kind")
    value = (F.when(k == "mean", F.avg(v))
              .when(k == "perplexity", F.exp(-F.avg(v)))
              .when(k == "weighted_perplexity", F.exp(-F.try_divide(F.sum(v), F.sum(w))))
              .when(k == "bits_per_byte", -F.try_divide(F.sum(v), F.sum(w)) / F.lit(math.log(2)))
              .when(k == "sum", F.sum(v)))
    pairs = {"gold", "pred"} <= set(scores.columns)
    if pairs:
        cell = lambda g, p: F.sum(F.when((F.col("gold") == 1) == F.lit(g), F.when((F.col("pred") == 1) == F.lit(p), 1.0).otherwise(0.0)).otherwise(0.0))
        tp, fp, fn, tn = cell(True, True), cell(False, True), cell(True, False), cell(False, False)
        value = (value.when(k == "f1", F.coalesce(F.try_divide(2 * tp, 2 * tp + fp + fn), F.lit(0.0)))
                      .when(k == "mcc", F.coalesce(F.try_divide(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))), F.lit(0.0))))
    stderr = F.when(k == "mean", F.try_divide(F.coalesce(F.stddev_samp(v), F.lit(0.0)), F.sqrt(F.count(v))))
    n = F.when(k.isin("f1", "mcc"), F.count(F.lit(1))).otherwise(F.count(v))
    out = j.filter(~F.col("kind").isin(*OWN_JOBS)).groupBy(*ks, "metric").agg(value.alias("value"), stderr.alias("stderr"), n.alias("n"))
    by = [*ks, "metric"]
    for k in own:
        rows = j.filter(F.col("kind") == k)
        sized = equi_join(_own_job(rows, by, k, order), rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n")), by)
        out = out.unionByName(sized.select(*by, "value", "stderr", "n"))
    if iters > 0 and named & {k for k, rule in AGG_KINDS.items() if rule.startswith("bootstrap")}:
        from .bootstrap import TEXT_METRIC_ITERS, bootstrap_stderr, text_bootstrap
        of = lambda k: j.filter(F.col("kind") == k)
        parts = [bootstrap_stderr(of(k), by, k, iters, seed, order, value="value") for k in ("perplexity", "median") if k in named]
        parts += [bootstrap_stderr(of(k), by, k, iters, seed, order, gold="gold", pred="pred") for k in ("f1", "mcc") if k in named and pairs]
        text = min(iters, TEXT_METRIC_ITERS)
        if "bleu" in named:
            parts.append(text_bootstrap(of("bleu"), by, "bleu", "hyp", "refs", order, text, seed))
        if "chrf" in named:
            parts.append(text_bootstrap(of("chrf").withColumn("_ref", F.get("refs", 0)), by, "chrf", "hyp", "_ref", order, text, seed))
        errors = parts[0]
        for p in parts[1:]:
            errors = errors.unionByName(p)
        out = equi_join(out, errors.select(*by, F.col("stderr").alias("_boot")), by, "left")
        out = out.withColumn("stderr", F.coalesce("stderr", "_boot")).drop("_boot")
    return out.select(*ks, "metric", "value", "stderr", "n")


def assert_disjoint(a: DataFrame, b: DataFrame, keys, raise_on_overlap: bool = False) -> DataFrame:
    """SET06: keys present in both inputs (e.g. train vs test split ids).  Returns the
    overlap (empty when disjoint); optionally raises when it is not."""
    ks = _keys(keys)
    overlap = a.select(*ks).intersect(b.select(*ks))
    if raise_on_overlap and not overlap.isEmpty():
        raise AssertionError(f"inputs share keys {ks}")
    return overlap
